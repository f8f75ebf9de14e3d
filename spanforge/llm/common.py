"""Shared plumbing: tables, the shared folder, text columns in Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

TEXT = "_sf_text"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its plain name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share.

    The session names that folder in ``spark.checkpoint.dir``. Only where it is
    unset and the master is local, as in tests, a temporary folder stands in for
    it: executors of a cluster would each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's own setting: the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again.

    This cuts the lineage: work done so far survives the loss of executors, and
    what follows plans with the written size. As the files take the place of the
    shuffles behind them, those are removed when all is written.
    """
    spark = df.sparkSession
    path, before = shared_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of a table that ``stored`` wrote, when all that is made from them is stored itself."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.search(r"-[0-9a-f]{32}$", folder):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches, at: int, most: int = 4 << 20, rows: int = 2_000):
    """Parts of the batches with at most so many rows, and bytes in column ``at`` (or one row), and their texts."""
    for batch in batches:
        column = batch.column(at).cast(pa.binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = min(max(first + 1, int(np.searchsorted(ends, before + most, side="right"))), first + rows, batch.num_rows)
            yield batch.slice(first, last - first), column.slice(first, last - first).to_pylist()
            first = last


def map_text(
    df: DataFrame,
    text_col: str,
    keep: Iterable[str],
    fields: list[StructField],
    make: Callable[[], Callable[[list[bytes | None]], list]],
) -> DataFrame:
    """The columns `keep` of every row, and the columns `fields` made from its text.

    ``make`` runs once in each task and returns a function from the UTF-8 texts
    of an Arrow batch (None for null) to one array for each field.
    """
    keep = list(keep)
    source = df.select(*[col(c) for c in keep], col(text_col).cast("string").alias(TEXT))
    schema = StructType(list(source.schema)[:-1] + fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        f = make()
        for batch, texts in slices(batches, len(keep)):
            made = f(texts)
            own = [batch.column(i) for i in range(batch.num_columns - 1)]
            made = [x if isinstance(x, pa.Array) else pa.array(x, arrow.field(len(own) + i).type) for i, x in enumerate(made)]
            own = [x if x.type == arrow.field(i).type else x.cast(arrow.field(i).type) for i, x in enumerate(own)]
            yield pa.RecordBatch.from_arrays(own + made, names=arrow.names)

    return source.mapInArrow(run, schema)


def filter_text(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[bytes | None]], list[bool]]]) -> DataFrame:
    """The rows of df, all columns, whose text the function made by ``make`` keeps."""
    schema, names = df.schema, df.columns
    at = names.index(text_col)

    def run(batches):
        f = make()
        for batch, texts in slices(batches, at):
            yield batch.filter(pa.array(f(texts), pa.bool_()))

    return df.mapInArrow(run, schema)


def fold_of(doc_id: str = "doc_id") -> Column:
    """The fold 0 to 4 of a document: crc32 of its id as text, modulo 5."""
    return F.coalesce(F.crc32(col(doc_id).cast("string").cast("binary")), F.lit(0)) % 5
