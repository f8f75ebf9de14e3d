"""Tables that a plan reads again and again, written once to the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; on a local master that names none, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (base or tempfile.mkdtemp(prefix="spark-")).rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """The rows of a table in few files over all cores, before work that is dear for each row.

    A file with one row group is read by one task. Tables of at least as many files
    as there are cores stay where they are.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if len(df.inputFiles()) < n else df


def stored(df: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """The rows of df from Parquet files in the folder of ``spark.checkpoint.dir``.

    That folder is shared by the driver and all executors; where it is unset and the
    master is local, as in tests, a temporary folder stands in. Later plans start from
    the files: they stay small, and lost executors cost no more than what came since.

    With a key the files are bucketed by it, into as many buckets as a shuffle has
    partitions or, if that is more, as df has input files. Windows over the key and
    joins on it then read them in place: only the other side of a join moves, which
    matters where the rows are texts. The catalog keeps no table.
    """
    spark = df.sparkSession
    own = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{own}"
    if key is None:
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(df.inputFiles()))
    (
        df.repartition(n, key).write.format("parquet").option("compression", "zstd").option("path", path)
        .bucketBy(n, key).sortBy(key).saveAsTable(own)
    )
    table = spark.table(own)
    table.schema  # noqa: B018 resolved now: it reads its files, which stay when the name goes
    spark.sql(f"DROP TABLE {own}")
    return table
