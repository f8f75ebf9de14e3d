"""A data source for folders of raw filings, in batches and as a stream, and a writer of such folders.

    spark.dataSource.register(FilingFiles)
    spark.read.format("filings").load(folder)
    spark.readStream.format("filings").load(folder)

A row is a file: its path, suffix, size, time, bytes and what was wrong with it. The
folder is listed once, where the plan is made; sizes cut the list into partitions of
``partitionBytes``, and a filter on the suffix takes other files off the list before any is opened. A
file that can't be read becomes an error row. A folder that is not there is an error.

As a stream the folder's files come in the order of their times and paths, ``filesPerBatch`` at
most in a batch; the offset is the last one. A file that is put in with a time before that
offset is not seen.
"""

from __future__ import annotations

import gzip
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

SCHEMA = "path string, suffix string, size long, modified timestamp, raw binary, error string"
SUFFIXES = "htm,html,txt,gz"
PARTITION_BYTES = 32 << 20
FILES_PER_BATCH = 1_000


@dataclass(frozen=True, order=True)
class Found:
    """A file of the folder, ordered by its time and path."""

    time_ns: int
    path: str
    size: int

    @property
    def suffix(self) -> str:
        return posixpath.splitext(self.path)[1].lower().removeprefix(".")


@dataclass
class Some(InputPartition):
    files: list[Found]


class Folder:
    """What both readers share: options, the list of files, and reading one of them."""

    def __init__(self, options):
        self.uri = options.get("path") or ""
        self.suffixes = {s.strip() for s in options.get("suffixes", SUFFIXES).split(",")}
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))

    def listed(self) -> list[Found]:
        store, path = fs.FileSystem.from_uri(self.uri)
        kind = store.get_file_info(path).type
        if kind == fs.FileType.NotFound:
            raise FileNotFoundError(f"no such file or folder: {self.uri}")
        every = store.get_file_info(fs.FileSelector(path, recursive=True)) if kind == fs.FileType.Directory else [store.get_file_info(path)]
        own = [Found(i.mtime_ns or 0, i.path, i.size or 0) for i in every if i.type == fs.FileType.File and not posixpath.basename(i.path).startswith((".", "_"))]
        return sorted(f for f in own if f.suffix in self.suffixes)

    def cut(self, files: list[Found]) -> list[Some]:
        """Files in a row up to so many bytes, or one larger file, make a partition."""
        out, size = [], 0
        for f in files:
            if not out or size + f.size > self.most:
                out.append(Some([]))
                size = 0
            out[-1].files.append(f)
            size += f.size
        return out

    def rows(self, partition: Some) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.uri)
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary(), pa.string()]
        for f in partition.files:
            raw = error = None
            try:
                with store.open_input_file(f.path) as opened:
                    raw = opened.read()
            except OSError as e:
                error = f"read: {e.strerror or e}"
            row = (f.path, f.suffix, f.size, f.time_ns // 1000, raw, error)
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)


class Batch(DataSourceReader):
    def __init__(self, options):
        self.folder = Folder(options)

    def pushFilters(self, filters):
        """Suffixes that are asked for; all other filters stay with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("suffix",):
                self.folder.suffixes &= {f.value} if isinstance(f, EqualTo) else set(f.value)
            else:
                yield f

    def partitions(self):
        return self.folder.cut(self.folder.listed()) or [Some([])]

    def read(self, partition):
        return self.folder.rows(partition)


class Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.folder = Folder(options)
        self.most = int(options.get("filesPerBatch", FILES_PER_BATCH))
        self.at = None

    def _behind(self, start: dict) -> list[Found]:
        return [f for f in self.folder.listed() if (f.time_ns, f.path) > (start["time_ns"], start["path"])]

    def initialOffset(self):
        return {"time_ns": -1, "path": ""}

    def latestOffset(self):
        ahead = self._behind(self.at or self.initialOffset())[: self.most]
        if ahead:
            self.at = {"time_ns": ahead[-1].time_ns, "path": ahead[-1].path}
        return self.at or self.initialOffset()

    def partitions(self, start, end):
        self.at = max(self.at or end, end, key=lambda o: (o["time_ns"], o["path"]))  # also where a query goes on from its checkpoint
        return self.folder.cut([f for f in self._behind(start) if (f.time_ns, f.path) <= (end["time_ns"], end["path"])]) or [Some([])]

    def read(self, partition):
        return self.folder.rows(partition)


class FilingFiles(DataSource):
    @classmethod
    def name(cls):
        return "filings"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Batch(self.options)

    def streamReader(self, schema):
        return Stream(self.options)


def registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FilingFiles)
    return spark


def read_folder(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The files of a folder as ``SCHEMA`` has them."""
    return registered(spark).read.format("filings").options(**options).load(folder)


def read_folder_stream(spark: SparkSession, folder: str, **options) -> DataFrame:
    return registered(spark).readStream.format("filings").options(**options).load(folder)


def write_folder(filings: DataFrame, folder: str) -> int:
    """Write filings(name, raw), one file each, and return how many. Names that end in .gz are packed.

    A file is written beside its name and moved there whole, so that a task that runs again replaces what it wrote.
    """
    def run(batches):
        n = 0
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_output_stream(f"{path}/.{name}.part", compression=None) as out:
                    out.write(gzip.compress(raw, mtime=0) if name.endswith(".gz") else raw)
                store.move(f"{path}/.{name}.part", f"{path}/{name}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return filings.select("name", F.col("raw").cast("binary")).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
