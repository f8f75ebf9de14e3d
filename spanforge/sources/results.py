"""A sink that publishes whole runs, and a reader that sees nothing else.

    rows.write.format("filing_results").mode("append").save(folder)
    read_results(spark, folder, years=["2023"])

Each task writes files of its own, by fiscal year, and reports which and how many rows they
hold. When all have reported, the driver publishes one manifest, moved into place whole. A
task that failed or ran twice leaves files that no manifest names, so no row is read twice or
from half a run. Mode ``overwrite`` makes all earlier manifests void, at the moment its own is there.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

YEAR = "fiscal_year_end"
#: The year of rows without a date.
UNDATED = "none"


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: (file, year, rows)."""

    files: list[tuple[str, str, int]]


class Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.run = folder, overwrite, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        store, path = fs.FileSystem.from_uri(self.folder)
        store.create_dir(f"{path}/run={self.run}", recursive=True)
        own, open_ = uuid.uuid4().hex, {}
        try:
            for batch in iterator:
                table = pa.Table.from_batches([batch])
                dates = table[YEAR].cast(pa.string()) if YEAR in table.column_names else pa.nulls(table.num_rows, pa.string())
                years = pc.fill_null(pc.utf8_slice_codeunits(dates, 0, 4), UNDATED)
                for year in pc.unique(years).to_pylist():
                    if year not in open_:
                        name = f"run={self.run}/{year}-{own}.parquet"
                        open_[year] = [name, pq.ParquetWriter(f"{path}/{name}", table.schema, filesystem=store, compression="zstd"), 0]
                    some = table.filter(pc.equal(years, year))
                    open_[year][1].write_table(some)
                    open_[year][2] += some.num_rows
        finally:
            for _, writer, _ in open_.values():
                writer.close()
        return Written([(name, year, n) for year, (name, _, n) in open_.items()])

    def commit(self, messages) -> None:
        store, path = fs.FileSystem.from_uri(self.folder)
        years: dict[str, dict] = {}
        for name, year, n in (f for m in messages if m for f in m.files):
            own = years.setdefault(year, {"files": [], "rows": 0})
            own["files"].append(name)
            own["rows"] += n
        store.create_dir(f"{path}/_manifests", recursive=True)
        with store.open_output_stream(f"{path}/_manifests/.{self.run}") as out:
            out.write(json.dumps({"run": self.run, "overwrite": self.overwrite, "years": years}).encode())
        store.move(f"{path}/_manifests/.{self.run}", f"{path}/_manifests/{time.time_ns():020d}-{self.run}.json")

    def abort(self, messages) -> None:
        store, path = fs.FileSystem.from_uri(self.folder)
        for name, _, _ in (f for m in messages if m for f in m.files):
            store.delete_file(f"{path}/{name}")


class FilingResults(DataSource):
    @classmethod
    def name(cls):
        return "filing_results"

    def writer(self, schema, overwrite):
        return Writer(self.options["path"], overwrite)


def manifests(folder: str) -> list[dict]:
    """The manifests that hold, oldest first."""
    store, path = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(f"{path}/_manifests", allow_not_found=True))
    out: list[dict] = []
    for name in sorted(i.path for i in found if i.path.endswith(".json")):
        with store.open_input_stream(name) as opened:
            told = json.loads(opened.read())
        out = [told] if told["overwrite"] else [*out, told]
    return out


def write_results(rows: DataFrame, folder: str, mode: str = "append") -> None:
    rows.sparkSession.dataSource.register(FilingResults)
    rows.write.format("filing_results").mode(mode).save(folder)


def read_results(spark: SparkSession, folder: str, schema, years: list[str] | None = None) -> DataFrame:
    """The rows of all published runs, of some fiscal years or all; none is an empty table."""
    names = [f"{folder}/{f}" for m in manifests(folder) for y, own in m["years"].items() if years is None or y in years for f in own["files"]]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
