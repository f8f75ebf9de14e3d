"""The sink with a commit: whole runs or nothing, no row twice."""

import glob

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanforge.sources.results import Writer, manifests, read_results, write_results

SCHEMA = "filing_id long, fiscal_year_end string, status string"


def rows(spark, first, n=40):
    return spark.range(first, first + n, 1, 4).select(F.col("id").alias("filing_id"), F.when(F.col("id") % 5 > 0, F.concat((2000 + F.col("id") % 3).cast("string"), F.lit("-12-31"))).alias("fiscal_year_end"), F.lit("pass").alias("status"))


def ids(df):
    return sorted(r["filing_id"] for r in df.collect())


def test_runs_years_and_overwriting(spark, tmp_path):
    folder = str(tmp_path / "out")
    assert read_results(spark, folder, SCHEMA).count() == 0
    write_results(rows(spark, 0), folder)
    write_results(rows(spark, 100), folder)
    assert ids(read_results(spark, folder, SCHEMA)) == [*range(40), *range(100, 140)]
    assert sum(own["rows"] for m in manifests(folder) for own in m["years"].values()) == 80
    assert ids(read_results(spark, folder, SCHEMA, years=["2001", "none"])) == sorted(i for i in [*range(40), *range(100, 140)] if i % 5 == 0 or i % 3 == 1)
    write_results(rows(spark, 7, 3), folder, mode="overwrite")
    assert ids(read_results(spark, folder, SCHEMA)) == [7, 8, 9]


def test_a_run_that_fails_shows_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    write_results(rows(spark, 0), folder)
    bad = rows(spark, 100).withColumn("status", F.when(F.col("filing_id") == 139, F.raise_error(F.lit("lost"))).otherwise("pass"))
    with pytest.raises(Exception, match="lost"):
        write_results(bad, folder)
    assert ids(read_results(spark, folder, SCHEMA)) == list(range(40)) and len(manifests(folder)) == 1


def test_a_repeated_task_leaves_no_row_twice(spark, tmp_path):
    writer = Writer(str(tmp_path), overwrite=False)
    batch = pa.RecordBatch.from_pylist([{"filing_id": i, "fiscal_year_end": "2020-01-01", "status": "pass"} for i in range(3)])

    def half():
        yield batch
        raise OSError("executor lost")

    with pytest.raises(OSError):
        writer.write(half())
    first = writer.write(iter([batch]))  # reported too late
    second = writer.write(iter([batch]))
    assert first.files != second.files
    writer.commit([second, None])
    assert len(glob.glob(f"{tmp_path}/run=*/*.parquet")) == 3
    assert ids(read_results(spark, str(tmp_path), SCHEMA)) == [0, 1, 2]
