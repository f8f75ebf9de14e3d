"""The data source for folders of filings."""

import gzip
import os
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spanforge.sources import filings
from spanforge.sources.files import Found, Folder, read_folder, read_folder_stream, write_folder


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.htm").write_text("<html>A</html>")
    (tmp_path / "sub" / "b.TXT").write_text("plain")
    (tmp_path / "sub" / "c.txt.gz").write_bytes(gzip.compress(b"packed"))
    (tmp_path / "broken.gz").write_bytes(b"\x1f\x8bno more")
    (tmp_path / "other.pdf").write_bytes(b"%PDF")
    (tmp_path / ".hidden.htm").write_text("no")
    return str(tmp_path)


def test_files_sizes_and_error_rows(spark, folder):
    rows = {os.path.basename(r["path"]): r for r in read_folder(spark, folder).collect()}
    assert sorted(rows) == ["a.htm", "b.TXT", "broken.gz", "c.txt.gz"]
    assert rows["a.htm"]["size"] == 14 and rows["b.TXT"]["suffix"] == "txt" and bytes(rows["b.TXT"]["raw"]) == b"plain"
    df = read_folder(spark, folder).select(F.col("path").alias("filing_id"), "raw")
    good, bad = filings.quarantined(filings.unpacked(df))
    assert {bytes(r["raw"]) for r in good.collect()} == {b"<html>A</html>", b"plain", b"packed"}
    assert [os.path.basename(r["filing_id"]) for r in bad.collect()] == ["broken.gz"]


def test_a_file_that_cannot_be_read_is_an_error_row(folder):
    whole = Folder({"path": folder})
    (batch,) = whole.rows(whole.cut([Found(0, f"{folder}/gone.htm", 3)])[0])
    assert batch.column(4)[0].as_py() is None and batch.column(5)[0].as_py().startswith("read: ")


def test_partitions_follow_sizes(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"{i}.txt").write_bytes(b"x" * 1000)
    (tmp_path / "big.txt").write_bytes(b"x" * 9000)
    df = read_folder(spark, str(tmp_path), partitionBytes=4000)
    assert 6 <= df.rdd.getNumPartitions() <= 8 and df.agg(F.sum(F.length("raw"))).first()[0] == 29_000


def test_suffixes_are_pushed_down(spark, folder):
    df = read_folder(spark, folder).where("suffix = 'htm' and size > 3")
    assert [os.path.basename(r["path"]) for r in df.collect()] == ["a.htm"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    kept = plan.split("Filter")[1].split("\n")[0]
    assert "= htm" not in kept and "> 3" in kept


def test_missing_and_empty_folders(spark, tmp_path):
    with pytest.raises(PySparkException, match="no such file or folder"):
        read_folder(spark, f"{tmp_path}/none").collect()
    assert read_folder(spark, str(tmp_path)).collect() == []


def test_one_file_and_what_was_written(spark, tmp_path):
    out = f"{tmp_path}/made"
    df = spark.createDataFrame([("x.htm", b"<p>"), ("y.txt.gz", b"text")], "name string, raw binary")
    assert write_folder(df, out) == 2 and write_folder(df, out) == 2
    assert sorted(os.listdir(out)) == ["x.htm", "y.txt.gz"] and gzip.open(f"{out}/y.txt.gz").read() == b"text"
    assert read_folder(spark, f"{out}/x.htm").count() == 1


def test_a_stream_sees_each_file_once_and_goes_on_after_a_restart(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def put(*names):
        for n in names:
            (source / n).write_text(n)
            time.sleep(0.02)

    def run():
        df = read_folder_stream(spark, str(source), filesPerBatch=2).select("path", F.col("raw").cast("string").alias("text"))
        query = df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).start(str(sink))
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(r["text"] for r in spark.read.schema("path string, text string").parquet(str(sink)).collect())

    put("1.htm", "2.txt", "3.htm")
    assert run() == ["1.htm", "2.txt", "3.htm"]
    put("4.htm", "x.pdf", "5.txt")
    assert run() == ["1.htm", "2.txt", "3.htm", "4.htm", "5.txt"]
