"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names: for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanforge.llm import decontaminate, linededup, lm, packing, pii, quality, simhash, substrdedup, tokenids, toxicity
from spanforge.llm.common import shared_path
from spanforge.llm.queries import queries
from tests.helpers import SF

CLASH = ["d", "th", "m", "a", "fp", "key", "part", "rank", "row", "c0", "ids", "length", "score", "offset", "_sf_text", "t", "spans", "base", "x", "n", "bucket", "g"]
ROWS = [
    (None, "text without an id and with some words in it", "en", "src0"),
    (None, None, None, None),
    (1, None, "en", None),
    (2, "", None, "src0"),
    (3, " \n\t\n  ", "en", "src0"),
    (4, "one", "en", "src0"),
    (4, "one", "en", "src0"),
    (4, "another text with the same id", "de", "src1"),
    (5, "word " * 60_000, "en", "src0"),
    (6, "x" * 200_000, "en", "src0"),
    (7, "1" * 30_000 + " " + "1 " * 9_000 + "@" * 500 + "a." * 3_000, "en", "src0"),
    (8, "a\nb\nc\nd\na\nb\nc", "en", "src0"),
    (9, "﻿́é \U0001f600   \x1c\x85 <|endoftext|> it's İ ﬁ", "fr", "src0"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *[F.lit(1).alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def sides(spark):
    benchmark = spark.createDataFrame([(1, "one"), (2, None), (None, "word " * 20), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(5, None, 1), (4, 1, None), (None, 0, 1), (8, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    return benchmark, labels


def _token_ids(spark, docs, benchmark, labels):
    path = shared_path(spark, "ids")
    tokenids.write_token_ids(docs, path, tokenids.tokenizer_path(), 2)
    return tokenids.token_digest(spark, path)


OPERATORS = {
    "packing": lambda s, d, b, y: packing.pack(d, tokenids.tokenizer_path()).where("piece = 0"),
    "decontamination": lambda s, d, b, y: decontaminate.judge(d, b),
    "decontamination by join": lambda s, d, b, y: decontaminate.judge(d, b, max_windows=0),
    "token ids": _token_ids,
    "line dedup": lambda s, d, b, y: linededup.line_digest(d),
    "substring dedup": lambda s, d, b, y: substrdedup.digest(d),
    "toxicity": lambda s, d, b, y: toxicity.score(d, toxicity.train(d, y)),
    "near-duplicates": lambda s, d, b, y: simhash.near_duplicates(d),
    "language model": lambda s, d, b, y: lm.perplexity(d, lm.train(d)),
    "personal data": lambda s, d, b, y: pii.digest(d),
    "quality": lambda s, d, b, y: quality.judge(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each(spark, docs, sides, name):
    got = OPERATORS[name](spark, docs, *sides).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, docs, sides, name):
    benchmark, labels = sides
    assert OPERATORS[name](spark, docs.where("false"), benchmark.where("false"), labels.where("false")).collect() == []


@pytest.mark.parametrize("rows", ["all", "none"])
def test_stages(spark, docs, tmp_path, sides, rows):
    sides[0].write.parquet(str(tmp_path / "benchmark.parquet"))
    sides[1].write.parquet(str(tmp_path / "labels.parquet"))
    df = docs if rows == "all" else docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        if name != "packing":
            assert out.columns == df.columns and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
        path = shared_path(spark, "stage")
        out.write.parquet(path)
        df = spark.read.parquet(path)
    if rows == "none":
        assert df.count() == 0


def test_registered():
    assert [int(n[2:].split("_")[0]) for n in queries()] == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near-duplicates", "decontamination", "packing"]


def test_pipeline_on_a_table(spark):
    out = corpus_pipeline.run(spark, SF)
    ends = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert ends.where("n <> end or n > 2048").isEmpty() and out.count() > 0
