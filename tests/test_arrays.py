"""Line offsets, repeated labels and running sums within a row."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanforge.functions.arrays import BLOCK, repeated, sums_before
from spanforge.functions.text import line_table, some_lines
from spanforge.operators import chrome


@pytest.mark.parametrize("n", [0, 1, BLOCK, BLOCK + 1, BLOCK * BLOCK + 7])
def test_sums_before(spark, n):
    rng = random.Random(n)
    items = [rng.randrange(100) for _ in range(n)]
    df = spark.createDataFrame([(items,)], "a array<int>")
    assert df.select(sums_before(F.col("a"))).first()[0] == [sum(items[:i]) for i in range(n + 1)]


def test_repeated(spark):
    rng = random.Random(5)
    rows = [[rng.choice(["a", "b", "c", "d", None]) for _ in range(rng.randrange(0, 14))] for _ in range(60)]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, a array<string>").select("i", repeated(F.col("a"), 3)).collect()
    for i, flags in got:
        counts = Counter(rows[i])
        assert flags == [x is not None and counts[x] >= 3 for x in rows[i]]


def plain_chrome(text):
    """Start, end and text of the chrome of a text, and what stays; ASCII only."""
    import re

    at, lines = 0, []
    for line in re.split("[\n\f]", text):
        lines.append((at, line))
        at += len(line) + 1

    def label(line):
        s = line.strip()
        if not s or len(s) > 90 or re.match(r"(?i)item\s+\d", s):
            return None
        if re.fullmatch(r"(?i)(page\s+)?\d{1,4}|-\s*\d{1,4}\s*-", s):
            return 0
        if s[-1] in ".!?" and len(s.split()) >= 6:
            return None
        return " ".join(s.split()).lower()

    counts = Counter(label(x) for _, x in lines)
    gone = [(a, a + len(x), x) for a, x in lines if label(x) is not None and counts[label(x)] >= 3]
    out = list(text)
    for a, b, _ in reversed(gone):
        del out[a:b]
    return gone, "".join(out)


def test_chrome_against_a_plain_version(spark):
    rng = random.Random(11)
    kinds = ["ACME Corp", "acme   corp ", "Page 3", "- 4 -", "17", "Item 1. Business", "This is a whole sentence of prose.", "", "x" * 95, "one off %d", "\ttabs\t"]
    texts = []
    for _ in range(80):
        lines = [rng.choice(kinds).replace("%d", str(rng.randrange(50))) for _ in range(rng.randrange(0, 40))]
        texts.append("".join(x + rng.choice("\n\n\n\f") for x in lines))
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "filing_id long, text string")
    got = {r["filing_id"]: r for r in chrome.cut(df).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, text in enumerate(texts):
        gone, kept = plain_chrome(text)
        assert [tuple(h) for h in got[i]["heads"]] == gone and got[i]["text"] == kept


def test_lines_never_leave_the_row(spark):
    df = spark.createDataFrame([(1, "a\nb")], "filing_id long, text string")
    for out in (line_table(df, "\n"), some_lines(df, "\n", lambda x: x == "b"), *chrome.stripped(df)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in some_lines(df, "\n", lambda x: x == "b").collect()] == [(1, 1, 2, "b")]


def test_two_million_lines_take_seconds(spark):
    df = spark.range(1).select(F.lit(1).alias("filing_id"), F.concat(F.repeat(F.lit("a line\n"), 2_000_000), F.lit("mark")).alias("text"))
    began = time.time()
    assert [tuple(r) for r in some_lines(df, "\n", lambda x: x == "mark").collect()] == [(1, 2_000_000, 14_000_000, "mark")]
    assert time.time() - began < 60
