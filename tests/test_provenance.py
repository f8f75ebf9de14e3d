"""Places in the source by bisection in the row, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from spanforge.operators import provenance


def filing(rng):
    """Stretches that follow each other, some injected, and cuts within them."""
    at, source, stretches = 0, 0, []
    for _ in range(rng.randrange(0, 40)):
        source += rng.randrange(0, 9)
        if rng.random() < 0.3:
            stretches.append((at, at + 1, source, source, "injected"))
            at += 1
        else:
            size = rng.randrange(1, 12)
            stretches.append((at, at + size, source, source + size, "dom_text"))
            at, source = at + size, source + size
    places = sorted(rng.sample(range(at + 1), min(at + 1, 2 * rng.randrange(0, 6))))
    cuts = [(a, b) for a, b in zip(places[::2], places[1::2]) if a < b]
    return stretches, cuts, at


def plain_excision(stretches, cuts, size):
    out, edges, gone = [], [], 0
    for (_, e), (s, _) in zip([(0, 0), *cuts], [*cuts, (size, size)]):
        edges.append((e, s, e - gone - (sum(b - a for a, b in cuts if b <= e) - gone)))
    for s, e, ss, se, kind in stretches:
        for a, b, new in edges:
            x, y = max(s, a), min(e, b)
            if x < y:
                point = se <= ss
                out.append((new + x - a, new + y - a, ss if point else ss + x - s, ss if point else min(ss + y - s, se), kind))
    return out


def plain_source(start, end, stretches):
    first = max(((s, ss + start - s, kind) for s, e, ss, _, kind in stretches if s <= start <= e), default=None)
    last = max(((s, ss + end - s) for s, e, ss, _, _ in stretches if s < end <= e), default=None)
    if first is None:
        return None, None, None
    return first[2], first[1], max(last[1] if last else first[1], first[1])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    return [filing(rng) for _ in range(150)]


def frames(spark, corpus):
    st = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(corpus)], f"filing_id int, stretches {provenance.STRETCHES}")
    heads = spark.createDataFrame([(i, [(a, b, "x") for a, b in c]) for i, (_, c, _) in enumerate(corpus) if i % 7], "filing_id int, heads array<struct<start:int,end:int,text:string>>")
    return st, heads


def test_excision(spark, corpus):
    st, heads = frames(spark, corpus)
    got = {r["filing_id"]: [tuple(x) for x in r["stretches"]] for r in provenance.after_excision(st, heads).collect()}
    for i, (stretches, cuts, size) in enumerate(corpus):
        assert got[i] == plain_excision(stretches, cuts if i % 7 else [], size)


def test_source_of_spans(spark, corpus):
    st, _ = frames(spark, corpus)
    rng = random.Random(1)
    spans = [(i, k, *sorted(rng.randrange(0, size + 4) for _ in "ab")) for i, (_, _, size) in enumerate([*corpus, ([], [], 5)]) for k in range(6)]
    df = spark.createDataFrame(spans, "filing_id int, k int, start int, end int")
    rows = provenance.source_of(df, st).collect()
    assert len(rows) == len(spans)
    for r in rows:
        stretches = corpus[r["filing_id"]][0] if r["filing_id"] < len(corpus) else []
        assert (r["source_kind"], r["source_start"], r["source_end"]) == plain_source(r["start"], r["end"], stretches), r


def test_bisection(spark):
    df = spark.createDataFrame([([1, 3, 3, 7], x) for x in range(9)], "a array<int>, x int")
    got = df.select("x", provenance.below(F.col("a"), F.col("x")), provenance.below(F.col("a"), F.col("x"), True)).collect()
    assert [tuple(r) for r in got] == [(x, sum(v < x for v in [1, 3, 3, 7]), sum(v <= x for v in [1, 3, 3, 7])) for x in range(9)]


def test_no_stretch_is_a_row(spark, corpus):
    st, heads = frames(spark, corpus)
    plan = provenance.after_excision(st, heads)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
