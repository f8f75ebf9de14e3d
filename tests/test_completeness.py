"""Token conservation: what balances never reaches a join, and what does not is told whole."""

import random
from collections import Counter

from pyspark.sql import functions as F

from spanforge.operators import completeness


def test_lost_and_made_up_tokens(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["3.5", "a-b", "Über"]
    rows = []
    for i in range(60):
        source = [rng.choice(words) for _ in range(rng.randrange(0, 120))]
        kept, head = source[10:], source[:10]
        if i % 3 == 1 and kept:
            kept = kept[1:] + ["made", "up"]
        if i % 3 == 2:
            kept = sorted(kept)
        rows.append((i, " ".join(source), " ".join(kept), " ".join(head)))
    df = spark.createDataFrame([*rows, (99, "", "", ""), (98, None, None, None), (97, "all lost " * 40, None, None)], "filing_id int, source string, kept string, head string")
    text = lambda c: df.select("filing_id", F.col(c).alias("text"))
    got = {r["filing_id"]: r for r in completeness.conservation(df, text("source"), text("kept"), text("head").withColumn("start", F.lit(0))).collect()}
    assert len(got) == 63
    for i, source, kept, head in rows:
        want, have = Counter(source.lower().split()), Counter((kept + " " + head).lower().split())
        missing, extra = want - have, have - want
        r = got[i]
        assert (r["passed"], r["n_source"], r["n_accounted"], r["n_missing"], r["n_extra"]) == (not missing and not extra, want.total(), have.total(), missing.total(), extra.total())
        assert r["missing_examples"] == [t for t, n in missing.items() for _ in range(n)][:50]
        assert r["extra_examples"] == [t for t, n in extra.items() for _ in range(n)][:50]
    assert sum(not r["passed"] for r in got.values()) >= 15
    assert got[99]["passed"] and got[98]["passed"] and got[98]["n_source"] == 0
    assert got[97]["n_missing"] == 80 and got[97]["missing_examples"] == ["all"] * 40 + ["lost"] * 10


def test_what_moves_is_a_row_of_numbers(spark):
    df = spark.createDataFrame([(1, "some words")], "filing_id int, text string")
    plan = completeness.fingerprints(df, "x")._jdf.queryExecution().executedPlan().toString()
    exchange = next(line for line in plan.split("\n") if "Exchange" in line)
    assert "text" not in exchange and plan.count("Exchange hashpartitioning") == 1


def test_sums_of_many_tokens_stay_exact(spark):
    row = spark.range(1).select(completeness.fingerprint(F.repeat(F.lit("token "), 200_000)).alias("f"), completeness.fingerprint(F.lit("token")).alias("one")).first()
    assert [x for x in row["f"]] == [200_000 * x for x in row["one"]]
