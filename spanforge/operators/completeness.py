"""Token conservation: no visible word of the source may be lost or made up.

Each text is summed up in its row as the number of its tokens and the sums of four
32-bit hashes of them. Such sums add up over texts and do not depend on the order, so
two sets of texts with equal sums hold the same tokens. Only filings whose sums differ
bring their texts together, and what differs is told in the row of the filing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.arrays import let
from spanforge.functions.text import tokens
from spanforge.sources.shared import stored

EXAMPLES, SHOWN = 50, 10
SUMS = ["n", "a", "b", "c", "d"]


def fingerprint(text: Column) -> Column:
    """The sums of a text as a struct of ``SUMS``; 32 bits at a time, so that two billion tokens do not overflow."""
    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in SUMS])

    def added(acc: Column, token: Column) -> Column:
        one, two = F.xxhash64(token), F.xxhash64(F.lit(1), token)
        parts = [F.lit(1), *[p for h in (one, two) for p in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]]
        return F.struct(*[(acc[n] + p).cast("long").alias(n) for n, p in zip(SUMS, parts)])

    return F.aggregate(tokens(text), zero, added)


def fingerprints(texts: DataFrame, suffix: str) -> DataFrame:
    """filing_id and the sums over one or more texts per filing; a row of numbers per text is all that moves."""
    each = texts.select("filing_id", fingerprint(F.col("text")).alias("f"))
    return each.groupBy("filing_id").agg(*[F.sum(f"f.{n}").alias(f"{n}_{suffix}") for n in SUMS])


#: Equal tokens in a row, in lines of sorted tokens; no token holds a line feed.
RUN = r"(?d)(?m)^(.+)$(?:\n\1$)*+"


def _runs(words: Column) -> Column:
    """The different tokens of an array, each as often as it stands there, in lines of one text."""
    return F.regexp_extract_all(F.array_join(F.sort_array(words), "\n"), F.lit(RUN), F.lit(0))


def _listed(words: Column, differing: Column) -> Column:
    """The tokens that differ by where they first stand among the words, each as often as it differs; ``EXAMPLES`` at most."""
    first = F.slice(F.array_intersect(words, F.transform(differing, lambda x: x["token"])), 1, EXAMPLES)
    times = lambda t: F.least(F.get(F.filter(differing, lambda x: x["token"] == t), F.lit(0))["n"], F.lit(EXAMPLES)).cast("int")
    return F.slice(F.flatten(F.transform(first, lambda t: F.array_repeat(t, times(t)))), 1, EXAMPLES)


def compared(rows: DataFrame) -> DataFrame:
    """What ``conservation`` gives, of rows(filing_id, want, have) with the texts of a filing on both sides as arrays.

    All of it stays in the row, and no token becomes a row of its own: sorted tokens fall into runs, the runs
    that only one side has are few, and neighbours among those, once sorted, say how often a token differs.
    """
    words = lambda c: F.flatten(F.transform(F.filter(c, lambda t: t.isNotNull()), tokens))
    told = rows.select("filing_id", *[words(c).alias(c) for c in ("want", "have")])
    runs = told.select("*", *[_runs(F.col(c)).alias(f"{c}_runs") for c in ("want", "have")])

    def only(own: str, other: str, sign: int) -> Column:
        def counted(run: Column) -> Column:
            return let(F.substring_index(run, "\n", 1), lambda t: F.struct(t.alias("token"), F.lit(sign).alias("sign"), F.floor((F.length(run) + 1) / (F.length(t) + 1)).cast("long").alias("n")))

        return F.transform(F.array_except(own, other), counted)

    def balance(s: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            # the two sides of a token are neighbours: the first of them tells for both
            paired = lambda j: F.coalesce(F.get(s, j)["token"] == x["token"], F.lit(False))
            other = F.when(paired(i + 1), F.get(s, i + 1)["n"] * F.get(s, i + 1)["sign"]).otherwise(F.lit(0).cast("long"))
            return F.struct(x["token"].alias("token"), F.when(paired(i - 1), F.lit(0).cast("long")).otherwise(x["n"] * x["sign"] + other).alias("n"))

        return F.transform(s, one)

    differing = runs.select("filing_id", "want", "have", F.sort_array(F.concat(only("want_runs", "have_runs", 1), only("have_runs", "want_runs", -1))).alias("d"))
    netted = differing.select("filing_id", "want", "have", let(F.col("d"), balance).alias("d"))
    apart = netted.select("filing_id", "want", "have", F.filter("d", lambda x: x["n"] > 0).alias("missing"), F.transform(F.filter("d", lambda x: x["n"] < 0), lambda x: F.struct(x["token"].alias("token"), (-x["n"]).alias("n"))).alias("extra"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    size = lambda c: F.size(c).cast("long")
    return apart.select(
        "filing_id", ((F.size("missing") == 0) & (F.size("extra") == 0)).alias("passed"), size("want").alias("n_source"), size("have").alias("n_accounted"),
        total("missing").alias("n_missing"), total("extra").alias("n_extra"),
        _listed(F.col("want"), F.col("missing")).alias("missing_examples"), _listed(F.col("have"), F.col("extra")).alias("extra_examples"),
    )


def gathered(texts: DataFrame, name: str) -> DataFrame:
    """filing_id, name: the texts of each filing of texts(filing_id, part, text) as an array, by part."""
    return texts.groupBy("filing_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]).alias(name))


def conservation(filings: DataFrame, baseline: DataFrame, ruler: DataFrame, visible_ledger: DataFrame) -> DataFrame:
    """filing_id, passed, n_source, n_accounted, n_missing, n_extra, missing_examples, extra_examples.

    Ruler and visible ledger entries are added up (entries are tokenized one by
    one) and compared with the baseline. Examples come in the order in which their tokens
    first stand in the source, or in the ruler and then the ledger; ``EXAMPLES`` at most.
    """
    at = F.col("start") if "start" in visible_ledger.columns else F.lit(0)
    own = ruler.select("filing_id", F.lit(-1).alias("part"), "text").unionByName(visible_ledger.select("filing_id", at.cast("int").alias("part"), "text"))
    want, have = fingerprints(baseline, "want"), fingerprints(own, "have")
    both = filings.select("filing_id").join(want, "filing_id", "left").join(have, "filing_id", "left").na.fill(0)
    both = stored(both.select("filing_id", "n_want", "n_have", (F.array(*[f"{n}_want" for n in SUMS]) == F.array(*[f"{n}_have" for n in SUMS])).alias("passed")), "balances")
    unequal = both.where("not passed").select("filing_id")
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    sums = ["filing_id", "passed", F.col("n_want").alias("n_source"), F.col("n_have").alias("n_accounted")]
    if unequal.isEmpty():  # nearly always: no token needs to be looked at
        return both.select(*sums, zero.alias("n_missing"), zero.alias("n_extra"), none.alias("missing_examples"), none.alias("extra_examples"))
    sides = [gathered(x.join(unequal, "filing_id", "left_semi"), n) for x, n in ((baseline.select("filing_id", F.lit(0).alias("part"), "text"), "want"), (own, "have"))]
    found = compared(unequal.join(sides[0], "filing_id", "left").join(sides[1], "filing_id", "left").select("filing_id", *[F.coalesce(n, none).alias(n) for n in ("want", "have")]))
    per = found.select("filing_id", "n_missing", "n_extra", "missing_examples", "extra_examples")
    return both.join(per, "filing_id", "left").select(
        *sums, *[F.coalesce(n, zero).alias(n) for n in ("n_missing", "n_extra")],
        *[F.coalesce(n, none).alias(n) for n in ("missing_examples", "extra_examples")],
    )
