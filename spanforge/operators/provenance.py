"""Where each stretch of the ruler comes from in the source.

The stretches of a filing are one sorted array in its row. What is looked up in it, by
bisection, are the ends of spans and the places that excision cut out; so no
stretch is ever a row of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.arrays import let, sums_before
from spanforge.functions.text import lengths

STRETCHES = "array<struct<start:int,end:int,source_start:int,source_end:int,kind:string>>"
#: Arrays to look things up in have fewer elements than two to this power.
BITS = 30


def below(ordered: Column, x: Column, with_equal: bool = False) -> Column:
    """How many elements of an ascending array are below x, or not above it: bisection from the largest step down."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(BITS))])

    def further(at: Column, step: Column) -> Column:
        seen = F.get(ordered, at + step - 1)
        return F.when((at + step <= F.size(ordered)) & (seen <= x if with_equal else seen < x), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


def stretches(spans: Column | str) -> Column:
    """The spans of the walk as stretches."""
    one = lambda s: F.struct(s["ruler_start"].alias("start"), s["ruler_end"].alias("end"), s["source_start"], s["source_end"], s["kind"])
    return F.transform(spans, one).cast(STRETCHES)


def segments(walked: DataFrame) -> DataFrame:
    """filing_id, stretches of walked filings, as the walk made them."""
    return walked.select("filing_id", stretches("spans").alias("stretches"))


def whole(texts: DataFrame) -> DataFrame:
    """filing_id, stretches of plain texts: each is one stretch."""
    size = F.col("length")
    return lengths(texts).select("filing_id", F.array(F.struct(F.lit(0).alias("start"), size.alias("end"), F.lit(0).alias("source_start"), size.alias("source_end"), F.lit("raw_byte").alias("kind"))).cast(STRETCHES).alias("stretches"))


def rows(stretches: DataFrame) -> DataFrame:
    """filing_id, start, end, source_start, source_end, kind: one row per stretch, for reports."""
    return stretches.select("filing_id", F.inline("stretches"))


def gathered(each: DataFrame) -> DataFrame:
    """filing_id, stretches of stretches that are rows."""
    own = F.struct("start", "end", "source_start", "source_end", "kind")
    return each.groupBy("filing_id").agg(F.array_sort(F.collect_list(own)).cast(STRETCHES).alias("stretches"))


def _shortened(stretches: Column, cuts: Column) -> Column:
    """The stretches in the offsets of the text without its cuts (start, end): cut where those are, and moved."""
    def moved(starts: Column, ends: Column, gone: Column) -> Column:
        def pieces(x: Column) -> Column:
            # stay k lies between cut k - 1 and cut k; these are the first and the last that x touches
            first, last = below(starts, x["start"], with_equal=True), below(ends, x["end"])

            def piece(k: Column) -> Column:
                a = F.greatest(x["start"], F.coalesce(F.get(ends, k - 1), F.lit(0)))
                b = F.least(x["end"], F.get(starts, k))
                point = x["source_end"] <= x["source_start"]
                s = F.when(point, x["source_start"]).otherwise(x["source_start"] + a - x["start"])
                e = F.when(point, x["source_start"]).otherwise(F.least(x["source_start"] + b - x["start"], x["source_end"]))
                return F.struct((a - F.get(gone, k)).alias("start"), (b - F.get(gone, k)).alias("end"), s.alias("source_start"), e.alias("source_end"), x["kind"].alias("kind"))

            ends_of = F.struct(first.alias("first"), last.alias("last"))
            touched = lambda r: F.when(r["first"] <= r["last"], F.transform(F.sequence(r["first"], r["last"]), piece))
            return F.filter(F.coalesce(let(ends_of, touched), F.array().cast(STRETCHES)), lambda p: p["start"] < p["end"])

        return F.flatten(F.transform(stretches, pieces))

    def bound(c: Column) -> Column:
        starts, ends = F.transform(c, lambda x: x["start"]), F.transform(c, lambda x: x["end"])
        gone = sums_before(F.transform(c, lambda x: x["end"] - x["start"]))
        return let(starts, lambda s: let(ends, lambda e: let(gone, lambda g: moved(s, e, g))))

    return let(F.filter(cuts, lambda x: x["start"] < x["end"]), bound)


def shortened(both: DataFrame) -> DataFrame:
    """filing_id, stretches in the offsets of the ruler, of both(filing_id, stretches, heads)."""
    cuts = F.coalesce("heads", F.array().cast("array<struct<start:int,end:int,text:string>>"))
    return both.select("filing_id", let(F.col("stretches"), lambda s: _shortened(s, cuts)).cast(STRETCHES).alias("stretches"))


def after_excision(stretches: DataFrame, found: DataFrame) -> DataFrame:
    """filing_id, stretches in the offsets of the ruler. found(filing_id, heads): what was cut out, in order."""
    return shortened(stretches.join(found.select("filing_id", "heads"), "filing_id", "left"))


def source_of(spans: DataFrame, stretches: DataFrame) -> DataFrame:
    """spans(filing_id, start, end, ...) with source_kind, source_start and source_end.

    The start belongs to the last stretch that holds it, the end to the last one
    that reaches it; within a stretch offsets are linear. No start: all null; no
    end: the end is the start.
    """
    names = [c for c in spans.columns if c != "filing_id"]
    per = spans.groupBy("filing_id").agg(F.collect_list(F.struct(*names)).alias("own"))
    both = per.join(stretches, "filing_id", "left").withColumn("stretches", F.coalesce("stretches", F.array().cast(STRETCHES)))

    def placed(known: Column) -> Column:
        def found(starts: Column) -> Column:
            def one(x: Column) -> Column:
                def at(place: Column, with_equal: bool) -> Column:
                    last = F.get(known, below(starts, place, with_equal) - 1)
                    return let(last, lambda s: F.when(place <= s["end"], F.struct(s["kind"].alias("kind"), (s["source_start"] + place - s["start"]).alias("at"))))

                def told(a: Column) -> Column:
                    end = let(at(x["end"], False), lambda b: F.when(a.isNotNull(), F.greatest(F.coalesce(b["at"], a["at"]), a["at"])))
                    return F.struct(*[x[n].alias(n) for n in names], a["kind"].alias("source_kind"), a["at"].alias("source_start"), end.alias("source_end"))

                return let(at(x["start"], True), told)

            return F.transform("own", one)

        return let(F.transform(known, lambda s: s["start"]), found)

    return both.select("filing_id", F.inline(let(F.col("stretches"), placed)))
