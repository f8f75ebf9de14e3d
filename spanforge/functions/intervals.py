"""Half-open intervals as columns ``start`` and ``end``, within a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    a_start, a_end, b_start, b_end = (F.col(x) if isinstance(x, str) else x for x in (a_start, a_end, b_start, b_end))
    return (a_start < b_end) & (b_start < a_end)


def _ordered(key: str, *order: str):
    return Window.partitionBy(key).orderBy("start", *order)


def cursor(key: str, *order: str) -> Column:
    """The furthest end of all intervals before this one, 0 for the first."""
    return F.coalesce(F.max("end").over(_ordered(key, *order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def islands(spans: DataFrame, key: str = "filing_id") -> DataFrame:
    """key, start, end: intervals that touch or overlap, merged. Of equal starts the furthest end says all."""
    spans = spans.groupBy(key, "start").agg(F.max("end").alias("end"))
    opened = spans.withColumn("new", (F.col("start") > F.coalesce(F.max("end").over(_ordered(key, "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    numbered = opened.withColumn("island", F.sum("new").over(_ordered(key, "end").rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def sessions(rows: DataFrame, gap: int, key: str = "filing_id", at: str = "start") -> DataFrame:
    """rows with ``run``: a new one begins where the distance to the row before exceeds gap."""
    w = Window.partitionBy(key).orderBy(at)
    far = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("far", far).withColumn("run", F.sum("far").over(w)).drop("far")


def merged_sessions(rows: DataFrame, gap: int, key: str = "filing_id", at: str = "start") -> DataFrame:
    """key, run, n, first, last of the runs that ``sessions`` numbers.

    Rows in a slot no wider than the gap are of one run, so slots are combined before
    the shuffle, and a window sees at most one row per slot of a key, however hot it is.
    """
    slots = rows.where(F.col(at).isNotNull()).groupBy(key, F.floor(F.col(at) / gap).alias("slot")).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    w = Window.partitionBy(key).orderBy("slot")
    far = F.coalesce((F.col("first") - F.lag("last").over(w) > gap).cast("int"), F.lit(0))
    dealt = slots.withColumn("far", far).withColumn("run", F.sum("far").over(w))
    return dealt.groupBy(key, "run").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def records(rows: DataFrame, key: str, at: str, tie: str, value: str, slot: Column) -> DataFrame:
    """The rows whose value exceeds all before them of the same key, by at and tie.

    slot grows with at. Rows meet the best of all slots before theirs, and are ordered
    only with those of their slot: a hot key is dealt over its slots.
    """
    dealt = rows.withColumn("_slot", slot)
    best = dealt.groupBy(key, "_slot").agg(F.max(value).alias("_top"))
    earlier = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    best = best.select(F.col(key).alias("_key"), F.col("_slot").alias("_s"), F.max("_top").over(earlier).alias("_before"))
    near = Window.partitionBy(key, "_slot").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    both = dealt.join(best, F.col(key).eqNullSafe(F.col("_key")) & F.col("_slot").eqNullSafe(F.col("_s")))
    over = both.where("_before is null or %s > _before" % value).withColumn("_best", F.max(value).over(near))
    return over.where("_best is null or %s > _best" % value).select(*rows.columns)


def clashes(spans: DataFrame, key: str) -> DataFrame:
    """key, n_overlaps, n_gaps: how many intervals begin before, and how many behind, the furthest end of those before them.

    Equal intervals are counted before the shuffle: behind the first of them the others
    only see its end as well.
    """
    own = spans.groupBy(key, "start", "end").agg(F.count("*").alias("n")).withColumn("from", cursor(key, "end"))
    late = lambda test: F.when(test(F.col("from")), 1).otherwise(0) + (F.col("n") - 1) * F.when(test(F.greatest("from", "end")), 1).otherwise(0)
    return own.groupBy(key).agg(F.sum(late(lambda x: F.col("start") < x)).alias("n_overlaps"), F.sum(late(lambda x: F.col("start") > x)).alias("n_gaps"))


def gaps(spans: DataFrame, lengths: DataFrame, key: str = "filing_id") -> DataFrame:
    """key, start, end: what of [0, length) no interval covers. lengths(key, length)."""
    between = spans.withColumn("from", cursor(key, "end")).where(F.col("start") > F.col("from")).select(key, F.col("from").alias("start"), F.col("start").alias("end"))
    last = spans.groupBy(key).agg(F.max("end").alias("last"))
    tail = lengths.join(last, key, "left").select(key, F.coalesce("last", F.lit(0)).alias("start"), F.col("length").alias("end")).where("start < end")
    return between.unionByName(tail)


def outside(points: DataFrame, regions: DataFrame, at: str, key: str = "filing_id") -> DataFrame:
    """The points that no region(key, start, end) holds: an anti join on key and range."""
    r = regions.select(F.col(key).alias("r_key"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    inside = (points[key] == r["r_key"]) & (r["r_start"] <= points[at]) & (points[at] < r["r_end"])
    return points.join(r, inside, "left_anti")


def intersections(a: DataFrame, b: DataFrame, width: int, key: str = "filing_id") -> DataFrame:
    """Pairs of overlapping intervals of a and b(key, b_start, b_end, ...), for two large sides.

    Both are put into buckets of ``width`` they touch; a pair is taken in the bucket
    where it first meets, so it comes once and the join stays an equality join.
    """
    def buckets(df, start, end):
        last = F.greatest(F.col(start), F.col(end) - 1)
        return df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width))))

    both = buckets(a, "start", "end").join(buckets(b, "b_start", "b_end"), [key, "bucket"])
    first = F.floor(F.greatest("start", "b_start") / width) == F.col("bucket")
    return both.where(overlaps("start", "end", "b_start", "b_end") & first).drop("bucket")
