"""Front matter: the table of contents and the cover page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.intervals import sessions
from spanforge.functions.text import END, WS, is_blank, lengths, piece, some_lines
from spanforge.operators.chrome import LINE_BREAKS
from spanforge.sources.shared import stored

TOC_GAP, DENSE_GAP = 600, 700
MIN_ENTRIES = 6
FRONT_SHARE = 0.2
ITEM_LINE = rf"(?i)^{WS}*items?{WS}+(\p{{Nd}}{{1,2}})([A-Za-z]?){END}"
PAGE_REF = rf"(?:(?:\.{WS}*+){{3}}\p{{Nd}}{{1,4}}{WS}*+$|{WS}\p{{Nd}}{{1,4}}{WS}*+$)"


def entries(ruler: DataFrame) -> DataFrame:
    """filing_id, start, end, key, ref: lines that open with an item number, and whether a page reference ends them."""
    found = some_lines(ruler, LINE_BREAKS, lambda x: x.rlike(ITEM_LINE))
    key = F.struct(F.regexp_extract("line", ITEM_LINE, 1).cast("int").alias("n"), F.upper(F.regexp_extract("line", ITEM_LINE, 2)).alias("letter"))
    return found.select("filing_id", "start", (F.col("start") + F.length("line")).alias("end"), key.alias("key"), F.col("line").rlike(PAGE_REF).alias("ref"))


def _cluster(items: DataFrame, sizes: DataFrame, gap: int) -> DataFrame:
    """filing_id, start, end of the first dense run of entries, with the runs that continue it.

    A run continues while it starts in the front of the text and with a number
    beyond all before it; entries behind the last one with the greatest number go.
    """
    dealt = sessions(items, gap)
    runs = dealt.groupBy("filing_id", "run").agg(F.count("*").alias("n"), F.min("start").alias("p0"), F.min_by("key", "start").alias("k0"), F.max("key").alias("top"))
    w = Window.partitionBy("filing_id").orderBy("run")
    seed = F.min(F.when(F.col("n") >= MIN_ENTRIES, F.col("run"))).over(Window.partitionBy("filing_id"))
    runs = runs.join(sizes, "filing_id").withColumn("seed", seed).where(F.col("run") >= F.col("seed"))
    ok = (F.col("run") == F.col("seed")) | ((F.col("p0") <= F.col("length") * FRONT_SHARE) & (F.col("k0") > F.max("top").over(w.rowsBetween(Window.unboundedPreceding, -1))))
    runs = runs.withColumn("ok", ok.cast("int")).withColumn("keep", F.min("ok").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("keep = 1")
    kept = dealt.join(runs.select("filing_id", "run"), ["filing_id", "run"])
    return kept.groupBy("filing_id").agg(F.min("start").alias("start"), F.max_by("end", F.struct("key", "start")).alias("end"))


def front_matter(ruler: DataFrame) -> DataFrame:
    """filing_id, start, end, cls: the cover page and the table of contents, where there are any."""
    sizes = lengths(ruler)
    every = stored(entries(ruler), "entries")  # few lines of each text; read by every branch below
    counted = every.withColumn("n", F.count("*").over(Window.partitionBy("filing_id"))).where(F.col("n") >= MIN_ENTRIES)
    by_ref = stored(_cluster(counted.where("ref"), sizes, TOC_GAP), "contents")
    dense = _cluster(counted, sizes, DENSE_GAP).join(sizes, "filing_id").where(F.col("start") <= F.col("length") * FRONT_SHARE)
    toc = by_ref.select("filing_id", "start", "end").unionByName(dense.select("filing_id", "start", "end").join(by_ref, "filing_id", "left_anti"))
    first = every.groupBy("filing_id").agg(F.min("start").alias("first"))
    edge = first.join(toc.select("filing_id", F.col("start").alias("toc")), "filing_id", "left").select("filing_id", F.coalesce("toc", "first").alias("edge"))
    cover = ruler.join(edge, "filing_id").where((F.col("edge") > 0) & ~is_blank(piece("text", F.lit(0), "edge"))).select("filing_id", F.lit(0).alias("start"), F.col("edge").alias("end"), F.lit("cover_page").alias("cls"))
    return cover.unionByName(toc.withColumn("cls", F.lit("toc")))
