"""Running heads, running feet and page numbers: found, cut out, kept in a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.arrays import let, repeated
from spanforge.functions.text import WS, lines_of, squash, strip, word_count

LINE_BREAKS = "[\n\f]"
MIN_REPEATS = 3
MAX_LENGTH = 90
ITEM_LINE = rf"(?i)^item{WS}+\p{{Nd}}"
PAGE_NUMBER = rf"(?i)^(?:(?:page{WS}+)?\p{{Nd}}{{1,4}}|-{WS}*\p{{Nd}}{{1,4}}{WS}*-)$"
PROSE_WORDS = 6


#: Stands for page numbers of any kind; no line holds a line feed.
NUMBERS = "\n"


def label(line: Column) -> Column:
    """What a line repeats if it is chrome: its text without white space and case, or that it is a page number; else null."""
    def told(s: Column) -> Column:
        eligible = (F.length(s) > 0) & (F.length(s) <= MAX_LENGTH) & ~s.rlike(ITEM_LINE)
        prose = s.rlike(r"[.!?]$") & (word_count(s) >= PROSE_WORDS)
        return F.when(eligible, F.when(s.rlike(PAGE_NUMBER), F.lit(NUMBERS)).when(~prose, F.lower(squash(s))))

    return let(strip(line), told)


def cut(texts: DataFrame, *keep: str) -> DataFrame:
    """filing_id, text, heads: each text without its chrome, and what was cut out as an array of start, end, text in old offsets.
    Keep names other columns that stay.

    A short line is chrome if the same text, white space and case aside, stands
    three times in its filing, unless it opens an item or reads like a sentence;
    page numbers are chrome if there are three of any kind. The line breaks stay. A
    null text has no row. All of it happens in the row of the text.
    """
    lined = texts.where("text is not null").select("filing_id", "text", *keep, lines_of(F.col("text"), LINE_BREAKS).alias("lines"))
    flags = repeated(F.transform("lines", lambda x: label(x["line"])), MIN_REPEATS)
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def apart(yes: Column) -> Column:
        heads = F.transform(F.filter("lines", lambda x: F.get(yes, x["pos"])), lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["line"])).alias("end"), x["line"].alias("text")))
        breaks = F.regexp_extract_all("text", F.lit(LINE_BREAKS), F.lit(0))
        kept = let(breaks, lambda b: F.transform("lines", lambda x: F.concat(F.when(F.get(yes, x["pos"]), "").otherwise(x["line"]), F.coalesce(F.get(b, x["pos"]), F.lit("")))))
        any_ = F.exists(yes, lambda x: x)
        return F.struct(F.when(any_, F.array_join(kept, "")).otherwise(F.col("text")).alias("text"), F.when(any_, heads).otherwise(none).alias("heads"))

    return lined.select("filing_id", *keep, let(flags, apart).alias("c")).select("filing_id", "c.text", "c.heads", *keep)


def heads(found: DataFrame) -> DataFrame:
    """The ledger (filing_id, start, end, text) of what ``cut`` found."""
    return found.select("filing_id", F.inline("heads"))


def stripped(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(filing_id, text) without chrome, and the ledger (filing_id, start, end, text) in old offsets."""
    found = cut(texts)
    return found.select("filing_id", "text"), heads(found)


def remapped(points: DataFrame, removed: DataFrame) -> DataFrame:
    """points(filing_id, pos, ...) with ``new``: the place after removed(filing_id, start, end) are cut out.

    A place within a removed range falls to where the range began. Ranges and
    places lie on one line, so a running sum over it is enough.
    """
    cuts = removed.select("filing_id", F.col("start").alias("pos"), F.col("end").alias("stop"), F.lit(0).alias("kind"))
    line = points.withColumn("kind", F.lit(1)).unionByName(cuts, allowMissingColumns=True)
    w = Window.partitionBy("filing_id").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    gone = F.coalesce(F.sum(F.col("stop") - F.col("pos")).over(w), F.lit(0))
    beyond = F.greatest(F.coalesce(F.last("stop", ignorenulls=True).over(w), F.lit(0)) - F.col("pos"), F.lit(0))
    return line.withColumn("new", (F.col("pos") - gone + beyond).cast("int")).where("kind = 1").drop("kind", "stop")
