"""Text expressions with code-point offsets and Unicode white space.

Java's ``\\s`` and ``trim`` know ASCII alone, so the classes are spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.arrays import let, sums_before

WS = r"[\p{IsWhite_Space}\x1c-\x1f]"
#: White space but no line feed.
GAP = r"[\p{IsWhite_Space}\x1c-\x1f&&[^\n]]"
#: No letter, digit or underscore follows.
END = r"(?![\p{L}\p{N}_])"
TOKEN = r"[\p{L}\p{N}]+(?:[.,/\-&%][\p{L}\p{N}]+)*"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{WS}+", ""), f"{WS}++$", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"[^\p{{IsWhite_Space}}\x1c-\x1f]")


def squash(c: Column) -> Column:
    """Trimmed, each run of white space a single space."""
    return F.regexp_replace(strip(c), f"{WS}+", " ")


def word_count(c: Column) -> Column:
    return F.when(is_blank(c), 0).otherwise(F.size(F.split(strip(c), f"{WS}+")))


def tokens(c: Column) -> Column:
    """Lower-case tokens, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), lambda x: F.lower(x))


def piece(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """The half-open slice [start, end) of a text."""
    text, start, end = (F.col(x) if isinstance(x, str) else x for x in (text, start, end))
    return F.substring(text, start + 1, end - start)


def sized(texts: DataFrame) -> DataFrame:
    """texts with ``length``: stored with it, later plans need not read a text to know its end."""
    return texts.withColumn("length", F.length("text"))


def lengths(texts: DataFrame, key: str = "filing_id") -> DataFrame:
    """key, length of each text."""
    return (texts if "length" in texts.columns else sized(texts)).select(key, "length")


def lines_of(text: Column, pattern: str) -> Column:
    """pos, start, line of each line of a text cut at single characters of a class, as an array of the row."""
    def placed(lines: Column) -> Column:
        starts = sums_before(F.transform(lines, lambda x: F.length(x) + 1))
        return let(starts, lambda at: F.transform(lines, lambda x, i: F.struct(i.alias("pos"), F.get(at, i).alias("start"), x.alias("line"))))

    return let(F.split(text, pattern, -1), placed)


def line_table(texts: DataFrame, pattern: str, key: str = "filing_id", text: str = "text") -> DataFrame:
    """key, pos, start, line: the text cut at single characters of a class, with offsets. Nothing is shuffled."""
    return texts.select(key, F.inline(lines_of(F.col(text), pattern)))


def some_lines(texts: DataFrame, pattern: str, wanted, key: str = "filing_id", text: str = "text") -> DataFrame:
    """The rows of ``line_table`` whose line is wanted(line): the others never leave the row of their text."""
    return texts.select(key, F.inline(F.filter(lines_of(F.col(text), pattern), lambda x: wanted(x["line"]))))
