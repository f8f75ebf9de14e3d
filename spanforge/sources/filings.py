"""Raw filings: read, unpack, decode, and find out format and fiscal year end.

All of it is column expressions but for gunzip and the decoding of entities, which
need Python and run on the rows that have a reason to. A file that can't be unpacked
becomes an error row and does not end the run.
"""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from spanforge.operators.html import ANY_TAG, unescaped

#: Format hints are looked for in so many bytes.
PREFIX_BYTES = 200_000
SUFFIXES = "*.{htm,html,txt,gz}"


def read_files(spark: SparkSession, path: str, suffixes: str = SUFFIXES) -> DataFrame:
    """filing_id (the path), raw, error: one row per file, unpacked where it is gzip data."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffixes).option("recursiveFileLookup", "true").load(path)
    return unpacked(files.select(F.col("path").alias("filing_id"), F.col("content").alias("raw")))


@F.pandas_udf(StructType([StructField("raw", BinaryType()), StructField("error", StringType())]))
def _gunzip(raw: pd.Series) -> pd.DataFrame:
    def one(b):
        try:
            return (None, None) if b is None else (gzip.decompress(b), None)
        except (OSError, EOFError, zlib.error) as e:
            return None, f"gunzip: {e}"

    return pd.DataFrame([one(b) for b in raw], columns=["raw", "error"])


def unpacked(filings: DataFrame) -> DataFrame:
    """filings(filing_id, raw) unpacked where raw is gzip data, with ``error``: what was
    wrong with data that can't be unpacked, whose raw is null then; else null."""
    packed = F.hex(F.substring("raw", 1, 2)) == "1F8B"
    found = filings.select("filing_id", "raw", F.when(packed, _gunzip(F.when(packed, F.col("raw")))).alias("u"), F.coalesce(packed, F.lit(False)).alias("packed"))
    return found.select("filing_id", F.when(F.col("packed"), F.col("u.raw")).otherwise(F.col("raw")).alias("raw"), F.when(F.col("packed"), F.col("u.error")).alias("error"))


def quarantined(filings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The filings(filing_id, raw, error) to go on with, and (filing_id, error) of the others:
    those with an error or without data."""
    bad = F.col("raw").isNull()
    return filings.where(~bad).drop("error"), filings.where(bad).select("filing_id", F.coalesce("error", F.lit("no data")).alias("error"))


def decoded(raw: Column) -> Column:
    """Strict UTF-8, else Latin-1, which takes any byte."""
    text = raw.cast("string")
    return F.when(F.call_function("is_valid_utf8", text), text).otherwise(F.decode(raw, "ISO-8859-1"))


def generation(raw: Column) -> Column:
    """html_xbrl, html or ascii."""
    every, front = F.decode(raw, "ISO-8859-1"), F.decode(F.substring(raw, 1, PREFIX_BYTES), "ISO-8859-1")
    xbrl = every.rlike(r"(?i)<\s*ix:") | front.rlike(r"(?i)xmlns:ix\s*=")
    html = front.rlike(r"(?i)<\s*(?:html|body|div|p|font|span)\b") | front.rlike(r"(?i)<!doctype\s+html")
    return F.when(xbrl, "html_xbrl").when(html, "html").otherwise("ascii")


def _header_date(raw: Column) -> Column:
    digits = F.regexp_extract(F.decode(raw, "ISO-8859-1"), r"CONFORMED PERIOD OF REPORT:[\s\x0b]*(\d{8})", 1)
    return F.date_format(F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMdd")), "yyyy-MM-dd")


# Fixed value: the name of the fact that holds the end of the period.
PERIOD_END = "dei:documentperiodenddate"
#: From the first element with that name to the next closing tag of its kind.
_PERIOD_FACT = rf"""(?is)<(?<tag>[a-z][^\s/>]*)\s(?:[^>]*\s)?name\s*=\s*['"]?\s*{PERIOD_END}\s*['"]?(?=[\s/>])[^>]*>(?<value>.*?)</\k<tag>\s*>"""


def _fact_date(raw: Column) -> Column:
    text = decoded(raw)
    named = F.when(text.rlike(f"(?i){PERIOD_END}"), text)
    value = unescaped(F.regexp_replace(F.regexp_extract(named, _PERIOD_FACT, 2), ANY_TAG, ""))
    words = F.initcap(F.trim(F.regexp_replace(value, r"[\s\x{a0}]+", " ")))
    long, short = (F.try_to_timestamp(words, F.lit(f)) for f in ("MMMM d, yyyy", "MMM d, yyyy"))
    return F.date_format(F.coalesce(long, short), "yyyy-MM-dd")


def fiscal_year_end(raw: Column) -> Column:
    """ISO date from the file header, else from the inline-XBRL fact, else null."""
    return F.coalesce(_header_date(raw), _fact_date(raw))


def prepared(filings: DataFrame) -> DataFrame:
    """filings(filing_id, raw[, fiscal_year_end]) with raw_text, generation and fiscal_year_end."""
    own = F.col("fiscal_year_end") if "fiscal_year_end" in filings.columns else F.lit(None).cast("string")
    return filings.select("filing_id", decoded(F.col("raw")).alias("raw_text"), generation(F.col("raw")).alias("generation"), F.coalesce(own, fiscal_year_end(F.col("raw"))).alias("fiscal_year_end"))


def resolve_cik(tickers: DataFrame, known: DataFrame, override: DataFrame) -> DataFrame:
    """ticker, cik: an override wins, then the ticker itself, then the ticker without punctuation.

    known(seq, ticker, cik): of equal normalized tickers the first one counts.
    """
    plain = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    exact = known.groupBy(F.upper("ticker").alias("k1")).agg(F.max_by("cik", "seq").alias("c1"))
    loose = known.groupBy(plain(F.col("ticker")).alias("k2")).agg(F.min_by("cik", "seq").alias("c2"))
    own = override.select(F.col("ticker").alias("k0"), F.col("cik").alias("c0"))
    out = tickers.join(own, F.col("ticker") == F.col("k0"), "left").join(exact, F.upper("ticker") == F.col("k1"), "left").join(loose, plain(F.col("ticker")) == F.col("k2"), "left")
    return out.select("ticker", F.coalesce("c0", "c1", "c2").alias("cik"))


def newest_annual(index: DataFrame, year: str) -> DataFrame:
    """Of index(cik, form, report_date, filing_date, accession) the newest 10-K for a year of each cik."""
    from pyspark.sql import Window

    own = index.where((F.col("form") == "10-K") & F.col("report_date").startswith(year))
    w = Window.partitionBy("cik").orderBy(F.desc("report_date"), F.desc("filing_date"))
    return own.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
