"""A corpus of filings made from ``documents``, the same in Spark and in DuckDB.

Eight documents in a row make a filing. Its lines are dealt into 22 or more
sections; sections 1 to 21 get the headings of the newest item order. Defects by
number of the filing: an item left out, a wrong number ahead or behind, a merged
heading, signatures before the end. Every fifth filing has a table of contents.
"""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from spanforge.plans.eras import NEWEST, item_rows
from spanforge.sources.shared import spread

DATES = ["1994-06-30", "2005-12-01", "2021-08-08", "2021-08-09", "2023-12-14", "2023-12-15"]
EXPECTED = [r[2] for r in item_rows() if r[0] == NEWEST and r[5] is not None]
_CONTENTS = [f"Item {x} {'.' * 12} {3 + k}" for k, x in enumerate(EXPECTED)]

# Expressions that both dialects read alike; s is the section that a line opens, or null.
_ID = "CASE " + " ".join(f"WHEN s = {k + 1} THEN '{x}'" for k, x in enumerate(EXPECTED)) + " END"
_LABEL = """CASE WHEN f % 6 = 1 AND id = '8' THEN NULL WHEN f % 6 = 2 AND id = '7A' THEN 'Item 10. '
  WHEN f % 6 = 3 AND id = '3' THEN 'Item 1A. ' WHEN f % 6 = 4 AND id = '1' THEN 'Items 1 and 2. '
  WHEN f % 6 = 4 AND id = '2' THEN NULL WHEN id IS NOT NULL THEN 'Item ' || id || '. ' END"""
_BLOCK = f"""concat_ws(NL, CASE WHEN s IS NOT NULL THEN 'ACME CORP - FORM 10-K' END,
  CASE WHEN id = '5' AND f % 2 = 0 THEN 'PART II' END, {_LABEL}, CASE WHEN id = '6' THEN '[Reserved]' END,
  CASE WHEN id IN ('11', '12', '13') THEN 'see proxy statement' END, CASE WHEN s = 22 AND f % 6 = 5 THEN 'SIGNATURES' END,
  line, CASE WHEN s = 0 AND f % 5 = 0 THEN TOC END)"""
_DATE = "CASE " + " ".join(f"WHEN DIV % 6 = {k} THEN '{d}'" for k, d in enumerate(DATES)) + " END"


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filing_id, text, fiscal_year_end."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    lines = docs.select(F.expr("doc_id div 8").alias("f"), "doc_id", F.posexplode(F.split("text", "[\n\f]", -1)).alias("pos", "line")).where(r"line rlike r'\S'")
    numbered = lines.selectExpr("f", "line", "row_number() over (partition by f order by doc_id, pos) - 1 as r", "count(*) over (partition by f) as n")
    dealt = numbered.selectExpr("f", "line", "r", "case when r % greatest(1, n div 24) = 0 then r div greatest(1, n div 24) end as s").withColumn("id", F.expr(_ID))
    block = F.expr(_BLOCK.replace("NL", r"'\n'").replace("TOC", "'" + "\\n".join(_CONTENTS) + "'"))
    texts = dealt.groupBy("f").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", block.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return texts.select(F.col("f").alias("filing_id"), "text", F.expr(_DATE.replace("DIV", "(f div 6)")).alias("fiscal_year_end"))


@F.pandas_udf(BinaryType())
def _gzipped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else gzip.compress(t.encode()))


def raw_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filing_id, raw: bytes of six kinds made from ``pages``, by the page's number: HTML, inline XBRL with
    a period, plain text under a header with a date, Latin-1, gzip, and data that only begins like gzip."""
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
    fact = """concat('<html xmlns:ix="x"><body><p>For the year ended <ix:nonNumeric contextRef="c" name="dei:DocumentPeriodEndDate">December&nbsp;31, <b>',
      2000 + page_id % 20, '</b></ix:nonNumeric></p>', html, '</body></html>')"""
    header = r"concat('CONFORMED PERIOD OF REPORT:\t', 1994 + page_id % 20, '0630\nPlain text number ', page_id)"
    raw = f"""case page_id % 6 when 0 then cast(html as binary) when 1 then cast({fact} as binary) when 2 then cast({header} as binary)
      when 3 then encode(concat('Caf\u00e9 number ', page_id), 'ISO-8859-1') when 5 then concat(X'1F8B', cast('no more' as binary)) end"""
    made = pages.select(F.col("page_id").alias("filing_id"), F.expr(raw).alias("raw"), F.when(F.col("page_id") % 6 == 4, _gzipped(F.when(F.col("page_id") % 6 == 4, F.col("html")))).alias("packed"))
    return made.select("filing_id", F.coalesce("raw", "packed").alias("raw"))


def paged_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filing_id, raw: for each page an inline-XBRL filing with a hidden fact and k = 0 to 4 sheets under
    one running head; every seventh is markup that no parser takes."""
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("filing_id")))
    sheets = "array_join(transform(sequence(0, filing_id % 5), j -> case when j > 0 then concat('<p>ACME REPORT</p><p>Sheet number ', j, ' of it</p>') else '' end), '')"
    raw = f"""concat('<html><body><ix:header><ix:hidden><ix:nonNumeric name="a">secret ', filing_id, '</ix:nonNumeric></ix:hidden></ix:header>',
      {sheets}, case when filing_id % 7 = 6 then '<![bogus[x]]>' else '' end, '</body></html>')"""
    return pages.select("filing_id", F.expr(raw).cast("binary").alias("raw"))


def tagged_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filing_id, raw: for each page an inline-XBRL filing of items 7 to 9 over its title and address; a number
    is tagged in item 8, in item 9 or nowhere, by the page's number."""
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    url = F.regexp_replace("url", "[?].*", "")
    fact = lambda k: F.when(F.col("page_id") % 3 == k, F.concat(F.lit('<ix:nonFraction name="n" scale="3">'), url, F.lit("</ix:nonFraction>"))).otherwise(url)
    title = F.regexp_extract("html", "<h1>([^<&]*)", 1)
    parts = ["<html><body><p>Item 7. Discussion</p><p>", title, "</p><p>Item 8. Statements</p><p>", fact(0), "</p><p>Item 9. Changes</p><p>", fact(1), " end</p></body></html>"]
    return pages.select(F.col("page_id").alias("filing_id"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).cast("binary").alias("raw"))


FYE_SQL = _DATE.replace("DIV", "(f // 6)")
FILINGS_SQL = rf"""
lines0 AS (
  SELECT doc_id // 8 AS f, doc_id, pos, parts[pos] AS line
  FROM (SELECT doc_id, string_split_regex(text, '[\n\f]') AS parts FROM documents) d, LATERAL unnest(range(1, len(parts) + 1)) AS u(pos)
  WHERE regexp_matches(parts[pos], '\S')
), numbered0 AS (
  SELECT f, line, row_number() OVER (PARTITION BY f ORDER BY doc_id, pos) - 1 AS r, count(*) OVER (PARTITION BY f) AS n FROM lines0
), dealt0 AS (
  SELECT f, line, r, CASE WHEN r % greatest(1, n // 24) = 0 THEN r // greatest(1, n // 24) END AS s FROM numbered0
), named0 AS (SELECT *, {_ID} AS id FROM dealt0
), filings AS (
  SELECT f AS filing_id, string_agg({_BLOCK.replace("NL", "chr(10)").replace("TOC", "array_to_string([" + ", ".join(f"'{x}'" for x in _CONTENTS) + "], chr(10))")}, chr(10) ORDER BY r) AS text,
    any_value({FYE_SQL}) AS fiscal_year_end
  FROM named0 GROUP BY f
)"""
