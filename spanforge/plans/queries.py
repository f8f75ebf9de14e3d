"""The registered queries of the segmentation engine, and independent DuckDB SQL for them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.intervals import clashes, islands, merged_sessions, records
from spanforge.functions.text import line_table, sized, some_lines, tokens
from spanforge.operators import chrome, completeness, front, gate, html, provenance, segment
from spanforge.plans import eras, reports
from spanforge.plans.segmentation import itemize, result_json, segment_filings, segment_texts, stretches_of
from spanforge.sources import filings as sources
from spanforge.sources.corpus import FILINGS_SQL, FYE_SQL, filings, paged_filings, raw_filings, tagged_filings
from spanforge.sources.files import read_folder, write_folder
from spanforge.sources.shared import shared_folder, spread, stored

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus, made once."""
    return stored(filings(spark, sf_dir), "corpus")


def _undated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filings(spark, sf_dir).withColumn("fiscal_year_end", F.lit(None).cast("string"))


def _unstored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without dates, for those who read it once."""
    return filings(spark, sf_dir).withColumn("fiscal_year_end", F.lit(None).cast("string"))


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


def _placed(*names: str):
    """Offsets with -1 for none, so that both engines return plain integers."""
    return [F.coalesce(F.col(n), F.lit(-1)).cast("long").alias(n) for n in names]


def page_tokens(spark, sf_dir):
    """Tokens of the visible text of pages."""
    text = html.stripped_markup(F.col("html"))
    t = tokens(text)
    return spread(_table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


def document_lines(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    lines = line_table(docs, chrome.LINE_BREAKS, key="doc_id").where(F.length("line") > 0)
    return lines.select("doc_id", *_long("pos", "start"), F.length("line").cast("long").alias("size"))


def filing_texts(spark, sf_dir):
    f = filings(spark, sf_dir)
    return f.select("filing_id", F.length("text").cast("long").alias("size"), F.md5(F.col("text").cast("binary")).alias("digest"), "fiscal_year_end")


def filing_eras(spark, sf_dir):
    f = eras.with_era(filings(spark, sf_dir))
    expected = eras.era_items(spark).groupBy("era_id").agg(F.count("order_index").alias("n_expected"), F.count("*").alias("n_declared"))
    absent = eras.permitted_absent(spark).groupBy("era_id").agg(F.count("*").alias("n_absent"))
    return f.select("filing_id", "era_id").join(F.broadcast(expected), "era_id").join(F.broadcast(absent), "era_id")


def order_eras(spark, sf_dir):
    """Orders by the era of their date: the range join on another table."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(F.add_months("o_orderdate", 312), "yyyy-MM-dd").alias("d"))
    return eras.with_era(o, "d").groupBy("era_id").agg(F.count("*").alias("n"))


def chrome_lines(spark, sf_dir):
    return chrome.heads(chrome.cut(_filings(spark, sf_dir))).select("filing_id", *_long("start", "end"), F.col("text").alias("line"))


def stripped_texts(spark, sf_dir):
    ruler, _ = chrome.stripped(_filings(spark, sf_dir))
    return ruler.select("filing_id", F.length("text").cast("long").alias("size"), F.md5(F.col("text").cast("binary")).alias("digest"))


def front_matter(spark, sf_dir):
    return front.front_matter(_ruler(spark, sf_dir)).select("filing_id", *_long("start", "end"), "cls")


def _ruler(spark, sf_dir) -> DataFrame:
    return stored(sized(chrome.stripped(_filings(spark, sf_dir))[0]), "ruler", key="filing_id")


def _stage2(spark, sf_dir):
    return segment_texts(_undated(spark, sf_dir))


def item_headings(spark, sf_dir):
    return segment.headings(some_lines(_ruler(spark, sf_dir), "\n", lambda x: x.rlike(segment.HEADING))).select("filing_id", *_long("start", "enum_start"), "item_id", "merged_id", "is_plural")


def accepted_items(spark, sf_dir):
    f = eras.with_era(_undated(spark, sf_dir))
    ruler = _ruler(spark, sf_dir)
    found, _, _ = segment.structure(ruler, stored(front.front_matter(ruler), "front"))
    return segment.accepted(found, f).select("filing_id", *_long("start"), "item_id", F.col("order_index").cast("long").alias("order_index"))


def items(spark, sf_dir):
    return _stage2(spark, sf_dir).items.select("filing_id", *_long("ord"), *_placed("start", "end"), "item_id", "part", "status", "merged_into", "confidence", F.array_join("reason_codes", ",").alias("reason_codes"))


def residual_spans(spark, sf_dir):
    return _stage2(spark, sf_dir).residual.select("filing_id", *_long("start", "end"), "cls")


def violations(spark, sf_dir):
    return _stage2(spark, sf_dir).violations.select("filing_id", *_long("inv_no"), "code", "item_id", *_placed("start", "end"))


def invariant_results(spark, sf_dir):
    run = _stage2(spark, sf_dir)
    return gate.invariant_results(run.filings, run.violations).select("filing_id", "invariant", "passed")


def verdicts(spark, sf_dir):
    return _stage2(spark, sf_dir).verdicts


def dated_summary(spark, sf_dir):
    """The whole run with each filing's own era."""
    return reports.summary(segment_texts(_filings(spark, sf_dir)))


def item_sequences(spark, sf_dir):
    return reports.item_sequence(itemize(_unstored(spark, sf_dir)))


def residual_classes(spark, sf_dir):
    return reports.classes(_stage2(spark, sf_dir))


def spot_check(spark, sf_dir):
    return reports.spot_check(itemize(_unstored(spark, sf_dir))).select("filing_id", "item_id", "status", *_long("start", "end"), "head", "tail", F.coalesce("delta", F.lit(0)).cast("long").alias("delta"), "short")


def result_documents(spark, sf_dir):
    """Everything on a filing as one JSON text, with the places of items in the text before chrome was cut out."""
    f = _undated(spark, sf_dir)
    run = segment_texts(f)
    return result_json(run, _whole_stretches(f, run))


def _pages(spark, sf_dir) -> DataFrame:
    pages = spread(_table(spark, sf_dir, "pages").select("page_id", "html")).select(F.col("page_id").alias("filing_id"), F.col("html").cast("binary").alias("raw"))
    return sources.prepared(pages)


def page_conservation(spark, sf_dir):
    """Token conservation of the walker against the independent text, per page."""
    pages = _pages(spark, sf_dir)
    walked = stored(html.walk(pages), "walked")
    baseline = pages.select("filing_id", html.baseline_text(F.col("raw_text"), F.col("generation")).alias("text"))
    hidden = walked.select("filing_id", F.lit(None).cast("string").alias("text")).where("false")
    return completeness.conservation(pages, baseline, walked, hidden).select("filing_id", "passed", "n_source", "n_accounted", "n_missing", "n_extra")


def filing_conservation(spark, sf_dir):
    """Token conservation of filings: what was stripped is in the ledger."""
    f = _filings(spark, sf_dir)
    ruler, ledger = chrome.stripped(f)
    return completeness.conservation(f, f, ruler, ledger).select("filing_id", "passed", "n_source", "n_accounted", "n_missing", "n_extra")


def conservation_examples(spark, sf_dir):
    """The words that filings lose if what is cut out of them were not in the ledger: how many, the first ten and the first fifty."""
    cut = chrome.cut(filings(spark, sf_dir).withColumn("source", F.col("text")), "source")
    found = completeness.compared(cut.select("filing_id", F.array("source").alias("want"), F.array("text").alias("have")))
    words = lambda n: F.array_join(F.slice("missing_examples", 1, n), " ")
    return found.select("filing_id", "passed", "n_source", "n_missing", "n_extra", words(completeness.SHOWN).alias("first_ten"), words(completeness.EXAMPLES).alias("first_fifty"))


def _whole_stretches(f, run) -> DataFrame:
    """Plain texts are one stretch each, cut where chrome was."""
    return provenance.after_excision(provenance.whole(f), run.cuts)


def item_sources(spark, sf_dir):
    """Where the spans of items lie in the text before chrome was cut out."""
    f = _undated(spark, sf_dir)
    run = itemize(f)
    spans = run.items.where("start is not null").select("filing_id", "item_id", "start", "end")
    return provenance.source_of(spans, _whole_stretches(f, run)).select("filing_id", "item_id", *_long("start", "end"), "source_kind", *_long("source_start", "source_end"))


def page_provenance(spark, sf_dir):
    """Stretches of the rulers of pages after chrome is cut out."""
    return provenance.rows(stretches_of(_pages(spark, sf_dir))).select("filing_id", *_long("start", "end", "source_start", "source_end"), "kind")


def _paged(spark, sf_dir):
    return segment_filings(stored(sources.prepared(paged_filings(spark, sf_dir)), "paged"))[0]


def ledger_classes(spark, sf_dir):
    """What was taken out of filings in HTML, by class: running heads and hidden facts."""
    return reports.ledger_classes(_paged(spark, sf_dir)).select("filing_id", "cls", "visible", "n", "n_chars", *_long("first"))


def walk_errors(spark, sf_dir):
    """The summary of filings some of which can't be walked."""
    return reports.summary(_paged(spark, sf_dir)).select("filing_id", "n_spans", F.col("status") == "error", "error").toDF("filing_id", "n_spans", "failed", "error")


def page_formats(spark, sf_dir):
    return _pages(spark, sf_dir).groupBy("generation").agg(F.count("*").alias("n"), F.count("fiscal_year_end").alias("n_dated"))


def file_formats(spark, sf_dir):
    """A folder of files of four kinds, made from ``pages``: what the data source finds there and what is in it."""
    name = F.concat(F.col("page_id"), F.expr("case page_id % 4 when 0 then '.htm' when 1 then '.txt' when 2 then '.html.gz' else '.pdf' end"))
    pages = spread(_table(spark, sf_dir, "pages")).select(name.alias("name"), F.when(F.col("page_id") % 4 == 1, F.col("url")).otherwise(F.col("html")).alias("raw"))
    folder = f"{shared_folder(spark)}/filings_{uuid.uuid4().hex}"
    write_folder(pages, folder)
    found = read_folder(spark, folder, suffixes="htm,txt,gz,pdf").where(F.col("suffix").isin("htm", "txt", "gz"))
    good, bad = sources.quarantined(sources.unpacked(found.select(F.regexp_extract("path", "([0-9]+)[.][a-z.]+$", 1).cast("long").alias("filing_id"), "raw")))
    read = sources.prepared(good).select("filing_id", "generation", F.length("raw_text").cast("long").alias("n_chars"), F.lit(False).alias("failed"))
    return read.unionByName(bad.select("filing_id", F.lit(True).alias("failed")), allowMissingColumns=True)


def raw_formats(spark, sf_dir):
    """Raw bytes of six kinds: what they are, their year end, their length decoded, and whether they are in quarantine."""
    good, bad = sources.quarantined(sources.unpacked(raw_filings(spark, sf_dir)))
    read = sources.prepared(good).select("filing_id", "generation", "fiscal_year_end", F.length("raw_text").cast("long").alias("n_chars"), F.lit(False).alias("failed"))
    return read.unionByName(bad.select("filing_id", F.lit(True).alias("failed")), allowMissingColumns=True)


#: Layouts of a ruler of 100 letters: (number, items (id, start, end), evidence of item 8, starts by another method).
LAYOUTS = [
    (0, [("1", 0, 50), ("1A", 50, 100)], None, []),
    (1, [("1A", 0, 50), ("1", 50, 100)], None, []),
    (2, [("1", 0, 60), ("2", 50, 100)], None, []),
    (3, [("1", 0, 50), ("2", 60, 100)], None, []),
    (4, [("8", 0, 50), ("9", 50, 100)], (60, 70), []),
    (5, [("8", 0, 100)], (10, 20), []),
    (6, [("1", 0, 100)], None, [("1", 6, 100)]),
    (7, [("1", 0, 100)], None, [("1", 5, 100)]),
]


def layout_violations(spark, sf_dir):
    """One layout for each document, most of them with a violation that the filings made from documents never show."""
    span = "array<struct<item_id:string,start:int,end:int>>"
    known = spark.createDataFrame([(k, items, *(e or (None, None)), other) for k, items, e, other in LAYOUTS], f"k int, items {span}, b_start int, b_end int, other {span}")
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("filing_id"))
    each = docs.join(F.broadcast(known), F.col("filing_id") % len(LAYOUTS) == F.col("k"))
    era_of = eras.with_era(docs.withColumn("fiscal_year_end", F.lit(None).cast("string")))
    ruler = docs.withColumn("text", F.repeat(F.lit("x"), F.lit(100)))
    placed = lambda c: each.select("filing_id", F.posexplode(c).alias("ord", "i")).select("filing_id", "ord", "i.*")
    items = placed("items").withColumns({"merged_into": F.lit(None).cast("string"), "status": F.lit("extracted")})
    residual = docs.where("false").select("filing_id", F.lit(0).alias("ord"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("toc").alias("cls"))
    evidence = each.where("b_start is not null").select("filing_id", "b_start", "b_end")
    found = gate.violations(era_of, ruler, items, residual, evidence, placed("other"))
    return found.where("inv_no <> 6").select("filing_id", F.col("inv_no").cast("long").alias("inv_no"), "code", "item_id", *_long("start", "end"))


def own_ruleset(spark, sf_dir):
    """The corpus by a caller's ruleset: eight items in an order of its own, one of which may be missing."""
    windows = spark.createDataFrame([("own", None, None)], "era_id string, from_fye string, until_fye string")
    declared = [("1", "I"), ("2", "I"), ("3", "I"), ("5", "II"), ("8", "II"), ("7A", "II"), ("9A", "II"), ("15", "III")]
    rows = [("own", k, i, "required", part) for k, (i, part) in enumerate(declared)] + [("own", 90, "1A", "conditional", None), ("own", 91, "6", "absent", None)]
    ruleset = eras.Ruleset.own(windows, spark.createDataFrame(rows, "era_id string, pos int, item_id string, expectation string, part string"), spark.createDataFrame([("own", "3")], "era_id string, item_id string"))
    run = segment_texts(_filings(spark, sf_dir), ruleset=ruleset)
    return reports.item_sequence(run).join(run.verdicts, "filing_id").join(run.filings.select("filing_id", "era_id"), "filing_id").select("filing_id", "era_id", "sequence", "status", "n_violations")


def tagged_evidence(spark, sf_dir):
    """Filings made from pages, with a tagged number in item 8, beside it, or nowhere: where item 8 is away from its facts."""
    found = segment_filings(stored(sources.prepared(tagged_filings(spark, sf_dir)), "tagged"), tagged_evidence=True)[0].violations
    return found.where("inv_no = 7").select("filing_id", "code", "item_id", *_long("start", "end"))


def user_sessions(spark, sf_dir):
    """Runs of events of a user with at most 30 minutes between them."""
    e = _table(spark, sf_dir, "events").withColumn("t", F.unix_timestamp("ts"))
    return merged_sessions(e, 1800, "user_id", "t")


def running_records(spark, sf_dir):
    """Events whose value exceeds all before it of the same user: the order filter on numbers."""
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return records(e, "user_id", "ts", "event_id", "value", F.to_date("ts")).select("user_id", "event_id", "value")


def _line_spans(spark, sf_dir) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem").where("l_shipdate is not null")
    day = F.datediff("l_shipdate", F.lit("1992-01-01"))
    return li.select(F.col("l_suppkey").alias("key"), day.alias("start"), (day + F.col("l_quantity").cast("int") % 5 + 1).alias("end"))


def shipping_islands(spark, sf_dir):
    """Shipping intervals of a supplier, merged where they touch."""
    return islands(_line_spans(spark, sf_dir), "key").select("key", *_long("start", "end"))


def shipping_overlaps(spark, sf_dir):
    """How many intervals of a supplier begin before an earlier one ends."""
    return clashes(_line_spans(spark, sf_dir), "key")


def queries() -> dict[str, Query]:
    found = (
        page_tokens, document_lines, filing_texts, filing_eras, order_eras, chrome_lines, stripped_texts, front_matter, item_headings,
        accepted_items, items, residual_spans, violations, invariant_results, verdicts, dated_summary, item_sequences, residual_classes,
        spot_check, result_documents, page_conservation, filing_conservation, conservation_examples, item_sources, page_provenance, ledger_classes, walk_errors, page_formats, file_formats, raw_formats, layout_violations, own_ruleset, tagged_evidence, user_sessions, running_records, shipping_islands, shipping_overlaps,
    )
    return {f.__name__: f for f in found}


# ---- SQL ----

_ERAS = "eras(era_id, from_fye, until_fye) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in e[:3]) + ")" for e in eras.ERAS) + ")"
_ERA_ITEMS = "era_items(era_id, item_id, expectation, part, order_index) AS (VALUES " + ", ".join(f"('{e}', '{i}', '{k}', {repr(p) if p else 'NULL'}, {'NULL' if o is None else o})" for e, _, i, k, p, o in eras.item_rows()) + ")"
_ABSENT = "absent(era_id, item_id) AS (SELECT era_id, item_id FROM era_items WHERE expectation = 'reserved' UNION VALUES " + ", ".join(f"('{e}', '{i}')" for e in eras.ABSENCES for i in (eras.ABSENCES[e] + " " + eras.OPTIONAL).split()) + ")"

_CHAIN = [
    FILINGS_SQL.strip(),
    r"""flines AS (
  SELECT filing_id, pos, parts[pos] AS line, sum(len(parts[pos]) + 1) OVER (PARTITION BY filing_id ORDER BY pos) - len(parts[pos]) - 1 AS start, seps[pos] AS sep
  FROM (SELECT filing_id, string_split_regex(text, '[\n\f]') AS parts, regexp_extract_all(text, '[\n\f]') AS seps FROM filings) t, LATERAL unnest(range(1, len(parts) + 1)) AS u(pos)
), shaped AS (SELECT *, trim(line, E' \t\r\v') AS s FROM flines
), kinds AS (
  SELECT *, len(s) BETWEEN 1 AND 90 AND NOT regexp_matches(s, '(?i)^item\s+\d') AS fit,
    regexp_matches(s, '(?i)^((page\s+)?\d{1,4}|-\s*\d{1,4}\s*-)$') AS num,
    regexp_matches(s, '[.!?]$') AND len(regexp_split_to_array(s, '\s+')) >= 6 AS prose,
    lower(regexp_replace(s, '\s+', ' ', 'g')) AS norm
  FROM shaped
), marked AS (
  SELECT *, coalesce(CASE WHEN fit AND num THEN count(*) FILTER (WHERE fit AND num) OVER (PARTITION BY filing_id) >= 3
    WHEN fit AND NOT prose THEN count(*) FILTER (WHERE fit AND NOT num AND NOT prose) OVER (PARTITION BY filing_id, norm) >= 3 END, false) AS chrome
  FROM kinds
), ruler AS (
  SELECT filing_id, string_agg(CASE WHEN chrome THEN '' ELSE line END || coalesce(sep, ''), '' ORDER BY pos) AS text FROM marked GROUP BY filing_id
)""",
    r"""rlines AS (
  SELECT filing_id, pos, parts[pos] AS line, sum(len(parts[pos]) + 1) OVER (PARTITION BY filing_id ORDER BY pos) - len(parts[pos]) - 1 AS start, size
  FROM (SELECT filing_id, string_split_regex(text, '[\n\f]') AS parts, len(text) AS size FROM ruler) t, LATERAL unnest(range(1, len(parts) + 1)) AS u(pos)
), entries AS (
  SELECT filing_id, start, start + len(line) AS stop, size, 100 * CAST(regexp_extract(line, '(?i)^\s*items?\s+(\d{1,2})([a-z]?)\b', 1) AS INT)
      + coalesce(ascii(nullif(upper(regexp_extract(line, '(?i)^\s*items?\s+(\d{1,2})([a-z]?)\b', 2)), '')), 0) AS key,
    regexp_matches(line, '(\.\s*){3,}\s*\d{1,4}\s*$|\s\d{1,4}\s*$') AS ref, count(*) OVER (PARTITION BY filing_id) AS n_entries
  FROM rlines WHERE regexp_matches(line, '(?i)^\s*items?\s+(\d{1,2})([a-z]?)\b')
), branches AS (SELECT 'ref' AS b, 600 AS gap, * FROM entries WHERE ref AND n_entries >= 6 UNION ALL SELECT 'dense', 700, * FROM entries WHERE n_entries >= 6
), stepped AS (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY b, filing_id ORDER BY start) > gap THEN 1 ELSE 0 END AS far FROM branches
), ran AS (SELECT *, sum(far) OVER (PARTITION BY b, filing_id ORDER BY start) AS run FROM stepped
), runs AS (SELECT b, filing_id, run, count(*) AS n, min(start) AS p0, min_by(key, start) AS k0, max(key) AS top, any_value(size) AS size FROM ran GROUP BY ALL
), seeded AS (SELECT *, min(run) FILTER (WHERE n >= 6) OVER (PARTITION BY b, filing_id) AS seed FROM runs
), after AS (
  SELECT *, CASE WHEN run = seed THEN 1 WHEN p0 <= 0.2 * size AND k0 > max(top) OVER (PARTITION BY b, filing_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS ok
  FROM seeded WHERE run >= seed
), joined AS (SELECT *, min(ok) OVER (PARTITION BY b, filing_id ORDER BY run) AS keep FROM after
), kept AS (SELECT r.* FROM ran r JOIN joined j ON j.b = r.b AND j.filing_id = r.filing_id AND j.run = r.run AND j.keep = 1
), tops AS (SELECT *, max(key) OVER (PARTITION BY b, filing_id) AS top FROM kept
), clusters AS (SELECT b, filing_id, min(start) AS start, max(stop) FILTER (WHERE start <= last) AS stop, any_value(size) AS size
  FROM (SELECT *, max(start) FILTER (WHERE key = top) OVER (PARTITION BY b, filing_id) AS last FROM tops) t GROUP BY b, filing_id
), toc AS (
  SELECT filing_id, start, stop FROM clusters WHERE b = 'ref'
  UNION ALL SELECT filing_id, start, stop FROM clusters WHERE b = 'dense' AND start <= 0.2 * size AND filing_id NOT IN (SELECT filing_id FROM clusters WHERE b = 'ref')
), edges AS (SELECT e.filing_id, coalesce(any_value(t.start), min(e.start)) AS edge FROM entries e LEFT JOIN toc t ON t.filing_id = e.filing_id GROUP BY e.filing_id
), front AS (
  SELECT r.filing_id, 0 AS start, edge AS stop, 'cover_page' AS cls FROM ruler r JOIN edges e ON e.filing_id = r.filing_id WHERE edge > 0 AND regexp_matches(r.text[1:edge], '\S')
  UNION ALL SELECT filing_id, start, stop, 'toc' FROM toc
)""",
    r"""nlines AS (
  SELECT filing_id, parts[pos] AS line, sum(len(parts[pos]) + 1) OVER (PARTITION BY filing_id ORDER BY pos) - len(parts[pos]) - 1 AS start
  FROM (SELECT filing_id, string_split(text, chr(10)) AS parts FROM ruler) t, LATERAL unnest(range(1, len(parts) + 1)) AS u(pos)
), heads AS (
  SELECT filing_id, start, start + len(regexp_extract(line, '(?i)^([\t\f\r\v ]*)items?', 1)) AS enum_start,
    regexp_extract(line, P, 2) || upper(regexp_extract(line, P, 3)) AS item_id,
    CASE WHEN regexp_extract(line, P, 4) <> '' THEN regexp_extract(line, P, 4) || upper(regexp_extract(line, P, 5)) END AS merged_id,
    lower(regexp_extract(line, P, 1)) = 'items' AS is_plural
  FROM nlines WHERE regexp_matches(line, P)
), free AS (SELECT h.* FROM heads h WHERE NOT EXISTS (SELECT 1 FROM front f WHERE f.filing_id = h.filing_id AND f.start <= h.enum_start AND h.enum_start < f.stop)
), known AS (SELECT f.*, e.order_index, e.part FROM free f JOIN era_items e ON e.era_id = 'era_2023' AND e.item_id = f.item_id AND e.order_index IS NOT NULL
), accepted AS (
  SELECT * FROM (SELECT *, coalesce(max(order_index) OVER (PARTITION BY filing_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS best FROM known) t WHERE order_index > best
)""".replace("(line, P", r"(line, '(?i)^[\t\f\r\v ]*(items?)[\t\f\r\v ]+(\d{1,2})([a-z])?(?:[\t\f\r\v ]+and[\t\f\r\v ]+(\d{1,2})([a-z])?)?\b'"),
    r"""dividers AS (
  SELECT filing_id, start, start + len(line) AS stop FROM nlines n WHERE regexp_matches(line, '(?i)^[\t\f\r\v ]*part[\t\f\r\v ]+(i{1,3}|iv)\b[\t\f\r\v ]*[.:–—-]?[\t\f\r\v ]*$')
    AND NOT EXISTS (SELECT 1 FROM front f WHERE f.filing_id = n.filing_id AND f.start <= n.start AND n.start < f.stop)
), signed AS (
  SELECT n.filing_id, max(start) AS start, any_value(len(r.text)) AS stop FROM nlines n JOIN ruler r ON r.filing_id = n.filing_id
  WHERE regexp_matches(line, '(?i)^[\t\f\r\v ]*signatures?[\t\f\r\v ]*$') GROUP BY n.filing_id
), cuts AS (SELECT filing_id, start FROM dividers UNION ALL SELECT filing_id, start FROM signed
), spans0 AS (SELECT a.*, coalesce(lead(start) OVER (PARTITION BY a.filing_id ORDER BY start), len(r.text)) AS next, r.text FROM accepted a JOIN ruler r ON r.filing_id = a.filing_id
), spans AS (SELECT s.*, least(s.next, coalesce((SELECT min(c.start) FROM cuts c WHERE c.filing_id = s.filing_id AND c.start > s.start AND c.start < s.next), s.next)) AS stop FROM spans0 s
), bodies AS (SELECT *, text[start + 1 : stop] AS body FROM spans
), stated AS (
  SELECT *, CASE WHEN merged_id IS NOT NULL THEN 'merged' WHEN regexp_matches(body, '(?i)\breserved\b') AND len(trim(body, E' \t\r\v\n\f')) <= 80 THEN 'reserved'
    WHEN item_id IN ('10', '11', '12', '13', '14') AND regexp_matches(body, '(?i)incorporated\s+by\s+reference|proxy\s+statement|see\s+proxy') THEN 'incorporated_by_reference' ELSE 'extracted' END AS status
  FROM bodies
), items0 AS (
  SELECT filing_id, start AS head, 0 AS k, item_id, part, start, stop, status, NULL AS merged_into FROM stated
  UNION ALL SELECT s.filing_id, s.start, 1, s.merged_id, e.part, NULL, NULL, 'merged', s.item_id FROM stated s LEFT JOIN era_items e ON e.era_id = 'era_2023' AND e.item_id = s.merged_id WHERE s.merged_id IS NOT NULL
), items AS (SELECT *, row_number() OVER (PARTITION BY filing_id ORDER BY head, k) - 1 AS ord FROM items0
), placed AS (
  SELECT filing_id, start, stop, cls FROM front UNION ALL SELECT filing_id, start, stop, 'part_divider' FROM dividers UNION ALL SELECT filing_id, start, stop, 'signatures' FROM signed
), claimed AS (SELECT filing_id, start, stop FROM spans UNION ALL SELECT filing_id, start, stop FROM placed
  UNION ALL SELECT filing_id, len(text), len(text) FROM ruler
), swept AS (SELECT filing_id, start, coalesce(max(stop) OVER (PARTITION BY filing_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM claimed
), open0 AS (
  SELECT s.filing_id, reached AS start, s.start AS stop, CASE WHEN reached < coalesce((SELECT min(a.start) FROM accepted a WHERE a.filing_id = s.filing_id), len(r.text)) THEN 'cover_page' ELSE 'unclassified' END AS cls
  FROM swept s JOIN ruler r ON r.filing_id = s.filing_id WHERE s.start > reached AND regexp_matches(r.text[reached + 1 : s.start], '\S')
), residual AS (SELECT * FROM placed UNION ALL SELECT * FROM open0
)""",
    r"""shapes AS (
  SELECT filing_id, start, stop, 0 AS g FROM items WHERE merged_into IS NULL UNION ALL SELECT filing_id, start, stop, 1 FROM residual
), swept2 AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY filing_id ORDER BY start, g, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM shapes
), merges AS (SELECT DISTINCT i.filing_id, i.merged_into AS rep, i.item_id AS member FROM items i WHERE merged_into IS NOT NULL
), measured AS (SELECT g.*, a.order_index AS x, b.order_index AS y FROM merges g LEFT JOIN era_items a ON a.era_id = 'era_2023' AND a.item_id = g.rep LEFT JOIN era_items b ON b.era_id = 'era_2023' AND b.item_id = g.member
), violations AS (
  SELECT filing_id, 3 AS inv_no, 'coverage_overlap' AS code, NULL AS item_id, start, stop FROM swept2 WHERE start < reached
  UNION ALL SELECT filing_id, 4, 'unclassified_residual', NULL, start, stop FROM residual WHERE cls = 'unclassified' AND stop - start > 200
  UNION ALL SELECT filing_id, 5, 'illegal_structure', NULL, NULL, NULL FROM measured m WHERE x IS NULL OR y IS NULL OR EXISTS (
    SELECT 1 FROM era_items e WHERE e.era_id = 'era_2023' AND e.order_index > least(x, y) AND e.order_index < greatest(x, y) AND NOT regexp_matches(e.item_id, '[A-Z]$'))
  UNION ALL SELECT f.filing_id, 6, 'missing_expected_item', e.item_id, NULL, NULL FROM ruler f, era_items e WHERE e.era_id = 'era_2023' AND e.order_index IS NOT NULL
    AND e.item_id NOT IN (SELECT item_id FROM absent WHERE era_id = 'era_2023') AND NOT EXISTS (SELECT 1 FROM items i WHERE i.filing_id = f.filing_id AND i.item_id = e.item_id)
  UNION ALL SELECT s.filing_id, 9, 'oversized_cover_page', NULL, s.start, s.stop FROM residual s JOIN ruler r ON r.filing_id = s.filing_id WHERE cls = 'cover_page' AND (s.stop - s.start) / len(r.text) >= 0.9
), verdict AS (SELECT r.filing_id, count(v.code) AS n FROM ruler r LEFT JOIN violations v ON v.filing_id = r.filing_id GROUP BY r.filing_id
)""",
]


def _sql(depth: int, select: str) -> str:
    return "WITH " + ",\n".join([_ERAS, _ERA_ITEMS, _ABSENT, *_CHAIN[:depth]]) + "\n" + select


_NAMES = "(VALUES " + ", ".join(f"({i + 1}, '{n}')" for i, n in enumerate(gate.NAMES)) + ") AS names(inv_no, invariant)"
_TAGS = "|".join(sorted(html.BLOCKS, key=len, reverse=True))
_BARE = "html"
for _pattern, _by in [
    (r"(?s)<!--.*?-->", " "), *[(rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", " ") for t in ("script", "style", "ix:header", "ix:hidden")],
    (rf"(?i)</?(?:{_TAGS})\b[^>]*>", " "), ("<[^>]*>", ""),
]:
    _BARE = f"regexp_replace({_BARE}, '{_pattern}', '{_by}', 'g')"

_SOURCES = """, moved AS (
  SELECT filing_id, start AS source, sum(CASE WHEN chrome THEN 1 ELSE len(line) + 1 END) OVER (PARTITION BY filing_id ORDER BY pos) - CASE WHEN chrome THEN 1 ELSE len(line) + 1 END AS start FROM marked
), sources AS (
  SELECT i.filing_id, i.ord, i.item_id, CAST(i.start AS BIGINT) AS start, CAST(i.stop AS BIGINT) AS "end", 'raw_byte' AS source_kind, CAST(a.source AS BIGINT) AS source_start, CAST(coalesce(b.source, len(f.text)) AS BIGINT) AS source_end
  FROM items i JOIN filings f ON f.filing_id = i.filing_id JOIN moved a ON a.filing_id = i.filing_id AND a.start = i.start LEFT JOIN moved b ON b.filing_id = i.filing_id AND b.start = i.stop WHERE i.start IS NOT NULL
)"""
# what each violation of the corpus says, written out apart from the engine's table
_SAID = """CASE code WHEN 'coverage_overlap' THEN 'begins before the spans ahead of it end' WHEN 'unclassified_residual' THEN 'a long stretch that is of no class'
  WHEN 'illegal_structure' THEN 'merged items that are no neighbours' WHEN 'missing_expected_item' THEN 'expected and not there' WHEN 'oversized_cover_page' THEN 'a cover page of nearly the whole text' END"""
_RESULTS = _SOURCES + f""", each_item AS (
  SELECT i.filing_id, list({{'item_id': i.item_id, 'part': i.part, 'start': i.start, 'end': i.stop, 'status': i.status,
    'confidence': CASE WHEN v.codes IS NOT NULL THEN 'low' WHEN i.status IN ('reserved', 'incorporated_by_reference') THEN 'high' ELSE 'medium' END, 'method': 'deterministic', 'reason_codes': coalesce(v.codes, []),
    'source_ref': CASE WHEN s.ord IS NOT NULL THEN {{'kind': s.source_kind, 'start': s.source_start, 'end': s.source_end}} END, 'merged_into': i.merged_into}} ORDER BY i.ord) AS items
  FROM items i LEFT JOIN sources s ON s.filing_id = i.filing_id AND s.ord = i.ord
  LEFT JOIN (SELECT filing_id, item_id, list(DISTINCT code) AS codes FROM violations WHERE item_id IS NOT NULL GROUP BY ALL) v ON v.filing_id = i.filing_id AND v.item_id = i.item_id GROUP BY i.filing_id
), each_left AS (SELECT filing_id, list({{'start': start, 'end': stop, 'cls': cls}} ORDER BY start, stop, cls) AS residual FROM residual GROUP BY filing_id
), each_bad AS (
  SELECT filing_id, list({{'code': code, 'severity': 'hard', 'message': concat_ws(' ', 'item ' || item_id, {_SAID}, 'at ' || start || ' to ' || stop), 'item_id': item_id, 'start': start, 'end': stop}}
    ORDER BY inv_no, start NULLS FIRST, stop NULLS FIRST, item_id NULLS FIRST) AS violations FROM violations GROUP BY filing_id
), each_check AS (
  SELECT r.filing_id, map_from_entries(list({{'k': invariant, 'v': NOT EXISTS (SELECT 1 FROM violations v WHERE v.filing_id = r.filing_id AND v.inv_no = names.inv_no)}} ORDER BY inv_no)) AS checks FROM ruler r, {_NAMES} GROUP BY r.filing_id
) SELECT r.filing_id, CAST(to_json({{'items': coalesce(i.items, []), 'residual': coalesce(l.residual, []), 'status': CASE WHEN n > 0 THEN 'failed' ELSE 'pass' END, 'confidence': CASE WHEN n > 0 THEN 'low' ELSE 'high' END,
    'verification_report': {{'violations': coalesce(b.violations, []), 'invariant_results': c.checks, 'status': CASE WHEN n > 0 THEN 'failed' ELSE 'pass' END, 'confidence': CASE WHEN n > 0 THEN 'low' ELSE 'high' END}}}}) AS VARCHAR) AS json
  FROM verdict r LEFT JOIN each_item i ON i.filing_id = r.filing_id LEFT JOIN each_left l ON l.filing_id = r.filing_id LEFT JOIN each_bad b ON b.filing_id = r.filing_id JOIN each_check c ON c.filing_id = r.filing_id"""

ORACLE = {
    "page_tokens": rf"""SELECT page_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (
  SELECT page_id, list_transform(regexp_extract_all({_BARE}, '[\p{{L}}\p{{N}}]+(?:[.,/\-&%][\p{{L}}\p{{N}}]+)*'), lambda x: lower(x)) AS t FROM pages)""",
    "document_lines": r"""SELECT * FROM (SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, CAST(sum(len(parts[pos]) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - len(parts[pos]) - 1 AS BIGINT) AS start, CAST(len(parts[pos]) AS BIGINT) AS size
  FROM (SELECT doc_id, string_split_regex(text, '[\n\f]') AS parts FROM documents) t, LATERAL unnest(range(1, len(parts) + 1)) AS u(pos)) WHERE size > 0""",
    "filing_texts": _sql(1, "SELECT filing_id, CAST(len(text) AS BIGINT) AS size, md5(text) AS digest, fiscal_year_end FROM filings"),
    "filing_eras": _sql(1, """SELECT f.filing_id, e.era_id, (SELECT count(order_index) FROM era_items i WHERE i.era_id = e.era_id) AS n_expected,
  (SELECT count(*) FROM era_items i WHERE i.era_id = e.era_id) AS n_declared, (SELECT count(*) FROM absent a WHERE a.era_id = e.era_id) AS n_absent
  FROM filings f JOIN eras e ON (from_fye IS NULL OR from_fye <= fiscal_year_end) AND (until_fye IS NULL OR fiscal_year_end < until_fye)"""),
    "order_eras": _sql(0, """SELECT e.era_id, count(*) AS n FROM (SELECT strftime(o_orderdate + INTERVAL 312 MONTH, '%Y-%m-%d') AS d FROM orders) o
  JOIN eras e ON (from_fye IS NULL OR from_fye <= d) AND (until_fye IS NULL OR d < until_fye) GROUP BY e.era_id"""),
    "chrome_lines": _sql(2, """SELECT filing_id, CAST(start AS BIGINT) AS start, CAST(start + len(line) AS BIGINT) AS "end", line FROM marked WHERE chrome"""),
    "stripped_texts": _sql(2, "SELECT filing_id, CAST(len(text) AS BIGINT) AS size, md5(text) AS digest FROM ruler"),
    "front_matter": _sql(3, """SELECT filing_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end", cls FROM front"""),
    "item_headings": _sql(4, "SELECT filing_id, CAST(start AS BIGINT) AS start, CAST(enum_start AS BIGINT) AS enum_start, item_id, merged_id, is_plural FROM heads"),
    "accepted_items": _sql(4, "SELECT filing_id, CAST(start AS BIGINT) AS start, item_id, CAST(order_index AS BIGINT) AS order_index FROM accepted"),
    "items": _sql(6, """SELECT i.filing_id, i.ord, CAST(coalesce(i.start, -1) AS BIGINT) AS start, CAST(coalesce(i.stop, -1) AS BIGINT) AS "end", i.item_id, i.part, i.status, i.merged_into,
  CASE WHEN v.codes IS NOT NULL THEN 'low' WHEN i.status IN ('reserved', 'incorporated_by_reference') THEN 'high' ELSE 'medium' END AS confidence, coalesce(v.codes, '') AS reason_codes
  FROM items i LEFT JOIN (SELECT filing_id, item_id, string_agg(DISTINCT code, ',') AS codes FROM violations WHERE item_id IS NOT NULL GROUP BY ALL) v ON v.filing_id = i.filing_id AND v.item_id = i.item_id"""),
    "residual_spans": _sql(5, """SELECT filing_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS "end", cls FROM residual"""),
    "violations": _sql(6, """SELECT filing_id, CAST(inv_no AS BIGINT) AS inv_no, code, item_id, CAST(coalesce(start, -1) AS BIGINT) AS start, CAST(coalesce(stop, -1) AS BIGINT) AS "end" FROM violations"""),
    "invariant_results": _sql(6, f"SELECT r.filing_id, invariant, NOT EXISTS (SELECT 1 FROM violations v WHERE v.filing_id = r.filing_id AND v.inv_no = names.inv_no) AS passed FROM ruler r, {_NAMES}"),
    "verdicts": _sql(6, "SELECT filing_id, CASE WHEN n > 0 THEN 'failed' ELSE 'pass' END AS status, CASE WHEN n > 0 THEN 'low' ELSE 'high' END AS confidence, n AS n_violations FROM verdict"),
    "item_sequences": _sql(5, "SELECT filing_id, string_agg(concat_ws('/', item_id, part), ' ' ORDER BY ord) AS sequence FROM items GROUP BY filing_id"),
    "residual_classes": _sql(5, "SELECT filing_id, " + ", ".join(f"count(*) FILTER (WHERE cls = '{c}') AS {c}" for c in ("cover_page", "toc", "part_divider", "signatures", "unclassified")) + " FROM residual GROUP BY filing_id"),
    "result_documents": _sql(6, _RESULTS),
    "spot_check": _sql(5, """SELECT i.filing_id, i.item_id, i.status, CAST(i.start AS BIGINT) AS start, CAST(i.stop AS BIGINT) AS "end", (r.text[i.start + 1 : i.stop])[1:90] AS head, right(r.text[i.start + 1 : i.stop], 60) AS tail,
  CAST(coalesce(i.start - lag(i.stop) OVER (PARTITION BY i.filing_id ORDER BY i.start), 0) AS BIGINT) AS delta, NOT regexp_matches(i.item_id, '[A-Z]$') AND i.status = 'extracted' AND i.stop - i.start < 200 AS short
  FROM items i JOIN ruler r ON r.filing_id = i.filing_id WHERE i.start IS NOT NULL"""),
    "filing_conservation": _sql(1, r"""SELECT filing_id, true AS passed, n AS n_source, n AS n_accounted, 0::BIGINT AS n_missing, 0::BIGINT AS n_extra FROM (
  SELECT filing_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[.,/\-&%][\p{L}\p{N}]+)*')) AS BIGINT) AS n FROM filings)"""),
    "conservation_examples": _sql(2, r""", stoken AS (
  SELECT filing_id, lower(t[i]) AS token, i AS pos FROM (SELECT filing_id, regexp_extract_all(text, '[\p{L}\p{N}]+(?:[.,/\-&%][\p{L}\p{N}]+)*') AS t FROM filings), LATERAL unnest(range(1, len(t) + 1)) AS u(i)
), rtoken AS (SELECT filing_id, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[.,/\-&%][\p{L}\p{N}]+)*'))) AS token FROM ruler
), want AS (SELECT filing_id, token, count(*) AS n, min(pos) AS pos FROM stoken GROUP BY ALL
), have AS (SELECT filing_id, token, count(*) AS n FROM rtoken GROUP BY ALL
), lost AS (SELECT w.filing_id, w.token, w.pos, w.n - coalesce(h.n, 0) AS n FROM want w LEFT JOIN have h ON h.filing_id = w.filing_id AND h.token = w.token WHERE w.n > coalesce(h.n, 0)
), told AS (SELECT filing_id, CAST(sum(n) AS BIGINT) AS n_missing, flatten(list(list_transform(range(0, n), lambda k: token) ORDER BY pos)) AS words FROM lost GROUP BY filing_id)
SELECT f.filing_id, n_missing IS NULL AS passed, (SELECT count(*) FROM stoken s WHERE s.filing_id = f.filing_id) AS n_source, coalesce(n_missing, 0) AS n_missing, 0::BIGINT AS n_extra,
  coalesce(array_to_string(words[1:10], ' '), '') AS first_ten, coalesce(array_to_string(words[1:50], ' '), '') AS first_fifty FROM filings f LEFT JOIN told t ON t.filing_id = f.filing_id"""),
    "item_sources": _sql(5, _SOURCES + """
  SELECT filing_id, item_id, start, "end", source_kind, source_start, source_end FROM sources"""),
    "ledger_classes": """WITH p AS (SELECT page_id AS filing_id, page_id % 5 AS k FROM pages WHERE page_id % 7 <> 6)
  SELECT filing_id, 'xbrl_hidden' AS cls, false AS visible, 1::BIGINT AS n, CAST(7 + len(CAST(filing_id AS VARCHAR)) AS BIGINT) AS n_chars, 12::BIGINT AS first FROM p
  UNION ALL SELECT filing_id, 'page_header_footer', true, k, 11 * k, CAST(108 + len(CAST(filing_id AS VARCHAR)) AS BIGINT) FROM p WHERE k >= 3""",
    "walk_errors": """SELECT page_id AS filing_id, CASE WHEN page_id % 7 <> 6 THEN 0::BIGINT END AS n_spans, page_id % 7 = 6 AS failed,
  CASE WHEN page_id % 7 = 6 THEN 'walk: unknown status keyword ''bogus'' in marked section' END AS error FROM pages""",
    "page_formats": "SELECT 'html' AS generation, count(*) AS n, 0::BIGINT AS n_dated FROM pages",
    "file_formats": """SELECT page_id AS filing_id, CASE WHEN page_id % 4 = 1 THEN 'ascii' ELSE 'html' END AS generation,
  CAST(CASE WHEN page_id % 4 = 1 THEN len(url) ELSE len(html) END AS BIGINT) AS n_chars, false AS failed FROM pages WHERE page_id % 4 <> 3""",
    "raw_formats": """SELECT page_id AS filing_id, CASE page_id % 6 WHEN 0 THEN 'html' WHEN 1 THEN 'html_xbrl' WHEN 2 THEN 'ascii' WHEN 3 THEN 'ascii' WHEN 4 THEN 'html' END AS generation,
  CASE page_id % 6 WHEN 1 THEN CAST(2000 + page_id % 20 AS VARCHAR) || '-12-31' WHEN 2 THEN CAST(1994 + page_id % 20 AS VARCHAR) || '-06-30' END AS fiscal_year_end,
  CAST(CASE page_id % 6 WHEN 0 THEN len(html) WHEN 1 THEN len(html) + 173 WHEN 2 THEN 55 + len(CAST(page_id AS VARCHAR)) WHEN 3 THEN 12 + len(CAST(page_id AS VARCHAR)) WHEN 4 THEN len(html) END AS BIGINT) AS n_chars,
  page_id % 6 = 5 AS failed FROM pages""",
    "layout_violations": """SELECT doc_id AS filing_id, CAST(inv_no AS BIGINT) AS inv_no, code, item_id, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS "end" FROM documents JOIN (VALUES
  (1, 1, 'order_violation', '1', 50, 100), (2, 2, 'overlap', '2', 50, 100), (2, 3, 'coverage_overlap', NULL, 50, 100), (3, 3, 'coverage_gap', NULL, 50, 60),
  (4, 7, 'xbrl_mismatch', '8', 0, 50), (6, 8, 'cross_method_disagree', '1', 0, 100)) AS e(k, inv_no, code, item_id, a, b) ON doc_id % 8 = k""",
    "user_sessions": """WITH e AS (SELECT user_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS t FROM events),
  s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 1800 THEN 1 ELSE 0 END AS far FROM e),
  r AS (SELECT *, sum(far) OVER (PARTITION BY user_id ORDER BY t)::BIGINT AS run FROM s)
  SELECT user_id, run, count(*) AS n, min(t) AS first, max(t) AS last FROM r GROUP BY user_id, run""",
    "running_records": """SELECT user_id, event_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events) WHERE best IS NULL OR value > best""",
}
# character references by the rules of HTML, apart from the engine's own decoding: the longest known name that a
# reference begins with, closed or not, and numbers with what they stand for where they are no code points of text
_NAMED = "named(name, text) AS (VALUES " + ", ".join(f"({', '.join(chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in pair)})" for pair in sorted(html5.items())) + ")"
_C1 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160))
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
ORACLE["page_conservation"] = rf"""WITH {_NAMED}, bare AS (SELECT page_id, {_BARE} AS html_text FROM pages
), refs AS (SELECT DISTINCT unnest(regexp_extract_all(html_text, '{_REFERENCE}')) AS ref FROM bare
), numbers AS (SELECT ref, CASE WHEN ref[3] IN ('x', 'X') THEN TRY_CAST('0x' || regexp_extract(ref, '[xX]0*([0-9a-fA-F]+)', 1) AS BIGINT) ELSE TRY_CAST(regexp_extract(ref, '[0-9]+') AS BIGINT) END AS n FROM refs WHERE ref[2] = '#'
), known AS (
  SELECT ref, CASE WHEN n IS NULL OR n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN n = 13 THEN chr(13) WHEN n BETWEEN 128 AND 159 THEN '{_C1}'[n - 127]
    WHEN n BETWEEN 1 AND 8 OR n = 11 OR n BETWEEN 14 AND 31 OR n = 127 OR n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN '' ELSE chr(CAST(n AS INT)) END AS text FROM numbers
  UNION ALL SELECT ref, arg_max(text || ref[len(name) + 2 :], len(name)) FROM refs JOIN named ON starts_with(ref[2:], name) GROUP BY ref
), m AS (SELECT map(coalesce(list(ref), []), coalesce(list(text), [])) AS texts FROM known
), decoded AS (SELECT page_id, array_to_string(list_transform(regexp_extract_all(html_text, '{_REFERENCE}|[^&]+|&'), lambda x: coalesce(texts[x], x)), '') AS html_text FROM bare, m)
SELECT page_id AS filing_id, true AS passed, n AS n_source, n AS n_accounted, 0::BIGINT AS n_missing, 0::BIGINT AS n_extra FROM (
  SELECT page_id, CAST(len(regexp_extract_all(html_text, '[\p{{L}}\p{{N}}]+(?:[.,/\-&%][\p{{L}}\p{{N}}]+)*')) AS BIGINT) AS n FROM decoded)"""
_OWN_ITEMS = """era_items(era_id, item_id, expectation, part, order_index) AS (VALUES ('own', '1', 'required', 'I', 0), ('own', '2', 'required', 'I', 1), ('own', '3', 'required', 'I', 2), ('own', '5', 'required', 'II', 3),
  ('own', '8', 'required', 'II', 4), ('own', '7A', 'required', 'II', 5), ('own', '9A', 'required', 'II', 6), ('own', '15', 'required', 'III', 7), ('own', '1A', 'conditional', NULL, NULL), ('own', '6', 'absent', NULL, NULL))"""
ORACLE["own_ruleset"] = ("WITH " + ",\n".join([_OWN_ITEMS, "absent(era_id, item_id) AS (VALUES ('own', '3'))", *_CHAIN[:6]]) + """
SELECT v.filing_id, 'own' AS era_id, string_agg(concat_ws('/', i.item_id, i.part), ' ' ORDER BY i.ord) AS sequence, any_value(CASE WHEN v.n > 0 THEN 'failed' ELSE 'pass' END) AS status, any_value(v.n) AS n_violations
  FROM verdict v JOIN items i ON i.filing_id = v.filing_id GROUP BY v.filing_id""").replace("'era_2023'", "'own'")
ORACLE["tagged_evidence"] = r"""SELECT page_id AS filing_id, 'xbrl_mismatch' AS code, '8' AS item_id, CAST(a AS BIGINT) AS start, CAST(a + length('Item 8. Statements') + length(url) + 2 AS BIGINT) AS "end"
  FROM (SELECT page_id, url, 1 + length('Item 7. Discussion') + 1 + CASE WHEN title = '' THEN 0 ELSE length(title) + 1 END AS a FROM (SELECT page_id, regexp_replace(url, '[?].*', '') AS url, regexp_extract(html, '<h1>([^<&]*)', 1) AS title FROM pages)) WHERE page_id % 3 = 1"""
# a tokenizer of its own for pages, and where what it shows stays once chrome is cut out
ORACLE["page_provenance"] = r"""WITH toks AS (
  SELECT page_id, t[i] AS tok, i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<!--.*?-->|<style[^>]*>.*?</style>|<script[^>]*>.*?</script>|<[^>]*>|<|&[a-z]+;?|&|[^<&]+') AS t FROM pages), LATERAL unnest(range(1, len(t) + 1)) AS u(i)
), laid AS (SELECT *, sum(len(tok)) OVER (PARTITION BY page_id ORDER BY i) - len(tok) AS s, lower(regexp_extract(tok, '^</?([a-zA-Z0-9]+)', 1)) AS tag, regexp_extract(tok, '^&([a-z]+)', 1) AS ref FROM toks
), adds AS (
  SELECT page_id, i, s, CASE WHEN tok[1] <> '<' OR tok = '<' THEN 'dom_text' WHEN tag IN ('p', 'li', 'br', 'html', 'title', 'body', 'ul', 'div', 'article', 'h1', 'footer') THEN 'injected' END AS kind,
    CASE WHEN tok[1] = '<' AND tok <> '<' THEN chr(10) WHEN ref = '' THEN tok WHEN ref = 'amp' THEN '&' WHEN ref = 'quot' THEN '"' WHEN ref = 'copy' THEN '©' WHEN ref = 'middot' THEN '·' ELSE '&' || ref || ';' END AS text,
    CASE WHEN tok[1] = '<' AND tok <> '<' THEN s WHEN ref = '' THEN s + len(tok) ELSE s + len(ref) + 2 END AS e FROM laid
), near AS (SELECT *, lag(kind) OVER w AS pk, lag(text) OVER w AS pt FROM adds WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY page_id ORDER BY i)
), spans AS (
  SELECT page_id AS filing_id, i, kind, text, s, e, sum(len(text)) OVER (PARTITION BY page_id ORDER BY i) - len(text) AS a, sum(len(text)) OVER (PARTITION BY page_id ORDER BY i) AS b
  FROM near WHERE kind = 'dom_text' OR pk IS NULL OR (pk = 'dom_text' AND NOT suffix(pt, chr(10)))
), filings AS (SELECT filing_id, string_agg(text, '' ORDER BY i) AS text FROM spans GROUP BY filing_id
), """ + _CHAIN[1] + r""", cuts AS (SELECT filing_id, start AS a, start + len(line) AS b FROM marked WHERE chrome AND len(line) > 0
), ends AS (SELECT * FROM cuts UNION ALL SELECT filing_id, len(text), len(text) FROM filings
), stays AS (SELECT filing_id, coalesce(max(b) OVER w, 0) AS a, a AS b, coalesce(sum(b - a) OVER w, 0) AS gone FROM ends WINDOW w AS (PARTITION BY filing_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT x.filing_id, CAST(greatest(x.a, y.a) - gone AS BIGINT) AS start, CAST(least(x.b, y.b) - gone AS BIGINT) AS "end", CAST(CASE WHEN e <= s THEN s ELSE s + greatest(x.a, y.a) - x.a END AS BIGINT) AS source_start,
  CAST(CASE WHEN e <= s THEN s ELSE least(s + least(x.b, y.b) - x.a, e) END AS BIGINT) AS source_end, kind FROM spans x JOIN stays y ON y.filing_id = x.filing_id AND x.a < y.b AND y.a < x.b"""
_SUMMARY = """SELECT f.filing_id, f.fiscal_year_end, 'era_2023' AS era_id, (SELECT count(*) FROM items i WHERE i.filing_id = f.filing_id) AS n_items,
  (SELECT count(*) FROM items i WHERE i.filing_id = f.filing_id AND i.start IS NOT NULL AND i.merged_into IS NULL) AS n_spans,
  9 - (SELECT count(DISTINCT inv_no) FROM violations v WHERE v.filing_id = f.filing_id) AS n_passed, d.n AS n_violations,
  CASE WHEN d.n > 0 THEN 'failed' ELSE 'pass' END AS status, CASE WHEN d.n > 0 THEN 'low' ELSE 'high' END AS confidence FROM filings f JOIN verdict d ON d.filing_id = f.filing_id"""


def _by_era(depth: int, select: str) -> str:
    """The chain once for each era, over the filings of that era."""
    found = []
    for era, low, high, _ in eras.ERAS:
        own = " AND ".join([f"fye0 >= '{low}'"] * bool(low) + [f"fye0 < '{high}'"] * bool(high))
        text = _sql(depth, select).replace("'era_2023' AND", f"'{era}' AND").replace("= 'era_2023'", f"= '{era}'").replace("'era_2023' AS era_id", f"'{era}' AS era_id")
        found.append("SELECT * FROM (" + text.replace("FROM named0 GROUP BY f\n", f"FROM named0 GROUP BY f HAVING {own.replace('fye0', 'any_value(' + FYE_SQL + ')')}\n") + ")")
    return "\nUNION ALL\n".join(found)


ORACLE["dated_summary"] = _by_era(6, _SUMMARY)
_SHIPPED = "s AS (SELECT l_suppkey AS key, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS a, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INT) % 5 + 1 AS b FROM lineitem WHERE l_shipdate IS NOT NULL)"
_REACHED = "max(b) OVER (PARTITION BY key ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
ORACLE["shipping_islands"] = f"""WITH {_SHIPPED}, n AS (SELECT *, CASE WHEN a > coalesce({_REACHED}, -1) THEN 1 ELSE 0 END AS opened FROM s),
  g AS (SELECT *, sum(opened) OVER (PARTITION BY key ORDER BY a, b, opened DESC ROWS UNBOUNDED PRECEDING) AS island FROM n)
  SELECT key, CAST(min(a) AS BIGINT) AS start, CAST(max(b) AS BIGINT) AS "end" FROM g GROUP BY key, island"""
ORACLE["shipping_overlaps"] = f"""WITH {_SHIPPED}, n AS (SELECT *, coalesce({_REACHED}, 0) AS reached FROM s)
  SELECT key, count(*) FILTER (WHERE a < reached) AS n_overlaps, count(*) FILTER (WHERE a > reached) AS n_gaps FROM n GROUP BY key"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
