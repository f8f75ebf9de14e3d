"""Reports over a run: summaries, ordered item lists and spot checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators.gate import NAMES
from spanforge.operators.segment import with_body
from spanforge.plans.segmentation import Itemized, Segmented, ledger

SHORT = 200


def summary(run: Segmented) -> DataFrame:
    """One row per filing: year end, era, items, items with a span, checks passed, violations, verdict.
    Filings that could not be walked have a row with status ``error`` and the ``error``."""
    items = run.items.groupBy("filing_id").agg(F.count("*").alias("n_items"), F.count_if(F.col("start").isNotNull() & F.col("merged_into").isNull()).alias("n_spans"))
    failed = run.violations.groupBy("filing_id").agg(F.count_distinct("inv_no").alias("n_failed"))
    out = run.filings.join(run.verdicts, "filing_id").join(items, "filing_id", "left").join(failed, "filing_id", "left").na.fill(0, ["n_items", "n_spans", "n_failed"])
    out = out.select("filing_id", "fiscal_year_end", "era_id", "n_items", "n_spans", (F.lit(len(NAMES)) - F.col("n_failed")).cast("long").alias("n_passed"), "n_violations", "status", "confidence")
    if run.failed is None:
        return out
    return out.unionByName(run.failed.select("filing_id", F.lit("error").alias("status"), "error"), allowMissingColumns=True)


def item_sequence(run: Segmented | Itemized) -> DataFrame:
    """filing_id, sequence: item ids and parts in order, as text."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("ord", "item_id", "part"))), lambda x: F.concat_ws("/", x["item_id"], x["part"]))
    return run.items.groupBy("filing_id").agg(F.array_join(each, " ").alias("sequence"))


def classes(run: Segmented) -> DataFrame:
    """filing_id and the number of residual spans of each class, one column per class."""
    known = ["cover_page", "toc", "part_divider", "signatures", "unclassified"]
    return run.residual.groupBy("filing_id").pivot("cls", known).count().na.fill(0)


def ledger_classes(run: Segmented) -> DataFrame:
    """filing_id, cls, visible, n, n_chars, first: what was taken out of each walked filing, by class."""
    return ledger(run).groupBy("filing_id", "cls", "visible").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"), F.min("source_start").alias("first"))


def spot_check(run: Segmented | Itemized) -> DataFrame:
    """Per item span its first 90 and last 60 characters, the distance from the span before, and whether it is short for a main item."""
    spans = run.items.where("start is not null").select("filing_id", "item_id", "status", "start", "end")
    cut = with_body(spans, run.ruler, head=lambda x, body: F.left(body, F.lit(90)), tail=lambda x, body: F.right(body, F.lit(60)))
    w = Window.partitionBy("filing_id").orderBy("start")
    short = ~F.col("item_id").rlike(r"\p{L}$") & (F.col("status") == "extracted") & (F.col("end") - F.col("start") < SHORT)
    return cut.select("*", (F.col("start") - F.lag("end").over(w)).alias("delta"), short.alias("short"))


SHOWN = 8


def text_report(run: Segmented) -> DataFrame:
    """filing_id, report: a few lines of text on each filing."""
    line = lambda x, a, b: F.concat_ws(" ", x, a, b)
    items = run.items.groupBy("filing_id").agg(F.array_sort(F.collect_list(F.struct("ord", "item_id", "status", "start", "end"))).alias("i"))
    bad = run.violations.groupBy("filing_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("inv_no", "seq", "code", "item_id"))), 1, SHOWN).alias("v"))
    out = run.verdicts.join(items, "filing_id", "left").join(bad, "filing_id", "left")
    listed = F.transform("i", lambda x: line(F.concat(F.lit("item "), x["item_id"]), x["status"], F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))))
    broken = F.transform("v", lambda x: F.concat_ws(" ", F.lit("violation"), x["code"], x["item_id"]))
    return out.select("filing_id", F.concat_ws("\n", F.concat_ws(" ", F.lit("status"), "status", "confidence"), F.concat_ws("\n", listed), F.concat_ws("\n", broken)).alias("report"))
