"""The whole plan: raw filings to rulers, items, violations and verdicts."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.functions.text import sized
from spanforge.operators import chrome, completeness, front, gate, html, provenance, segment
from spanforge.plans.eras import Ruleset, with_era
from spanforge.sources.shared import stored


@dataclass
class Segmented:
    """The tables of a run, keyed by filing_id."""

    filings: DataFrame
    ruler: DataFrame
    ledger: DataFrame
    front: DataFrame
    items: DataFrame
    residual: DataFrame
    violations: DataFrame
    verdicts: DataFrame
    #: What the HTML walk gave, and (filing_id, error) of the filings it failed on; none for plain texts.
    walked: DataFrame | None = None
    failed: DataFrame | None = None
    #: (filing_id, heads) of what was cut out of each text, in order.
    cuts: DataFrame | None = None


@dataclass
class Itemized:
    """The tables of a run as far as the items, which is all that some reports read. Items have no confidence yet."""

    filings: DataFrame
    ruler: DataFrame
    ledger: DataFrame
    front: DataFrame
    items: DataFrame
    cuts: DataFrame
    #: What the residual is told from.
    spans: DataFrame
    known: DataFrame


def itemize(texts: DataFrame, ruleset: Ruleset | None = None) -> Itemized:
    """texts(filing_id, text, fiscal_year_end) to their items, without residual, invariants and verdicts.

    Texts are read once: dates stay with the rulers, and a filing without a text has no more than a date.
    """
    cut = stored(sized(chrome.cut(texts.select("filing_id", "text", "fiscal_year_end"), "fiscal_year_end")), "ruler", key="filing_id")
    dates = cut.select("filing_id", "fiscal_year_end").unionByName(texts.where("text is null").select("filing_id", "fiscal_year_end"))
    cut = cut.drop("fiscal_year_end")
    filings = stored(ruleset.with_era(dates) if ruleset else with_era(dates), "filings")
    ruler, ledger = cut.drop("heads"), chrome.heads(cut)
    regions = stored(front.front_matter(ruler), "front")
    items, spans, known = segment.itemized(ruler, regions, filings, ruleset or Ruleset.standard(texts.sparkSession))
    return Itemized(filings, ruler, ledger, regions, items, cut.select("filing_id", "heads"), spans, known)


def segment_texts(texts: DataFrame, evidence: DataFrame | None = None, other: DataFrame | None = None, ruleset: Ruleset | None = None, facts: DataFrame | None = None) -> Segmented:
    """texts(filing_id, text, fiscal_year_end): plain or already normalized filings.

    evidence(filing_id, b_start, b_end) lies in the ruler; facts(filing_id, facts), arrays of
    stretches of the texts, are followed through excision and become evidence. A ruleset
    of the caller takes the place of the four eras.

    Tables that many branches read are stored, so no plan grows beyond one step.
    """
    rules = ruleset or Ruleset.standard(texts.sparkSession)
    own = itemize(texts, ruleset)
    filings, ruler, items, cut = own.filings, own.ruler, own.items, own.cuts
    residual = segment.left_over(ruler, own.spans, own.known)
    if facts is not None:
        moved = provenance.rows(provenance.after_excision(facts.select("filing_id", F.col("facts").alias("stretches")), cut))
        tagged = moved.select("filing_id", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
        evidence = tagged if evidence is None else evidence.select(*tagged.columns).unionByName(tagged)
    found = stored(gate.violations(filings, ruler, items, residual, evidence, other, rules), "violations")
    return Segmented(filings, ruler, own.ledger, own.front, gate.annotated(items, found), residual, found, gate.verdicts(filings, found), cuts=cut)


def segment_filings(filings: DataFrame, ruleset: Ruleset | None = None, tagged_evidence: bool = False) -> tuple[Segmented, DataFrame, DataFrame]:
    """filings(filing_id, raw_text, generation, fiscal_year_end), as ``sources.filings.prepared``
    gives them: the run, its completeness report, and its provenance. With tagged_evidence the
    numbers that a filing tags say where item 8 should be."""
    every = stored(html.walk(filings), "walked")
    walked, failed = every.where("error is null"), every.where("error is not null").select("filing_id", "error")
    filings = filings.join(failed, "filing_id", "left_anti")
    texts = walked.join(filings.select("filing_id", "fiscal_year_end"), "filing_id").select("filing_id", "text", "fiscal_year_end")
    run = segment_texts(texts, ruleset=ruleset, facts=walked.select("filing_id", "facts") if tagged_evidence else None)
    run = replace(run, walked=walked, failed=failed)
    baseline = filings.select("filing_id", html.baseline_text(F.col("raw_text"), F.col("generation")).alias("text"))
    report = completeness.conservation(filings, baseline, run.ruler, run.ledger)
    return run, report, provenance.after_excision(provenance.segments(walked), run.cuts)


def stretches_of(filings: DataFrame) -> DataFrame:
    """filing_id, stretches: the provenance that ``segment_filings`` gives, and nothing else. A walked filing stays in its row."""
    walked = stored(html.walk(filings), "walked").where("error is null")
    cut = chrome.cut(walked.select("filing_id", "text", "spans"), "spans")
    return provenance.shortened(cut.select("filing_id", provenance.stretches("spans").alias("stretches"), "heads"))


def ledger(run: Segmented) -> DataFrame:
    """filing_id, cls, visible, source_start, source_end, text of all that was taken out of a walked filing:
    page heads, feet and numbers, which showed, and hidden facts, which did not. Places are those of the source."""
    own = provenance.source_of(run.ledger, provenance.segments(run.walked))
    heads = own.select("filing_id", F.lit("page_header_footer").alias("cls"), "source_start", "source_end", "text")
    facts = run.walked.select("filing_id", F.inline("hidden")).select("filing_id", F.lit("xbrl_hidden").alias("cls"), "source_start", "source_end", "text")
    return heads.unionByName(facts).select("filing_id", "cls", (F.col("cls") != "xbrl_hidden").alias("visible"), "source_start", "source_end", "text")


def results(run: Segmented, stretches: DataFrame | None = None) -> DataFrame:
    """filing_id, result: one nested row per filing, for JSON.

    stretches(filing_id, stretches), where given, say where items lie in the source.
    """
    def listed(rows: DataFrame, order: list[str], each: list, name: str) -> DataFrame:
        per = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*each).alias("x")))), lambda v: v["x"])
        return rows.groupBy("filing_id").agg(per.alias(name))

    items = run.items
    if stretches is None:
        source = F.lit(None).cast("struct<kind:string,start:int,end:int>")
    else:
        found = provenance.source_of(items.where("start is not null").select("filing_id", "ord", "start", "end"), stretches)
        items = items.join(found.drop("start", "end"), ["filing_id", "ord"], "left")
        source = F.when(F.col("source_kind").isNotNull(), F.struct(F.col("source_kind").alias("kind"), F.col("source_start").alias("start"), F.col("source_end").alias("end")))
    own = ["item_id", "part", "start", "end", "status", "confidence", F.lit("deterministic").alias("method"), "reason_codes", source.alias("source_ref"), "merged_into"]
    parts = [
        listed(items, ["ord"], own, "items"),
        listed(run.residual, ["start", "end", "cls"], ["start", "end", "cls"], "residual"),
        listed(run.violations, ["inv_no", "seq"], ["code", "severity", gate.message().alias("message"), "item_id", "start", "end"], "violations"),
    ]
    checks = gate.invariant_results(run.filings, run.violations).groupBy("filing_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("inv_no", "invariant", "passed"))), lambda x: F.struct(x["invariant"], x["passed"]))).alias("invariant_results"))
    out = run.verdicts
    for part in (*parts, checks):
        out = out.join(part, "filing_id", "left")
    filled = [F.coalesce(n, F.array()).alias(n) for n in ("items", "residual")]
    report = F.struct(F.coalesce("violations", F.array()).alias("violations"), "invariant_results", "status", "confidence").alias("verification_report")
    return out.select("filing_id", F.struct(*filled, "status", "confidence", report).alias("result"))


def result_json(run: Segmented, stretches: DataFrame | None = None) -> DataFrame:
    """filing_id, json: the results with their nulls."""
    return results(run, stretches).select("filing_id", F.to_json("result", {"ignoreNullFields": "false"}).alias("json"))
