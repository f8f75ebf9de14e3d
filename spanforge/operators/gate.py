"""The nine invariants: each gives violations(filing_id, inv_no, seq, code, item_id, start, end).

All are hard. items and residual are as ``segment`` makes them, or the caller's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.intervals import cursor, gaps, overlaps
from spanforge.functions.text import is_blank, lengths
from spanforge.operators.segment import with_body
from spanforge.plans.eras import Ruleset

NAMES = ["order", "no_overlap", "coverage", "residual_sanity", "legal_structure", "should_exist", "item8_xbrl", "cross_method", "cover_dominance"]
#: What a violation says, by its code.
MESSAGES = {
    "order_violation": "behind an item that follows it in the legal order",
    "overlap": "begins before the item ahead of it ends",
    "coverage_overlap": "begins before the spans ahead of it end",
    "coverage_gap": "text that no span holds",
    "unclassified_residual": "a long stretch that is of no class",
    "illegal_structure": "merged items that are no neighbours",
    "missing_expected_item": "expected and not there",
    "xbrl_mismatch": "away from its tagged facts",
    "cross_method_disagree": "begins elsewhere by another method",
    "oversized_cover_page": "a cover page of nearly the whole text",
}
LONG_UNCLASSIFIED = 200
TOLERANCE = 5
COVER_SHARE = 0.9
SUB_ITEM = r"\p{L}$"


def _violations(rows: DataFrame, inv_no: int, code, item_id=None, start="start", end="end") -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    item = F.lit(None).cast("string") if item_id is None else F.col(item_id)
    place = [F.lit(None).cast("int").alias(n) if c is None else F.col(c).cast("int").alias(n) for n, c in (("start", start), ("end", end))]
    return rows.select("filing_id", F.lit(inv_no).alias("inv_no"), code.alias("code"), item.alias("item_id"), *place)


def _spanned(items: DataFrame) -> DataFrame:
    return items.where("merged_into is null and start is not null")


def _indexed(items: DataFrame, era_of: DataFrame, rules: Ruleset | None) -> DataFrame:
    order = F.broadcast((rules or Ruleset.standard(items.sparkSession)).items.select("era_id", "item_id", "order_index"))
    return items.join(era_of.select("filing_id", "era_id"), "filing_id").join(order, ["era_id", "item_id"], "left")


def order(items: DataFrame, era_of: DataFrame, rules: Ruleset | None = None) -> DataFrame:
    w = Window.partitionBy("filing_id").orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, -1)
    known = _indexed(_spanned(items), era_of, rules).where("order_index is not null").withColumn("best", F.max("order_index").over(w))
    return _violations(known.where("order_index <= best"), 1, "order_violation", "item_id")


def no_overlap(items: DataFrame) -> DataFrame:
    w = Window.partitionBy("filing_id").orderBy("start", "ord")
    pairs = _spanned(items).withColumns({"p_start": F.lag("start").over(w), "p_end": F.lag("end").over(w)})
    return _violations(pairs.where(overlaps("p_start", "p_end", "start", "end")), 2, "overlap", "item_id")


def geometry(items: DataFrame, residual: DataFrame) -> DataFrame:
    """filing_id, start, end, k: all spans, items before residuals, each in its order."""
    own = _spanned(items).select("filing_id", "start", "end", F.col("ord").alias("k"))
    return own.unionByName(residual.select("filing_id", "start", "end", (F.col("ord") + 1_000_000_000).alias("k")))


def coverage(ruler: DataFrame, items: DataFrame, residual: DataFrame) -> DataFrame:
    spans = geometry(items, residual)
    clash = _violations(spans.withColumn("from", cursor("filing_id", "k")).where("start < from"), 3, "coverage_overlap")
    left = with_body(gaps(spans, lengths(ruler)), ruler, blank=lambda x, body: is_blank(body)).where("not blank")
    return clash.unionByName(_violations(left, 3, "coverage_gap"))


def residual_sanity(residual: DataFrame) -> DataFrame:
    return _violations(residual.where((F.col("cls") == "unclassified") & (F.col("end") - F.col("start") > LONG_UNCLASSIFIED)), 4, "unclassified_residual")


def legal_structure(items: DataFrame, era_of: DataFrame, rules: Ruleset | None = None) -> DataFrame:
    """Merged items must be neighbours in the legal order, sub-items between them aside."""
    merged = items.where("merged_into is not null")
    members = merged.select("filing_id", F.col("merged_into").alias("rep"), "item_id").unionByName(merged.select("filing_id", F.col("merged_into").alias("rep"), F.col("merged_into").alias("item_id"))).distinct()
    groups = _indexed(members, era_of, rules).groupBy("filing_id", "era_id", "rep").agg(F.array_sort(F.collect_set("item_id")).alias("ids"), F.min("order_index").alias("low"), F.max("order_index").alias("high"), F.bool_or(F.col("order_index").isNull()).alias("unknown"))
    groups = groups.dropDuplicates(["filing_id", "ids"])
    main = F.broadcast((rules or Ruleset.standard(items.sparkSession)).items.where(F.col("order_index").isNotNull() & ~F.col("item_id").rlike(SUB_ITEM)).select(F.col("era_id").alias("e"), F.col("item_id").alias("between"), F.col("order_index").alias("i")))
    split = groups.join(main, (F.col("era_id") == F.col("e")) & (F.col("i") > F.col("low")) & (F.col("i") < F.col("high")) & ~F.array_contains("ids", F.col("between")), "left_semi").where("not unknown")
    return _violations(groups.where("unknown").unionByName(split), 5, "illegal_structure", None, None, None)


def should_exist(filings: DataFrame, items: DataFrame, rules: Ruleset | None = None) -> DataFrame:
    rules = rules or Ruleset.standard(items.sparkSession)
    needed = rules.items.where("order_index is not null").join(rules.absent, ["era_id", "item_id"], "left_anti").select("era_id", "item_id")
    missing = filings.select("filing_id", "era_id").join(F.broadcast(needed), "era_id").join(items.select("filing_id", "item_id"), ["filing_id", "item_id"], "left_anti")
    return _violations(missing, 6, "missing_expected_item", "item_id", None, None)


def item8_xbrl(items: DataFrame, evidence: DataFrame | None) -> DataFrame | None:
    """evidence(filing_id, b_start, b_end): where given, the first item 8 must touch it."""
    if evidence is None:
        return None
    w = Window.partitionBy("filing_id").orderBy("ord")
    eight = items.where("item_id = '8' and start is not null").withColumn("n", F.row_number().over(w)).where("n = 1")
    given = eight.join(evidence.select("filing_id").distinct(), "filing_id", "left_semi")
    e = evidence.select(F.col("filing_id").alias("f2"), "b_start", "b_end")
    return _violations(given.join(e, (F.col("filing_id") == F.col("f2")) & overlaps("start", "end", "b_start", "b_end"), "left_anti"), 7, "xbrl_mismatch", "item_id")


def cross_method(items: DataFrame, other: DataFrame | None) -> DataFrame | None:
    """other(filing_id, ord, item_id, start, end): starts must agree within a tolerance; of equal ids with a span the last counts."""
    if other is None:
        return None
    last = other.where("start is not null").groupBy("filing_id", "item_id").agg(F.max_by(F.struct("start", "end"), "ord").alias("o"))
    both = items.where("start is not null").join(last, ["filing_id", "item_id"])
    return _violations(both.where(F.abs(F.col("start") - F.col("o.start")) > TOLERANCE), 8, "cross_method_disagree", "item_id")


def cover_dominance(ruler: DataFrame, residual: DataFrame) -> DataFrame:
    covers = residual.where("cls = 'cover_page'").join(lengths(ruler).where("length > 0"), "filing_id")
    return _violations(covers.where((F.col("end") - F.col("start")) / F.col("length") >= COVER_SHARE), 9, "oversized_cover_page")


def violations(filings: DataFrame, ruler: DataFrame, items: DataFrame, residual: DataFrame, evidence: DataFrame | None = None, other: DataFrame | None = None, rules: Ruleset | None = None) -> DataFrame:
    """All violations, numbered within their invariant by place and item."""
    found = [order(items, filings, rules), no_overlap(items), coverage(ruler, items, residual), residual_sanity(residual), legal_structure(items, filings, rules), should_exist(filings, items, rules), item8_xbrl(items, evidence), cross_method(items, other), cover_dominance(ruler, residual)]
    out = None
    for f in found:
        if f is not None:
            out = f if out is None else out.unionByName(f)
    w = Window.partitionBy("filing_id", "inv_no").orderBy("start", "end", "item_id")
    return out.withColumn("seq", (F.row_number().over(w) - 1).cast("int")).select("filing_id", "inv_no", "seq", "code", F.lit("hard").alias("severity"), "item_id", "start", "end")


def message() -> Column:
    """A sentence on a violation: the item if there is one, what is wrong, and where."""
    said = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    place = F.concat(F.lit("at "), F.col("start"), F.lit(" to "), F.col("end"))
    return F.concat_ws(" ", F.concat(F.lit("item "), F.col("item_id")), F.element_at(said, F.col("code")), place)


def invariant_results(filings: DataFrame, found: DataFrame) -> DataFrame:
    """filing_id, invariant, passed: nine rows per filing."""
    names = found.sparkSession.createDataFrame([(i + 1, n) for i, n in enumerate(NAMES)], "inv_no int, invariant string")
    each = filings.select("filing_id", F.explode(F.sequence(F.lit(1), F.lit(len(NAMES)))).alias("inv_no")).join(F.broadcast(names), "inv_no")
    failed = found.select("filing_id", "inv_no").distinct().withColumn("failed", F.lit(True))
    return each.join(failed, ["filing_id", "inv_no"], "left").select("filing_id", "inv_no", "invariant", F.col("failed").isNull().alias("passed"))


def verdicts(filings: DataFrame, found: DataFrame) -> DataFrame:
    """filing_id, status, confidence, n_violations of every filing."""
    per = found.groupBy("filing_id").agg(F.count("*").alias("n"), F.bool_or(F.col("severity") == "hard").alias("hard"))
    status = F.when(F.col("hard"), "failed").when(F.col("n") > 0, "review").otherwise("pass")
    tier = F.when(F.col("hard"), "low").when(F.col("n") > 0, "medium").otherwise("high")
    return filings.select("filing_id").join(per, "filing_id", "left").select("filing_id", status.alias("status"), tier.alias("confidence"), F.coalesce("n", F.lit(0)).cast("long").alias("n_violations"))


def annotated(items: DataFrame, found: DataFrame) -> DataFrame:
    """items with their confidence and the codes of their violations, in order and without repeats."""
    per = found.where("item_id is not null").groupBy("filing_id", "item_id").agg(F.bool_or(F.col("severity") == "hard").alias("hard"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("inv_no", "seq", "code"))), lambda x: x["code"])).alias("codes"))
    tier = F.when(F.col("hard"), "low").when(F.col("status").isin("reserved", "incorporated_by_reference"), "high").when(F.col("status") == "failed", "low").otherwise("medium")
    return items.join(per, ["filing_id", "item_id"], "left").select(*items.columns, tier.alias("confidence"), F.coalesce("codes", F.array().cast("array<string>")).alias("reason_codes"))
