"""Segmentation: item headings, the legal order, item spans and what is left over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.arrays import let
from spanforge.functions.intervals import gaps, outside
from spanforge.functions.text import END, GAP, is_blank, lengths, piece, some_lines, strip
from spanforge.plans.eras import Ruleset
from spanforge.sources.shared import stored

# Fixed patterns: what opens an item, a part and the signatures, and what says that an item is reserved or elsewhere.
HEADING = rf"(?i)^({GAP}*)(items?){GAP}+(\p{{Nd}}{{1,2}})([a-z])?(?:{GAP}+and{GAP}+(\p{{Nd}}{{1,2}})([a-z])?)?{END}"
DIVIDER = rf"(?i)^{GAP}*part{GAP}+(?:i{{1,3}}|iv){END}{GAP}*[.:–—-]?{GAP}*$"
SIGNATURES = rf"(?i)^{GAP}*signatures?{GAP}*$"
RESERVED = rf"(?i)(?<![\p{{L}}\p{{N}}_])reserved{END}"
BY_REFERENCE = r"(?i)incorporated[\p{IsWhite_Space}\x1c-\x1f]+by[\p{IsWhite_Space}\x1c-\x1f]+reference|proxy[\p{IsWhite_Space}\x1c-\x1f]+statement|see[\p{IsWhite_Space}\x1c-\x1f]+proxy"
RESERVED_LENGTH = 80
PART_THREE = ["10", "11", "12", "13", "14"]


def headings(lines: DataFrame) -> DataFrame:
    """filing_id, start, enum_start, item_id, merged_id, is_plural of the lines that open an item."""
    g = lambda i: F.regexp_extract("line", HEADING, i)
    found = lines.where(F.col("line").rlike(HEADING))
    merged = F.when(g(5) != "", F.concat(g(5), F.upper(g(6))))
    return found.select("filing_id", "start", (F.col("start") + F.length(g(1))).alias("enum_start"), F.concat(g(3), F.upper(g(4))).alias("item_id"), merged.alias("merged_id"), (F.lower(g(2)) == "items").alias("is_plural"))


def accepted(found: DataFrame, era_of: DataFrame, rules: Ruleset | None = None) -> DataFrame:
    """The headings that advance the legal order: beyond all known ones before them.

    The last accepted index is the greatest of all before, so a running maximum decides.
    """
    order = (rules or Ruleset.standard(found.sparkSession)).items.where("order_index is not null").select("era_id", "item_id", "order_index")
    known = found.join(era_of.select("filing_id", "era_id"), "filing_id").join(F.broadcast(order), ["era_id", "item_id"])
    w = Window.partitionBy("filing_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return known.withColumn("best", F.coalesce(F.max("order_index").over(w), F.lit(-1))).where("order_index > best").drop("best")


def status_of(item_id: Column, body: Column) -> Column:
    reserved = body.rlike(RESERVED) & (F.length(strip(body)) <= RESERVED_LENGTH)
    return F.when(reserved, "reserved").when(item_id.isin(PART_THREE) & body.rlike(BY_REFERENCE), "incorporated_by_reference").otherwise("extracted")


def with_body(spans: DataFrame, ruler: DataFrame, **made) -> DataFrame:
    """spans(filing_id, start, end, ...) with columns made from the text they cover.

    The spans of a filing are gathered and meet its text in one row, so texts are
    not repeated per span. Each body is cut out once, for all that is made from it.
    """
    names = [c for c in spans.columns if c != "filing_id"]
    per = spans.groupBy("filing_id").agg(F.collect_list(F.struct(*names)).alias("s"))
    both = per.join(ruler.select("filing_id", "text"), "filing_id")
    told = lambda x, body: F.struct(*[x[c].alias(c) for c in names], *[f(x, body).alias(k) for k, f in made.items()])
    each = F.transform("s", lambda x: let(piece(F.col("text"), x["start"], x["end"]), lambda body: told(x, body)))
    return both.select("filing_id", F.inline(each))


def structure(ruler: DataFrame, front: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headings and part dividers outside the front matter, and the signatures."""
    lines = stored(some_lines(ruler, "\n", lambda x: x.rlike(HEADING) | x.rlike(DIVIDER) | x.rlike(SIGNATURES)), "openings")
    regions = front.where("cls in ('cover_page', 'toc')").select("filing_id", "start", "end")
    found = outside(headings(lines), regions, "enum_start")
    divided = lines.where(F.col("line").rlike(DIVIDER)).select("filing_id", "start", (F.col("start") + F.length("line")).alias("end"))
    ends = lengths(ruler).withColumnRenamed("length", "end")
    signed = lines.where(F.col("line").rlike(SIGNATURES)).groupBy("filing_id").agg(F.max("start").alias("start")).join(ends, "filing_id")
    return found, outside(divided, regions, "start"), signed


def item_spans(taken: DataFrame, cuts: DataFrame, sizes: DataFrame) -> DataFrame:
    """taken with ``end``: the next item, or the first cut before it, or the end of the text.

    Items and cuts lie on one line, so the next of each is a window function over it.
    """
    line = taken.withColumn("cut", F.lit(None).cast("int")).unionByName(cuts.select("filing_id", "start", F.col("start").alias("cut")), allowMissingColumns=True)
    ahead = Window.partitionBy("filing_id").orderBy("start").rangeBetween(1, Window.unboundedFollowing)
    own = F.when(F.col("item_id").isNotNull(), F.col("start"))
    nexts = line.withColumns({"next": F.min(own).over(ahead), "stop": F.min("cut").over(ahead)}).where("item_id is not null")
    return nexts.join(sizes, "filing_id").withColumn("end", F.least(F.coalesce("next", "length"), F.coalesce("stop", "length"))).drop("next", "stop", "cut", "length")


def itemized(ruler: DataFrame, front: DataFrame, era_of: DataFrame, rules: Ruleset | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """items(filing_id, ord, item_id, part, start, end, status, merged_into) of rulers(filing_id, text), and what
    ``left_over`` needs: the spans of the items, and known(filing_id, start, end, cls) of the stretches of a class."""
    rules = rules or Ruleset.standard(ruler.sparkSession)
    sizes = lengths(ruler)
    found, divided, signed = structure(ruler, front)
    taken = accepted(found, era_of, rules)
    spans = item_spans(taken, divided.select("filing_id", "start").unionByName(signed.select("filing_id", "start")), sizes)
    spans = stored(spans.select("filing_id", "era_id", "item_id", "merged_id", "start", "end"), "spans")
    judged = with_body(spans, ruler, status=lambda x, body: F.when(x["merged_id"].isNotNull(), "merged").otherwise(status_of(x["item_id"], body)))
    own = F.struct(F.lit(0).alias("k"), F.col("item_id").alias("id"), F.col("start").alias("s"), F.col("end").alias("e"), F.lit(None).cast("string").alias("into"))
    member = F.struct(F.lit(1).alias("k"), F.col("merged_id").alias("id"), F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e"), F.col("item_id").alias("into"))
    rows = judged.withColumn("r", F.explode(F.when(F.col("merged_id").isNull(), F.array(own)).otherwise(F.array(own, member))))
    parts = F.broadcast(rules.items.where("part is not null").select("era_id", F.col("item_id").alias("p_id"), "part"))
    parted = rows.join(parts, (rows["era_id"] == parts["era_id"]) & (F.col("r.id") == F.col("p_id")), "left")
    w = Window.partitionBy("filing_id").orderBy("start", "r.k")
    items = parted.select("filing_id", (F.row_number().over(w) - 1).alias("ord"), F.col("r.id").alias("item_id"), "part", F.col("r.s").alias("start"), F.col("r.e").alias("end"), "status", F.col("r.into").alias("merged_into"))
    known = front.select("filing_id", "start", "end", "cls").unionByName(divided.withColumn("cls", F.lit("part_divider"))).unionByName(signed.select("filing_id", "start", "end", F.lit("signatures").alias("cls")))
    return stored(items, "items"), spans, known


def left_over(ruler: DataFrame, spans: DataFrame, known: DataFrame) -> DataFrame:
    """residual(filing_id, ord, start, end, cls): the known stretches, and those that are neither blank nor claimed."""
    sizes = lengths(ruler)
    claimed = spans.select("filing_id", "start", "end").unionByName(known.select("filing_id", "start", "end"))
    first = spans.groupBy("filing_id").agg(F.min("start").alias("first"))
    open_ = gaps(claimed, sizes).join(first, "filing_id", "left").join(sizes, "filing_id")
    cls = F.when(F.col("start") < F.coalesce("first", "length"), "cover_page").otherwise("unclassified")
    left = with_body(open_.select("filing_id", "start", "end", cls.alias("cls")), ruler, blank=lambda x, body: is_blank(body)).where("not blank").drop("blank")
    ranked = F.when(F.col("cls") == "cover_page", 0).when(F.col("cls") == "toc", 1).when(F.col("cls") == "part_divider", 2).when(F.col("cls") == "signatures", 3).otherwise(4)
    residual = known.withColumn("g", ranked).unionByName(left.withColumn("g", F.lit(4)))
    w = Window.partitionBy("filing_id").orderBy("g", "start")
    return stored(residual.select("filing_id", (F.row_number().over(w) - 1).alias("ord"), "start", "end", "cls"), "residual")


def segment(ruler: DataFrame, front: DataFrame, era_of: DataFrame, rules: Ruleset | None = None) -> tuple[DataFrame, DataFrame]:
    """The items of ``itemized`` and the residual of ``left_over``."""
    items, spans, known = itemized(ruler, front, era_of, rules)
    return items, left_over(ruler, spans, known)
