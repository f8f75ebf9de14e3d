"""The legal item order by fiscal year end, as small dimension tables.

Eras are half-open windows of ISO dates, compared as text. A missing date means
the newest era. Dimensions have a fixed size (four eras, 84 items), so they are
broadcast. A caller may bring a ruleset of the same form, as tables of at most
``MOST_RULES`` rows that keep its rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Name, first and following bound of the fiscal year end, and evidence of each era.
ERAS = [
    ("era_1994", None, "2005-12-01", "real_filing"),
    ("era_2005", "2005-12-01", "2021-08-09", "sec_primary"),
    ("era_2020", "2021-08-09", "2023-12-15", "real_filing"),
    ("era_2023", "2023-12-15", None, "real_filing"),
]
# The items of each era in their legal order: id, expectation and part (- is none).
ITEMS = {
    "era_1994": """
        1 required I
        1A absent -
        1B absent -
        2 required I
        3 required I
        4 required I
        5 required II
        6 required II
        7 required II
        7A absent -
        8 required II
        9 required II
        9A absent -
        10 required III
        11 required III
        12 required III
        13 required III
        14 required IV
    """,
    "era_2005": """
        1 required I
        1A required I
        1B required I
        2 required I
        3 required I
        4 required I
        5 required II
        6 required II
        7 required II
        7A required II
        8 required II
        9 required II
        9A required II
        9B required II
        10 required III
        11 required III
        12 required III
        13 required III
        14 required III
        15 required IV
        16 conditional -
    """,
    "era_2020": """
        1 required I
        1A required I
        1B required I
        2 required I
        3 required I
        4 required I
        5 required II
        6 reserved II
        7 required II
        7A required II
        8 required II
        9 required II
        9A required II
        9B required II
        9C conditional II
        10 required III
        11 required III
        12 required III
        13 required III
        14 required III
        15 required IV
        16 conditional -
    """,
    "era_2023": """
        1 required I
        1A required I
        1B required I
        1C required I
        2 required I
        3 required I
        4 required I
        5 required II
        6 reserved II
        7 required II
        7A required II
        8 required II
        9 required II
        9A required II
        9B required II
        9C conditional II
        10 required III
        11 required III
        12 required III
        13 required III
        14 required III
        15 required IV
        16 conditional -
    """,
}
# Items that may be missing in an era, and in all.
ABSENCES = {"era_1994": "11 12 13", "era_2005": "10 11 12 13 14", "era_2020": "10 11 12 13 14", "era_2023": "10 11 12 13 14"}
OPTIONAL = "1B 1C 9B 9C 16"
NEWEST = "era_2023"
EXPECTATIONS = ["required", "reserved", "absent", "conditional"]


def item_rows() -> list[tuple[str, int, str, str, str | None, int | None]]:
    """(era_id, pos, item_id, expectation, part, order_index); order over required and reserved items."""
    out = []
    for era, text in ITEMS.items():
        order = 0
        for pos, line in enumerate(filter(str.strip, text.split("\n"))):
            item, kind, part = line.split()
            expected = kind in ("required", "reserved")
            out.append((era, pos, item, kind, None if part == "-" else part, order if expected else None))
            order += expected
    return out


def eras(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ERAS, "era_id string, from_fye string, until_fye string, evidence_level string")


def era_items(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(item_rows(), "era_id string, pos int, item_id string, expectation string, part string, order_index int")


def permitted_absent(spark: SparkSession) -> DataFrame:
    """era_id, item_id: reserved items, permitted absences and optional items."""
    rows = {(e, i) for e, ids in ABSENCES.items() for i in ids.split()} | {(e[0], i) for e in ERAS for i in OPTIONAL.split()}
    rows |= {(e, i) for e, _, i, kind, *_ in item_rows() if kind == "reserved"}
    return spark.createDataFrame(sorted(rows), "era_id string, item_id string")


def with_era(filings: DataFrame, fye: str = "fiscal_year_end") -> DataFrame:
    """filings with ``era_id``: the window that holds the fiscal year end."""
    when = F.coalesce(F.col(fye), F.lit("9999-12-31"))
    out = F.lit(NEWEST)
    for era, _, until, _ in reversed(ERAS):
        if until:
            out = F.when(when < until, era).otherwise(out)
    return filings.withColumn("era_id", out)


def invalid_items(items: DataFrame) -> DataFrame:
    """Rows of an item dimension that break its rules: repeated ids, or a needed part that is missing."""
    twice = items.groupBy("era_id", "item_id").count().where("count > 1").select("era_id", "item_id", F.lit("duplicate").alias("fault"))
    partless = items.where("expectation in ('required', 'reserved') and part is null").select("era_id", "item_id", F.lit("no part").alias("fault"))
    return twice.unionByName(partless)


def invalid_eras(windows: DataFrame) -> DataFrame:
    return windows.where("from_fye >= until_fye").select("era_id", F.lit("inverted window").alias("fault"))


def era_labels(items: DataFrame) -> DataFrame:
    """era_id, label: the year an item order is known by, told from the items themselves."""
    per = items.groupBy("era_id").agg(F.collect_set(F.when(F.col("order_index").isNotNull(), F.col("item_id"))).alias("ids"), F.bool_or((F.col("item_id") == "6") & (F.col("expectation") == "reserved")).alias("six"))
    has = lambda x: F.array_contains("ids", x)
    return per.select("era_id", F.when(has("1C"), "2023").when(F.col("six"), "2020").when(has("1A"), "2005").otherwise("1994").alias("label"))


#: Rows of a table of a caller's ruleset, so that it can be broadcast.
MOST_RULES = 10_000


@dataclass
class Ruleset:
    """windows(era_id, from_fye, until_fye), items(era_id, item_id, expectation, part, order_index) and absent(era_id, item_id)."""

    windows: DataFrame
    items: DataFrame
    absent: DataFrame

    @classmethod
    def standard(cls, spark: SparkSession) -> Ruleset:
        return cls(eras(spark), era_items(spark), permitted_absent(spark))

    @classmethod
    def own(cls, windows: DataFrame, items: DataFrame, absent: DataFrame) -> Ruleset:
        """A caller's windows, items(era_id, pos, item_id, expectation, part) and absences, or an error that says what is wrong with them.

        Required and reserved items are ordered by pos; reserved ones may always be missing.
        """
        for table in (windows, items, absent):
            if table.limit(MOST_RULES + 1).count() > MOST_RULES:
                raise ValueError(f"a table of a ruleset has more than {MOST_RULES} rows")
        found = faults(windows, items).orderBy("era_id", "item_id", "fault").limit(20).collect()
        if found:
            raise ValueError("ruleset: " + "; ".join(" ".join(x for x in (r["era_id"], r["item_id"], r["fault"]) if x) for r in found))
        needed = F.col("expectation").isin("required", "reserved")
        order = F.when(needed, F.row_number().over(Window.partitionBy("era_id", needed).orderBy("pos")) - 1).cast("int")
        reserved = items.where("expectation = 'reserved'").select("era_id", "item_id")
        return cls(windows, items.withColumn("order_index", order), absent.select("era_id", "item_id").union(reserved).distinct())

    def with_era(self, filings: DataFrame, fye: str = "fiscal_year_end") -> DataFrame:
        """filings with ``era_id``: the window that holds the year end; the newest without a date, null outside all windows."""
        w = F.broadcast(self.windows.select("era_id", "from_fye", "until_fye"))
        newest = self.windows.agg(F.max_by("era_id", F.struct(F.col("from_fye").isNotNull(), "from_fye")).alias("newest"))
        when = F.col(fye)
        inside = (F.col("from_fye").isNull() | (F.col("from_fye") <= when)) & (F.col("until_fye").isNull() | (when < F.col("until_fye")))
        dated = filings.join(w, inside, "left").crossJoin(F.broadcast(newest))  # one row
        return dated.select(*filings.columns, F.when(when.isNull(), F.col("newest")).otherwise(F.col("era_id")).alias("era_id"))


def faults(windows: DataFrame, items: DataFrame) -> DataFrame:
    """era_id, item_id, fault: what breaks the rules of a ruleset, told by windows over its few rows."""
    none = F.lit(None).cast("string").alias("item_id")
    w = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_first("from_fye"), "era_id")
    following = F.lead("from_fye").over(w)
    after = windows.withColumns({"next": following, "later": F.lead("era_id").over(w)}).where("later is not null")
    clash = after.where("next is null or until_fye is null or until_fye > next").select("era_id", none, F.concat(F.lit("overlaps "), F.col("later")).alias("fault"))
    hole = after.where("until_fye < next").select("era_id", none, F.concat(F.lit("leaves a hole before "), F.col("later")).alias("fault"))
    twice = windows.groupBy("era_id").count().where("count > 1").select("era_id", none, F.lit("declared twice").alias("fault"))
    known = windows.select("era_id").distinct()
    strange = items.join(known, "era_id", "left_anti").select("era_id", "item_id", F.lit("is of no era").alias("fault"))
    odd = items.where(~F.coalesce(F.col("expectation").isin(EXPECTATIONS), F.lit(False))).select("era_id", "item_id", F.lit("has no known expectation").alias("fault"))
    out = invalid_eras(windows).select("era_id", none, "fault").unionByName(invalid_items(items))
    for part in (clash, hole, twice, strange, odd):
        out = out.unionByName(part)
    return out
