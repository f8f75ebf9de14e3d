"""A caller's ruleset: its faults are told, its order and absences are used."""

import pytest
from pyspark.sql import functions as F

from spanforge.plans import eras
from spanforge.plans.eras import Ruleset
from spanforge.plans.segmentation import segment_texts

WINDOWS, ITEMS = "era_id string, from_fye string, until_fye string", "era_id string, pos int, item_id string, expectation string, part string"


def made(spark, windows, items, absent=()):
    return spark.createDataFrame(windows, WINDOWS), spark.createDataFrame(items, ITEMS), spark.createDataFrame(list(absent), "era_id string, item_id string")


GOOD = [("a", None, "2010-01-01"), ("b", "2010-01-01", None)]
ONE = ("a", 0, "1", "required", "I")


@pytest.mark.parametrize(
    "windows, items, said",
    [
        (GOOD, [ONE, ("a", 1, "1", "required", "I")], "duplicate"),
        (GOOD, [("a", 0, "1", "required", None)], "no part"),
        (GOOD, [("a", 0, "6", "reserved", None)], "no part"),
        ([("a", "2023-12-15", "2021-08-09")], [ONE], "inverted window"),
        ([("a", None, "2011-01-01"), ("b", "2010-01-01", None)], [ONE], "overlaps b"),
        ([("a", None, None), ("b", "2010-01-01", None)], [ONE], "overlaps b"),
        ([("a", None, "2009-01-01"), ("b", "2010-01-01", None)], [ONE], "hole before b"),
        ([("a", None, "2010-01-01"), ("a", "2010-01-01", None)], [ONE], "declared twice"),
        (GOOD, [("z", 0, "1", "required", "I")], "of no era"),
        (GOOD, [("a", 0, "1", "wished", "I")], "no known expectation"),
    ],
)
def test_faults_are_told(spark, windows, items, said):
    with pytest.raises(ValueError, match=said):
        Ruleset.own(*made(spark, windows, items))


def test_what_is_allowed(spark):
    rules = Ruleset.own(*made(spark, GOOD, [ONE, ("a", 5, "6", "reserved", "II"), ("a", 3, "1A", "absent", "I"), ("a", 9, "16", "conditional", None), ("b", 2, "2", "required", "I"), ("b", 1, "1", "required", "I")]))
    assert {(r["era_id"], r["item_id"]): r["order_index"] for r in rules.items.collect()} == {("a", "1"): 0, ("a", "6"): 1, ("a", "1A"): None, ("a", "16"): None, ("b", "1"): 0, ("b", "2"): 1}
    assert [tuple(r) for r in rules.absent.collect()] == [("a", "6")]
    dates = spark.createDataFrame([(0, "2009-12-31"), (1, "2010-01-01"), (2, None)], "i int, fiscal_year_end string")
    assert {r["i"]: r["era_id"] for r in rules.with_era(dates).collect()} == {0: "a", 1: "b", 2: "b"}
    late = Ruleset.own(*made(spark, [("c", "2010-01-01", "2020-01-01")], []))
    assert {r["i"]: r["era_id"] for r in late.with_era(dates).collect()} == {0: None, 1: "c", 2: "c"}


def test_the_standard_rules_have_no_faults(spark):
    rules = Ruleset.standard(spark)
    assert eras.faults(rules.windows, rules.items).isEmpty()
    days = ["1994-06-30", "2005-11-30", "2005-12-01", "2021-08-08", "2021-08-09", "2023-12-14", "2023-12-15", None]
    df = spark.createDataFrame([(d,) for d in days], "fiscal_year_end string")
    assert rules.with_era(df).collect() == eras.with_era(df).collect()


def test_a_run_by_own_rules(spark):
    """Item 8 comes before item 2 here, and item 3 may be missing."""
    text = "Item 1. A\nbody one\nItem 8. B\nbody two\nItem 2. C\nbody three\n"
    rows = [("x", 0, "1", "required", "I"), ("x", 1, "8", "required", "I"), ("x", 2, "2", "required", "II"), ("x", 3, "3", "required", "II")]
    rules = Ruleset.own(*made(spark, [("x", None, None)], rows, [("x", "3")]))
    df = spark.createDataFrame([(1, text, None)], "filing_id long, text string, fiscal_year_end string")
    run = segment_texts(df, ruleset=rules)
    assert [r["item_id"] for r in run.items.orderBy("ord").collect()] == ["1", "8", "2"]
    assert run.violations.where(F.col("inv_no").isin(1, 6)).isEmpty() and run.filings.first()["era_id"] == "x"
