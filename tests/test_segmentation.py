"""The plan on a small complete filing, and each invariant with a case that passes and one that does not."""

import json

import pytest
from pyspark.sql import functions as F

from spanforge.operators import gate, html
from spanforge.plans import eras, reports
from spanforge.plans.segmentation import result_json, segment_filings, segment_texts
from spanforge.sources.corpus import EXPECTED
from spanforge.sources.filings import newest_annual, prepared, resolve_cik

HEAD = "NORTHWIND TOOLS INC - FORM 10-K"


def whole_filing() -> str:
    toc = "\n".join(f"Item {x}. Heading {'.' * 20} {3 + i}" for i, x in enumerate(EXPECTED))
    out = ["NORTHWIND TOOLS INC", "Annual report for the fiscal year ended December 31, 2023", "", "TABLE OF CONTENTS", toc, ""]
    for i, x in enumerate(EXPECTED):
        if x in ("1", "5", "10", "15"):
            out += [HEAD, f"PART {['I', 'II', 'III', 'IV'][['1', '5', '10', '15'].index(x)]}"]
        else:
            out.append(HEAD)
        body = "[Reserved]" if x == "6" else "This part is incorporated by reference to our proxy statement." if x in ("10", "11", "12", "13", "14") else f"Paragraph number {x} has words of its own about matter {x} and nothing more."
        out += [f"ITEM {x}. HEADING", body, f"Page {3 + i}", ""]
    return "\n".join([*out, "SIGNATURES", "Signed by an officer of the company."])


@pytest.fixture(scope="module")
def run(spark):
    df = spark.createDataFrame([(1, whole_filing(), None), (2, "No headings at all, only prose.", "1994-06-30"), (3, "", None)], "filing_id long, text string, fiscal_year_end string")
    return segment_texts(df)


def test_complete_filing_passes(run):
    got = {r["filing_id"]: (r["status"], r["confidence"]) for r in run.verdicts.collect()}
    assert got[1] == ("pass", "high")
    assert got[2] == ("failed", "low")  # all of it is taken for a cover page
    items = {r["item_id"]: r for r in run.items.where("filing_id = 1").collect()}
    assert list(items) and set(items) == set(EXPECTED)
    assert items["6"]["status"] == "reserved" and items["6"]["confidence"] == "high"
    assert all(items[x]["status"] == "incorporated_by_reference" for x in ("10", "11", "12", "13", "14"))
    assert items["1"]["status"] == "extracted" and items["1"]["part"] == "I"
    assert {r["cls"] for r in run.residual.where("filing_id = 1").collect()} == {"cover_page", "toc", "part_divider", "signatures"}


def test_chrome_is_in_the_ledger(run):
    texts = [r["text"] for r in run.ledger.where("filing_id = 1").collect()]
    assert texts.count(HEAD) == 21 and "Page 3" in texts


def test_reports(run):
    s = {r["filing_id"]: r for r in reports.summary(run).collect()}
    assert (s[1]["n_items"], s[1]["n_passed"], s[1]["era_id"]) == (21, 9, "era_2023") and s[2]["era_id"] == "era_1994"
    doc = {r["filing_id"]: json.loads(r["json"]) for r in result_json(run).collect()}[1]
    assert doc["status"] == "pass" and len(doc["items"]) == 21 and all(doc["verification_report"]["invariant_results"].values())
    assert all(i["method"] == "deterministic" and i["source_ref"] is None for i in doc["items"])


def _gate(spark, items, residual, length=100, fye=None, other=None, evidence=None, text=None):
    filings = eras.with_era(spark.createDataFrame([(1, fye)], "filing_id long, fiscal_year_end string"))
    ruler = spark.createDataFrame([(1, text or "x" * length)], "filing_id long, text string")
    it = spark.createDataFrame([(1, i, *x) for i, x in enumerate(items)], "filing_id long, ord int, item_id string, start int, end int, merged_into string").withColumn("status", F.lit("extracted"))
    rs = spark.createDataFrame([(1, i, *x) for i, x in enumerate(residual)], "filing_id long, ord int, start int, end int, cls string")
    ev = spark.createDataFrame([(1, *x) for x in evidence], "filing_id long, b_start int, b_end int") if evidence is not None else None
    ot = spark.createDataFrame([(1, i, *x) for i, x in enumerate(other)], "filing_id long, ord int, item_id string, start int, end int") if other is not None else None
    return {r["code"] for r in gate.violations(filings, ruler, it, rs, ev, ot).collect()} - {"missing_expected_item"}


@pytest.mark.parametrize(
    ("items", "residual", "more", "codes"),
    [
        ([("1", 0, 50, None), ("1A", 50, 100, None)], [], {}, set()),
        ([("1A", 0, 50, None), ("1", 50, 100, None)], [], {}, {"order_violation"}),
        ([("1", 0, 60, None), ("2", 50, 100, None)], [], {}, {"overlap", "coverage_overlap"}),
        ([("1", 0, 50, None), ("2", 60, 100, None)], [], {}, {"coverage_gap"}),
        ([("1", 0, 50, None), ("2", 60, 100, None)], [], {"text": "x" * 50 + " " * 10 + "x" * 40}, set()),
        ([("1", 0, 50, None)], [(50, 100, "unclassified")], {}, set()),
        ([("1", 0, 50, None)], [(50, 300, "unclassified")], {"length": 300}, {"unclassified_residual"}),
        ([("1", 0, 100, None), ("2", None, None, "1")], [], {}, set()),
        ([("1", 0, 100, None), ("3", None, None, "1")], [], {}, {"illegal_structure"}),
        ([("1", 0, 100, None), ("77", None, None, "1")], [], {}, {"illegal_structure"}),
        ([("1", 95, 100, None)], [(0, 95, "cover_page")], {}, {"oversized_cover_page"}),
        ([("8", 0, 100, None)], [], {"evidence": [(10, 20)]}, set()),
        ([("8", 0, 50, None), ("9", 50, 100, None)], [], {"evidence": [(60, 70)]}, {"xbrl_mismatch"}),
        ([("1", 0, 100, None)], [], {"other": [("1", 5, 100)]}, set()),
        ([("1", 0, 100, None)], [], {"other": [("1", 6, 100)]}, {"cross_method_disagree"}),
    ],
)
def test_invariants(spark, items, residual, more, codes):
    assert _gate(spark, items, residual, **more) == codes


def test_missing_items(spark):
    filings = eras.with_era(spark.createDataFrame([(1, "1994-06-30")], "filing_id long, fiscal_year_end string"))
    items = spark.createDataFrame([(1, "1")], "filing_id long, item_id string")
    got = {r["item_id"] for r in gate.should_exist(filings, items).collect()}
    assert got == {"2", "3", "4", "5", "6", "7", "8", "9", "10", "14"}


def test_era_bounds(spark):
    days = ["2005-11-30", "2005-12-01", "2021-08-09", "2023-12-14", "2023-12-15", None]
    got = eras.with_era(spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, fiscal_year_end string")).orderBy("i").collect()
    assert [r["era_id"] for r in got] == ["era_1994", "era_2005", "era_2020", "era_2020", "era_2023", "era_2023"]
    assert eras.invalid_items(eras.era_items(spark)).isEmpty() and eras.invalid_eras(eras.eras(spark)).isEmpty()


HTML = [
    (b"<html><body><p>One B<b>old</b> word</p><div>AT&amp;T 5&nbsp;%</div></body></html>", "html", True),
    (b"<html xmlns:ix='x'><ix:header><ix:hidden>secret</ix:hidden></ix:header><p>Seen <ix:nonFraction>1,234</ix:nonFraction></p></html>", "html_xbrl", True),
    (b"<html xmlns:ix='x'><p>a <ix:nonNumeric style='display:none'>gone</ix:nonNumeric> b</p></html>", "html_xbrl", True),
    (b"plain \xa9 text", "ascii", True),
    (b"<html><script>var x = 1;</script><p>shown</p></html>", "html", True),
]


def test_html_is_conserved(spark):
    from spanforge.operators.provenance import rows

    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(HTML)], "filing_id long, raw binary")
    filings = prepared(df)
    assert [r["generation"] for r in filings.orderBy("filing_id").collect()] == [x[1] for x in HTML]
    run, report, stretches = segment_filings(filings)
    assert {r["filing_id"]: r["passed"] for r in report.collect()} == {i: x[2] for i, x in enumerate(HTML)}
    texts = {r["filing_id"]: r["text"] for r in run.ruler.collect()}
    assert "secret" not in texts[1] and "1,234" in texts[1] and "gone" not in texts[2] and texts[3] == "plain © text" and "Bold" in texts[0]
    walked = {r["filing_id"]: r["hidden"] for r in html.walk(filings).collect()}
    assert [h["text"] for h in walked[2]] == ["gone"]
    for r in rows(stretches).where("kind = 'dom_text' and filing_id = 4").collect():
        assert HTML[4][0].decode()[r["source_start"] : r["source_end"]] == texts[4][r["start"] : r["end"]]


def test_year_end(spark):
    raw = [b"CONFORMED PERIOD OF REPORT:\t19940630", b"CONFORMED PERIOD OF REPORT: 19941399", b"<html><ix:nonNumeric name='dei:DocumentPeriodEndDate'>June <b>30</b>, 2023</ix:nonNumeric></html>", b"none", b"<p name='dei:documentperiodenddate'> Dec 31,  2023 </p>"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "filing_id long, raw binary")
    assert [r["fiscal_year_end"] for r in prepared(df).orderBy("filing_id").collect()] == ["1994-06-30", None, "2023-06-30", None, "2023-12-31"]


def test_index_lookups(spark):
    known = spark.createDataFrame([(1, "BRK-B", "10"), (2, "BRKB", "11"), (3, "ABC", "12")], "seq int, ticker string, cik string")
    over = spark.createDataFrame([("ABC", "99")], "ticker string, cik string")
    got = resolve_cik(spark.createDataFrame([("BRK.B",), ("ABC",), ("NONE",)], "ticker string"), known, over)
    assert {r["ticker"]: r["cik"] for r in got.collect()} == {"BRK.B": "10", "ABC": "99", "NONE": None}
    index = spark.createDataFrame([("1", "10-K", "2023-06-30", "2023-08-01", "a"), ("1", "10-K", "2023-06-30", "2023-09-01", "b"), ("1", "10-K/A", "2023-12-30", "2024-01-01", "c")], "cik string, form string, report_date string, filing_date string, accession string")
    assert [r["accession"] for r in newest_annual(index, "2023").collect()] == ["b"]


def test_stream(spark, tmp_path):
    from spanforge.streaming.ingest import segment_stream

    source = str(tmp_path / "in")
    spark.createDataFrame([(1, whole_filing(), None)], "filing_id long, text string, fiscal_year_end string").write.parquet(source)
    texts = spark.readStream.schema("filing_id long, text string, fiscal_year_end string").parquet(source)
    segment_stream(texts, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert [r["status"] for r in spark.read.parquet(str(tmp_path / "out/verdicts")).collect()] == ["pass"]


def test_text_report(run):
    got = {r["filing_id"]: r["report"] for r in reports.text_report(run).collect()}
    assert got[1].startswith("status pass high\nitem 1 extracted ") and got[2].count("violation missing_expected_item") == reports.SHOWN


def test_era_labels(spark):
    got = eras.era_labels(eras.era_items(spark)).collect()
    assert all(r["era_id"] == f"era_{r['label']}" for r in got) and len(got) == 4


def test_remapped_places(spark):
    from spanforge.operators.chrome import remapped

    text, cuts = "0123456789abcdef", [(2, 4), (7, 10)]
    points = spark.createDataFrame([(1, i) for i in range(17)], "filing_id long, pos int")
    got = {r["pos"]: r["new"] for r in remapped(points, spark.createDataFrame([(1, *c) for c in cuts], "filing_id long, start int, end int")).collect()}
    gone = {i for s, e in cuts for i in range(s, e)}
    assert got == {p: len([i for i in range(min(p, len(text))) if i not in gone]) for p in range(17)}


def test_source_of_spans(spark):
    from spanforge.operators.provenance import gathered, source_of

    stretches = spark.createDataFrame([(1, 0, 5, 10, 15, "dom_text"), (1, 5, 6, 20, 20, "injected"), (1, 6, 9, 30, 33, "dom_text")], "filing_id long, start int, end int, source_start int, source_end int, kind string")
    spans = spark.createDataFrame([(1, 0, 3), (1, 2, 9), (1, 7, 8), (1, 50, 60)], "filing_id long, start int, end int")
    got = {(r["start"], r["end"]): (r["source_kind"], r["source_start"], r["source_end"]) for r in source_of(spans, gathered(stretches)).collect()}
    assert got == {(0, 3): ("dom_text", 10, 13), (2, 9): ("dom_text", 12, 33), (7, 8): ("dom_text", 31, 32), (50, 60): (None, None, None)}


def test_broken_files_are_rows(spark, tmp_path):
    import gzip

    from spanforge.sources.filings import quarantined, read_files

    (tmp_path / "a.txt").write_bytes(b"plain")
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"packed"))
    (tmp_path / "c.gz").write_bytes(gzip.compress(b"packed" * 100)[:15])
    (tmp_path / "d.pdf").write_bytes(b"other")
    good, bad = quarantined(read_files(spark, str(tmp_path)))
    assert sorted(bytes(r["raw"]) for r in good.collect()) == [b"packed", b"plain"]
    (row,) = bad.collect()
    assert row["filing_id"].endswith("c.gz") and row["error"].startswith("gunzip: ")


def test_markup_no_parser_takes_is_a_row(spark):
    raw = [(1, b"<html><body><p>Item 1. Business</p><p>shown</p></body></html>"), (2, b"<html><p>a</p><![bogus[x]]></html>"), (3, b"plain")]
    run, report, _ = segment_filings(prepared(spark.createDataFrame(raw, "filing_id long, raw binary")))
    assert {r["filing_id"]: r["error"] is None for r in reports.summary(run).collect()} == {1: True, 2: False, 3: True}
    assert {r["filing_id"] for r in report.collect()} == {1, 3} and [r["error"][:5] for r in run.failed.collect()] == ["walk:"]


def test_every_code_has_a_message(spark):
    df = spark.createDataFrame([("overlap", "2", 5, 9), ("missing_expected_item", "3", None, None), ("coverage_gap", None, 1, 2)], "code string, item_id string, start int, end int")
    assert [r["m"] for r in df.select(gate.message().alias("m")).collect()] == [
        "item 2 begins before the item ahead of it ends at 5 to 9", "item 3 expected and not there", "text that no span holds at 1 to 2",
    ]


def test_hot_keys_give_the_same_rows(spark):
    """What is combined before the windows, against the plain windows."""
    import random

    from pyspark.sql import Window

    from spanforge.functions import intervals as v

    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2]), i, rng.randrange(4000), rng.choice([None, *range(60)])) for i in range(600)]
    df = spark.createDataFrame(rows, "key long, id long, t int, value int")
    plain = v.sessions(df, 30, "key", "t").groupBy("key", "run").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))
    got = v.merged_sessions(df, 30, "key", "t")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    w = Window.partitionBy("key").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    best = df.withColumn("best", F.max("value").over(w)).where("best is null or value > best").select("id")
    assert sorted(map(tuple, v.records(df, "key", "t", "id", "value", F.floor(F.col("t") / 100)).select("id").collect())) == sorted(map(tuple, best.collect()))
    spans = df.select("key", (F.col("t") % 300).alias("start"), (F.col("t") % 300 + F.col("id") % 3 + 1).alias("end"))
    late = spans.withColumn("from", v.cursor("key", "end")).groupBy("key").agg(F.count_if(F.col("start") < F.col("from")), F.count_if(F.col("start") > F.col("from")))
    assert sorted(map(tuple, v.clashes(spans, "key").collect())) == sorted(map(tuple, late.collect()))


def test_stored_tables_leave_no_name(spark):
    from spanforge.sources.shared import stored

    df = spark.range(100).selectExpr("id % 7 as filing_id", "id")
    kept = stored(df, "kept", key="filing_id")
    assert kept.groupBy("filing_id").count().count() == 7 and kept.count() == 100
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("kept")]
    assert "Exchange" not in kept.groupBy("filing_id").count()._jdf.queryExecution().sparkPlan().toString()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Fake

    from spanforge.sources.shared import shared_folder

    session = lambda master, base: Fake(conf=Fake(get=lambda *_: base), sparkContext=Fake(master=master, getConf=dict))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("spark://host:7077", None))
    assert shared_folder(session("spark://host:7077", "hdfs:/shared/")) == "hdfs:/shared"
    assert shared_folder(session("local[4]", None))
