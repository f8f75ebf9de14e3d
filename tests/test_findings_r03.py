"""Cases that a review of larger tables brought up."""

import html as entities
import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from spanforge.operators import completeness, segment
from spanforge.plans import queries as engine
from spanforge.plans.segmentation import segment_filings, segment_texts, stretches_of
from spanforge.sources.filings import prepared
from tests.helpers import SF, result, rows


def both(spark, folder, name, table, df):
    """What a query and its SQL make of one table."""
    df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    cursor = con.execute(engine.oracle_sql()[name])
    return result(engine.queries()[name](spark, str(folder))), rows([d[0] for d in cursor.description], cursor.fetchall())


def test_references_without_an_end(spark, tmp_path):
    texts = ["a &amp;&amp</h1><p>b", "x&ampy &copy z &copy;", "the &quo</p>", "Caf&eacute; Caf&eacute 3&nbsp;4", "&#65;&#x42;c &#128; &#0; &#55555;", "&notit; &noti; &zzz; &amp;amp;", "none", "3 & 4 &", "&#8217;s &#99999999999;"]
    df = spark.createDataFrame([(i, f"u{i}", f"<html><body><h1>{t}</p></body></html>") for i, t in enumerate(texts)], "page_id long, url string, html string")
    got, want = both(spark, tmp_path, "page_conservation", "pages", df)
    assert got == want


def test_sql_decodes_as_html_does():
    rng = random.Random(2)
    parts = ["&", "#", "x", ";", "amp", "notin", "not", "it", "CounterClockwiseContourIntegral", "65", "128", "1F600", "D800", "0", "13", "11", " ", "é", "<", "q"]
    texts = ["".join(rng.choice(["&", *parts]) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    sql = engine.oracle_sql()["page_conservation"]
    decoded = sql[: sql.index(engine._BARE)] + "html" + sql[sql.index(engine._BARE) + len(engine._BARE) : sql.rindex("SELECT page_id AS filing_id")] + " SELECT html_text FROM decoded ORDER BY page_id"
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id INT, html VARCHAR)")
    con.execute("INSERT INTO pages SELECT unnest(?), unnest(?)", [list(range(len(texts))), texts])
    assert [r[0] for r in con.execute(decoded).fetchall()] == [entities.unescape(t) for t in texts]


def test_islands_of_equal_intervals(spark, tmp_path):
    """Many equal rows open an island; whichever of them SQL's window takes first, the island begins with them all."""
    rng = random.Random(5)
    made = [(s, 10 * k + rng.randrange(3), q) for s in range(400) for k in range(rng.randrange(1, 30)) for q in [float(rng.randrange(1, 6))] for _ in range(rng.choice([1, 1, 2, 40]))]
    rng.shuffle(made)
    df = spark.createDataFrame(made, "l_suppkey long, day int, l_quantity double").selectExpr("l_suppkey", "l_quantity", "cast(date_add(date'1992-01-01', day) as timestamp) as l_shipdate")
    got, want = both(spark, tmp_path, "shipping_islands", "lineitem", df)
    assert got == want


def test_differing_tokens_stay_in_their_row(spark):
    df = spark.createDataFrame([(1, ["a b a"], ["a"])], "filing_id int, want array<string>, have array<string>")
    plan = completeness.compared(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_compared_with_plain_counts(spark):
    rng = random.Random(8)
    words = ["a", "ab", "b", "abc", "3.5", "x-y", "über", "a.b", "z"]
    made = lambda n: [" ".join(rng.choice(words) for _ in range(rng.randrange(n))) for _ in range(rng.randrange(4))]
    data = [(i, made(20), made(20)) for i in range(200)]
    data += [(200, ["w " * 30_000], ["w " * 29_990 + "v"]), (201, [" ".join(f"k{i}" for i in range(20_000))], [" ".join(f"j{i}" for i in range(20_000))]), (202, [None], []), (203, ["B a b A"], ["a"])]
    df = spark.createDataFrame(data, "filing_id int, want array<string>, have array<string>")
    got = {r["filing_id"]: r for r in completeness.compared(df).collect()}
    assert len(got) == len(data)
    for i, want, have in data:
        w, h = (Counter(" ".join(t or "" for t in side).lower().split()) for side in (want, have))
        missing, extra, r = w - h, h - w, got[i]
        assert (r["passed"], r["n_source"], r["n_accounted"], r["n_missing"], r["n_extra"]) == (w == h, w.total(), h.total(), missing.total(), extra.total())
        listed = lambda order, d: [t for t in order for _ in range(d[t])][:50]
        assert r["missing_examples"] == listed(w, missing) and r["extra_examples"] == listed(h, extra)


def stored_by(spark, monkeypatch, folder, name):
    """The names of the tables that a query stores."""
    monkeypatch.setattr("spanforge.sources.shared.shared_folder", lambda spark: str(folder))
    result(engine.queries()[name](spark, SF))
    return {p.name.rsplit("_", 1)[0] for p in folder.iterdir()}


def test_spot_check_goes_no_further_than_items(spark, monkeypatch, tmp_path):
    names = stored_by(spark, monkeypatch, tmp_path, "spot_check")
    assert "items" in names and not names & {"corpus", "residual", "violations"}


def test_a_body_is_cut_out_once(spark):
    ruler = spark.createDataFrame([(1, "some text")], "filing_id int, text string")
    spans = spark.createDataFrame([(1, 2, 7), (1, 0, 4)], "filing_id int, start int, end int")
    made = segment.with_body(spans, ruler, head=lambda x, body: F.left(body, F.lit(2)), tail=lambda x, body: F.right(body, F.lit(2)))
    assert sorted(map(tuple, made.collect())) == [(1, 0, 4, "so", "me"), (1, 2, 7, "me", "te")]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring(text") == 1


def test_filings_without_text_keep_their_verdict(spark):
    df = spark.createDataFrame([(1, "Item 1. Business\nwords", "2024-01-01"), (2, None, "1999-01-01")], "filing_id long, text string, fiscal_year_end string")
    run = segment_texts(df)
    assert {r["filing_id"]: r["era_id"] for r in run.filings.collect()} == {1: "era_2023", 2: "era_1994"}
    assert {r["filing_id"] for r in run.verdicts.collect()} == {1, 2}


def test_provenance_alone(spark, monkeypatch, tmp_path):
    assert stored_by(spark, monkeypatch, tmp_path, "page_provenance") == {"walked"}
    pages = prepared(spark.createDataFrame([(i, f"<html><p>HEAD</p><p>a {i} &amp; b</p><p>HEAD</p><p>c</p><p>HEAD</p>{'<![bogus[x]]>' * (i % 2)}</html>".encode()) for i in range(4)] + [(9, b"plain\nHEAD\nHEAD\nHEAD"), (10, b"")], "filing_id long, raw binary"))
    _, _, whole = segment_filings(pages)
    assert result(stretches_of(pages)) == result(whole) and whole.count() == 4
