"""Sweeps against their definition, added spans against labels by hand, and work in proportion to the matches."""

import random
import time

from pyspark.sql import functions as F

from spanforge.llm import pii


def test_sweeps_keep_what_touches_nothing(spark):
    rng = random.Random(5)
    fields = [*pii.LABELERS, *pii.FEATURES]

    def span(base):
        start = rng.randint(0, 3000)
        return (start, rng.randint(0, 3), start + rng.randint(1, 12), base, *[0] * len(fields))

    rows = [(i, sorted(span(True) for _ in range(rng.choice([0, 3, 300]))), sorted(span(False) for _ in range(rng.choice([0, 1, 5, 600])))) for i in range(40)]
    got = {r["doc_id"]: [tuple(x) for x in r["more"]] for r in pii._apart(spark.createDataFrame(rows, f"doc_id long, base array<{pii._SPAN}>, more array<{pii._SPAN}>")).collect()}
    for i, base, more in rows:
        want, to = [], 0
        for x in more:
            if x[0] >= to and not any(x[0] < y[2] and y[0] < x[2] for y in base):
                want.append(x)
                to = x[2]
        assert got[i] == want


# (text, spans that are personal; those in brackets only the method finds)
LABELLED = [
    ("mail ann.lee@site.org or bob@shop.co.uk today", ["ann.lee@site.org", "bob@shop.co.uk"]),
    ("write to carla (at) firma.de please", ["[carla (at) firma.de]"]),
    ("card 4111 1111 1111 1111 was charged", ["4111 1111 1111 1111"]),
    ("cards 4111111111111111 5500005555555559 were charged", ["[4111111111111111]", "[5500005555555559]"]),
    ("ids 4111111111111112 5500005555555550 of parcels", []),
    ("call +1 415 555 2671 or +44 20 7946 0958.", ["+1 415 555 2671", "+44 20 7946 0958"]),
    ("phone (415) 555-2671 at noon", ["[(415) 555-2671]"]),
    ("login from 84.23.11.9 and 7.7.7.7, not 999.1.1.1", ["84.23.11.9", "7.7.7.7"]),
    ("pages 415-555 and 12.50 in 2024", []),
]


def test_labelled_texts(spark):
    rows = [(i, t) for i, (t, _) in enumerate(LABELLED * 30)]
    for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text, wanted = LABELLED[r["doc_id"] % len(LABELLED)]
        cut = [x.split(":") for x in r["spans"].split(",") if x]
        assert [text[int(s) : int(e)] for _, s, e in cut] == [w.strip("[]") for w in wanted]
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] == sum(not w.startswith("[") for w in wanted)


def test_many_matches_in_one_text(spark):
    took = []
    for n in (1_000, 10_000, 100_000):
        text = " ".join(f"u{i}@b{i}.com" for i in range(n)) + " cards" + " 4111111111111111" * 3_000
        start = time.perf_counter()
        r = pii.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        took.append(time.perf_counter() - start)
        assert r["n_email"] == n and len(r["spans"].split(",")) == n + 3_000
    assert took[2] < 15 * took[1]
    assert spark.createDataFrame([(1, "")], "doc_id long, text string").transform(pii.spans).select(F.size("base")).first()[0] == 0
