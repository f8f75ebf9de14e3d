"""Suffix arrays, equal windows and the removal of repeated bytes against plain versions."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.llm import suffixdedup
from spanforge.llm.common import table
from spanforge.llm.suffixsort import equal_windows, suffix_array
from tests.helpers import SF


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 2), max_size=60), st.lists(st.integers(0, 30), max_size=60), st.lists(st.sampled_from([0, 5]), max_size=120)))
def test_suffix_array(s):
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("letters", [b"a", b"ab", b"\0\1", bytes(range(256))])
def test_equal_windows(letters):
    rng = random.Random(7)
    base = bytes(rng.choice(letters) for _ in range(400))
    pieces = [base[a : a + rng.randrange(50, 115)] for a in (rng.randrange(0, 285) for _ in range(200))]
    piece, cls = equal_windows(pieces, np.array([len(p) - 49 for p in pieces]), 50)
    windows = [p[o : o + 50] for p in pieces for o in range(len(p) - 49)]
    assert piece.tolist() == [i for i, p in enumerate(pieces) for _ in range(len(p) - 49)]
    assert len(set(zip(windows, cls.tolist()))) == len(set(windows)) == len(set(cls.tolist()))


def plain(rows):
    """doc_id, n_bytes, n_removed, n_spans, kept of (doc_id, text)."""
    least = {}
    order = lambda d: (d is not None, d or 0)
    texts = [(d, t.encode() if t else b"") for d, t in rows]
    for d, b in texts:
        for o in range(len(b) - 49):
            w = b[o : o + 50]
            least[w] = min(least.get(w, order(d)), order(d))
    out = []
    for d, b in texts:
        gone = [False] * len(b)
        for o in range(len(b) - 49):
            if least[b[o : o + 50]] < order(d):
                gone[o : o + 50] = [True] * 50
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def ordered(rows):
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in rows), key=repr)


NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]


def test_matches_plain_version(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    got = suffixdedup.remove_repeats(docs).select(*NAMES).collect()
    want = plain([tuple(r) for r in docs.collect()])
    assert ordered(got) == ordered(want)
    assert sum(r[2] for r in want) > 0


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh\u00e9\u4e2d") for _ in range(rng.randrange(2, 9))) for _ in range(200)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, rows = [text(9), text(14), text(40), "x" * 130, "\0" * 70, "ab" * 60], []
    for i in range(120):
        parts = [text(rng.randrange(0, 12)) for _ in range(4)] + rng.sample(shared, rng.randrange(0, 4))
        rng.shuffle(parts)
        rows.append((i * 7 % 61, "\n".join(parts)))
    copy = text(60)
    rows += [(1000 + i, copy) for i in range(40)] + [(1000, copy)] * 3 + [(None, copy + "!"), (None, shared[2]), (2, None), (3, ""), (4, "short"), (-5, shared[1]), (5, copy[:49]), (6, copy[:50]), (7, "z" * 200_000)]
    rows += [(2000 + i, text(3) + shared[2] + text(3)) for i in range(60)]
    return rows


@pytest.mark.parametrize("crowd, bucket", [(20_000, 1 << 20), (3, 2_000)])
def test_odd_texts_small_buckets_and_crowded_anchors(spark, crowd, bucket):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as k", "2 as m", "'x' as x").repartition(5)
    got = suffixdedup.remove_repeats(docs, crowd=crowd, bucket_bytes=bucket).select(*NAMES).collect()
    assert ordered(got) == ordered(plain(rows))


def test_empty_table(spark):
    assert suffixdedup.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
