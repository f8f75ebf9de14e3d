"""Cases in which an operator once did less than the whole job."""

import re

import numpy as np
import pytest

from spanforge.llm import decontaminate, substrdedup, tokenids


def _clean(text, items):
    """The definition, word by word."""
    words = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    w, hit = words(text), set()
    for item in items:
        x = words(item)
        for k in range(max(1, len(x) - 12) if x else 0):
            v = x[k : k + 13]
            for i in range(len(w) - len(v) + 1):
                if w[i : i + len(v)] == v:
                    hit.update(range(i, i + len(v)))
    return not (hit and 20 * len(hit) >= len(w))


@pytest.mark.parametrize("max_windows", [0, 300_000])
def test_contaminated_rows_go_alone(spark, max_windows):
    item = " ".join(f"q{i}" for i in range(15))
    bad, good, long = f"see {item} there", "nothing of that kind here", item + " pad" * 400
    rows = [(None, bad), (None, good), (None, None), (1, bad), (1, good), (1, good), (2, bad), (2, bad), (3, long), (4, ""), (None, "Short One!"), (5, "a short one is here"), (5, good)]
    items = [item, "short one", "", None]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.drop_contaminated(docs, benchmark, max_windows=max_windows)
    want = [(i, t, k) for k, (i, t) in enumerate(rows) if _clean(t, items)]
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=lambda r: r[2]) == want
    assert {k for _, _, k in want} == {1, 2, 4, 5, 8, 9, 12}


def test_join_path_shuffles_few_places(spark, monkeypatch):
    """Two windows of 13 and 2 words that many items share, in one of 400 documents."""
    stored, kept = decontaminate.stored, {}
    monkeypatch.setattr(decontaminate, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    rows = [(i, " ".join(f"w{i * 7 + k}" for k in range(60))) for i in range(400)]
    item = " ".join(rows[3][1].split()[:13])
    benchmark = spark.createDataFrame([(i, item if i % 2 else "w25 w26") for i in range(100)], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    small, joined = (sorted(map(tuple, decontaminate.judge(docs, benchmark, max_windows=m).collect())) for m in (1000, 0))
    assert small == joined and sum(r[3] for r in joined) > 50
    assert kept["window-hits"].count() == sum(r[1].count(item) + r[1].count("w25 w26") for r in rows)


def test_words_that_begin_like_others_are_other_words(spark):
    """Three long copies repeat as a whole; another text ends in a word that only begins like theirs."""
    head = " ".join(f"w{i:03}" for i in range(39))
    long = f"{head} stumpword " + " ".join(f"x{i}" for i in range(10_000))
    once = " ".join([*head.split()[-34:], "stump"])
    docs = spark.createDataFrame([(1, long), (2, long), (3, long), (4, once)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substrdedup.digest(docs).collect()}
    assert got == {1: 10_040, 2: 10_040, 3: 10_040, 4: 0}


def test_a_common_anchor_gathers_no_documents(spark, monkeypatch):
    """A passage in every text: what is noted of it does not grow with the texts."""
    kept = {}
    monkeypatch.setattr(substrdedup, "stored", lambda df, name, f=substrdedup.stored: kept.setdefault((n, name), f(df, name)))
    passage = " ".join(f"p{i}" for i in range(60))
    for n in (50, 500):
        rows = [(i, " ".join(f"a{i}_{j}" for j in range(40)) + f" {passage} " + " ".join(f"z{i}_{j}" for j in range(40))) for i in range(n)]
        got = substrdedup.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert [r["n_removed"] for r in got] == [60] * n
    words = lambda n: sum(len(r["x"].split()) for r in kept[n, "passages"].where("x is not null").collect())
    assert words(500) < 300  # not 500 times 60


@pytest.mark.parametrize(("name", "by_chunk"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_ids_are_those_of_whole_texts(name, by_chunk):
    from tokenizers import Tokenizer

    path = tokenids.tokenizer_path(name)
    own, known = tokenids.ChunkEncoder(path), Tokenizer.from_file(path)
    texts = ["Two Words,  and\n\tlines.", " led by space ", "\u00c9t\u00e9 it's 12 <|endoftext|> x", "", None]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode([None if t is None else t.encode() for t in texts])]
    assert got == [known.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert own.by_chunk == by_chunk


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Fake

    from spanforge.llm.common import shared_path

    session = lambda master, base: Fake(conf=Fake(get=lambda *_: base), sparkContext=Fake(master=master, getConf=dict))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_path(session("local-cluster[3,2,1000]", None), "x")
    assert shared_path(session("yarn", "hdfs:/shared/"), "x").startswith("hdfs:/shared/x-")
