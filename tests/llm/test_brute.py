"""Each operator against a plain version of its definition, on small tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from spanforge.llm import decontaminate, linededup, lm, packing, pii, quality, simhash, substrdedup, tokenids, toxicity
from spanforge.llm.common import fold_of, shared_path
from spanforge.llm.queries import oracle_sql, queries
from tests.helpers import SF, oracle, result

WORD = "[^\x20\x09-\x0D]+"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenids.tokenizer_path())
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x in texts.items()}


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_sql(spark, name):
    assert result(queries()[name](spark, SF)) == oracle(oracle_sql()[name])


def test_decontamination_by_join(spark, docs):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert result(decontaminate.judge(docs, benchmark, max_windows=0)) == result(decontaminate.judge(docs, benchmark))


def test_token_ids(spark, docs, ids):
    path = shared_path(spark, "ids")
    tokenids.write_token_ids(docs, path, tokenids.tokenizer_path(), 2)
    want, start = [], 0
    for i in sorted(ids):
        whole = [*ids[i], 2]
        want.append((i, start, len(whole), crc(whole)))
        start += len(whole)
    assert sorted(tuple(r) for r in tokenids.token_digest(spark, path).collect()) == want
    some = tokenids.read_token_ids(spark, path, ["doc_id", "ids"], 10, 19)
    assert {r["doc_id"]: r["ids"] for r in some.collect()} == {i: [*ids[i], 2] for i in ids if 10 <= i <= 19}


def test_packing(docs, ids):
    rows = packing.pack(docs, tokenids.tokenizer_path(), with_ids=True)
    got = rows.collect()
    want = {(i, k, k * 2048): [*x, 0][k * 2048 : (k + 1) * 2048] for i, x in ids.items() for k in range(-(-(len(x) + 1) // 2048))}
    assert {(r["doc_id"], r["piece"], r["start"]): (r["length"], r["ids_crc32"]) for r in got} == {k: (len(v), crc(v)) for k, v in want.items()}
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"], r["doc_id"], r["piece"]))
    for pieces in by.values():
        at = 0
        for offset, length, *_ in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        assert sum(3 * p[1] > 2048 for p in pieces) <= 2
    assert len(by) <= 1.02 * sum(r["length"] for r in got) / 2048 + 1
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(rows).collect()}
    for s, pieces in by.items():
        assert whole[s] == [x for _, n, i, k in sorted(pieces) for x in want[i, k, k * 2048]]


def test_plan_size_is_bounded():
    rng = np.random.default_rng(0)
    sizes = []
    for n in (10_000, 1_000_000):
        lengths = np.minimum(np.exp(rng.normal(6.4, 0.9, n)).astype(int) + 1, 2048)
        counts = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)]))
        runs, bins = packing.plan_bins(counts)
        assert sum(e - f for _, f, e, *_ in runs) == n and bins <= 1.01 * lengths.sum() / 2048 + 1
        sizes.append(len(runs))
    assert sizes[1] < 3 * sizes[0]


def _repeats(rows):
    texts = [(i, re.findall(WORD, x or "")) for i, x in rows]
    seen = collections.Counter(tuple(w[k : k + 35]) for _, w in texts for k in range(len(w) - 34))
    out = []
    for i, w in texts:
        cover = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                cover[k : k + 35] = [True] * 35
        out.append((i, len(w), sum(cover), hashlib.sha256(" ".join(x for x, y in zip(w, cover) if not y).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard", "patterns", "segment"), [(4 << 20, 15_000, 256), (2_000, 7, 20), (300, 1, 1)])
def test_substring_dedup(spark, monkeypatch, shard, patterns, segment):
    for name, value in (("SHARD_BYTES", shard), ("PATTERNS", patterns), ("SEGMENT", segment)):
        monkeypatch.setattr(substrdedup, name, value)
    rng = random.Random(3)
    phrases = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(30, 90))) for _ in range(6)]
    part = lambda: rng.choice([rng.choice(phrases), " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60)))])
    rows = [(i if i % 50 else None, " ".join(part() for _ in range(rng.randint(0, 5)))) for i in range(300)]
    rows += [(5, None), (5, ""), (7, rows[7][1]), (7, rows[7][1]), (8, "a " * 500), (9, "b\n" * 36)]
    rows += [(400 + i, f"own{i} " * 3 + phrases[0] + f" end{i}" * 40) for i in range(60)]
    got = substrdedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == _repeats(rows)


def _components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(docs, texts):
    def fingerprint(t):
        w = re.findall(WORD, lower(t))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    order = sorted(texts)
    fps = [fingerprint(texts[i]) for i in order]
    want = [(i, f"{f:016x}", order[c]) for i, f, c in zip(order, fps, _components(fps))]
    assert sorted(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == {c for _, _, c in want}


@pytest.mark.parametrize("most", [4096, 8])
def test_dense_groups_lose_no_link(spark, most):
    rng = np.random.default_rng(1)
    centre, near = int(rng.integers(0, 2**62)), set()
    for _ in range(300):
        x = centre
        for b in rng.integers(0, 64, rng.integers(0, 9)):
            x ^= 1 << int(b)
        near.add(x - 2**64 if x >= 2**63 else x)
    fps = sorted(near)
    links = simhash.near_links(spark.createDataFrame([(x,) for x in fps], "fp long"), most).collect()
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(x) for x in fps] == [fps[c] for c in _components(fps)]


def test_toxicity(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    hit, wrong = ([r["predicted"] for r in held if r["toxic"] == y] for y in (1, 0))
    assert sum(hit) / len(hit) > 0.75 and sum(wrong) / len(wrong) < 0.01


@pytest.mark.parametrize(("fanout", "maps"), [(1_024, 4_000), (5, 3)])
def test_language_model(docs, texts, monkeypatch, fanout, maps):
    monkeypatch.setattr(lm, "FANOUT", fanout)
    monkeypatch.setattr(lm, "MAPS", maps)
    model = lm.train(docs.where(fold_of() != 1))
    tokens = {i: [*re.findall(WORD, lower(t)), "</s>"] for i, t in texts.items()}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1]
    count = collections.Counter(w for i in train for w in tokens[i])
    n, v = sum(count.values()), len(count)
    pairs = collections.Counter(p for i in train for p in zip(["<s>", *tokens[i]], tokens[i]))
    left = collections.Counter(w for _, w in pairs)
    ctx = collections.defaultdict(collections.Counter)
    for (a, _), c in pairs.items():
        ctx[a][min(c, 3)] += 1
        ctx[a]["all"] += c
    tally = lambda c: lm.discounts(*[collections.Counter(c.values())[i] for i in (1, 2, 3, 4)])
    d, dw, k = tally(pairs), tally(left), sum(left.values())
    rest = sum(dw[min(c, 3) - 1] for c in left.values()) / k
    one = lambda w: (left[w] - (dw[min(left[w], 3) - 1] if left[w] else 0)) / k + rest / (v + 1)

    def two(a, w):
        if a not in ctx:
            return one(w)
        c, x = pairs[a, w], ctx[a]
        return (c - (d[min(c, 3) - 1] if c else 0)) / x["all"] + sum(d[j - 1] * x[j] for j in (1, 2, 3)) / x["all"] * one(w)

    assert math.isclose(sum(two("the", w) for w in count) + two("the", "never seen"), 1, rel_tol=1e-9)
    for r in lm.perplexity(docs, model).collect():
        t = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in count for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(two(a, w)) for a, w in zip(["<s>", *t], t)), rel_tol=1e-9)


KIND_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base(text):
    out = []
    for k, (kind, pattern) in enumerate(KIND_PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_personal_data(spark, docs, texts):
    hard = ["a@b.c_d@e.f x.y@z.q+1@r.s.", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255", "4111 1111 1111 1111 4111-1111-1111-1111  5", "+1 (559) 555-3817+44 20 7946 0958", "\U0001f600 a@b.co \U0001f600 +1 555 555 5555", "a." * 500 + "@b", "a@b.c.@d.e@f.g-h.i", "+1+1 2345678901", "1.1.1.1@x.y 8.8.8.8", "no 83.229.25.121 4111111111111111 yes"]
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(hard)], "doc_id long, text string")
    known = texts | {10_000 + i: t for i, t in enumerate(hard)}
    for r in pii.digest(docs.select("doc_id", "text").union(more)).collect():
        base = _base(known[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KIND_PATTERNS] == [sum(b.startswith(k + ":") for b in base) for k in KIND_PATTERNS]
        assert set(base) <= set(r["spans"].split(",")) | {""}


def test_label_model():
    patterns = [((1, 1, 0), 90), ((1, 0, 0), 20), ((-1, -1, 0), 80), ((-1, 0, 0), 30), ((-1, 1, 0), 4)]
    share, given, post = pii.reliabilities(patterns)
    assert post[0] > 0.9 and post[2] < 0.1 and 0.3 < share < 0.7 and given[0][1][0] > given[0][1][1]
    w = pii.classifier([(v, n, p * n) for (v, n), p in zip(patterns, post)])
    z = lambda v: w[-1, 0] + sum(w[i, x] for i, x in enumerate(v))
    assert z((1, 1, 0)) > 0 > z((-1, -1, 0))


def test_quality(spark, docs, texts):
    for r in quality.judge(docs).collect():
        t = texts[r["doc_id"]] or ""
        w = re.findall(WORD, t)
        three = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(WORD, line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        got = [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
        assert got == [len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), dup, len(cover), failed]
        assert not (failed and r["kept"])


def test_outliers_go_and_clean_texts_stay(spark):
    sf = SF.replace("0.001", "0.1")
    got = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    clean, junk = ([r["kept"] for r in got if r["quality"] == q] for q in (1, 0))
    assert sum(clean) / len(clean) > 0.995 and sum(junk) / len(junk) < 0.05


def test_line_dedup_keeps_first(spark):
    rows = [(2, "x\ny\nz\nw"), (1, "x\ny\nz"), (3, "p\nx\ny\nz\nx\ny\nz"), (4, None), (5, "x\ny")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) as n_chars")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in linededup.dedup_lines(df, length_col="n_chars").collect()}
    assert got == {1: ("x\ny\nz", 5), 2: ("w", 1), 3: ("p", 1), 4: (None, None), 5: ("x\ny", 3)}
