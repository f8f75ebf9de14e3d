"""The pipeline, and the fit of its classifier, against plain versions of their definitions."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from spanforge.llm import tokenids, toxicity
from tests.helpers import SF
from tests.llm.test_brute import WORD, _components, crc, lower
from tests.llm.test_whole import _clean


def _features(text):
    """Words and their beginnings of three to eight letters, by hash."""
    out = set()
    for w in re.findall("[a-z0-9\x80-\U0010ffff]+", lower(text)):
        out.add(xxhash.xxh3_64_intdigest(f"={w}".encode()) % toxicity.BUCKETS)
        out.update(xxhash.xxh3_64_intdigest(f"<{w[:k]}".encode()) % toxicity.BUCKETS for k in range(3, 9) if k < len(w))
    return out


def _risk(theta, x_p, x_u, prior):
    """The two parts of the risk: c E_P[l(+)] and E_U[l(-)] - c E_P[l(-)]."""
    z = lambda x: x @ theta[:-1] + theta[-1]
    loss = lambda v: np.logaddexp(0, -v)
    return prior * loss(z(x_p)).mean(), loss(-z(x_u)).mean() - prior * loss(-z(x_p)).mean()


def _gradient(f, theta):
    e = 1e-6
    return np.array([(f(theta + e * d) - f(theta - e * d)) / (2 * e) for d in np.eye(len(theta))])


def _fit(positive, unlabelled, prior):
    """The same descent on a dense matrix, with derivatives by differences of the risk."""
    ids = sorted({x for v in [*positive, *unlabelled] for x in v})
    dense = lambda rows: np.array([[float(i in v) for i in ids] for v in map(set, rows)])
    x_p, x_u = dense(positive), dense(unlabelled)
    theta = np.append(np.zeros(len(ids)), np.log(prior / (1 - prior)))
    m1, m2, turned = 0, 0, 0
    for t in range(1, toxicity.STEPS + 1):
        first, rest = (lambda v: _risk(v, x_p, x_u, prior)[0]), (lambda v: _risk(v, x_p, x_u, prior)[1])
        against = rest(theta) < 0
        turned += against
        g = -_gradient(rest, theta) if against else _gradient(lambda v: first(v) + rest(v), theta)
        g = g + toxicity.DECAY * np.append(theta[:-1], 0)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g**2
        theta = theta - toxicity.RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return dict(zip(ids, theta[:-1])), theta[-1], turned


@pytest.mark.parametrize("prior", [0.1, 0.6])
def test_fit_follows_the_risk(monkeypatch, prior):
    monkeypatch.setattr(toxicity, "STEPS", 150)
    rng = random.Random(5)
    row = lambda likely: [i for i in range(8) if rng.random() < (0.7 if i in likely else 0.2)]
    positive, unlabelled = [row({0, 1}) for _ in range(12)], [row({0, 1} if rng.random() < 0.2 else {5}) for _ in range(40)]
    model = toxicity.fit(positive, unlabelled, prior)
    weights, bias, turned = _fit(positive, unlabelled, prior)
    assert set(model.weights) == set(weights) and abs(model.bias - bias) < 1e-3
    assert all(abs(model.weights[i] - w) < 1e-3 for i, w in weights.items())
    assert 0 < turned < toxicity.STEPS  # steps with and against the part that must not fall below zero


def _plain_scores(docs, labels):
    """Scores by id of all docs, from marks of those outside fold 0 (fewer than the limits of the sample)."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    known = {i: y for i, y in labels.items() if y is not None and fold(i) != 0}
    rows = [(y, _features(t)) for i, t in docs for y in [known.get(i)] if y is not None]
    p, u = [f for y, f in rows if y], [f for _, f in rows]
    n_p, n_u = (collections.Counter(x for f in v for x in f) for v in (p, u))
    picked = []
    for x in n_u:
        a, b = (n_p[x] + 0.5) / (len(p) + 1), (n_u[x] + 0.5) / (len(u) + 1)
        z = abs((a - b) / np.sqrt(a * (1 - a) / len(p) + b * (1 - b) / len(u)))
        if n_p[x] + n_u[x] >= toxicity.MIN_DOCUMENTS and z >= toxicity.MIN_Z:
            picked.append((-z, x))
    only = {x for _, x in sorted(picked)[: toxicity.FEATURES]}
    model = toxicity.fit([sorted(f & only) for f in p], [sorted(f & only) for f in u], sum(known.values()) / len(known))
    return [1 / (1 + np.exp(-(model.bias + sum(model.weights.get(x, 0.0) for x in _features(t))))) for _, t in docs]


def _plain_lines(docs):
    lines = {i: (t or "").split("\n") for i, t in docs}
    seen, gone = set(), collections.defaultdict(set)
    for i in sorted(lines):
        for k in range(len(lines[i]) - 2):
            w = tuple(lines[i][k : k + 3])
            gone[i].update({k, k + 1, k + 2} if w in seen else ())
            seen.add(w)
    return [(i, t if t is None else "\n".join(x for k, x in enumerate(lines[i]) if k not in gone[i])) for i, t in docs]


def _fingerprint(t):
    w = re.findall(WORD, lower(t))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """200 documents with copies, near copies, benchmark passages and toxic words of our own among them."""
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [r.asDict() for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rng, new = random.Random(2), 10_000
    for k in range(70):
        base = dict(rng.choice(rows[:200]))
        words = (base["text"] or "").split(" ")
        if k < 40:
            words.insert(rng.randrange(len(words) + 1), "vilest scumword" if k % 2 else "scumwords all")
        elif k < 50:
            words[rng.randrange(len(words))] = "other"
        elif k < 60:
            words = rng.choice(items).split(" ") + words[:20]
        base |= {"doc_id": new + k, "text": " ".join(words)}
        labels.append(labels[0] | {"doc_id": new + k, "toxic": int(k < 40)})
        rows.append(base)
    for row in rows:
        row["n_chars"] = len(row["text"] or "")
    folder = str(tmp_path_factory.mktemp("planted"))
    for name, data in (("documents", rows), ("labels", labels)):
        source = spark.read.parquet(f"{SF}/{name}.parquet")
        spark.createDataFrame([[d[c] for c in source.columns] for d in data], source.schema).write.parquet(f"{folder}/{name}.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder, [(d["doc_id"], d["text"]) for d in rows], {d["doc_id"]: d["toxic"] for d in labels}, items


def test_pipeline(spark, planted):
    from tokenizers import Tokenizer

    folder, docs, labels, items = planted
    sizes = [len(docs)]
    scores = _plain_scores(docs, labels)
    assert all(abs(s - 0.5) > 1e-6 for s in scores)
    docs = [d for d, s in zip(docs, scores) if s < 0.5]
    sizes.append(len(docs))
    assert not any("scumword" in (t or "") for _, t in docs)
    docs = sorted(_plain_lines(docs))
    before = _components([_fingerprint(t) for _, t in docs])
    docs = [d for k, d in enumerate(docs) if before[k] == k]
    sizes.append(len(docs))
    docs = [(i, t) for i, t in docs if _clean(t, items)]
    sizes.append(len(docs))
    assert sizes == sorted(set(sizes), reverse=True)  # each of these stages takes something
    known = Tokenizer.from_file(tokenids.tokenizer_path())
    want = set()
    for i, t in docs:
        ids = [*known.encode(t or "", add_special_tokens=False).ids, 0]
        want |= {(i, k, s, len(ids[s : s + 2048]), crc(ids[s : s + 2048])) for k, s in enumerate(range(0, len(ids), 2048))}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got} == want and len(got) == len(want)
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        ends = [a + n for a, n in sorted(pieces)]
        assert [a for a, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(by) <= 1.02 * sum(r["length"] for r in got) / 2048 + 1
