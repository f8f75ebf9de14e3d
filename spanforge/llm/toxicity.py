"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier on the presence of words and of beginnings of words is trained in numpy from confirmed
toxic texts (P) and texts taken as unlabelled (U). With the class prior c and
the logistic loss l, the risk is  c E_P[l(+)] + max(0, E_U[l(-)] - c E_P[l(-)]);
where the part in brackets falls below zero, the step goes against it, so that
the classifier cannot gain by treating all unlabelled text as harmless.

Fitting uses a bounded sample of labelled rows, chosen by a hash of the id: at
most ``MAX_POSITIVE`` toxic rows and ``MAX_UNLABELLED`` rows regardless of their
label. Of rows alike in id and text one counts, and an id that stands on many rows
takes up no more than the limits. Scoring covers the whole text of every row.

Defined cases: null and empty texts get the score of a text without known words;
labels that are null are no labels, and one toxic label makes a document toxic;
without any toxic example every score is zero; repeated rows each get their
score; an empty table gives no rows; other columns are ignored or, in
``drop_toxic``, kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField

from spanforge.llm.common import col, filter_text, fold_of, map_text, stored

MAX_POSITIVE = 2_000
MAX_UNLABELLED = 6_000
BUCKETS = 1 << 22
FEATURES = 1_000
MIN_DOCUMENTS, MIN_Z = 3, 3.0
STEPS, RATE, DECAY = 600, 0.05, 1e-4

PREFIXES = range(3, 9)

_WORD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes | None) -> set[bytes]:
    return set(text.translate(_WORD).split()) if text else set()


def features_of(word: bytes) -> list[int]:
    """Bucket numbers of a word and of its beginnings."""
    text = word.decode("utf-8", "replace")
    parts = [b"=" + word] + [b"<" + text[:k].encode() for k in PREFIXES if k < len(text)]
    return [xxhash.xxh3_64_intdigest(x) % BUCKETS for x in parts]


def features(only: set[int] | None = None, limit: int = 250_000):
    """A function from a text to the set of its features (of those in ``only``); it remembers words."""
    known: dict[bytes, tuple[int, ...]] = {}

    def run(text: bytes | None) -> set[int]:
        found: set[int] = set()
        for w in words_of(text):
            f = known.get(w)
            if f is None:
                f = tuple(x for x in features_of(w) if only is None or x in only)
                if len(known) < limit:
                    known[w] = f
            if f:
                found.update(f)
        return found

    return run


@dataclass
class Model:
    weights: dict[int, float]
    bias: float

    def scorer(self):
        """A function from a text to its score."""
        weights, bias, run = self.weights, self.bias, features(set(self.weights))

        def score(text: bytes | None) -> float:
            z = bias + sum(weights[x] for x in sorted(run(text)))
            return float(1 / (1 + np.exp(-z))) if z > -700 else 0.0

        return score


def fit(positive: list[list[int]], unlabelled: list[list[int]], prior: float) -> Model:
    """Logistic weights of features, each at most once in a text."""
    if not positive or not unlabelled or prior <= 0:
        return Model({}, -800.0)
    n_p, n_u = len(positive), len(unlabelled)
    flat = np.array([x for v in [*positive, *unlabelled] for x in v], np.int64)
    r = np.repeat(np.arange(n_p + n_u), [len(v) for v in [*positive, *unlabelled]])
    ids, c = np.unique(flat, return_inverse=True)
    k = len(ids)
    w, b = np.zeros(k), float(np.log(prior / (1 - prior))) if prior < 1 else 0.0
    m1, m2 = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, STEPS + 1):
        s = 1 / (1 + np.exp(-np.clip(b + np.bincount(r, w[c], minlength=n_p + n_u), -60, 60)))
        lost = -np.log1p(-np.minimum(s, 1 - 1e-12))
        gain_p = prior * (s[:n_p] - 1) / n_p  # of c E_P[l(+)]
        harm = np.concatenate([-prior * s[:n_p] / n_p, s[n_p:] / n_u])  # of E_U[l(-)] - c E_P[l(-)]
        negative = lost[n_p:].mean() - prior * lost[:n_p].mean() < 0
        g = -harm if negative else harm + np.concatenate([gain_p, np.zeros(n_u)])
        grad = np.append(np.bincount(c, g[r], minlength=k) + DECAY * w, g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        step = RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:k], b - step[k]
    return Model(dict(zip(ids.tolist(), w.tolist())), float(b))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """A model from the documents whose fold is not 0."""
    marks = labels.where(col(label_col).isNotNull()).groupBy(col(id_col).alias("doc_id")).agg(F.max(col(label_col).cast("int")).alias("toxic")).where(fold_of("doc_id") != 0)
    n = marks.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    prior = (n["p"] or 0) / max(1, n["n"])
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    picked_p = marks.where("toxic = 1").orderBy(order, "doc_id").limit(max_positive).select("doc_id", F.lit(True).alias("p"))
    picked_u = marks.orderBy(F.xxhash64(F.lit("unlabelled"), "doc_id"), "doc_id").limit(max_unlabelled).select("doc_id", F.lit(False).alias("p"))
    # at most max_positive + max_unlabelled ids
    picked = F.broadcast(picked_p.union(picked_u).withColumnRenamed("doc_id", "d"))
    rows = _examples(docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text")), picked, max_positive, max_unlabelled)
    sample = _features(rows, None)
    counts = sample.select("p", F.explode("f").alias("f")).groupBy("f").agg(F.count_if("p").alias("in_p"), F.count_if(~F.col("p")).alias("in_u"))
    sizes = sample.agg(F.count_if("p").alias("p"), F.count_if(~F.col("p")).alias("u")).first()
    # what most separates the two samples, by the z score of the shares of texts that have it
    p, u = ((F.col(f"in_{x}") + 0.5) / (sizes[x] + 1) for x in "pu")
    z = F.abs((p - u) / F.sqrt(p * (1 - p) / max(1, sizes["p"]) + u * (1 - u) / max(1, sizes["u"])))
    best = counts.where(F.col("in_p") + F.col("in_u") >= MIN_DOCUMENTS).select("f", z.alias("z")).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "f").limit(FEATURES)
    only = {r["f"] for r in best.collect()}
    # at most FEATURES numbers of each of the sampled rows
    both = sorted((r["p"], list(r["f"])) for r in _features(rows, only).collect())  # whatever the order of partitions
    return fit([v for q, v in both if q], [v for q, v in both if not q], prior)


def _examples(own: DataFrame, picked: DataFrame, max_positive: int, max_unlabelled: int) -> DataFrame:
    """p, text: the rows of the picked ids, each different one once, and no more than the limits.

    An id may stand on very many rows. So rows are chosen by a hash of id and text, first as
    hashes alone, and their texts are fetched for those that are chosen.
    """
    keys = [F.xxhash64("doc_id", "text").alias("h"), F.xxhash64(F.lit(6), "doc_id", "text").alias("t")]
    each = own.join(picked, own["doc_id"] == picked["d"]).select("p", *keys, "text")
    hashed = each.select("p", "h", "t").distinct()
    few = [hashed.where(F.col("p") == toxic).orderBy("h", "t").limit(most) for toxic, most in ((True, max_positive), (False, max_unlabelled))]
    chosen = F.broadcast(few[0].union(few[1]))  # at most max_positive + max_unlabelled rows
    return stored(each.join(chosen, ["p", "h", "t"]).dropDuplicates(["p", "h", "t"]).select("p", "text"), "examples")


def _features(rows: DataFrame, only: set[int] | None) -> DataFrame:
    def make():
        run = features(only)
        return lambda texts: [[sorted(run(t)) for t in texts]]

    return map_text(rows, "text", ["p"], [StructField("f", ArrayType(IntegerType()))], make)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def make():
        one = model.scorer()
        return lambda texts: [[one(t) for t in texts]]

    own = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    scored = map_text(own, "text", ["doc_id"], [StructField("score", DoubleType())], make)
    return scored.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that score below one half."""

    def make():
        one = model.scorer()
        return lambda texts: [one(t) < 0.5 for t in texts]

    return filter_text(docs, text_col, make)
