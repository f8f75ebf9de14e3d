"""Quality rules with robust multivariate outliers.

Every text gets counts and, from them, a vector of seven transformed statistics.
Texts with fewer than 50 words, or over half of whose words are in repeated
windows of three, fail by rule. For the others a minimum-covariance-determinant
estimate of centre and scatter is made for each language and source. Sources with
fewer than ``LEAST`` such texts are judged by the estimate of their whole language,
small languages by that of all texts.

The estimate has three deterministic starts: medians and quartile ranges alone, and
with the correlations of hyperbolic tangents and of spatial signs. From each,
concentration steps are taken: the three quarters of a group that lie nearest give
the next centre and scatter. The start that ends with the least determinant counts,
made consistent with the normal distribution. All documents take part: quantiles
come from counts over fine bins and scatter from sums, so a group of any size is
combined before it is shuffled, and only one row per group, or per group and bin,
is gathered.

The cube root of a squared Mahalanobis distance is near normal (Wilson and
Hilferty). Its median and quartile range in the group give the score of a text; a
text is rejected if that is beyond the normal quantile at 1 - ``TAIL``.

Defined cases: null and empty texts have no words and fail by rule; null
languages and sources are groups of their own; with fewer texts than ``LEAST`` in
all nobody is rejected by distance; a statistic that hardly varies in a group
counts with a least standard deviation, so constant statistics and equal rows do
no harm; repeated rows each get their result; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField

from spanforge.llm.common import col, map_text, stored

#: Least standard deviations of: log words, word length, and the roots of the shares of symbols, repeated words, repeated lines, capitals, punctuation.
FLOORS = (0.1, 0.1, 0.02, 0.1, 0.15, 0.01, 0.01)
D = len(FLOORS)
HALF = 0.75
STEPS = 5
LEAST = 200
#: The share of normal texts that may be rejected.
TAIL = 1e-7

_SPACE, _SYMBOLS, _CAPITALS, _MARKS = b" \t\n\v\f\r", b"#*$%&|<>", bytes(range(65, 91)), b".,!?;:\"'()"
_X = [f"x{i}" for i in range(D)]


def counts(text: bytes | None) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the statistics."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return 0, 0, len(text or b"") - len((text or b"").translate(None, _SYMBOLS)), 0, 0, [0.0] * D
    chars = len(text.translate(None, _SPACE + bytes(range(0x80, 0xC0))))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    threes = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(threes)) < len(threes):
        seen: dict = {}
        cover = bytearray(n)
        for i, x in enumerate(threes):
            first = seen.setdefault(x, i)
            if first != i:
                cover[i : i + 3] = cover[first : first + 3] = b"\x01\x01\x01"
        repeated = sum(cover)
    share = [symbols / chars, repeated / n, dup / len(lines), (len(text) - len(text.translate(None, _CAPITALS))) / chars, (len(text) - len(text.translate(None, _MARKS))) / chars]
    return n, chars, symbols, dup, repeated, [float(np.log1p(n)), min(chars / n, 50.0), *[float(np.sqrt(x)) for x in share]]


def statistics(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = [StructField(x, LongType()) for x in names] + [StructField("base_failed", BooleanType()), StructField("x", ArrayType(DoubleType()))]

    def make():
        def run(texts):
            rows = [counts(t) for t in texts]
            base = [r[0] < 50 or 100 * r[4] > 50 * r[0] for r in rows]
            return [*[[r[i] for r in rows] for i in range(5)], base, [r[5] for r in rows]]

        return run

    own = docs.select(col(id_col).alias("doc_id"), col(lang_col).cast("string").alias("lang"), col(source_col).cast("string").alias("source"), col(text_col).alias("text"))
    return map_text(own, "text", ["doc_id", "lang", "source"], fields, make).select("*", *[F.get("x", F.lit(i)).alias(x) for i, x in enumerate(_X)]).drop("x")


def _keyed(stats: DataFrame) -> DataFrame:
    """stats with ``g``, the group that a document is judged by, and ``fits``, those that it is part of."""
    none = "\x02"
    lang, source = F.coalesce("lang", F.lit(none)), F.coalesce("source", F.lit(none))
    full = stats.withColumns({"_l": lang, "_s": source})
    each = stored(full.where("not base_failed").groupBy("_l", "_s").agg(F.count("*").alias("n")), "quality-sizes")
    langs = each.groupBy("_l").agg(F.sum("n").alias("m"), F.min("n").alias("least"))
    few = langs.where(f"m < {LEAST}").isEmpty()
    own, whole = F.concat_ws("\x01", F.lit("2"), "_l", "_s"), F.concat_ws("\x01", F.lit("1"), "_l")
    g = F.when(F.col("n") >= LEAST, own).when(F.col("m") >= LEAST, whole).otherwise("0")
    fits = F.array(F.when(F.col("n") >= LEAST, own), F.when((F.col("m") >= LEAST) & (F.col("least") < LEAST), whole), F.lit(None if few else "0"))
    groups = each.join(langs.withColumnRenamed("_l", "_r"), F.col("_l") == F.col("_r")).select(F.col("_l").alias("kl"), F.col("_s").alias("ks"), g.alias("g"), F.array_compact(fits).alias("fits"))
    return full.join(_per_group(stored(groups, "quality-groups")), (F.col("_l") == F.col("kl")) & (F.col("_s") == F.col("ks")), "left").drop("_l", "_s", "kl", "ks")


def _at_share(binned: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """For rows (keys, bin): per key the least bin with at least each share of its rows at or below it."""
    w = Window.partitionBy(*keys)
    tally = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    summed = tally.withColumns({"below": F.sum("n").over(w.orderBy("bin")), "all": F.sum("n").over(w)})
    return summed.groupBy(*keys).agg(*[F.min(F.when(F.col("below") >= F.ceil(F.col("all") * q), F.col("bin"))).alias(name) for name, q in shares.items()])


_DISTANCE_BINS, _VALUE_BINS, _ROOT_BINS = 40, 200, 200
#: Tables of one row per group are broadcast up to so many groups; beyond, they are joined by exchange.
MAX_BROADCAST_GROUPS = 20_000


def _per_group(groups: DataFrame) -> DataFrame:
    return F.broadcast(groups) if groups.count() <= MAX_BROADCAST_GROUPS else groups


def _distance() -> Column:
    """The squared distance from the columns m0.. and p00.. of a group's estimate."""
    c = [f"(x{i} - m{i})" for i in range(D)]
    return F.expr(" + ".join(f"{1 if i == j else 2} * {c[i]} * {c[j]} * p{i}{j}" for i, j in _PAIRS))


_PAIRS = list(combinations_with_replacement(range(D), 2))
_M, _P = [f"m{i}" for i in range(D)], [f"p{i}{j}" for i, j in _PAIRS]
_ESTIMATE = ", ".join(["g string", "b int", "det double", *[f"{x} double" for x in _M + _P]])


def chi_squared(x: float, k: int) -> float:
    """The chi-squared distribution function with k degrees of freedom."""
    a, t = k / 2, x / 2
    term = total = math.exp(a * math.log(t) - t - math.lgamma(a + 1)) if x > 0 else 0.0
    n = a
    while term > 1e-17 * total:
        n += 1
        term *= t / n
        total += term
    return total


def consistency(half: float, d: int) -> float:
    """By what the scatter of the nearest share of a normal distribution is too small."""
    low, high = 0.0, 100.0 * d
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_squared(mid, d) < half else (low, mid)
    return half / chi_squared(low, d + 2)


def _table(rows: list[list]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * (3 + len(_M) + len(_P))
    types = [pa.string(), pa.int32(), *[pa.float64()] * (len(cols) - 2)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["g", "b", "det", *_M, *_P])


def _estimate(g: str, b: int, m: np.ndarray, cov: np.ndarray) -> list:
    """A row of _ESTIMATE: a statistic that hardly varies gets its least variance."""
    cov = cov.copy()
    cov[np.diag_indices(D)] = np.maximum(np.diag(cov), np.square(FLOORS))
    p = np.linalg.inv(cov)
    return [g, b, float(np.linalg.slogdet(cov)[1]), *m.tolist(), *[float(p[i, j]) for i, j in _PAIRS]]


def _full(r: dict, name: str) -> np.ndarray:
    out = np.zeros((D, D))
    for i, j in _PAIRS:
        out[i, j] = out[j, i] = r[f"{name}{i}{j}"]
    return out


def starts(fit: DataFrame) -> DataFrame:
    """Three first estimates of each group."""
    each = fit.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(x) * _VALUE_BINS).alias("bin")) for i, x in enumerate(_X)])).alias("v")).select("g", "v.i", "v.bin")
    q = _at_share(each, ["g", "i"], {"low": 0.25, "mid": 0.5, "high": 0.75})
    floor = F.element_at(F.array(*[F.lit(f) for f in FLOORS]), F.col("i") + 1)
    sd = F.greatest((F.col("high") - F.col("low")) / _VALUE_BINS / 1.349, floor)
    value = lambda c, name: [F.max(F.when(F.col("i") == i, c)).alias(f"{name}{i}") for i in range(D)]
    scales = stored(q.groupBy("g").agg(*value((F.col("mid") + 0.5) / _VALUE_BINS, "m"), *value(sd, "d")), "quality-scales")
    u = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"d{i}") for i in range(D)]
    length = F.sqrt(sum((x * x for x in u), F.lit(1e-12)))
    own = fit.join(_per_group(scales), "g").select("g", *[F.tanh(x).alias(f"t{i}") for i, x in enumerate(u)], *[(x / length).alias(f"u{i}") for i, x in enumerate(u)])
    sums = own.groupBy("g").agg(*[F.sum(F.col(f"{n}{i}") * F.col(f"{n}{j}")).alias(f"{n}{i}{j}") for n in "tu" for i, j in _PAIRS])

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                m, d = np.array([r[f"m{i}"] for i in range(D)]), np.array([r[f"d{i}"] for i in range(D)])
                rows.append(_estimate(r["g"], 0, m, np.diag(d * d)))
                for b, name in enumerate("tu", 1):
                    s = _full(r, name)
                    own = np.sqrt(np.maximum(np.diag(s), 1e-12))
                    cor = s / np.outer(own, own) * (1 - 1e-6)
                    np.fill_diagonal(cor, 1.0)
                    rows.append(_estimate(r["g"], b, m, cor * np.outer(d, d)))
            yield _table(rows)

    return sums.join(_per_group(scales), "g").mapInArrow(run, _ESTIMATE)


def _solved(sums: DataFrame) -> DataFrame:
    """The next estimate of each group and start from its sums: one row each."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                m = np.array([r[f"s{i}"] for i in range(D)]) / r["n"]
                rows.append(_estimate(r["g"], r["b"], m, _full(r, "s") / r["n"] - np.outer(m, m)))
            yield _table(rows)

    return sums.mapInArrow(run, _ESTIMATE)


def estimates(fit: DataFrame) -> DataFrame:
    """g, b, det, m*, p*: the estimate of each group with the least determinant, consistent with
    the normal distribution, and mid and spread of the cube roots of its distances."""
    now = stored(starts(fit), "quality-estimates")
    for _ in range(STEPS):
        far = fit.join(_per_group(now), "g").select("g", "b", *_X, F.floor(F.log(F.lit(1e-9) + _distance()) * _DISTANCE_BINS).alias("bin"))
        edge = stored(_at_share(far.select("g", "b", "bin"), ["g", "b"], {"edge": HALF}), "quality-edges")
        near = far.join(_per_group(edge), ["g", "b"]).where("bin <= edge")
        sums = near.groupBy("g", "b").agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(D)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in _PAIRS])
        now = stored(_solved(sums), "quality-estimates")
    best = now.groupBy("g").agg(F.min_by(F.struct(*now.columns[1:]), F.struct("det", "b")).alias("e")).select("g", "e.*")
    scale = consistency(HALF, D)
    best = stored(best.select("g", "b", "det", *_M, *[(F.col(p) / scale).alias(p) for p in _P]), "quality-estimates")
    roots = fit.join(_per_group(best), "g").select("g", F.floor(_root() * _ROOT_BINS).alias("bin"))
    q = _at_share(roots, ["g"], {"low": 0.25, "mid": 0.5, "high": 0.75})
    spread = F.greatest(F.col("high") - F.col("low"), F.lit(1)) / _ROOT_BINS / 1.349
    return best.join(q.select("g", ((F.col("mid") + 0.5) / _ROOT_BINS).alias("mid"), spread.alias("spread")), "g")


def _root() -> Column:
    """The cube root of the squared distance by its degrees of freedom."""
    return F.cbrt(F.greatest(_distance(), F.lit(0.0)) / D)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tail: float = TAIL) -> DataFrame:
    """doc_id, the counts, base_failed, distance (null if none was taken) and kept of every row.

    distance is how many standard deviations of the group's cube roots that of the text lies above their median.
    """
    stats = stored(_keyed(stored(statistics(docs, id_col, text_col, lang_col, source_col), "quality-counts")), "quality-statistics")
    fit = stats.where("not base_failed").select(F.explode("fits").alias("g"), *_X)
    sizes = fit.groupBy("g").agg(F.count("*").alias("size"))
    found = stored(estimates(fit).join(sizes, "g"), "quality-final")
    far = stats.join(_per_group(found), "g", "left").withColumn("distance", F.when((F.col("size") >= LEAST) & ~F.col("base_failed"), (_root() - F.col("mid")) / F.col("spread")))
    within = F.coalesce("distance", F.lit(0.0)) <= NormalDist().inv_cdf(1 - tail)
    return far.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", (~F.col("base_failed") & within).alias("kept"))
