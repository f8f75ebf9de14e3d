"""Interpolated modified Kneser-Ney language model over words, order two.

Counting: tasks count pairs of neighbouring words in blocks, deal the sorted
counts over buckets as packed columns, and Spark shuffles those; a bucket adds
up its pairs and writes them as arrays sorted by hash to the shared folder. From
the pairs follow the counts of words and their continuation counts, dealt and
added up in the same way. Workers map the arrays into memory and look up what
they need, so the model's size is not bounded by their memory.

Pairs are dealt by their first word, so the sums of a context stay in one
bucket. Words that open more than a quarter of a bucket's share of pairs in a small
sample (at most ``HOT`` of them) are dealt by both words instead, and their sums are
added up by Spark; the sample decides on that layout alone, never on a count.

A block of counts is dealt to at most ``FANOUT`` places. Where there are more buckets
than that, blocks meet halfway: in groups of buckets, as many tasks for each as there
are blocks for them, from which they are dealt on.

    p(w | v) = (c(v w) - D) / T(v) + g(v) p(w)
    p(w)     = (k(w) - D') / K + g' / (V + 1)

with k(w) the number of different words before w, discounts D for counts one,
two and more by Chen and Goodman, and g what the discounts set free. A context
not seen gives p(w); a word not seen has k(w) = 0 and no discount.

Words and pairs are known by hashes of 56 and 64 bits. The shared folder must
be mounted at the same path everywhere, as memory mapping needs files.

Defined cases: a null or empty text is its end token alone; rows of training
documents that are repeated count again; without training documents the model
knows no word and gives every token log10(1 / (V + 1)) with V = 0; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from spanforge.llm.common import TEXT, col, fold_of, map_text, shared_path, slices

BLOCK = 3_000_000
FANOUT = 1_024
HOT = 20_000
SAMPLE_ROWS = 2_000
#: The numbers of sums that come to the driver; from CONTEXTS on, four for each hot word.
PAIRS, WORDS, FREE, TOKENS, SIZE, LEFT, CONTEXTS = 0, 4, 8, 11, 12, 13, 14
#: Files that a worker keeps mapped.
MAPS = 4_000
MASK = (1 << 56) - 1

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & MASK


START, END = _hash(b" start"), _hash(b" end")


class _Known(dict):
    def __missing__(self, word: bytes) -> int:
        h = _hash(word)
        if len(self) < 400_000:
            self[word] = h
        return h


_KNOWN = _Known()


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens, and how many each text has, its end included."""
    get, parts, sizes = _KNOWN.__getitem__, [], []
    for t in texts:
        words = t.translate(_LOWER).split() if t else []
        parts.append(np.fromiter(map(get, words), np.uint64, len(words)))
        parts.append(np.array([END], np.uint64))
        sizes.append(len(words) + 1)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array(sizes, np.int64)


def before(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each token, the start token at the start of a text."""
    v = np.empty_like(h)
    if len(h):
        v[1:] = h[:-1]
        v[np.cumsum(sizes) - sizes] = START
    return v


def mix(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (v * _A) ^ (w * _B)
        x ^= x >> np.uint64(29)
        x *= _A
        return x ^ (x >> np.uint64(32))


def spread(h: np.ndarray, n: int) -> np.ndarray:
    """Buckets 0 to n - 1 of hashes."""
    with np.errstate(over="ignore"):
        return (((h * _B) >> np.uint64(40)) % np.uint64(n)).astype(np.int64)


def pair_bucket(v: np.ndarray, w: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    out = spread(v, n)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
        both = hot[at] == v
        out[both] = spread(mix(v[both], w[both]), n)
    return out


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned integers as compressed byte planes; the first is ascending."""
    n = len(columns[0])
    first = columns[0].astype("<u8")
    first[1:] -= columns[0][:-1].astype("<u8")
    planes = [x.view(np.uint8).reshape(n, 8).T.tobytes() for x in (first, *[c.astype("<u8") for c in columns[1:]])]
    return n.to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes, k: int) -> list[np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=8 * n * k), np.uint8)
    columns = [np.ascontiguousarray(flat[8 * n * i : 8 * n * (i + 1)].reshape(8, n).T).view("<u8").ravel() for i in range(k)]
    columns[0] = np.cumsum(columns[0], dtype=np.uint64)
    return columns


def _added(keys: list[np.ndarray], *sums: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Different keys in ascending order, and the sums of their values."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [k[order] for k in keys]
    if not len(order):
        return keys, [s[order] for s in sums]
    first = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))
    return [k[first] for k in keys], [np.add.reduceat(s[order], first) for s in sums]


def _dealt(buckets: np.ndarray, *columns: np.ndarray):
    """(bucket, blob) for the rows of each bucket, in their order."""
    order = np.argsort(buckets, kind="stable")
    b = buckets[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(buckets[at[0]]), _pack(*[c[at] for c in columns])


def _rows(found) -> pa.RecordBatch:
    found = list(found)
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.binary())], names=["bucket", "blob"])


def local_path(path: str) -> str:
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"the model is memory-mapped, so the shared folder must be a mounted path: {path}")
    return url.path


def _save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """A file of arrays, whole or not at all, whichever attempt of a task writes it."""
    part = f"{folder}/.{name}.{os.getpid()}"
    with open(part, "wb") as f:
        np.array([len(x) for x in arrays.values()], "<u8").tofile(f)
        for x in arrays.values():
            np.ascontiguousarray(x).tofile(f)
    os.replace(part, f"{folder}/{name}")


#: The arrays in the files of a bucket, by the kind of file: keys come first.
LAYOUT = {
    "pair": {"key": "<u8", "count": "<u8"},
    "context": {"key": "<u8", "total": "<u8", "n1": "<u8", "n2": "<u8", "n3": "<u8"},
    "word": {"key": "<u8", "count": "<u8", "left": "<u8"},
}


class Maps:
    """The arrays of files by name; the files used least lately are let go."""

    def __init__(self, folder: str):
        self.folder, self.open = folder, OrderedDict()

    def __call__(self, what: str, bucket: int) -> dict[str, np.ndarray] | None:
        name = f"{what}-{bucket}"
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name]
        path, kinds = f"{self.folder}/{name}", LAYOUT[what]
        found = None
        if os.path.exists(path):
            whole, at, found = np.memmap(path, np.uint8, "r"), 8 * len(kinds), {}
            for size, (k, kind) in zip(whole[:at].view("<u8").tolist(), kinds.items()):
                end = at + size * np.dtype(kind).itemsize
                found[k], at = whole[at:end].view(kind), end
        self.open[name] = found
        if len(self.open) > MAPS:
            self.open.popitem(last=False)
        return found


def _tally(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D for counts 1, 2 and more, from how many have counts 1 to 4."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    out = []
    for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = i - (i + 1) * y * b / a if a else i * 0.5
        out.append(min(max(d, 0.1), i - 0.1 * (i == 1)))
    return out


@dataclass
class Model:
    folder: str
    n: int
    hot: np.ndarray
    hot_contexts: np.ndarray
    tokens: int
    words: int
    continuations: int
    pair_discounts: list[float]
    word_discounts: list[float]
    rest: float
    _maps: Maps | None = field(default=None)

    def __getstate__(self):
        return self.__dict__ | {"_maps": None}

    def _find(self, what: str, keys: np.ndarray, buckets: np.ndarray) -> list[np.ndarray]:
        """The values of keys in the arrays of a kind, 0 where they are not."""
        self._maps = self._maps or Maps(self.folder)
        names = list(LAYOUT[what].items())[1:]
        out = [np.zeros(len(keys), k) for _, k in names]
        order = np.lexsort((keys, buckets))
        for at in np.split(order, np.flatnonzero(np.diff(buckets[order])) + 1):
            arrays = self._maps(what, int(buckets[at[0]])) if len(at) else None
            if not arrays or not len(arrays["key"]):
                continue
            place = np.minimum(np.searchsorted(arrays["key"], keys[at]), len(arrays["key"]) - 1)
            hit = arrays["key"][place] == keys[at]
            for o, (name, _) in zip(out, names):
                o[at[hit]] = arrays[name][place[hit]]
        return out

    def score(self, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n_known, base score and score of each text."""
        v = before(h, sizes)
        w, wi = np.unique(h, return_inverse=True)
        count, left = self._find("word", w, spread(w, self.n))
        base = np.log10((count + 0.5) / (self.tokens + 0.5 * (self.words + 1)))
        d = np.array([0.0, *self.word_discounts])
        p1 = (left - d[np.minimum(left, 3).astype(int)]) / max(1, self.continuations) + self.rest / (self.words + 1)
        c, ci = np.unique(v, return_inverse=True)
        total, n1, n2, n3 = (x.astype(float) for x in self._find("context", c, spread(c, self.n)))
        often = np.isin(c, self.hot)
        total[often], n1[often], n2[often], n3[often] = self.hot_contexts[np.searchsorted(self.hot, c[often])].T
        d1, d2, d3 = self.pair_discounts
        free = np.where(total > 0, (d1 * n1 + d2 * n2 + d3 * n3) / np.maximum(total, 1), 1.0)
        key = mix(v, h)
        pairs, first, pi = np.unique(key, return_index=True, return_inverse=True)
        (seen,) = self._find("pair", pairs, pair_bucket(v[first], h[first], self.hot, self.n))
        dp = np.array([0.0, *self.pair_discounts])
        own = (seen - dp[np.minimum(seen, 3).astype(int)])[pi] / np.maximum(total, 1)[ci]
        p = own + free[ci] * p1[wi]
        text = np.repeat(np.arange(len(sizes)), sizes)
        add = lambda x: np.bincount(text, x, minlength=len(sizes))
        return add((count > 0)[wi].astype(float)).astype(np.int64), add(base[wi]), add(np.log10(p))


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """A model of all the texts of docs."""
    spark = docs.sparkSession
    path = shared_path(spark, "model")
    folder = local_path(path)
    os.makedirs(folder, exist_ok=True)
    own = docs.select(col(text_col).cast("string").alias(TEXT))
    parts = own.rdd.getNumPartitions()
    n = max(16, 2 * parts)
    hot = _hot_words(own, 1 / (4 * n))
    # at most HOT hashes
    shared = spark.sparkContext.broadcast(hot)

    # so many buckets in a row make a group
    wide = 1 if n <= FANOUT else -(-n // round(n**0.5))

    def count(batches):
        parts_v, parts_w, size = [], [], 0

        def flush():
            v, w = np.concatenate(parts_v), np.concatenate(parts_w)
            (v, w), (c,) = _added([v, w], np.ones(len(v), np.uint64))
            b = pair_bucket(v, w, shared.value, n)
            return _rows(_dealt(b // wide, v, w, c))

        for _, texts in slices(batches, 0):
            h, sizes = tokens(texts)
            parts_v.append(before(h, sizes))
            parts_w.append(h)
            size += len(h)
            if size >= BLOCK:
                yield flush()
                parts_v, parts_w, size = [], [], 0
        if size:
            yield flush()

    def grouped(batches):
        """(bucket, blobs): rows are sorted by bucket."""
        now, held = None, []
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b != now and held:
                    yield now, held
                    held = []
                now = b
                held.append(blob)
        if held:
            yield now, held

    def joined(blobs, k):
        return [np.concatenate(x) for x in zip(*[_unpack(b, k) for b in blobs])]

    def dealt_on(batches):
        """From groups to buckets, a block at a time."""
        for _, blobs in grouped(batches):
            held, size = [], 0
            for i, blob in enumerate(blobs):
                held.append(blob)
                size += int.from_bytes(blob[:8], "little")
                if size >= BLOCK or i + 1 == len(blobs):
                    v, w, c = joined(held, 3)
                    (v, w), (c,) = _added([v, w], c)
                    yield _rows(_dealt(pair_bucket(v, w, shared.value, n), v, w, c))
                    held, size = [], 0

    def noted(sums):
        """Rows of a sum's number and the sum, beside no blob."""
        names, values = zip(*[(int(k), int(x)) for k, x in sums])
        return pa.RecordBatch.from_arrays([pa.array([-1] * len(names), pa.int32()), pa.nulls(len(names), pa.binary()), pa.array(names, pa.int64()), pa.array(values, pa.int64())], names=["bucket", "blob", "name", "value"])

    def unnoted(rows):
        return pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(rows.num_rows, pa.int64()), pa.nulls(rows.num_rows, pa.int64())], names=["bucket", "blob", "name", "value"])

    def pairs(batches):
        for b, blobs in grouped(batches):
            v, w, c = joined(blobs, 3)
            (v, w), (c,) = _added([v, w], c)
            key = mix(v, w)
            order = np.argsort(key)
            _save(folder, f"pair-{b}", {"key": key[order].astype("<u8"), "count": c[order].astype("<u8")})
            one, two = (c == 1).astype(np.uint64), (c == 2).astype(np.uint64)
            (ctx,), sums = _added([v], c, one, two, np.uint64(1) - one - two)
            cold = ~np.isin(ctx, shared.value)
            _save(folder, f"context-{b}", {"key": ctx[cold].astype("<u8")} | {x: s[cold].astype("<u8") for x, s in zip(("total", "n1", "n2", "n3"), sums)})
            (word,), (total, left) = _added([w], c, np.ones(len(w), np.uint64))
            yield unnoted(_rows(_dealt(spread(word, n), word, total, left)))
            yield noted([(PAIRS + i, x) for i, x in enumerate(_tally(c))])
            often = np.flatnonzero(~cold)
            if len(often):
                place = np.searchsorted(shared.value, ctx[often])
                yield noted([(CONTEXTS + 4 * k + j, s[i]) for k, i in zip(place.tolist(), often.tolist()) for j, s in enumerate(sums)])

    def words(batches):
        told = []

        def blobs_alone():
            for batch in batches:
                told.append(batch.filter(pc.less(batch.column(0), 0)).select([2, 3]))
                yield batch.filter(pc.greater_equal(batch.column(0), 0))

        for b, blobs in grouped(blobs_alone()):
            w, c, left = joined(blobs, 3)
            (w,), (c, left) = _added([w], c, left)
            _save(folder, f"word-{b}", {"key": w.astype("<u8"), "count": c.astype("<u8"), "left": left.astype("<u8")})
            free = [(left == 1).sum(), (left == 2).sum(), (left > 2).sum()]
            yield noted([*enumerate(_tally(left), WORDS), *enumerate(free, FREE), (TOKENS, c.sum()), (SIZE, len(w)), (LEFT, left.sum())]).select([2, 3])
        yield from told

    kind, both = "bucket int, blob binary", "bucket int, blob binary, name long, value long"
    first = own.mapInArrow(count, kind)
    if wide > 1:
        tasks = F.lit(max(1, parts * wide // n))
        first = first.repartition(parts, "bucket", F.pmod(F.crc32("blob"), tasks)).sortWithinPartitions("bucket").mapInArrow(dealt_on, kind)
    first = first.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(pairs, both)
    spots = F.coalesce(F.col("bucket"), F.lit(0)) + F.coalesce(F.col("name"), F.lit(0))
    second = first.repartition(n, spots).sortWithinPartitions("bucket").mapInArrow(words, "name long, value long")
    # at most 4 rows for each hot word, and a few for all
    sums = {r["name"]: r["value"] for r in second.groupBy("name").agg(F.sum("value").alias("value")).collect()}
    total = lambda name, k: [sums.get(name + i, 0) for i in range(k)]
    word_d = discounts(*total(WORDS, 4))
    contexts = np.array(total(CONTEXTS, 4 * len(hot)), float).reshape(-1, 4)
    left = sums.get(LEFT, 0)
    rest = sum(d * m for d, m in zip(word_d, total(FREE, 3))) / left if left else 1.0
    return Model(folder, n, hot, contexts, sums.get(TOKENS, 0), sums.get(SIZE, 0), left, discounts(*total(PAIRS, 4)), word_d, rest)


def _hot_words(own: DataFrame, share: float) -> np.ndarray:
    """Hashes of words with that share in a bounded sample of whole texts; they only decide where pairs are counted."""

    def shares(batches):
        for _, texts in slices(batches, 0):
            h, sizes = tokens(texts)
            w, c = np.unique(before(h, sizes), return_counts=True)
            top = np.argsort(-c)[: 2 * HOT]
            yield pa.RecordBatch.from_arrays([pa.array(w[top].astype(np.int64)), pa.array(c[top])], names=["w", "c"])

    # about so many rows from all over the input, whatever it is sorted by
    some = own.where(F.rand(11) < SAMPLE_ROWS / max(1, own.count()))
    found = some.mapInArrow(shares, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    rows = found.orderBy(F.desc("c"), "w").limit(HOT).collect()
    all_ = sum(r["c"] for r in rows)
    return np.sort(np.array([r["w"] for r in rows if r["c"] >= max(2, share * all_)], np.uint64))


def perplexity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [StructField("n_tokens", LongType()), StructField("n_known", LongType()), StructField("base_score", DoubleType()), StructField("score", DoubleType())]

    def make():
        own = shared.value

        def run(texts):
            h, sizes = tokens(texts)
            known, base, full = own.score(h, sizes)
            return [sizes, known, base, full]

        return run

    own = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    scored = map_text(own, "text", ["doc_id"], fields, make)
    return scored.select("doc_id", (fold_of("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
