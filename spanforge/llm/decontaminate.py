"""Benchmark decontamination by word windows.

Words: A-Z in lower case, then runs of ASCII letters and digits and of all
characters beyond ASCII. A window is 13 consecutive words of a benchmark item;
an item of fewer words, but not none, is one window. A document word inside any
occurrence of a window is hit.

The windows of the benchmark are broadcast as a hash set as long as their
number is within ``MAX_WINDOWS``; every text is scanned once and hits are
verified word by word. A larger benchmark is not broadcast: window hashes of
benchmark and documents meet in an equality join instead, after a bitmap of
bounded size has let through what places of the documents can be hit.

Defined cases: null and empty texts have no words and are never contaminated;
an item without words has no window; items with the same words are all named;
a null item id is named as an empty string; repeated rows each get their
result; an empty benchmark hits nothing; other columns are ignored or, in
``drop_contaminated``, kept as they are.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField

from spanforge.llm.common import TEXT, col, filter_text, map_text, stored

HASH = "_sf_hash"
N = 13
MAX_WINDOWS = 300_000
#: The bitmap before the join has so many bits at most (16 MB), for 32 bits a window of four million windows.
MAP_BITS = 27
#: 20 * n_hit >= n_words makes a document contaminated.
HIT_PARTS = 20

_WORD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD).split() if text else []


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values, by doubling."""
    with np.errstate(over="ignore"):
        out, have, power, step, width = None, 0, np.uint64(1), h, 1
        p = _P
        while n:
            if n & width:
                if out is None:
                    out, have, power = step, width, p
                else:
                    m = min(len(out), len(step) - have)
                    out = out[:m] + power * step[have : have + m] if m > 0 else out[:0]
                    have, power = have + width, power * p
                n -= width
            if n:
                m = len(step) - width
                step = step[:m] + p * step[width:] if m > 0 else step[:0]
                p, width = p * p, 2 * width
        return out


class Scanner:
    """Occurrences of the windows of a benchmark in a text."""

    def __init__(self, windows: dict[tuple[bytes, ...], list[str]]):
        self.windows = windows
        self.ids: dict[bytes, int] = {}
        for w in windows:
            for x in w:
                self.ids.setdefault(x, len(self.ids) + 1)
        rng = np.random.default_rng(0)
        self.value = rng.integers(1, 2**63, len(self.ids) + 1, dtype=np.uint64)
        by: dict[int, list[np.uint64]] = defaultdict(list)
        for w in windows:
            by[len(w)].append(rolling(self.value[[self.ids[x] for x in w]], len(w))[0])
        self.hashes = {n: np.unique(np.array(v, np.uint64)) for n, v in by.items()}

    def scan(self, words: list[bytes]) -> tuple[int, set[str]]:
        """The number of hit words, and the items whose windows occur."""
        get = self.ids.get
        ids = np.fromiter([get(w, 0) for w in words], np.int64, len(words))
        items: set[str] = set()
        spans = []
        for n, hashes in self.hashes.items():
            if len(ids) < n:
                continue
            known = np.concatenate([[0], np.cumsum(ids > 0)])
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            h = rolling(self.value[ids], n)[at]
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in at[hashes[place] == h].tolist():
                found = self.windows.get(tuple(words[i : i + n]))
                if found is not None:
                    items.update(found)
                    spans.append((i, i + n))
        if not spans:
            return 0, items
        cover = np.zeros(len(words) + 1, np.int64)
        for s, e in spans:
            cover[s] += 1
            cover[e] -= 1
        return int((np.cumsum(cover) > 0).sum()), items


def item_windows(benchmark: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """item string, words array: the distinct windows of each item."""
    fields = [StructField("windows", ArrayType(ArrayType(StringType())))]

    def make():
        def run(texts):
            out = []
            for t in texts:
                w = [x.decode("utf-8", "replace") for x in words_of(t)]
                out.append([list(x) for x in dict.fromkeys(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))] if w else [])
            return [out]

        return run

    items = benchmark.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("item"), col(text_col).alias("text"))
    return map_text(items, "text", ["item"], fields, make).select("item", F.explode("windows").alias("words")).distinct()


def summed(n_words: int, n_hit: int, items) -> tuple:
    names = sorted(items)
    return n_words, n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0 and HIT_PARTS * n_hit >= n_words


FIELDS = [
    StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("n_items", LongType()),
    StructField("items_sha256", StringType()), StructField("contaminated", BooleanType()),
]


def _scanner(benchmark: DataFrame, n: int, max_windows: int, item_id: str, item_text: str):
    """A broadcast function words -> (n_hit, items), or the windows alone if they are too many."""
    spark = benchmark.sparkSession
    windows = stored(item_windows(benchmark, n, item_id, item_text), "windows")
    if windows.count() > max_windows:
        return None, windows
    found: dict[tuple[bytes, ...], list[str]] = defaultdict(list)
    for r in windows.collect():
        found[tuple(w.encode() for w in r["words"])].append(r["item"])
    return spark.sparkContext.broadcast(dict(found)), windows


def judge(docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs."""
    small, windows = _scanner(benchmark, n, max_windows, item_id, item_text)
    own = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    if small is None:
        return _joined(own, windows, n)

    def make():
        scanner = Scanner(small.value)

        def run(texts):
            rows = []
            for t in texts:
                w = words_of(t)
                rows.append(summed(len(w), *scanner.scan(w)))
            return [list(c) for c in zip(*rows)] if rows else [[] for _ in FIELDS]

        return run

    return map_text(own, "text", ["doc_id"], FIELDS, make)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated."""
    small, windows = _scanner(benchmark, n, max_windows, item_id, item_text)
    if small is None:
        # ids may repeat or be null, so a row is known by its id and the hash of its text
        marked = _joined(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), windows, n, keep_hash=True)
        gone = marked.where("contaminated").select(F.col("doc_id").alias(TEXT), F.col("th").alias(HASH)).distinct()
        return docs.join(gone, col(id_col).eqNullSafe(F.col(TEXT)) & (F.xxhash64(col(text_col)) == F.col(HASH)), "left_anti")

    def make():
        scanner = Scanner(small.value)

        def clean(t):
            w = words_of(t)
            hit = scanner.scan(w)[0]
            return not (hit and HIT_PARTS * hit >= len(w))

        return lambda texts: [clean(t) for t in texts]

    return filter_text(docs, text_col, make)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 400_000:
            self[word] = h
        return h


_WORD_HASHES = _WordHashes()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORD_HASHES.__getitem__, words), np.uint64, len(words))


def _bitmap(keyed: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the windows by the upper bits of f, and by how much f is shifted: at most 2 ** MAP_BITS bits."""
    bits = min(MAP_BITS, max(16, (32 * keyed.count()).bit_length()))
    place = F.shiftrightunsigned("f", 64 - bits)
    # at most 2 ** (MAP_BITS - 6) rows
    parts = keyed.groupBy(F.shiftright(place, 6).alias("k")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(f, {64 - bits}) & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[parts["k"].to_numpy()] = parts["v"].to_numpy().view(np.uint64)
    return out, 64 - bits


def _joined(own: DataFrame, windows: DataFrame, n: int, keep_hash: bool = False) -> DataFrame:
    """The same result by an equality join of 128-bit window hashes, and th, the hash of the text, if asked for.

    A bitmap lets few places of the documents through to the join but those that
    are hit. The join is with the different windows; a document's windows meet
    the items that have them only afterwards, once each.
    """
    names = "h1 long, h2 long"

    def key(words: list[bytes]) -> tuple[int, int]:
        x = xxhash.xxh3_128_intdigest(b" ".join(words))
        return int(np.uint64(x >> 64).astype(np.int64)), int(np.uint64(x & 0xFFFFFFFFFFFFFFFF).astype(np.int64))

    def items(batches):
        for b in batches:
            each = [[w.encode() for w in ws] for ws in b.column(1).to_pylist()]
            keys = [key(ws) for ws in each]
            f = np.array([rolling(_word_hashes(ws), len(ws))[0] for ws in each], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(ws) for ws in each], pa.int32()), pa.array(f), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], names=["item", "n", "f", "h1", "h2"])

    keyed = stored(windows.mapInArrow(items, f"item string, n int, f long, {names}"), "window-hashes")
    different = stored(keyed.select("n", "f", "h1", "h2").distinct(), "different-windows")
    sizes = [r["n"] for r in different.select("n").distinct().collect()]  # at most 13 values
    shared = own.sparkSession.sparkContext.broadcast(_bitmap(different))
    id_kind = own.schema["doc_id"].dataType.simpleString()
    source = own.select("doc_id", F.xxhash64("text").alias("th"), col("text").cast("string").alias("text"))

    def spread(batches):
        bitmap, shift = shared.value
        for b in batches:
            for i, t in enumerate(b.column(2).cast(pa.binary()).to_pylist()):
                w = words_of(t)
                h = _word_hashes(w)
                for size in sizes:
                    if len(w) < size:
                        continue
                    place = rolling(h, size) >> np.uint64(shift)
                    at = np.flatnonzero(bitmap[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1))
                    for s in range(0, len(at), 10_000):
                        some = at[s : s + 10_000]
                        keys = [key(w[j : j + size]) for j in some.tolist()]
                        take = pa.array([i] * len(keys))
                        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(some.astype(np.int32)), pa.array([size] * len(keys), pa.int32()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())], names=["doc_id", "th", "at", "n", "h1", "h2"])

    places = source.mapInArrow(spread, f"doc_id {id_kind}, th long, at int, n int, {names}")
    found = stored(places.join(different.drop("f"), ["n", "h1", "h2"]), "window-hits")
    named = found.select("doc_id", "th", "n", "h1", "h2").distinct().join(keyed.drop("f"), ["n", "h1", "h2"]).select("doc_id", "th", "item").distinct()
    spans = found.select("doc_id", "th", F.lit(None).cast("string").alias("item"), F.struct("at", "n").alias("span"))
    hits = spans.unionByName(named, allowMissingColumns=True).groupBy("doc_id", "th").agg(F.collect_set("item").alias("items"), F.collect_set("span").alias("spans"))
    hits = hits.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "items", "spans")
    both = source.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")

    def finish(batches):
        for b in batches:
            rows = []
            for t, its, spans in zip(b.column(2).cast(pa.binary()).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                m = len(words_of(t))
                hit = np.zeros(m, bool)
                for s in spans or []:
                    hit[s["at"] : s["at"] + s["n"]] = True
                rows.append(summed(m, int(hit.sum()), its or []))
            cols = list(zip(*rows)) if rows else [[] for _ in FIELDS]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", "th", *[f.name for f in FIELDS]])

    kinds = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    judged = both.select("doc_id", "th", "text", "items", "spans").mapInArrow(finish, f"doc_id {id_kind}, th long, {kinds}")
    return judged if keep_hash else judged.drop("th")
