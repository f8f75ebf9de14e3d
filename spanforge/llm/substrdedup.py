"""Removal of passages of 35 words that occur more than once, by phrase automata.

A window is 35 consecutive words of a document. A word goes if a window covers
it whose word sequence also starts anywhere else, in the same document or
another; windows are judged on the input.

1. Runs. Of the six-word phrases in a window the one with the least hash is its
   anchor. Consecutive windows with one anchor are a run, known by the hashes of
   anchor and words (128 bits in all). Runs are counted over all documents, each
   task combining its own first, so no document is named but the one of least key.
2. Confirmation. The windows of a run that occurs twice all recur. A run that
   occurs once can share some of its windows with other runs of its anchor, as at
   both ends of a recurring passage: windows of such runs are counted one by one,
   again combined before the shuffle, and where they recur is noted. The
   documents named in step 1 give the words of the runs that recur: the passages.
3. Automata. Documents are dealt into shards of bounded size. A passage goes to
   every shard that has one of its runs. Each shard compiles its passages into
   Aho-Corasick automata over word numbers (at most ``PATTERNS`` runs in one) and
   streams all its documents, whole, through them; they locate every occurrence.

Nothing is sampled, and no task gathers the documents of a run, an anchor or a
passage: a passage in a third of all documents costs one row per task, then one
per shard.

Defined cases: null and empty texts have no words; texts of fewer than 35 words
lose none; rows alike in id and text are two places, so their windows repeat;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from spanforge.llm.common import col, slices, stored
from spanforge.llm.decontaminate import rolling

N = 35
PHRASE = 6
#: Text in a shard of documents, in bytes.
SHARD_BYTES = 4 << 20
#: Runs in one automaton of a shard.
PATTERNS = 15_000
#: Words of a document whose recurring runs travel together, as one passage.
SEGMENT = 256

_ODD, _INVERSE = np.uint64(0xD6E8FEB86659FD93), np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 400_000:
            self[word] = h
        return h


_HASHES = _Hashes()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def least(r: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least value in each window of that width."""
    at, size = np.arange(len(r)), 1
    while size < width:
        step = min(size, width - size)
        right = r[step:] < r[: len(r) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        r = np.where(right, r[step:], r[: len(r) - step])
        size += step
    return at


def stretches(h: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words first to end of each stretch, from the hashes of all words; not that of ``rolling``."""
    with np.errstate(over="ignore"):
        x = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(28)
        power = np.cumprod(np.full(len(h) + 1, _ODD), dtype=np.uint64)
        back = np.cumprod(np.full(len(h) + 1, _INVERSE), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(x * power[:-1], dtype=np.uint64)])
        return (sums[end] - sums[first]) * back[first] + (end - first).astype(np.uint64)


def runs(texts: list[list[bytes]]) -> tuple[np.ndarray, ...]:
    """(text, anchor, hash, first window, number of windows) of each run, and the hashes of all windows.

    The texts are laid end to end; windows that lie in two of them are left out.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    h = hashes([w for t in texts for w in t])
    if len(h) < N:
        return *[np.zeros(0, np.int64)] * 5, starts, np.zeros(0, np.int64)
    g = rolling(h, PHRASE)
    text = np.repeat(np.arange(len(texts)), sizes)
    at = least(g >> np.uint64(1), N - PHRASE + 1)
    at = np.where(text[: len(at)] != text[N - 1 :], -1, at)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1 : len(at)] != text[: len(at) - 1])]))
    size = np.diff(np.append(first, len(at)))
    keep = at[first] >= 0
    first, size = first[keep], size[keep]
    whole = stretches(h, first, first + size + N - 1)
    return text[first], g[at[first]].view(np.int64), whole.view(np.int64), first - starts[text[first]], size, starts, rolling(h, N).view(np.int64)


def _words(texts: list[bytes | None]) -> list[list[bytes]]:
    return [t.split() if t else [] for t in texts]


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the keys, and where in it each different key begins."""
    order = np.lexsort(keys[::-1])
    change = [k[order][1:] != k[order][:-1] for k in keys]
    return order, np.flatnonzero(np.concatenate([[True], np.logical_or.reduce(change)])) if len(order) else order


class Automaton:
    """The stretches of texts that are occurrences of any of some word sequences, over word numbers."""

    def __init__(self, patterns):
        self.ids: dict[bytes, int] = {}
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for w in patterns:
            self.found.add_word(tuple([self.ids.setdefault(x, len(self.ids) + 1) for x in w]), len(w))
        if len(self.found):
            self.found.make_automaton()

    def places(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(first word, end) of all occurrences. A word that no sequence has parts the text."""
        if not len(self.found) or len(words) < N:
            return []
        get = self.ids.get
        ids = np.fromiter([get(w, 0) for w in words], np.int64, len(words))
        gaps = np.flatnonzero(np.concatenate([[True], ids == 0, [True]])) - 1
        out = []
        for k in np.flatnonzero(np.diff(gaps) > N).tolist():
            s = int(gaps[k]) + 1
            out += [(s + end - size + 1, s + end + 1) for end, size in self.found.iter(tuple(ids[s : gaps[k + 1]].tolist()))]
        return out


def counted(own: DataFrame) -> DataFrame:
    """m, rh, c, k, v of the runs to look at, from k, text: anchor, hash, how often the run
    occurs, the least key of a document that has it, and whether its anchor has other runs.
    Those are the runs that occur twice and those whose anchor has another run."""

    def each(batches):
        for batch, texts in slices(batches, 1):
            row, m, rh, *_ = runs(_words(texts))
            order, first = _distinct(m, rh)
            k = batch.column(0).to_numpy()[row[order]]
            least_k = np.minimum.reduceat(k, first) if len(first) else k
            yield pa.RecordBatch.from_arrays([pa.array(m[order][first]), pa.array(rh[order][first]), pa.array(least_k), pa.array(np.diff(np.append(first, len(order))))], names=["m", "rh", "k", "c"])

    # no column is null, and the conditions on c and k below always hold: so both readers of the
    # counts want the same of the documents, and what is shuffled for one serves the other
    layout = StructType([StructField(x, LongType(), False) for x in ("m", "rh", "k", "c")])
    every = own.mapInArrow(each, layout).groupBy("m", "rh").agg(F.sum("c").alias("c"), F.min("k").alias("k"))
    several = every.groupBy("m").agg(F.count("*").alias("n"), F.min("c").alias("lc"), F.min("k").alias("lk")).where("n > 1 and lc > 0 and lk is not null").select(F.col("m").alias("m2"))
    both = every.join(several, F.col("m") == F.col("m2"), "left").withColumn("v", F.col("m2").isNotNull())
    return stored(both.where("c > 1 or v").drop("m2"), "runs")


def confirmed(own: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Passages (k, seg, x, cuts, keys), and (k, t, at): the windows of single runs that recur.

    x has the words of the passage, cuts the first word and the number of windows of
    each run in it, keys the runs' anchors and hashes.
    """
    per = known.groupBy("k").agg(F.collect_list(F.struct("m", "rh", "c", "v")).alias("r")).withColumnRenamed("k", "k2")
    both = own.select("k", "t", "text").join(per, F.col("k") == F.col("k2")).select("k", "t", "text", "r")

    def spelled(batches):
        """Rows of two kinds: passages, and runs whose windows are to be counted."""
        for batch, texts in slices(batches, 2, 1 << 20):
            words = _words(texts)
            row, m, rh, a, n, starts, h = runs(words)
            wanted = [{(x["m"], x["rh"]): x for x in r} for r in batch.column(3).to_pylist()]
            k, t = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            held: dict[tuple[int, int], list] = {}
            single = []
            for i, mm, hh, s, size in zip(row.tolist(), m.tolist(), rh.tolist(), a.tolist(), n.tolist()):
                x = wanted[i].pop((mm, hh), None)
                if x is None:
                    continue
                if x["c"] > 1:
                    held.setdefault((i, s // SEGMENT), []).append((s, size, mm, hh))
                if x["v"]:
                    single.append((k[i], None, None, None, None, t[i], s, mm, x["c"], h[starts[i] + s : starts[i] + s + size]))
            out = []
            for (i, seg), found in held.items():
                low, high = found[0][0], max(s + size for s, size, *_ in found) + N - 1
                out.append((k[i], seg, b" ".join(words[i][low:high]), [y for s, size, *_ in found for y in (s - low, size)], [y for f in found for y in f[2:]], *[None] * 5))
            c = list(zip(*(out + single))) or [[]] * 10
            types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, types)], names=["k", "seg", "x", "cuts", "keys", "t", "a", "m", "c", "h"])

    both = stored(both.mapInArrow(spelled, "k long, seg int, x binary, cuts array<int>, keys array<long>, t long, a int, m long, c long, h array<long>"), "passages")
    windows = both.where("x is null").select("k", "t", "m", "c", "a", F.posexplode("h").alias("i", "h")).select("k", "t", "m", "h", "c", (F.col("a") + F.col("i")).alias("at"))
    again = windows.groupBy("m", "h").agg(F.sum("c").alias("s")).where("s > 1").select("m", "h")
    single = stored(windows.where("c = 1").join(again, ["m", "h"]).groupBy("k", "t").agg(F.collect_set("at").alias("at")), "recurring-windows")
    # rows alike in id and text have one key and spell the same passages: one of each goes on
    return both.where("x is not null").select("k", "seg", "x", "cuts", "keys").dropDuplicates(["k", "seg"]), single


def dealt(own: DataFrame, passages: DataFrame) -> DataFrame:
    """p, x, cuts: each passage for every shard p that has one of its runs."""

    def each(batches):
        for batch, texts in slices(batches, 1):
            row, m, rh, *_ = runs(_words(texts))
            p = batch.column(0).to_numpy()[row]
            order, first = _distinct(p, m, rh)
            at = order[first]
            yield pa.RecordBatch.from_arrays([pa.array(m[at]), pa.array(rh[at]), pa.array(p[at])], names=["m", "rh", "p"])

    places = own.mapInArrow(each, "m long, rh long, p long").distinct()
    pair = F.posexplode("keys").alias("i", "m")
    keys = passages.select("k", "seg", "keys", pair).where("i % 2 = 0").select("k", "seg", "m", F.get("keys", F.col("i") + 1).alias("rh")).distinct()
    wanted = places.join(keys, ["m", "rh"]).select("p", "k", "seg").distinct()
    return wanted.join(passages.select("k", "seg", "x", "cuts"), ["k", "seg"]).select("p", "x", "cuts")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of every row."""
    # a document is known by its shard's key k and, beside it, by t
    key, text = [col(id_col), col(text_col)], col(text_col).cast("string").alias("text")
    own = docs.select(F.xxhash64(*key).alias("k"), F.xxhash64(F.lit(N), *key).alias("t"), col(id_col).alias("d"), text)
    kind = own.schema["d"].dataType.simpleString()
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    p = F.pmod("k", F.lit(size // SHARD_BYTES + 1)).alias("p")
    passages, single = confirmed(own, counted(own.select("k", "text")))
    no_id, no_key = F.lit(None).cast(kind).alias("d"), [F.lit(None).cast("long").alias(x) for x in ("k", "t")]
    # kinds: 0 passages, 1 windows that recur in a document, 2 documents
    parts = [
        dealt(own.select(p, "text"), passages).select("p", F.lit(0).alias("kind"), *no_key, no_id, F.col("x").alias("text"), "cuts"),
        single.select(p, F.lit(1), "k", "t", no_id, F.lit(None).cast("binary"), "at"),
        own.select(p, F.lit(2), "k", "t", "d", F.col("text").cast("binary"), F.lit(None).cast("array<int>")),
    ]
    whole = parts[0].unionAll(parts[1]).unionAll(parts[2])

    def shorten(batches):
        """Rows are sorted by shard and kind: what is known of a shard comes before its documents."""
        now, patterns, at, automata = None, [], {}, None
        for batch, texts in slices(batches, 5):
            rows, n, gone, kept = [], [], [], []
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 6)]
            for i, (p, what, k, t, cuts, text) in enumerate(zip(*columns, texts)):
                if p != now:
                    now, patterns, at, automata = p, set(), {}, None
                if what == 0:
                    words = text.split()
                    patterns.update(tuple(words[s : s + size + N - 1]) for s, size in zip(cuts[::2], cuts[1::2]))
                    continue
                if what == 1:
                    at[k, t] = cuts
                    continue
                if automata is None:
                    every = list(patterns)
                    automata = [Automaton(every[s : s + PATTERNS]) for s in range(0, len(every), PATTERNS)]
                    patterns = every = None
                words = text.split() if text else []
                cover = np.zeros(len(words) + 1, np.int64)
                found = [x for a in automata for x in a.places(words)] + [(s, s + N) for s in at.get((k, t), ())]
                if found:
                    np.add.at(cover, [s for s, _ in found], 1)
                    np.add.at(cover, [e for _, e in found], -1)
                stays = np.cumsum(cover[:-1]) == 0
                rows.append(i)
                n.append(len(words))
                gone.append(len(words) - int(stays.sum()))
                kept.append(b" ".join(words) if not gone[-1] else b" ".join([w for w, s in zip(words, stays.tolist()) if s]))
            yield pa.RecordBatch.from_arrays([batch.column(4).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return whole.repartition("p").sortWithinPartitions("p", "kind").mapInArrow(shorten, f"doc_id {kind}, n_words long, n_removed long, kept string")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    return remove_repeats(docs, id_col, text_col).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
