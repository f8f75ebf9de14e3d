"""Removal of passages of 50 bytes that an earlier document has, by suffix arrays.

A byte goes if a window of 50 bytes covers it that also starts in a document with
a smaller id; windows are judged on the input and never cross documents.

1. Anchors. Of the 24-byte grams in a window the one with the least hash is its
   anchor: equal windows have equal anchors. Consecutive windows with one anchor, at
   most ``RUN`` of them, are a run. Anchors are counted over all rows, each task adding up
   its own first; only those of two rows or more go on.
2. Runs. Each document learns which of its anchors go on, and sends the bytes of their runs:
   each different run once, with the least and the greatest id that has it. A third
   of all documents with one passage so cost one row per task and run.
3. Suffix arrays. Runs are dealt by anchor into buckets of bounded size. Each bucket
   sorts its suffixes by linear grouping over Lyndon prefixes (``suffixsort``); neighbours
   that agree for a window are one class, and the least id of a class decides on it.
   An anchor with more than ``CROWD`` different runs would be a bucket of its own: its runs are
   cut into windows first, which are grouped again and dealt by what they hold.
4. Each run's verdict goes back to the documents that have the run, which cut.

Nothing is sampled and no task gathers the documents of a run, anchor or passage.

Defined cases: ids must be whole numbers; rows with a null id come before all
others, as if they were one document, and so do rows with equal ids: a row never loses
bytes to them; null and empty texts have no bytes; bytes are cut wherever they
lie, also within a character; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import col, dropped, slices, stored
from spanforge.llm.suffixsort import equal_windows

WIDTH = 50
GRAM = 24
#: Windows in a run.
RUN = 64
#: Bytes of runs in a bucket, and different runs of an anchor that may share one.
BUCKET_BYTES, CROWD = 1 << 20, 20_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def grams(buffer: bytes, n: int) -> np.ndarray:
    """A hash of the 24 bytes from each of the first n places; the buffer goes on for so many behind them."""
    eight = np.ndarray(n + 16, "<u8", buffer, strides=(1,))
    with np.errstate(over="ignore"):
        h = eight[:n] * _A
        h ^= h >> np.uint64(32)
        h += eight[8 : n + 8] * _B
        h ^= h >> np.uint64(29)
        h *= _C
        h += eight[16 : n + 16] * _A
        h ^= h >> np.uint64(32)
        h *= _B
    h ^= h >> np.uint64(31)
    return h


def runs(texts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts end to end; of each run the text, the anchor, the first window and the number of windows; and where each text begins."""
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    buffer = b"".join([t for t in texts if t]) + b"\0" * (WIDTH + 8)
    n = int(sizes.sum())
    if n < WIDTH:
        return buffer, *[np.zeros(0, np.int64)] * 4, starts
    least, width = grams(buffer, n), 1
    want = WIDTH - GRAM + 1
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    least = least[: n - WIDTH + 1].view(np.int64)
    new = np.empty(len(least), bool)
    new[0], new[1:] = True, least[1:] != least[:-1]
    long = sizes >= WIDTH
    new[starts[long]] = True
    # windows behind the last of a text lie in two texts
    over = np.minimum(np.where(long, starts + sizes - WIDTH + 1, starts), len(least))
    new[over[over < len(least)]] = True
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(least)))
    text = np.searchsorted(starts, first, side="right") - 1
    keep = first + WIDTH <= starts[text] + sizes[text]
    first, size, text = first[keep], size[keep], text[keep]
    parts = (size + RUN - 1) // RUN
    if (parts > 1).any():
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        first, text, rest = np.repeat(first, parts) + RUN * nth, np.repeat(text, parts), np.repeat(size, parts) - RUN * nth
        size = np.minimum(rest, RUN)
    return buffer, text, least[first], first, size, starts


def anchors(own: DataFrame) -> DataFrame:
    """m: the anchors that two rows or more have. own(k, d, text)."""

    def run(batches):
        for batch, texts in slices(batches, 2):
            _, text, m, *_ = runs(texts)
            order = np.argsort(m, kind="stable")  # texts ascend already
            m, text = m[order], text[order]
            apart = np.ones(len(m), bool)
            apart[1:] = (m[1:] != m[:-1]) | (text[1:] != text[:-1])
            m = m[apart]
            first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]])) if len(m) else m
            yield pa.RecordBatch.from_arrays([pa.array(m[first]), pa.array(np.diff(np.append(first, len(m))))], names=["m", "n"])

    every = own.mapInArrow(run, "m long, n long").groupBy("m").agg(F.sum("n").alias("n"))
    return stored(every.where("n > 1").select("m"), "anchors")


def wanted(own: DataFrame, known: DataFrame) -> DataFrame:
    """k, ms: of each document the known anchors that it has."""

    def run(batches):
        for batch, texts in slices(batches, 2):
            _, text, m, *_ = runs(texts)
            apart = np.ones(len(m), bool)  # runs that follow each other may have one anchor; what is left of repeats the sets below take
            apart[1:] = (m[1:] != m[:-1]) | (text[1:] != text[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(m[apart]), batch.column(0).take(pa.array(text[apart]))], names=["m", "k"])

    # an anchor stands once among the known ones: a part's share of them is hashed, and the many rows are not sorted
    return own.mapInArrow(run, "m long, k long").join(known.hint("shuffle_hash"), "m").groupBy("k").agg(F.collect_set("m").alias("ms"))


def spelled(own: DataFrame, lists: DataFrame) -> DataFrame:
    """m, rh, k, d, at, x, low, high: every known run of a document, and with the first of equal runs in a batch its bytes and ids."""
    both = own.join(lists.withColumnRenamed("k", "k2"), F.col("k") == F.col("k2")).select("k", "d", "text", "ms")

    def run(batches):
        for batch, texts in slices(batches, 2, 2 << 20):
            buffer, text, m, first, size, starts = runs(texts)
            lists, k, d = batch.column(3), batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cuts = np.searchsorted(text, np.arange(len(texts) + 1))
            held: dict[tuple[int, int], list] = {}
            out: list[tuple] = []
            for i in range(len(texts)):
                own_m = m[cuts[i] : cuts[i + 1]]
                go = np.flatnonzero(np.isin(own_m, lists[i].values.to_numpy())) + cuts[i]
                begin, own_k, own_d = int(starts[i]), k[i], d[i]
                for a, n, mm in zip(first[go].tolist(), size[go].tolist(), m[go].tolist()):
                    x = buffer[a : a + n + WIDTH - 1]
                    key = mm, xxhash.xxh3_64_intdigest(x) - (1 << 63)
                    row = held.get(key)
                    if row is None:
                        held[key] = [x, own_d, own_d]
                        out.append((*key, own_k, own_d, a - begin, True))
                    else:
                        if own_d < row[1]:
                            row[1] = own_d
                        elif own_d > row[2]:
                            row[2] = own_d
                        out.append((*key, own_k, own_d, a - begin, False))
            rows = [(*r[:5], *(held[r[:2]] if r[5] else (None, None, None))) for r in out]
            columns = list(zip(*rows)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["m", "rh", "k", "d", "at", "x", "low", "high"])

    return stored(both.mapInArrow(run, "m long, rh long, k long, d long, at int, x binary, low long, high long"), "runs")


def _windows(crowded: DataFrame) -> DataFrame:
    """m, rh, o, wm, wh, x, low, high: each window of the runs, and two hashes of it."""

    def run(batches):
        for batch in batches:
            out = []
            for m, rh, x, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                for o in range(len(x) - WIDTH + 1):
                    w = x[o : o + WIDTH]
                    h = xxhash.xxh3_128_intdigest(w)
                    out.append((m, rh, o, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), w, low, high))
                if len(out) > 50_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    def _batch(out):
        columns = list(zip(*out)) or [[]] * 8
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["m", "rh", "o", "wm", "wh", "x", "low", "high"])

    return crowded.select("m", "rh", "x", "low", "high").mapInArrow(run, "m long, rh long, o int, wm long, wh long, x binary, low long, high long")


VERDICT = "m long, rh long, cuts array<struct<first:int,last:int,low:long>>"


def judged(different: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """m, rh, cuts: of each run the stretches of windows (first, last) and the least id that has them, where a row of the run has a greater one."""
    size = different.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    dealt = different.withColumn("p", F.pmod(F.xxhash64("m"), F.lit(size // bucket_bytes + 1)))

    def bucket(rows: list[tuple]) -> pa.RecordBatch:
        m, rh, x, low, high = zip(*rows) if rows else [[]] * 5
        m, rh, low, high = (np.array(c, np.int64) for c in (m, rh, low, high))
        n = np.array([len(b) - WIDTH + 1 for b in x], np.int64)
        _, at, times = np.unique(m, return_inverse=True, return_counts=True)
        # a run that has its anchor alone has nothing to be compared with: it is one class as it is
        alone, rest = np.flatnonzero(times[at] == 1), np.flatnonzero(times[at] > 1)
        piece, cls = equal_windows([x[i] for i in rest.tolist()], n[rest], WIDTH) if len(rest) else (rest, rest)
        piece = rest[piece]
        least = np.full(int(cls.max()) + 1 if len(cls) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, cls, low[piece])
        own = least[cls]
        begin = np.cumsum(n) - n
        place = np.flatnonzero(np.repeat(times[at] > 1, n))  # of each window among those of all runs
        new = np.ones(len(piece), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(piece))[: len(first)] - 1
        of = np.concatenate([piece[first], alone])
        o = np.concatenate([place[first] - begin[piece[first]], np.zeros(len(alone), np.int64)])
        e = np.concatenate([place[last] - begin[piece[last]], n[alone] - 1])
        own = np.concatenate([own[first], low[alone]])
        go = np.flatnonzero(own < high[of])
        go = go[np.argsort(of[go], kind="stable")]
        of, o, e, own = of[go], o[go], e[go], own[go]
        begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
        cuts = pa.StructArray.from_arrays([pa.array(o.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(own)], names=["first", "last", "low"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(of)).astype(np.int32)), cuts)
        return pa.RecordBatch.from_arrays([pa.array(m[of[begins]]), pa.array(rh[of[begins]]), lists], names=["m", "rh", "cuts"])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for p, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if p != now and rows:
                    yield bucket(rows)
                    rows = []
                now = p
                rows.append(row)
        yield bucket(rows)

    return dealt.select("p", "m", "rh", "x", "low", "high").repartition("p").sortWithinPartitions("p").mapInArrow(run, VERDICT)


def verdicts(different: DataFrame, crowd: int = CROWD, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """m, rh, cuts of different(m, rh, x, low, high): one row per run at most."""
    crowded = stored(different.groupBy("m").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("m"), "crowded")
    plain = judged(different.join(crowded, "m", "left_anti"), bucket_bytes)
    if crowded.isEmpty():
        return stored(plain, "verdicts")
    windows = stored(_windows(different.join(crowded, "m", "left_semi")), "windows")
    again = stored(windows.groupBy(F.col("wm").alias("m"), F.col("wh").alias("rh"), "x").agg(F.min("low").alias("low"), F.max("high").alias("high")), "different-windows")
    found = judged(again, bucket_bytes).select(F.col("m").alias("wm"), F.col("rh").alias("wh"), F.col("cuts")[0]["low"].alias("own"))
    each = F.collect_list(F.struct(F.col("o").alias("first"), F.col("o").alias("last"), F.col("own").alias("low")))
    cut = windows.select("m", "rh", "o", "wm", "wh").join(found, ["wm", "wh"]).groupBy("m", "rh").agg(each.alias("cuts"))
    return stored(plain.unionAll(cut), "verdicts")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) of every row."""
    d = F.coalesce(col(id_col).cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")
    own = docs.select(F.xxhash64(col(id_col), col(text_col)).alias("k"), d.alias("d"), text, col(id_col).alias("doc_id"))
    kind = own.schema["doc_id"].dataType.simpleString()
    short = own.select("k", "d", "text").where(F.octet_length("text") >= WIDTH)
    # documents whose keys are equal by chance look for some anchors too many, which changes nothing
    known = anchors(short)
    lists = stored(wanted(short, known), "wanted-anchors")
    dropped(known)
    found = spelled(short, lists)
    dropped(lists)
    different = stored(found.where("x is not null").groupBy("m", "rh", "x").agg(F.min("low").alias("low"), F.max("high").alias("high")), "different-runs")
    having = stored(found.select("m", "rh", "k", "d", "at"), "places-of-runs")
    dropped(found)
    verdict = verdicts(different, crowd, bucket_bytes)
    dropped(different)
    # only what goes from a document comes back to it; its id beside its key tells documents apart whose keys are equal by chance
    gone = having.join(verdict.hint("shuffle_hash"), ["m", "rh"]).select("k", "d", "at", F.inline("cuts")).where("low < d")
    span = F.struct((F.col("at") + F.col("first")).alias("s"), (F.col("at") + F.col("last") + WIDTH).alias("e"))
    per = gone.groupBy(F.col("k").alias("k2"), F.col("d").alias("d2")).agg(F.collect_set(span).alias("gone"))
    both = own.join(per, (F.col("k") == F.col("k2")) & (F.col("d") == F.col("d2")), "left").select("doc_id", "text", "gone")

    def cut(batches):
        for batch, texts in slices(batches, 1):
            lists, there = batch.column(2), batch.column(2).is_valid().to_pylist()
            starts, ends = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            offsets = lists.offsets.to_numpy()
            n, removed, spans, kept = [len(t) for t in texts], [0] * len(texts), [0] * len(texts), list(texts)
            for i in np.flatnonzero(there).tolist():
                cover = np.zeros(n[i] + 1, np.int32)
                np.add.at(cover, starts[offsets[i] : offsets[i + 1]], 1)
                np.add.at(cover, ends[offsets[i] : offsets[i + 1]], -1)
                out = np.cumsum(cover[:-1]) > 0
                removed[i] = int(out.sum())
                spans[i] = int(out[0]) + int((out[1:] & ~out[:-1]).sum())
                kept[i] = np.frombuffer(texts[i], np.uint8)[~out].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return remove_repeats(docs, id_col, text_col).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
