"""Best-fit packing of documents into sequences of a fixed number of tokens.

Only lengths decide a packing, and there are at most ``capacity`` of them. So
the plan is made from the histogram of piece lengths, in bulk: its size depends
on the capacity and not on the number of documents, and every document finds
its place from the rank of its piece among those of the same length.

Plan: pieces above a third of the capacity are matched greedily, the longest
with the longest partner that fits, so that no sequence gets more than two;
shorter ones go, longest first, to the fullest sequence with room for them.

Defined cases: a null or empty text is one piece with the end id alone; a text
longer than the capacity is cut, its last piece may be shorter; repeated rows
are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import TEXT, col, slices, stored
from spanforge.llm.tokenids import encoder

CAPACITY = 2048


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first, end, base, bins, offset), and the number of sequences.

    The pieces of a length with ranks first to end - 1 are dealt in turn over
    ``bins`` sequences from ``base`` on; the first of them starts at ``offset``.
    """
    left = {n: c for n, c in counts.items() if c}
    rank: Counter = Counter()
    runs: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[list[int]]] = {}  # gap: groups [base, bins, used]
    gaps: list[int] = []
    bins = 0

    def put(n: int, base: int, over: int, each: int, used: int) -> None:
        runs.append((n, rank[n], rank[n] + over * each, base, over, used))
        rank[n] += over * each
        left[n] -= over * each

    def leave(base: int, over: int, used: int) -> None:
        gap = capacity - used
        if over and gap:
            if not room.get(gap):
                room[gap] = []
                bisect.insort(gaps, gap)
            room[gap].append([base, over, used])

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        for m in large:
            if not left[n]:
                break
            if m > n or n + m > capacity or not left[m]:
                continue
            pairs = left[n] // 2 if m == n else min(left[n], left[m])
            if pairs:
                put(n, bins, pairs, 1, 0)
                put(m, bins, pairs, 1, n)
                leave(bins, pairs, n + m)
                bins += pairs
        if alone := left[n]:
            put(n, bins, alone, 1, 0)
            leave(bins, alone, n)
            bins += alone
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):
                each = min(left[n], capacity // n)
                over = left[n] // each
                put(n, bins, over, each, 0)
                leave(bins, over, each * n)
                bins += over
                continue
            gap = gaps[at]
            base, over, used = group = room[gap][-1]
            each = min(left[n], gap // n)
            over = min(over, left[n] // each)
            put(n, base, over, each, used)
            group[0] += over
            group[1] -= over
            if not group[1]:
                room[gap].pop()
                if not room[gap]:
                    gaps.pop(at)
            leave(base, over, used + each * n)
    return runs, bins


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    """One row per piece, ranked among the pieces of its length in its task."""
    source = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias(TEXT))
    kind = source.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"] + ["ids"] * with_ids

    def run(batches):
        seen: Counter = Counter()
        part = TaskContext.get().partitionId()
        own = encoder(tokenizer)
        for batch, texts in slices(batches, 1):
            rows, data = [], []
            for row, ids in enumerate(own.encode(texts)):
                ids += end
                for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                    cut = ids[4 * start : 4 * (start + capacity)]
                    n = len(cut) // 4
                    rows.append((row, k, start, n, zlib.crc32(cut), part, seen[n]))
                    data.append(cut)
                    seen[n] += 1
            cols = list(zip(*rows))
            arrays = [batch.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.int32())]
            arrays += [pa.array(c, pa.int64()) for c in cols[2:5]] + [pa.array(cols[5], pa.int32()), pa.array(cols[6], pa.int64())]
            if with_ids:
                arrays.append(pa.array(data, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and offset; with ``ids`` if asked for.

    The pieces are written to the shared folder: texts are encoded once, and the
    ranks that the plan counts on stay as they are if executors are lost.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids), "pieces")
    tally = stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    # at most `capacity` rows come to the driver
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = plan_bins(counts, capacity)
    plan = spark.createDataFrame(runs, "p_length long, p_first long, p_end long, p_base long, p_bins long, p_offset long")
    before = tally.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = cut.join(before, ["part", "length"]).withColumn("at", F.col("rank") + F.col("before"))
    i = F.col("at") - F.col("p_first")
    # the plan's size is bounded by the capacity alone
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("p_length")) & (F.col("at") >= F.col("p_first")) & (F.col("at") < F.col("p_end")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("p_base") + i % F.col("p_bins")).alias("sequence_id"),
        (F.col("p_offset") + F.floor(i / F.col("p_bins")).cast("long") * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves. Each has at most ``capacity`` ids."""
    whole = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))

    def run(batches):
        for b in batches:
            for s, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(b"".join(x["ids"] for x in p), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], names=["sequence_id", "ids"])

    return whole.mapInArrow(run, "sequence_id long, ids array<int>")
