"""SimHash near-duplicates, found with signatures that leave out one bit.

Fingerprint: words of the text with A-Z in lower case, shingles of three words
(all words if there are fewer), XXH64 with seed 42 of each; a bit is set if over
half of the hashes have it. Fingerprints link if at most three bits differ.

Search: three bits cannot make both of two 32-bit halves differ in two bits, so
in one half the fingerprints differ in one bit at most. Each half is indexed
under its 32 variants that leave out one bit; linked fingerprints meet under an
equal variant, where they are verified. Only different fingerprints are indexed,
so exact copies cost nothing. Under one variant no pairs are listed: a search
that removes what it has reached finds a spanning forest. A variant with more
than ``MOST`` fingerprints is not gathered at all: its rows are indexed again by
the same rule on the half that is left, until no more than 11 bits are open.

Defined cases: null and empty texts have fingerprint zero and link like others;
the component id is the smallest id reachable, nulls aside (null if there is no
other); rows alike in id and text are one document; an empty table gives no
rows; other columns are ignored or, in ``drop_near_duplicates``, kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from spanforge.llm.common import TEXT, col, map_text, stored
from spanforge.llm.components import components

BITS = 3
SHINGLE = 3
SEED = 42
MOST = 4096

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None, block: int = 50_000) -> int:
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined, xxh = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(SHINGLE, len(words))
    starts, ends = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), block):
        h = np.array([xxh(joined[a:b], SEED) for a, b in zip(starts[i : i + block], ends[i : i + block])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (a hash of the text), fp of every row."""
    own = docs.select(col(id_col).alias("doc_id"), F.xxhash64(col(text_col)).alias("th"), col(text_col).alias("text"))
    return map_text(own, "text", ["doc_id", "th"], [StructField("fp", LongType())], lambda: lambda texts: [[fingerprint(t) for t in texts]])


def _variants(rows: DataFrame, width: int) -> DataFrame:
    """key, fp, off: rows(key, fp, off) under all one-bit-less variants of the two halves of the open bits."""
    half = width // 2
    i = F.col("i")
    side = F.floor(i / half).cast("int")
    shifted = F.expr(f"shiftrightunsigned(fp, off + {half} * cast(floor(i / {half}) as int))")
    kept = shifted.bitwiseAND(F.lit((1 << half) - 1)).bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1L, i % {half})")))
    return rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).select(
        F.xxhash64("key", i, kept).alias("key"), "fp", (F.col("off") + (1 - side) * half).cast("int").alias("off")
    )


def forest(fps: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that span the components of fps, at most one less than there are fps."""
    left, a, b = fps.view(np.uint64), [], []  # the count of set bits is of unsigned numbers
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= BITS
            if near.any():
                got = left[near]
                left = left[~near]
                a += [int(x.view(np.int64))] * len(got)
                b += got.view(np.int64).tolist()
                todo += list(got)
    return a, b


def _verified(rows: DataFrame, most: int | None) -> DataFrame:
    """big, key, a, b, off: links within each key, and the rows of keys with over ``most`` fps as they are."""
    names = ["big", "key", "a", "b", "off"]

    def out(big, key, a, b, off):
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, big)), pa.array(np.full(n, key, np.int64)), pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64)), pa.array(np.full(n, off, np.int32))], names=names)

    def run(batches):
        key, off, held, big = None, 0, [], False

        def flush():
            fps = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
            if len(fps) > 1:
                a, b = forest(fps)
                if a:
                    yield out(False, 0, a, b, 0)

        for batch in batches:
            k, f, o = (batch.column(i).to_numpy() for i in range(3))
            cut = np.flatnonzero(np.diff(k)) + 1
            bounds = np.concatenate([[0], cut, [len(k)]])
            several = np.flatnonzero((np.diff(bounds) > 1) | (np.arange(len(bounds) - 1) == 0) | (np.arange(len(bounds) - 1) == len(bounds) - 2))
            for s, e in zip(bounds[several].tolist(), bounds[several + 1].tolist()):
                if s == e:
                    continue
                if key != k[s]:
                    yield from flush()
                    key, off, held, big = k[s], o[s], [], False
                held.append(f[s:e])
                if big or most is not None and sum(map(len, held)) > most:
                    big = True
                    for x in held:
                        yield out(True, key, x, x, off)
                    held = []
        yield from flush()

    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "big boolean, key long, a long, b long, off int")


def near_links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """a, b: links that connect all of the different fingerprints fps(fp) that are linked."""
    rows, width, found = fps.select(F.lit(0).cast("long").alias("key"), "fp", F.lit(0).alias("off")), 64, None
    while True:
        last = width <= 16
        made = stored(_verified(_variants(rows, width), None if last else most), "near-links")
        links = made.where("not big").select("a", "b")
        found = links if found is None else found.union(links)
        rows = made.where("big").select("key", F.col("a").alias("fp"), "off")
        if last or rows.isEmpty():
            return found
        width //= 2


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """doc_id, th, fp, component_id, first (the id and hash of the document that stands for the component)."""
    fps = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(place).alias("first")), "distinct-fingerprints")
    roots = components(near_links(nodes.select("fp"), most), "near")
    joined = stored(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "first", F.coalesce("root", "fp").alias("root")), "near-roots")
    heads = stored(joined.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("first")), "near-heads")
    named = stored(joined.select("fp", "root").join(heads, "root").select("fp", "component_id", "first"), "near-groups")
    return fps.join(named, "fp").select("doc_id", "th", "fp", "component_id", "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    return groups(docs, id_col, text_col, most).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """One row, all columns, of each component: of its smallest id, and then of the smallest text hash."""
    found = groups(docs, id_col, text_col, most)
    heads = found.where(F.col("first").eqNullSafe(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")))
    heads = heads.select(F.col("doc_id").alias(f"{TEXT}_d"), F.col("th").alias(f"{TEXT}_t")).distinct()
    names = docs.columns
    rows = docs.select(F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("row"), col(id_col).alias("d"), F.xxhash64(col(text_col)).alias("t"))
    kept = rows.join(heads, F.col("d").eqNullSafe(F.col(f"{TEXT}_d")) & (F.col("t") == F.col(f"{TEXT}_t")), "left_semi").dropDuplicates(["d", "t"])
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])
