"""Removal of repeated lines by overlapping windows of three lines.

A window is three consecutive lines (texts are split at every line feed) and is
known by a 128-bit hash of them. Of the occurrences of a window the first, by
document id and then by line, stays; the lines that a later one covers go. The
covered positions of a document are merged, so overlapping windows remove a
line once. What is left is judged no more.

Defined cases: null texts stay null and have no lines; texts of fewer than
three lines have no window; null ids come first; rows alike in id and text are
one document, whose copies are all treated alike; a document whose lines all go
keeps its row with an empty text; an empty table stays empty; all other columns
are kept, whatever their names.

A window that very many documents share reaches the join once per occurrence;
both sides of that join are plain exchanges, which adaptive execution splits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import col, slices, stored

LINES = 3


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """d, th, pos, h1, h2: every window of three lines of every text."""
    lines = docs.select(col(id_col).alias("d"), F.xxhash64(col(text_col)).alias("th"), F.split(col(text_col), "\n", -1).alias("lines")).where(F.size("lines") >= LINES)
    x = F.col("lines")

    def window(i):
        three = [F.get(x, i + k) for k in range(LINES)]
        return F.struct(i.cast("int").alias("pos"), F.xxhash64(*three).alias("h1"), F.xxhash64(F.lit(1), *reversed(three)).alias("h2"))

    each = lines.select("d", "th", F.explode(F.transform(F.sequence(F.lit(0), F.size(x) - LINES), window)).alias("w"))
    return each.select("d", "th", "w.pos", "w.h1", "w.h2")


def covered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """d, th, at: per document the places of later occurrences of windows."""
    found = windows(docs, id_col, text_col)
    place = F.struct("d", "th", "pos")
    repeated = stored(found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n"), "repeated-lines")
    later = found.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("d", "th").agg(F.collect_set("pos").alias("at"))


def _kept(text: bytes | None, at: list[int] | None) -> tuple[bytes | None, int, int]:
    """The text without the covered lines, the number of lines, and of those removed."""
    if text is None:
        return None, 0, 0
    lines = text.split(b"\n")
    if not at:
        return text, len(lines), 0
    gone = np.zeros(len(lines), bool)
    at = np.array(at)
    for k in range(LINES):
        gone[at + k] = True
    return b"\n".join([x for x, g in zip(lines, gone.tolist()) if not g]), len(lines), int(gone.sum())


def _marked(docs: DataFrame, id_col: str, text_col: str, *keep) -> DataFrame:
    at = covered(docs, id_col, text_col)
    source = docs.select(*keep, col(id_col).alias("d0"), F.xxhash64(col(text_col)).alias("t0"), col(text_col).cast("string").alias("x0"))
    both = source.join(at, source["d0"].eqNullSafe(at["d"]) & (source["t0"] == at["th"]), "left")
    return both.select(*source.columns[:-3], "d0", "x0", "at")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with shortened texts, and with ``length_col`` set to their new length if it is given."""
    both = _marked(docs, id_col, text_col, F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]).alias("row"))

    def run(batches):
        for b, whole in slices(batches, 2):
            texts = [_kept(t, a)[0] for t, a in zip(whole, b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["row", "text"])

    out = both.mapInArrow(run, f"row {both.schema['row'].dataType.simpleString()}, text string")
    new = {text_col: F.col("text")} | ({length_col: F.length("text").cast(docs.schema[length_col].dataType)} if length_col else {})
    return out.select(*[(new[c] if c in new else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def line_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of every row."""
    both = _marked(docs, id_col, text_col)

    def run(batches):
        for b, whole in slices(batches, 1):
            rows = [_kept(t, a) for t, a in zip(whole, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([None if r[0] is None else hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string())], names=["doc_id", "n_lines", "n_removed", "kept_sha256"])

    kind = both.schema["d0"].dataType.simpleString()
    return both.mapInArrow(run, f"doc_id {kind}, n_lines long, n_removed long, kept_sha256 string")
