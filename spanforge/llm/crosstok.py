"""Alignment of the tokens of two tokenizers by an event sweep.

Tokenizer A is a byte-level BPE, given a space and the text; tokenizer B a
sentencepiece model, which adds that space itself. Both cut the same bytes, so
each token is an event: the byte offset where it ends.

1. Events. Each side encodes every whole text by itself and sends its token ids
   in blocks of at most ``BLOCK``, with the offset where the block begins. A token's
   length follows from its id, so ids are all that is sent.
2. Sweep. Both sides' blocks are put together, dealt by document and sorted by
   offset. One pass over a partition keeps only what is not decided yet: tokens
   since the last offset where both sides end, and where each side has got to.
   Between two ends that follow each other lies the overlap of exactly one token
   of A and one of B: a link. Where both end, a group ends.
3. Counts. Links are counted by pair of ids over the whole corpus, each task
   adding up its own first, and compared with the highest count of their B id.
4. Look-up. The ``KNOWN_PAIRS`` most frequent pairs go to all workers as arrays of a
   fixed size; documents with other pairs send those to a join. No count is cut.

Defined cases: null and empty texts, texts that aren't valid UTF-8 and texts whose
tokens don't give back a space and the text have no tokens; rows alike in id and
text are aligned once and give a row each, and their links count once for each
row; rows with a null id are kept; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import col, slices, stored
from spanforge.llm.tokenids import _byte_symbols

#: Tokens of one side that travel as one row.
BLOCK = 8192
#: Pairs of ids whose counts all workers hold, at 16 bytes each.
KNOWN_PAIRS = 2_000_000
#: Words whose ids a worker keeps, and the longest such word.
CACHED_WORDS, LONGEST = 300_000, 64
#: Links of a document that travel as one row, and different pairs that a task adds up before it sends them.
LINKS, HELD_PAIRS = 200_000, 1_000_000


def packed(ids: list[int], parts: list[bytes], text: str) -> bytes | None:
    """The ids as little-endian integers, if they are the text's bytes, cut."""
    own = [parts[i] for i in ids]
    return np.array(ids, kind_of(parts)).tobytes() if b"".join(own) == text.encode() and b"" not in own else None


def kind_of(parts: list[bytes]) -> str:
    return "<u2" if len(parts) <= 1 << 16 else "<u4"


class ByteLevel:
    """Ids of a space and a text by a byte-level BPE of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocab, of = self.tokenizer.get_vocab(), {c: b for b, c in _byte_symbols().items()}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        self.ranked = self._ranked(json.loads(self.tokenizer.to_str()))

    def _ranked(self, spec: dict):
        """The same vocabulary as ranks, which encode faster, if ids are in the order of the merges."""
        model = spec["model"]
        plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        special = {t["id"] for t in spec["added_tokens"]}
        merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model.get("merges", [])]
        if spec["normalizer"] or spec["pre_tokenizer"] != plain or model["type"] != "BPE" or model.get("dropout") or merged != sorted(merged) or len(set(merged)) < len(merged) or -1 in merged:
            return None
        try:
            import public_tokenizers
            import tiktoken
        except ImportError:
            return None
        ranks = {self.bytes[i]: i for i in model["vocab"].values() if i not in special}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """The ids of each text, packed, or None where their bytes are not those of a space and the text."""
        spaced = [" " + t for t in texts]
        if self.ranked:
            ids = [self.ranked.encode_ordinary(t) for t in spaced]
        else:
            ids = [e.ids for e in self.tokenizer.encode_batch(spaced, add_special_tokens=False)]
        return [packed(x, self.bytes, t) for x, t in zip(ids, spaced)]


class Pieces:
    """Ids of a text by a sentencepiece model, which puts the space before it.

    Where no piece has a space behind another character, and the model only joins
    pieces, the words between spaces are encoded alone and looked up afterwards.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.by_word = self._joins_within_words(pieces)
        #: What ``packed`` gives for a space and a word; ids lie there as bytes, not as objects.
        self.known: dict[str, bytes | None] = {}

    def _joins_within_words(self, pieces: list[str]) -> bool:
        """Words and runs of spaces are encoded as they are, and alone as in a text."""
        if any("▁" in p.lstrip("▁") for p in pieces):
            return False
        probe = ["a", "the house", "x\ty\nz", "été 中文", "1 22 333"]
        return all(self.model.encode(p) == sum((self.model.encode(w) for w in p.split(" ")), []) for p in probe)

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """As of the other side."""
        known, encode, out = self.known, self.model.encode, []
        for text in texts:
            words = text.split(" ")
            # a word that is empty stands for spaces in a row
            if not self.by_word or "" in words or max(map(len, words)) > LONGEST:
                out.append(packed(encode(text), self.bytes, " " + text))
                continue
            found, fresh = [], {}
            for w in words:
                ids = known.get(w, b"")
                if ids == b"":
                    ids = fresh.get(w, b"")
                    if ids == b"":
                        ids = fresh[w] = packed(encode(w), self.bytes, " " + w)
                found.append(ids)
            if len(known) < CACHED_WORDS:
                known.update(fresh)
            out.append(None if None in found else b"".join(found))
        return out


_SIDES: dict[tuple[int, str], ByteLevel | Pieces] = {}


def side_of(side: int, path: str) -> ByteLevel | Pieces:
    """The worker's encoder of side 0 (A) or 1 (B)."""
    if (side, path) not in _SIDES:
        _SIDES[side, path] = (ByteLevel, Pieces)[side](path)
    return _SIDES[side, path]


def _keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    own = [col(id_col), col(text_col).cast("string")]
    return F.xxhash64(*own).alias("k"), F.xxhash64(F.lit(11), *own).alias("t")


EVENTS = "k long, t long, at long, side int, ids binary"
#: What a block says in place of an offset: these bytes have no alignment.
BROKEN = -1


def events(own: DataFrame, side: int, path: str, block: int = BLOCK) -> DataFrame:
    """k, t, at, side, ids: the tokens of own(k, t, text) in blocks; at is -1 where they don't give back the text."""

    def run(batches):
        encoder, seen = side_of(side, path), set()
        length = np.array([len(b) for b in encoder.bytes], np.int64)
        kind = kind_of(encoder.bytes)
        for batch, texts in slices(batches, 2, 2 << 20):
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            fresh, out = [], []
            for key, raw in zip(keys, texts):
                if not raw or key in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(key)
                try:
                    fresh.append((key, raw.decode()))
                except UnicodeDecodeError:
                    out.append((*key, BROKEN, side, None))
            for (key, _), ids in zip(fresh, encoder.encode([t for _, t in fresh])):
                if ids is None:
                    out.append((*key, BROKEN, side, None))
                    continue
                ids = np.frombuffer(ids, kind)
                at = 0
                for s in range(0, len(ids), block):
                    part = ids[s : s + block]
                    out.append((*key, at, side, part.tobytes()))
                    at += int(length[part].sum())
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["k", "t", "at", "side", "ids"])

    return own.mapInArrow(run, EVENTS)


class Tables:
    """Of each side the length of a token, and how it is written within and at the end of its part of a group."""

    def __init__(self, paths: tuple[str, str]):
        self.kinds, self.lengths, self.written, self.first = [], [], [], [0]
        for side, path in enumerate(paths):
            n = side_of(side, path).bytes
            self.kinds.append(kind_of(n))
            self.lengths.append(np.array([len(b) for b in n], np.int64))
            self.written += [b"%d%s" % (i, end) for i in range(len(n)) for end in (b",", b"|;"[side : side + 1])]
            self.first.append(len(self.written))


_TABLES: dict[tuple[str, str], Tables] = {}


def _none() -> np.ndarray:
    return np.zeros(0, np.int64)


@dataclass
class Sweep:
    """The state of the sweep over one document: what comes after the last common end, and sums."""

    tables: Tables
    ids: list = field(default_factory=lambda: [_none(), _none()])
    ends: list = field(default_factory=lambda: [_none(), _none()])
    reached: list = field(default_factory=lambda: [0, 0])
    linked: int = 0
    counts: list = field(default_factory=lambda: [0, 0])
    groups: int = 0
    digest: object = field(default_factory=hashlib.sha256)
    broken: bool = False

    def feed(self, side: int, block: bytes) -> np.ndarray:
        """Take a block of a side; the links (A id << 32 | B id) that are certain now."""
        ids = np.frombuffer(block, self.tables.kinds[side]).astype(np.int64)
        ends = self.reached[side] + np.cumsum(self.tables.lengths[side][ids])
        self.ids[side], self.ends[side] = np.concatenate([self.ids[side], ids]), np.concatenate([self.ends[side], ends])
        self.reached[side] = int(ends[-1])
        limit = min(self.reached)
        a, b = self.ends
        if limit <= self.linked:
            return _none()
        own = [e[: np.searchsorted(e, limit, side="right")] for e in (a, b)]
        every = np.union1d(*own)
        every = every[np.searchsorted(every, self.linked, side="right") :]
        links = self.ids[0][np.searchsorted(a, every)] << 32 | self.ids[1][np.searchsorted(b, every)]
        self.linked = limit
        common = own[0][np.isin(own[0], own[1], assume_unique=True)]
        if len(common):
            self._grouped(common)
        return links

    def _grouped(self, common: np.ndarray) -> None:
        """Write the groups that end at these offsets, and forget their tokens."""
        last = [np.searchsorted(e, common) for e in self.ends]
        n = [int(x[-1]) + 1 for x in last]
        codes = np.zeros(n[0] + n[1], np.int64)
        before = [np.diff(x, prepend=-1) for x in last]
        for side in (0, 1):
            token, group = np.arange(n[side]), np.repeat(np.arange(len(common)), before[side])
            # tokens of the other side that stand before it: of earlier groups, and for B those of its own
            ahead = last[1][group] + 1 - before[1][group] if side == 0 else last[0][group] + 1
            code = self.tables.first[side] + 2 * self.ids[side][: n[side]]
            code[last[side]] += 1
            codes[token + ahead] = code
        text = b"".join(map(self.tables.written.__getitem__, codes.tolist()))
        if self.groups:
            self.digest.update(b";")
        self.digest.update(text[:-1])
        self.groups += len(common)
        for side in (0, 1):
            self.counts[side] += n[side]
            self.ids[side], self.ends[side] = self.ids[side][n[side] :], self.ends[side][n[side] :]


SWEPT = "k long, t long, done boolean, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


def swept(blocks: DataFrame, paths: tuple[str, str], most: int = LINKS) -> DataFrame:
    """Of each document a row with its sums (done), and rows with links, 8 bytes each."""

    def run(batches):
        if paths not in _TABLES:
            _TABLES[paths] = Tables(paths)
        tables, now, last, state, out, held, size = _TABLES[paths], None, None, None, [], [], 0

        def links() -> bytes | None:
            return np.concatenate(held).astype("<i8").tobytes() if held else None

        def ended():
            if now is None:
                return
            if state.broken or state.reached[0] != state.reached[1] or not state.groups:
                out.append((*now, True, 0, 0, 0, "", None))
            else:
                out.append((*now, True, *state.counts, state.groups, state.digest.hexdigest(), links()))

        def table():
            columns = list(zip(*out)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["k", "t", "done", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

        weight = 0
        for batch in (b.slice(s, 200) for b in batches for s in range(0, b.num_rows, 200)):
            for k, t, at, side, block in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (k, t) != now:
                    ended()
                    now, last, state, held, size = (k, t), None, Sweep(tables), [], 0
                if (at, side) == last or state.broken:
                    continue  # the same row, encoded by another task
                last = at, side
                if at == BROKEN:
                    state.broken = True
                    continue
                found = state.feed(side, block)
                held.append(found)
                size += len(found)
                weight += len(found)
                if size >= most:
                    out.append((*now, False, None, None, None, None, links()))
                    held, size = [], 0
                if weight >= 500_000:
                    yield table()
                    out, weight = [], 0
        ended()
        yield table()

    return blocks.mapInArrow(run, SWEPT)


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, weights=n, minlength=len(found)).astype(np.int64)


def pair_counts(links: DataFrame, copies: DataFrame) -> DataFrame:
    """pair, n, best: how many links of the corpus a pair of ids has, and whether its B id has none with more.

    copies(k, t, copies) are the documents that stand in several rows: their links count again.
    """
    both = links.select("links", F.lit(1).cast("long").alias("copies"))
    if not copies.isEmpty():
        both = both.unionAll(links.join(copies, ["k", "t"]).select("links", (F.col("copies") - 1).alias("copies")))

    def run(batches):
        keys, n, parts, weight = _none(), _none(), [], 0
        for batch in (b.slice(s, 200) for b in batches for s in range(0, b.num_rows, 200)):
            for blob, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(blob, "<i8")
                parts.append((own, np.full(len(own), c, np.int64)))
                weight += len(own)
                if weight >= HELD_PAIRS:
                    keys, n = _added(np.concatenate([keys, *(p for p, _ in parts)]), np.concatenate([n, *(c for _, c in parts)]))
                    parts, weight = [], 0
                    if len(keys) >= HELD_PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])
                        keys, n = _none(), _none()
        if parts:
            keys, n = _added(np.concatenate([keys, *(p for p, _ in parts)]), np.concatenate([n, *(c for _, c in parts)]))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])

    every = both.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    every = stored(every.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)), "pairs")
    # one row per B id: as many as its vocabulary has
    best = every.groupBy("b").agg(F.max("n").alias("m"))
    return stored(every.join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("m")).alias("best")), "counted-pairs")


def _frequent(pairs: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The pairs with the highest counts, at most so many, cut at a power of two; and whether these are all."""
    by_size = sorted((r["size"], r["count"]) for r in pairs.groupBy(F.floor(F.log2("n")).alias("size")).count().collect())
    least, total = None, 0
    for size, count in reversed(by_size):
        if total + count > most:
            return (pairs.where(F.floor(F.log2("n")) >= least) if least is not None else pairs.where("false")), False
        least, total = size, total + count
    return pairs, True


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", known_pairs: int = KNOWN_PAIRS, block: int = BLOCK, links_in_row: int = LINKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    n_best links have a count that is their B id's highest; count_sum adds up the counts of all links.
    """
    spark, paths, key = docs.sparkSession, (path_a, path_b), ["k", "t"]
    rows = docs.select(*_keys(id_col, text_col), col(id_col).alias("doc_id"))
    own = docs.select(*_keys(id_col, text_col), col(text_col).cast("string").alias("text"))
    both = events(own, 0, path_a, block).unionByName(events(own, 1, path_b, block))
    found = stored(swept(both.repartition("k", "t").sortWithinPartitions("k", "t", "at", "side"), paths, links_in_row), "swept")
    links = found.where("links is not null").select("k", "t", "links")
    copies = stored(rows.groupBy(*key).agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    pairs = pair_counts(links, copies)
    few, whole = _frequent(pairs, known_pairs)
    top = few.toArrow().sort_by("pair")  # at most known_pairs rows
    table = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "n", "best")))

    def look_up(batches):
        keys, n, best = table.value
        for batch in (b.slice(s, 200) for b in batches for s in range(0, b.num_rows, 200)):
            out = []
            for k, t, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = np.frombuffer(blob, "<i8")
                at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
                at = at[hit]
                rest, c = np.unique(own[~hit], return_counts=True)
                out.append((k, t, len(own), int(best[at].sum()), int(n[at].sum()), rest.tolist(), c.tolist()))
            columns = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(columns, kinds)], names=["k", "t", "n_links", "n_best", "count_sum", "rest", "times"])

    looked = links.mapInArrow(look_up, "k long, t long, n_links long, n_best long, count_sum long, rest array<long>, times array<long>")
    sums = ["n_links", "n_best", "count_sum"]
    if whole:
        parts = looked.select(*key, *sums)
    else:  # pairs that workers don't hold go to a join
        looked = stored(looked, "looked-up")
        each = looked.select(*key, F.explode(F.arrays_zip("rest", "times")).alias("x")).select(*key, F.col("x.rest").alias("pair"), F.col("x.times").alias("c"))
        rest = each.join(pairs, "pair").select(*key, F.lit(0).alias("n_links"), F.when(F.col("best"), F.col("c")).otherwise(0).alias("n_best"), (F.col("c") * F.col("n")).alias("count_sum"))
        parts = looked.select(*key, *sums).unionByName(rest)
    per = parts.groupBy(*key).agg(*[F.sum(x).alias(x) for x in sums])
    done = found.where("done").select(*key, "n_a", "n_b", "n_groups", "groups_sha256").join(per, key, "left")
    zero = [F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("n_a", "n_b", "n_groups", *sums)]
    return rows.join(done, key, "left").select("doc_id", *zero, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
