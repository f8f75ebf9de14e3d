"""Token ids of whole texts, and Parquet files of them that allow selective reads.

Layout of the files: one row per document in ascending id order, ``ids`` as a
Parquet list of 32-bit integers. Token ids repeat, so they are dictionary
encoded; counts and offsets are dense, so they are delta encoded (version 2
pages). Row groups and pages are kept small and the writer adds page indexes:
a reader of metadata touches no ids, and a reader of an id range only those
pages that hold it.

Defined cases: a null or empty text has no tokens but the end id; rows with a
null id come first; rows with the same id are ordered by a hash of their text, and
dealt over files by it; repeated rows are all written; an empty table gives files without rows; other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField

from spanforge.llm.common import col, map_text

#: Chunks between white space whose ids a worker keeps; frequent ones come early.
CACHED_CHUNKS = 500_000
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10

_ENCODERS: dict[str, ChunkEncoder] = {}


#: Marks that end a word; as symbols they are a pre-token of their own.
_MARKS = b".,!?;:#$%&*|"


def _byte_symbols() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(other)) for b in range(256)}


_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITTERS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def _parts_at_space(spec: dict) -> bool:
    """Whether a tokenizer is of the one shape whose words are known to be encoded alone."""
    model = spec["model"]
    return (
        spec["normalizer"] == {"type": "Sequence", "normalizers": _NORMALIZERS}
        and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": _SPLITTERS}
        and (model["type"], model["dropout"], model["unk_token"], model["continuing_subword_prefix"]) == ("BPE", None, None, None)
        and spec["truncation"] is None
        and spec["padding"] is None
        and all(t["special"] and not t["normalized"] and not t["lstrip"] and not t["rstrip"] and not any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
    )


class ChunkEncoder:
    """Ids of a text. Of a tokenizer not known to part texts at ASCII white space, whole texts are encoded.

    Where it does, the ids of a text are those of its chunks in turn, so a chunk is
    encoded once by the tokenizers library and looked up afterwards. The
    library's normalizer and splitter take most of its time. They change nothing
    in a word of ASCII or Latin-1 letters but its case, and split it only from
    marks behind it; such words go to the library's BPE model itself.
    """

    def __init__(self, path: str, limit: int = CACHED_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), limit, {}
        self.by_chunk = _parts_at_space(json.loads(self.tokenizer.to_str()))
        self.model, self.symbols = self.tokenizer.model, _byte_symbols()
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def word(self, chunk: bytes) -> str | None:
        """The model's input for a chunk of letters alone, else None."""
        if chunk.isalpha():
            return chunk.lower().decode("ascii")
        text = chunk.decode("utf-8", "replace")
        if text.isalpha() and max(text) < "\u0100":
            return text.lower().encode().decode("latin-1").translate(self.symbols)
        return None

    def learn(self, chunks: set[bytes]) -> dict[bytes, bytes]:
        """The ids of chunks, as little-endian 32-bit integers."""
        fresh, whole, tails, tokenize, packed = {}, [], {}, self.model.tokenize, self.packed
        for c in chunks:
            core = c.rstrip(_MARKS)
            word = self.word(core) if core else None
            if word is None:
                whole.append(c)
                continue
            fresh[c] = b"".join([packed[x.id] for x in tokenize(word)])
            if len(core) < len(c):
                tails.setdefault(c[len(core) :], []).append(c)
        plain = list(dict.fromkeys([*whole, *tails]))
        for i in range(0, len(plain), 1000):
            some = plain[i : i + 1000]
            for c, e in zip(some, self.tokenizer.encode_batch([x.decode("utf-8", "replace") for x in some], add_special_tokens=False)):
                ids = b"".join([packed[x] for x in e.ids])
                fresh.setdefault(c, ids)
                for owner in tails.pop(c, ()):
                    fresh[owner] += ids
        room = self.limit - len(self.known)
        if room > 0:
            self.known.update(fresh if len(fresh) <= room else list(fresh.items())[:room])
        return fresh

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        if not self.by_chunk:
            whole = self.tokenizer.encode_batch([(t or b"").decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            return [np.array(e.ids, "<u4").tobytes() for e in whole]
        get, out, gaps, missing = self.known.get, [], [], set()
        for i, text in enumerate(texts):
            chunks = (text or b"").split()
            ids = list(map(get, chunks))
            at = -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                missing.add(chunks[at])
                gaps.append((i, at, chunks[at]))
            out.append(ids)
        if gaps:
            fresh = self.learn(missing)
            for i, at, chunk in gaps:
                out[i][at] = fresh[chunk]
        return [b"".join(ids) for ids in out]


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the id files described above to ``path``."""
    ordered = (
        docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
        .withColumn("h", F.xxhash64("text"))
        .repartitionByRange(F.asc_nulls_first("doc_id"), F.asc("h"))
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "h", F.asc_nulls_first("text"))
    )
    end = np.array([end_id], "<u4").tobytes()

    def make():
        before, part = 0, TaskContext.get().partitionId()

        def run(texts):
            nonlocal before
            own = encoder(tokenizer)
            ids = [x + end for x in own.encode(texts)]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.cumsum(n)
            starts = before + ends - n
            before += int(ends[-1]) if len(n) else 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            return [pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), lists.cast(pa.list_(pa.field("element", pa.int32(), True)))]

        return run

    fields = [StructField("n_tokens", LongType()), StructField("part", IntegerType()), StructField("start_in_part", LongType()), StructField("ids", ArrayType(IntegerType()))]
    (
        map_text(ordered, "text", ["doc_id"], fields, make)
        .write.option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_token_ids(spark: SparkSession, path: str, columns: list[str] | None = None, first=None, last=None) -> DataFrame:
    """The files at ``path``: only these columns, and documents from id first to last.

    Spark prunes columns and pushes the id range to the page indexes.
    """
    df = spark.read.parquet(path)
    if first is not None:
        df = df.where(F.col("doc_id") >= first)
    if last is not None:
        df = df.where(F.col("doc_id") <= last)
    return df.select(*columns) if columns else df


def part_offsets(spark: SparkSession, path: str) -> DataFrame:
    """part, base: the ids in all files before each file. One row per file."""
    totals = read_token_ids(spark, path, ["part", "n_tokens"]).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""

    def run(batches):
        for b in batches:
            ids = b.column(3)
            flat, at = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[s:e].astype("<u4").tobytes()) for s, e in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([int(e - s) for s, e in zip(at, at[1:])], pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    files = read_token_ids(spark, path, ["doc_id", "part", "start_in_part", "ids"])
    kind = files.schema["doc_id"].dataType.simpleString()
    each = files.mapInArrow(run, f"doc_id {kind}, part int, start_in_part long, n_tokens long, ids_crc32 long")
    # one row per file: its size is bounded by the number of files
    return each.join(F.broadcast(part_offsets(spark, path)), "part").select(
        "doc_id", (F.col("start_in_part") + F.col("base")).alias("start"), "n_tokens", "ids_crc32"
    )
