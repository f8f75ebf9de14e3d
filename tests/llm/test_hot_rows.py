"""One id, row or word on a great share of all rows; counts beyond 32 bits; what the files of token ids look like inside."""

import glob

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from spanforge.llm import lm, substrdedup, tokenids, toxicity
from spanforge.llm.common import shared_path
from spanforge.llm.tokenids import tokenizer_path


def test_examples_are_bounded_rows(spark, monkeypatch):
    """One toxic id on nearly all rows, each with another text, and one row repeated very often."""
    docs = spark.range(4_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("vile words "), F.col("id")).alias("text"))
    docs = docs.unionAll(spark.range(400).select((F.col("id") + 100).alias("doc_id"), F.lit("kind words").alias("text"))).unionAll(spark.range(3_000).select(F.lit(7).cast("long"), F.lit("again")))
    labels = spark.createDataFrame([(7, 1), *[(100 + i, 0) for i in range(400)]], "doc_id long, toxic int")
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda p, u, prior: seen.update(p=len(p), u=len(u)) or toxicity.Model({}, 0.0))
    toxicity.train(docs, labels, max_positive=20, max_unlabelled=30)
    assert 0 < seen["p"] <= 20 and 0 < seen["u"] <= 30
    picked = spark.createDataFrame([(7, True)], "d long, p boolean")
    few = toxicity._examples(docs, picked, 10_000, 10_000)
    assert few.count() == 4_001 and few.where("text = 'again'").count() == 1


def test_counts_beyond_32_bits(tmp_path):
    keys, counts = np.array([3, 5, 9], "<u8"), np.array([2**32 - 1, 2**32 + 17, 2**45], "<u8")
    lm._save(str(tmp_path), "pair-0", {"key": keys, "count": counts})
    found = lm.Maps(str(tmp_path))("pair", 0)
    assert found["key"].tolist() == keys.tolist() and found["count"].tolist() == counts.tolist()


def test_hot_words_of_sorted_input(spark):
    """A word in the second half of the rows alone is hot as well."""
    rows = [("alpha " * 3 + f"x{i} " + "alpha y",) for i in range(600)] + [("omega " * 3 + f"z{i} " + "omega y",) for i in range(600)]
    own = spark.createDataFrame(rows, "text string").coalesce(1).select(F.col("text").alias(lm.TEXT))
    hot = lm._hot_words(own, 0.05).tolist()
    assert lm._hash(b"alpha") in hot and lm._hash(b"omega") in hot


def test_copies_do_not_multiply_passages(spark):
    """Dealt rows follow the passages and shards, not how often a row is repeated."""
    passage = " ".join(f"p{i}" for i in range(80))
    others = [(1_000 + i, f"a{i} " * 30 + passage + f" b{i}" * 30) for i in range(12)]

    def dealt_rows(copies):
        df = spark.createDataFrame([*others, *[(1, "once more " + passage)] * copies], "doc_id long, text string")
        own = df.select(F.xxhash64("doc_id", "text").alias("k"), F.xxhash64(F.lit(35), "doc_id", "text").alias("t"), "text")
        passages, _ = substrdedup.confirmed(own, substrdedup.counted(own.select("k", "text")))
        return substrdedup.dealt(own.select(F.pmod("k", F.lit(8)).alias("p"), "text"), passages).count()

    assert dealt_rows(40) == dealt_rows(4)


def test_one_id_on_a_third_of_the_rows_is_dealt_over_files(spark):
    docs = spark.range(3_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).repartition(8)
    path = shared_path(spark, "ids")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tokenids.write_token_ids(docs, path, tokenizer_path(), end_id=2)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    found = tokenids.read_token_ids(spark, path, ["doc_id", "part", "start_in_part", "n_tokens"])
    per = found.where("doc_id is null").groupBy("part").count().collect()
    assert len(per) >= 2 and max(r["count"] for r in per) < 900
    ids = [r["doc_id"] for r in found.orderBy("part", "start_in_part").collect()]
    known = [i for i in ids if i is not None]
    assert ids[:1000] == [None] * 1000 and known == sorted(known)


def test_encodings_row_groups_and_page_indexes(spark, monkeypatch):
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of text"), F.repeat(F.concat(F.lit("w"), F.col("id") % 50, F.lit(" ")), 40)).alias("text")).coalesce(1)
    path = shared_path(spark, "ids")
    monkeypatch.setattr(tokenids, "ROW_GROUP_BYTES", 64 << 10)
    monkeypatch.setattr(tokenids, "PAGE_BYTES", 4 << 10)
    tokenids.write_token_ids(docs, path, tokenizer_path(), end_id=2)
    metas = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path.removeprefix('file:')}/*.parquet")]
    groups = [m.row_group(i) for m in metas for i in range(m.num_row_groups)]
    assert len(groups) > len(metas)
    for g in groups:
        by = {g.column(i).path_in_schema: g.column(i) for i in range(g.num_columns)}
        assert "RLE_DICTIONARY" in by["ids.list.element"].encodings and by["ids.list.element"].has_dictionary_page
        for name in ("doc_id", "n_tokens", "start_in_part"):
            assert "DELTA_BINARY_PACKED" in by[name].encodings and not by[name].has_dictionary_page
        assert all(c.has_column_index and c.has_offset_index for c in by.values())
