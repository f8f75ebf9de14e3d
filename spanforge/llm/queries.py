"""The registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm.common import shared_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.packing import pack
    from spanforge.llm.tokenids import tokenizer_path

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.decontaminate import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.tokenids import token_digest, tokenizer_path, write_token_ids

    path = shared_path(spark, "token-ids")
    write_token_ids(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return token_digest(spark, path)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.linededup import line_digest

    return line_digest(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.substrdedup import digest

    return digest(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.common import fold_of
    from spanforge.llm.lm import perplexity, train

    docs = table(spark, sf_dir, "documents")
    return perplexity(docs, train(docs.where(fold_of() != 1)))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.pii import digest

    return digest(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.quality import judge

    return judge(table(spark, sf_dir, "documents")).drop("distance")


def op11_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.suffixdedup import digest

    return digest(table(spark, sf_dir, "documents"))


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.crosstok import align
    from spanforge.llm.tokenids import tokenizer_path

    return align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanforge.llm.centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    found = (
        op1_best_fit_packing, op2_decontamination, op3_token_ids, op4_line_dedup, op5_substring_dedup,
        op6_toxicity, op7_simhash, op8_lm_scoring, op9_pii, op10_quality_rules,
        op11_suffix_array, op12_cross_tokenizer, op13_centroid_clustering,
    )
    return {f.__name__: f for f in found}


LINE_DEDUP_SQL = """
WITH lines AS (
  SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, parts[pos] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) s,
       LATERAL unnest(range(1, len(parts) + 1)) AS u(pos)
), windows AS (
  SELECT doc_id, pos, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
  SELECT doc_id, pos FROM windows WHERE c IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) > 1
), gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM later, (VALUES (0), (1), (2)) t(k)
), judged AS (
  SELECT l.doc_id, l.pos, l.line, g.pos IS NOT NULL AS gone
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

DECONTAMINATION_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), items AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM iw, LATERAL unnest(range(1, greatest(1, len(w) - 12) + 1)) AS u(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM items
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM dw, sizes, LATERAL unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n
), hits AS (SELECT p.doc_id, p.n, p.i, t.item_id FROM places p JOIN items t ON t.n = p.n AND t.g = p.g
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, LATERAL unnest(range(0, n)) AS u(k) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(s, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw d LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""


def _clustering_sql() -> str:
    """Ten rounds, each a table of distances and a table of centroids."""
    parts = ["""q AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)""", """c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS k, v AS c FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM q ORDER BY h, v LIMIT 8)
)"""]
    near = """a{i} AS MATERIALIZED (
  SELECT vec_id, v, k, d FROM (SELECT vec_id, v, k, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM q, c{i})
  QUALIFY row_number() OVER (PARTITION BY vec_id, v ORDER BY d, k) = 1
)"""
    step = """c{j} AS MATERIALIZED (
  SELECT k, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS c FROM (
      SELECT k, p, sum(v[p]) AS s, count(*) AS n FROM a{i}, LATERAL unnest(range(1, 65)) AS u(p) GROUP BY k, p) GROUP BY k) m USING (k)
)"""
    for i in range(10):
        parts += [near.format(i=i), step.format(i=i, j=i + 1)]
    parts.append(near.format(i=10))
    return "WITH " + ",\n".join(parts) + """
SELECT vec_id, k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a10 JOIN c10 USING (k)"""


def oracle_sql() -> dict[str, str]:
    return {"op13_centroid_clustering": _clustering_sql(), "op2_decontamination": DECONTAMINATION_SQL, "op4_line_dedup": LINE_DEDUP_SQL}
