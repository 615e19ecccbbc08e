"""The corpus operators' queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, dedup, embed, license, lm, mining, neardup, quality, ranked, trie, unigram

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str, parts: int, part: int):
    """Whether crc32 of the id's text leaves that remainder."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.substring_dedup(read(spark, sf_dir, "documents"), window=20).select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=10)
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.scan_licenses(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", "n_known", F.concat_ws(",", "sentence_ids").alias("sentence_ids"), F.concat_ws(",", "licenses").alias("licenses"))


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train_quality(docs, read(spark, sf_dir, "labels"), allowed=~held_out("_id", 5, 0))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.suffix_array_dedup(read(spark, sf_dir, "documents"), window=200).select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


@query
def op6_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicate_vectors(read(spark, sf_dir, "embeddings"), cosine=0.98)


ORACLE_SQL["op6_embedding_near_duplicates"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, e FROM v WHERE list_sum(list_transform(e, lambda x: x * x)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c.b, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(c.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""


@query
def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_class_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(read(spark, sf_dir, "documents"), held_out("id", 7, 2))


@query
def op9_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), size=5, percent=75)


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    changed = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mining.hard_negatives(changed, anchors=F.col("id") % 100 == 0, positives=5, negatives=5, low=80, scale=256)


ORACLE_SQL["op11_hard_negatives"] = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
q AS (SELECT vec_id, label, list_transform(e, lambda x: floor(256 * x)) AS e FROM r WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score QUALIFY rank <= 5
"""


@query
def op12_ranked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked_round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(read(spark, sf_dir, "conversations"))


#: The crc32 of an id's digits is taken bit by bit, and a node is its first d turns as a list.
ORACLE_SQL["op13_conversation_trie"] = """
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS own FROM t GROUP BY c),
b AS (SELECT c, c - c % 5 AS base, own, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda crc, x: list_reduce(list_prepend(xor(crc, x), CAST(range(8) AS BIGINT[])), lambda v, k: xor(v // 2, (v % 2) * 3988292384))), 4294967295) % 9 AS h FROM o),
v AS (SELECT b.c, list_concat(coalesce(o.own, [])[:b.h], b.own[b.h + 1:]) AS turns FROM b LEFT JOIN o ON o.c = b.base),
m AS (SELECT c, len(turns) AS n, turns, unnest(range(len(turns) + 1)) AS d FROM v),
p AS (SELECT c, n, d, turns[:d] AS k, CASE WHEN d > 0 THEN turns[:d - 1] END AS up FROM m),
n AS (SELECT d, k, any_value(up) AS up, min(c) AS id, count(*) AS n, CASE WHEN d > 0 THEN octet_length(encode(any_value(k)[d].t)) ELSE 0 END AS bytes, string_agg(CASE WHEN n = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends FROM p GROUP BY d, k),
x AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
w AS (SELECT n.*, coalesce(x.n, 0) AS kids FROM n LEFT JOIN x ON x.d = n.d AND x.k = n.k)
SELECT a.id AS conv_id, CAST(a.d AS BIGINT) AS depth, any_value(u.id) AS parent_conv_id, any_value(a.n) AS n_convs, CAST(any_value(a.kids) AS BIGINT) AS n_children,
  CAST(count(*) FILTER (WHERE s.kids = 0) AS BIGINT) AS n_leaves, CAST(sum((s.n - 1) * s.bytes) AS BIGINT) AS saved_tokens, sha256(coalesce(any_value(a.ends), '')) AS ends_sha256
FROM w a JOIN w s ON s.d >= a.d AND s.k[:a.d] = a.k LEFT JOIN n u ON u.d = a.d - 1 AND u.k = a.up GROUP BY a.id, a.d
"""
