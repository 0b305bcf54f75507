"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import (
    chat_format,
    decontaminate,
    embed_dedup,
    jaccard_join,
    license_scan,
    lm_score,
    mixing,
    quality,
    sharding,
    suffix_dedup,
    token_align,
    token_output,
    vector_codes,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(
        F.explode(F.array(
            F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit(said).alias("text")),
            F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit(said).alias("text")),
        )).alias("m")
    ).select("m.*")
    return chat_format.format_conversations(conv.unionByName(extra))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    blocks = token_output.write_blocks(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.read_documents(blocks)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.link_embeddings(_table(spark, sf_dir, "embeddings"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs).drop("text")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source", "times")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.score_documents(docs, _table(spark, sf_dir, "labels")).drop("text", "lang", "source")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents")).drop("detections")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_align.align_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir).drop("text")


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(regexp_replace(role, '([<\[])(\\*)(s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g'))
      + length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g'))
      + length('<s>[INST][/INST]</s>')) AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM documents
), p AS (SELECT doc_id, n_bytes, depth, key >> (60 - depth) AS prefix FROM d, generate_series(0, 40) AS g(depth)
), s AS (SELECT depth, prefix, sum(n_bytes) AS b, count(*) AS n FROM p GROUP BY ALL
), leaf AS (
  SELECT p.doc_id, p.n_bytes, min(p.depth) AS depth, arg_min(p.prefix, p.depth) AS prefix,
    arg_min(s.b, p.depth) AS b, arg_min(s.n, p.depth) AS n
  FROM p JOIN s USING (depth, prefix) WHERE s.b <= 1048576 OR s.n = 1 GROUP BY p.doc_id, p.n_bytes)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes,
  CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END AS shard_id,
  CAST(depth AS INTEGER) AS shard_depth, CAST(b AS BIGINT) AS shard_bytes, CAST(n AS BIGINT) AS shard_rows FROM leaf
"""


def op11_sql() -> str:
    """The scan over every window of every text, without gates or keywords, from the rule table."""
    table = ", ".join(f"({k}, '{r.anchor}', '^(?:{r.pattern}) ', '{r.label}', {r.priority}, {r.weight})" for k, r in enumerate(license_scan.rules()))
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS start FROM t
), win AS (
  SELECT r, start, word, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY start ROWS BETWEEN CURRENT ROW AND {license_scan.WINDOW - 1} FOLLOWING) || ' ' AS said FROM p
), rule(k, anchor, pattern, label, priority, weight) AS (VALUES {table}
), d AS (
  SELECT r, start, start + len(regexp_extract(said, pattern)) - len(replace(regexp_extract(said, pattern), ' ', '')) AS stop, k, label, priority, weight
  FROM win JOIN rule ON anchor = word WHERE regexp_matches(said, pattern)
), kept AS (
  SELECT * FROM d AS x WHERE priority = 0 OR NOT EXISTS (
    SELECT 1 FROM d AS y WHERE y.r = x.r AND y.start <= x.start AND y.stop >= x.stop
      AND (y.priority, x.stop - x.start - (y.stop - y.start), y.k) < (x.priority, 0, x.k))
), g AS (
  SELECT r, count(*) FILTER (WHERE priority = 0) AS n_base, min(start) FILTER (WHERE priority = 0) AS first_word, max(start) FILTER (WHERE priority = 0) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE priority = 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    least(100, max(weight) + 2 * (count(DISTINCT label) - 1)) / 100.0 AS score
  FROM kept GROUP BY r)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM t LEFT JOIN g USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_jaccard_join": op2_jaccard_join,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_lm_score": op4_lm_score,
        "op5_token_output": op5_token_output,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_sharding": op7_sharding,
        "op8_mixing": op8_mixing,
        "op9_quality": op9_quality,
        "op10_decontamination": op10_decontamination,
        "op11_license_scan": op11_license_scan,
        "op12_token_alignment": op12_token_alignment,
        "op13_vector_codes": op13_vector_codes,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op7_sharding": OP7_SQL, "op11_license_scan": op11_sql()}
