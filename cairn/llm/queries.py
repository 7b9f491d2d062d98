"""The registered queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import byte_bpe, exact_dedup, katz, media, mixing, ngram_join, secrets, sentencepiece, spelling, surrogates, token_counts, toxicity, vector_codes


#: The public tokenizers' folder is a parameter of the environment.
TOKENIZERS = os.environ.get("CAIRN_TOKENIZERS", "/opt/tokenizers")
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
BYTE_RANKS = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = PIECES) -> DataFrame:
    return sentencepiece.encode(documents(spark, sf_dir), model_path)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.size("kept")).alias("taken")
    )


def op4_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(documents(spark, sf_dir), stored=True)


def op5_pii_surrogates(spark: SparkSession, sf_dir: str, key: bytes | None = None) -> DataFrame:
    """The key comes from the caller or from CAIRN_SURROGATE_KEY; without either, each run draws its own."""
    key = key or os.environ.get("CAIRN_SURROGATE_KEY", "").encode() or None
    return surrogates.surrogate_digests(documents(spark, sf_dir), key)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str, model_path: str = PIECES) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), model_path)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.encode_media(documents(spark, sf_dir)))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


def op12_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str = BYTE_RANKS) -> DataFrame:
    return byte_bpe.token_digests(documents(spark, sf_dir), ranks_path)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_secret_scan,
        op3_source_mixing,
        op4_katz_scores,
        op5_pii_surrogates,
        op6_ngram_jaccard,
        op7_token_counts,
        op8_exact_dedup,
        op9_toxicity,
        op10_media_columns,
        op11_spelling_variants,
        op12_byte_bpe,
        op13_vector_codes,
    )
}

ORACLE_SQL = {
    "op13_vector_codes": """
        WITH kept AS MATERIALIZED (
          SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS ints,
                 row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid
          FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pieces AS MATERIALIZED (
          SELECT rid, vec_id, label, part, ints[part * (len(ints) // 16) + 1 : (part + 1) * (len(ints) // 16)] AS v
          FROM kept, range(16) r(part)
        ), book0 AS MATERIALIZED (
          SELECT part, rid - 1 AS entry, v FROM pieces WHERE rid <= 64
        ), near0 AS MATERIALIZED (
          SELECT rid, vec_id, label, part, v, entry, distance
          FROM (SELECT p.*, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance
                FROM pieces p JOIN book0 b USING (part))
          QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY distance, entry) = 1
        ), book1 AS MATERIALIZED (
          SELECT part, entry, coalesce(m.v, o.v) AS v
          FROM book0 o LEFT JOIN (
            SELECT part, entry, list(mean ORDER BY k) AS v
            FROM (SELECT part, entry, k, CAST(floor(sum(x) / count(*)) AS BIGINT) AS mean
                  FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS k FROM near0)
                  GROUP BY part, entry, k)
            GROUP BY part, entry
          ) m USING (part, entry)
        ), near1 AS MATERIALIZED (
          SELECT rid, vec_id, label, part, v, entry, distance
          FROM (SELECT p.*, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance
                FROM pieces p JOIN book1 b USING (part))
          QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY distance, entry) = 1
        ), book2 AS MATERIALIZED (
          SELECT part, entry, coalesce(m.v, o.v) AS v
          FROM book1 o LEFT JOIN (
            SELECT part, entry, list(mean ORDER BY k) AS v
            FROM (SELECT part, entry, k, CAST(floor(sum(x) / count(*)) AS BIGINT) AS mean
                  FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS k FROM near1)
                  GROUP BY part, entry, k)
            GROUP BY part, entry
          ) m USING (part, entry)
        ), near2 AS MATERIALIZED (
          SELECT rid, vec_id, label, part, v, entry, distance
          FROM (SELECT p.*, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance
                FROM pieces p JOIN book2 b USING (part))
          QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY distance, entry) = 1
        ), coded AS (
          SELECT rid, vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(distance) AS BIGINT) AS error
          FROM near2 GROUP BY rid, vec_id, label
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book2) AS codebooks_sha256
        FROM coded
    """,
    "op8_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER w AS keep_id,
               count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op3_source_mixing": r"""
        WITH sized AS (
          SELECT doc_id, source,
                 CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                 md5(concat('7|', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h
          FROM documents
        ), sources AS (
          SELECT *, CAST((rank - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS cap,
                 CAST(sum(source_size) OVER () AS DOUBLE) AS budget
          FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                       row_number() OVER (ORDER BY source NULLS LAST) AS rank
                FROM sized GROUP BY source)
        ), filling AS (
          SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
          FROM sources
        ), water AS (
          SELECT arg_min(level, row(cap / weight, rank)) AS level FROM filling WHERE level <= cap / weight
        ), targets AS (
          SELECT s.*, CASE WHEN w.level IS NULL OR cap / weight < w.level THEN cap ELSE w.level * weight END AS target
          FROM sources s, water w
        ), sent AS (
          SELECT d.*, t.source_size, t.rank, t.weight, t.target, t.budget,
                 sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.h, d.size ROWS UNBOUNDED PRECEDING) AS sent
          FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
        ), copies AS (
          SELECT *, CAST(epoch * source_size + sent AS DOUBLE) / weight AS f FROM sent, range(3) e(epoch)
        ), cut AS (
          SELECT *, sum(size) OVER (ORDER BY f, rank, h, size, epoch ROWS UNBOUNDED PRECEDING) AS upto FROM copies
        )
        SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
               CAST(coalesce(sum(size) FILTER (WHERE upto <= budget), 0) AS BIGINT) AS taken
        FROM cut GROUP BY doc_id
    """,
}
