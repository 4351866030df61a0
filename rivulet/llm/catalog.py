"""The queries of the training-data operators and, where SQL can express one, its oracle.

Operators are imported when their query is called, so that a worker loads only what it runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm.common import table


def op1_nra_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rivulet.llm.topk import search

    return search(table(spark, sf_dir, "embeddings"))


def op2_gru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rivulet.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rivulet.llm.quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rivulet.llm.pii import detect

    return detect(table(spark, sf_dir, "documents"))


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rivulet.llm.token_rollup import roll_up

    return roll_up(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rivulet.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op7_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rivulet.llm.decontamination import find

    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rivulet.llm.sharding import assign, grow, tree

    return assign(table(spark, sf_dir, "documents"), tree(), grow(tree()))


def op9_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rivulet.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op10_simhash_popcount_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rivulet.llm.simhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def _h(expr: str) -> str:
    return f"CAST('0x' || substr(md5({expr}), 1, 13) AS BIGINT)"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_nra_top_k,
        op2_gru_toxicity,
        op3_fourier_quality,
        op4_skip_chain_pii,
        op5_token_rollup,
        op6_mix_sources,
        op7_simhash_decontamination,
        op8_hash_tree_shards,
        op9_byte_cnn_language,
        op10_simhash_popcount_grid,
    )
}

ORACLES: dict[str, str] = {
    "op1_nra_top_k": """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 20 = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM q JOIN v c ON q.vec_id IS DISTINCT FROM c.vec_id)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY rank <= 20""",
    "op6_mix_sources": f"""
    WITH d AS (
      SELECT doc_id, source AS src, source IS NULL AS is_null, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
             {_h("'mix:' || coalesce(CAST(doc_id AS VARCHAR), '')")} AS h
      FROM documents),
    s AS (SELECT is_null, src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
    w AS (SELECT *, (row_number() OVER (ORDER BY is_null, src) - 1) % 3 + 1 AS w, CAST(source_size * 3 AS DOUBLE) AS cap FROM s),
    r AS (SELECT *, cap / w AS ratio FROM w),
    l AS (SELECT *, row_number() OVER o AS pos,
                 ((SELECT sum(source_size) FROM s) - (sum(cap) OVER o - cap)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
          FROM r WINDOW o AS (ORDER BY ratio, is_null, src)),
    v AS (SELECT arg_min(level, pos) AS level FROM l WHERE ratio > level),
    t AS (SELECT is_null, src, source_size, CASE WHEN coalesce(ratio <= v.level, TRUE) THEN cap ELSE v.level * w END AS target,
                 CAST('0x' || substr(md5('offset:' || CASE WHEN is_null THEN '0' ELSE '1' || src END), 1, 3) AS BIGINT) / 4096.0::DOUBLE AS u
          FROM l LEFT JOIN v ON TRUE),
    k AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS e,
                 row_number() OVER (PARTITION BY d.is_null, d.src ORDER BY d.size, d.h, d.doc_id) AS i
          FROM d JOIN t ON d.is_null = t.is_null AND d.src IS NOT DISTINCT FROM t.src)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
           CAST(size * least(floor(i * e + u) - floor((i - 1) * e + u), 3) AS BIGINT) AS taken
    FROM k""",
}
