"""Queries of the corpus operators with their production parameters, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chosen_path, pieces, quality_net, repeats, secrets, templates, tiles, token_files, tool_calls, warc
from .common import prepare, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_net.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.embedding_near_duplicates(table(spark, sf_dir, "embeddings"), 0.93)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_pages(warc.write_pages(table(spark, sf_dir, "pages")))


def op6_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.linked(*tool_calls.from_turns(table(spark, sf_dir, "conversations")))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)

        return run

    return {k: ready(f) for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


SQL: dict[str, str] = {
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest FROM p),
l AS (SELECT digest, max(page_id) AS last FROM d WHERE n >= 1000 GROUP BY digest)
SELECT d.page_id, d.n AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN l.last IS NOT NULL AND l.last <> d.page_id AND d.n >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN l.last IS NOT NULL AND l.last <> d.page_id AND d.n >= 1000 THEN l.last END AS refers_to
FROM d LEFT JOIN l ON d.digest = l.digest""",
    "op6_tool_call_linking": r"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL),
c AS (SELECT conv_id, turn, conv_id || '-' || turn AS call_id, role AS name, text FROM t WHERE role <> 'assistant'
      QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) = 1),
r AS (SELECT conv_id || '-' || (turn - 1) AS call_id, turn, text AS content FROM t WHERE role = 'assistant'
      QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) = 1)
SELECT c.conv_id, c.call_id, c.turn, c.name, r.turn AS result_turn,
       CASE WHEN c.turn > 0 AND z.call_id IS NOT NULL THEN 1 ELSE 0 END AS level,
       concat_ws(',', CASE WHEN c.name NOT IN ('user', 'system') THEN 'schema:' || c.name END,
                      CASE WHEN c.name IN ('user', 'system') AND c.text IS NULL THEN 'missing:text' END,
                      CASE WHEN c.name = 'system' THEN 'unknown:turn' END) AS faults,
       c.name = 'user' AND c.text IS NOT NULL AS valid,
       '{"arguments":{"text":' || coalesce(CAST(to_json(c.text) AS VARCHAR), 'null')
         || ',"turn":' || CASE WHEN c.name = 'user' THEN CAST(c.turn AS VARCHAR) ELSE '"' || c.turn || '"' END || '},"id":' || CAST(to_json(c.call_id) AS VARCHAR) || ',"name":' || CAST(to_json(c.name) AS VARCHAR)
         || ',"result":' || CASE WHEN r.content IS NULL THEN 'null' ELSE CAST(to_json(r.content) AS VARCHAR) END || '}' AS json
FROM c LEFT JOIN r ON c.call_id = r.call_id LEFT JOIN c AS z ON z.conv_id = c.conv_id AND z.turn = 0 AND z.call_id <> c.call_id""",
}
