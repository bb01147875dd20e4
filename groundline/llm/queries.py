"""The operators' queries over ``documents`` and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, line_dedup, mixing, packing, pii, quality_classifier, quality_rules, simhash, substring_dedup, suffix_dedup
from .common import documents

#: White space of the contracts, for DuckDB's regular expressions.
_WS = r"[\x20\x09-\x0D]"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digests(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(documents(spark, sf_dir))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir), keep="largest")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digests(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_quality_rules, op3_pii, op4_source_mix, op5_simhash,
        op6_quality_classifier, op7_packing, op8_exact_dedup, op9_line_dedup, op10_substring_dedup,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op9_line_dedup": r"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        line AS (
          SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
        keyed AS (
          SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
        often AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(often.k) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE often.k IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN often ON keyed.k = often.k GROUP BY doc_id""",
    "op4_source_mix": r"""
        WITH d AS (
          SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS name,
                 coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                 CASE WHEN length(text) > 0 THEN 2 - length(regexp_replace(text, '[\p{L}\x20\x09-\x0D]+', '', 'g')) / length(text)::DOUBLE ELSE 1.0 END AS quality
          FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
        w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((k - 1) % 3 + 1)::INT] AS weight FROM s),
        f AS (SELECT *, 3 * source_size / weight AS full_at FROM w),
        l AS (
          SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY full_at, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(weight) OVER (ORDER BY full_at, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
        t AS (
          SELECT source, source_size, coalesce(least(weight * (SELECT max(level) FROM l WHERE level <= full_at), (3 * source_size)::DOUBLE), 0.0) AS target FROM l),
        e AS (
          SELECT doc_id, size, source_size, target,
                 CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
                 coalesce(sum(size) OVER (PARTITION BY t.source ORDER BY pow((('0x' || substr(name, 1, 12))::BIGINT + 1) / 281474976710656.0::DOUBLE, 1 / quality) DESC, doc_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        b AS (SELECT *, target - whole * source_size AS budget FROM e)
        SELECT doc_id, size, source_size, target,
               (size * least(3, whole + CASE WHEN target > 0 AND (so_far + size <= budget OR (so_far < budget AND so_far + size - budget < budget - so_far)) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM b""",
}
