"""The queries of this subpackage, each over the whole of its table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fingerprints, language, lines, mixing, quality, repeats, sharding, simhash, urls

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_bytes(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("ends", "starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), "kept_sha256")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "held_out", "lang_pred", "score")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = sharding.sharded(docs)
    return out.select("doc_id", F.expr(sharding.BYTES).alias("n_bytes"), "shard", "shard_bytes")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprinted(table(spark, sf_dir, "documents"))
    text = [F.concat_ws("", k).alias(k.replace("signature", "fingerprint")) for k in ("signature", "edited_signature")]
    return found.select("doc_id", "n_chars", "edited_sha256", *text, "near_edited", "near_next")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.repetitions(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", F.expr("copies * size").alias("taken"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontamination.judged(decontamination.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return hits.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_near", F.concat_ws(",", "removed").alias("removed"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_repeats": op2_repeats,
    "op3_language": op3_language,
    "op4_sharding": op4_sharding,
    "op5_fingerprints": op5_fingerprints,
    "op6_mixing": op6_mixing,
    "op7_simhash": op7_simhash,
    "op8_decontamination": op8_decontamination,
    "op9_lines": op9_lines,
    "op10_urls": op10_urls,
}

#: The SQL function compares bytes: each of these letters of the tables gives way to a control character, so that a letter is a byte.
_LETTERS = "éóèñçüêäößíÉÈÑÓÇÄÊÜÖÍ"
_MARKS = "".join(map(chr, [*range(1, 9), *range(14, 14 + len(_LETTERS) - 8)]))

ORACLE_SQL: dict[str, str] = {
    "op4_sharding": f"""
        WITH u AS (
            SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
                   CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
            FROM documents
        ), buckets AS (
            SELECT d, h >> CAST(60 - d AS BIGINT) AS p, sum(n_bytes) AS shard_bytes, min(h) = max(h) AS single FROM u, range(61) r(d) GROUP BY 1, 2
        ), fit AS (
            SELECT u.doc_id, u.h, u.n_bytes, min(d) AS depth, arg_min(shard_bytes, d) AS shard_bytes
            FROM u, buckets b WHERE b.p = u.h >> CAST(60 - d AS BIGINT) AND (shard_bytes <= {sharding.SHARD_BYTES} OR single) GROUP BY ALL
        )
        SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, left(lpad(bin(h), 60, '0'), CAST(depth AS BIGINT)) AS shard, CAST(shard_bytes AS BIGINT) AS shard_bytes FROM fit
    """,
    "op6_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
            FROM documents
        ), s AS (
            SELECT source, sum(size) AS source_size, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM d GROUP BY source
        ), l AS (
            SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - 2.0::DOUBLE * CAST(coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
                      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER o AS turn
            FROM s WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST)
        ), t AS (
            SELECT source, source_size, least(2.0::DOUBLE * source_size, (SELECT arg_min(level, turn) FROM l WHERE level * weight <= 2.0::DOUBLE * source_size) * weight) AS target FROM l
        ), r AS (
            SELECT d.doc_id, size, draw, source_size, target, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE target / source_size END AS rate
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
               CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
        FROM r
    """,
    "op9_lines": f"""
        WITH l AS (
            SELECT doc_id, n - 1 AS n, parts[n] AS line FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
        ), u AS (
            SELECT line, translate(line, '{_LETTERS}', '{_MARKS}') AS marks, length(line) AS size, min(CAST(doc_id AS HUGEINT) * 4294967296 + n) AS first,
                   length(replace(line, 'e', '')) AS c1, length(replace(line, 't', '')) AS c2, length(replace(line, 'n', '')) AS c3, length(replace(line, 'a', '')) AS c4 FROM l WHERE trim(line, ' ') <> '' GROUP BY line
        ), near AS (
            SELECT DISTINCT b.line FROM u a, (SELECT unnest([-2, -1, 0, 1, 2]) AS d) r, u b
            WHERE b.size = a.size + r.d AND a.first < b.first AND abs(a.c1 - b.c1) <= 2 AND abs(a.c2 - b.c2) <= 2 AND abs(a.c3 - b.c3) <= 2 AND abs(a.c4 - b.c4) <= 2
              AND levenshtein(a.marks, b.marks) BETWEEN 1 AND {lines.THRESHOLD}
        ), judged AS (
            SELECT l.doc_id, l.n, near.line IS NOT NULL AS near, u.line IS NOT NULL AND (near.line IS NOT NULL OR u.first <> CAST(l.doc_id AS HUGEINT) * 4294967296 + l.n) AS removed
            FROM l LEFT JOIN u ON u.line = l.line LEFT JOIN near ON near.line = l.line
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed, count(*) FILTER (near) AS n_near,
               coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (removed), '') AS removed
        FROM judged GROUP BY doc_id
    """,
    "op8_decontamination": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
        ), b AS (
            SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, least(len(w), 13) AS width, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s
            FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)
        ), found AS (
            SELECT p.doc_id, p.i, p.width, x.item_id
            FROM (SELECT doc_id, width, i, array_to_string(w[i : i + width - 1], ' ') AS s
                  FROM (SELECT doc_id, w, width, unnest(generate_series(1, len(w) - width + 1)) AS i FROM d, (SELECT DISTINCT width FROM windows) WHERE len(w) >= width)) p
            JOIN windows x ON x.s = p.s AND x.width = p.width
        ), hit AS (
            SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + width - 1)) AS k FROM found) GROUP BY 1
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
    """,
}
