"""Queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import exact_dedup, mixing, packing, quality, setsketch, sharding, suffix_tree, syncmers, token_counts, vector_codes, warc, wrappers


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.poisson_mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "source", F.round("mix_rate", 6).alias("rate"), F.col("mix_copies").alias("copies"), F.col("mix_copy").alias("copy"), F.col("mix_order").alias("order_key"), F.sha2("text", 256).alias("text_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.scored(documents(spark, sf_dir), labels).select("doc_id", "held_out", "score", "predicted")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    found = exact_dedup.exact_duplicates(spark, path, **exact_dedup.bounded(spark, path))
    return found.withColumnRenamed("text_digest", "text_sha256")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir), 8).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.suffix_tree_scores(documents(spark, sf_dir), lambda key: suffix_tree.fold(key) != 1)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), vocabulary())
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return wrappers.extracted(pages).select("page_id", "url", "text", "n_chars")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of pages as an HTTP response record."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.concat(F.lit("<urn:pages:"), F.col("page_id").cast("string"), F.lit(">")).alias("record_id"), F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("date"), F.concat(F.encode(head, "UTF-8"), body).alias("block"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derivatives(responses(spark, sf_dir), keep=("page_id",))
    return records.select("page_id", "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "content_type", F.size("headers").alias("n_headers"), "payload_digest", "block_digest", "content_length", F.sha2("block", 256).alias("block_sha256"))


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(documents(spark, sf_dir))


def op10_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(documents(spark, sf_dir), size=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.totals(token_counts.stored(documents(spark, sf_dir), vocabulary()))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_mixing": op1_mixing, "op2_quality": op2_quality, "op3_exact_dedup": op3_exact_dedup, "op4_sharding": op4_sharding, "op5_suffix_tree": op5_suffix_tree, "op6_packing": op6_packing, "op7_wrappers": op7_wrappers, "op8_warc": op8_warc, "op9_syncmers": op9_syncmers, "op10_setsketch": op10_setsketch, "op11_token_counts": op11_token_counts, "op12_vector_codes": op12_vector_codes}

_LOG_FACTORIALS = ", ".join(repr(math.lgamma(k + 1)) + "::DOUBLE" for k in range(mixing.LEVELS))

def _codes_sql() -> str:
    """Every part against every entry, round by round."""
    measured = "SELECT p.vec_id, p.m, p.x, min(list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 16 + c.k) AS best FROM p JOIN c{n} c USING (m) GROUP BY ALL"
    ctes = [
        "v AS (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(4096 * CAST(e AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        "p AS MATERIALIZED (SELECT vec_id, m, e[m * (len(e) // 8) + 1 : (m + 1) * (len(e) // 8)] AS x FROM v, (SELECT unnest(range(8)) AS m))",
        "c0 AS MATERIALIZED (SELECT m, CAST(row_number() OVER (PARTITION BY m ORDER BY vec_id) - 1 AS BIGINT) AS k, x FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16))",
    ]
    for n in range(6):
        ctes += [
            f"a{n} AS MATERIALIZED ({measured.format(n=n)})",
            f"s{n} AS (SELECT m, best % 16 AS k, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{n})",
            f"f{n} AS (SELECT m, k, i, CAST(sum(y) AS BIGINT) AS total, count(*) AS n FROM s{n} GROUP BY ALL)",
            f"g{n} AS (SELECT m, k, list((total - ((total % n) + n) % n) // n ORDER BY i) AS x FROM f{n} GROUP BY ALL)",
            f"c{n + 1} AS MATERIALIZED (SELECT m, k, coalesce(g.x, c.x) AS x FROM c{n} c LEFT JOIN g{n} g USING (m, k))",
        ]
    ctes += [
        f"a6 AS MATERIALIZED ({measured.format(n=6)})",
        "r AS (SELECT vec_id, string_agg(printf('%02x', best % 16), '' ORDER BY m) AS code, CAST(sum(best // 16) AS BIGINT) AS error FROM a6 GROUP BY ALL)",
        "d AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY m, k)) AS codebooks_sha256 FROM c6)",
    ]
    return f"WITH {', '.join(ctes)} SELECT r.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id), d"


ORACLE_SQL: dict[str, str] = {
    "op1_mixing": f"""
        WITH lf AS (SELECT [{_LOG_FACTORIALS}] AS l),
        per AS (SELECT coalesce(source, '') AS s, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY 1),
        rate AS (SELECT s, w / (SELECT sum(w) FROM per) * (SELECT sum(n) FROM per) / n AS r FROM per),
        mass AS (
            SELECT s, r, CAST(floor(r / 16) AS INTEGER) AS steps,
                   list_transform(range({mixing.LEVELS}), lambda k: CASE WHEN r - floor(r / 16) * 16 > 0 THEN exp(k * ln(r - floor(r / 16) * 16) - (r - floor(r / 16) * 16) - l[k + 1]) END) AS p,
                   list_transform(range({mixing.LEVELS}), lambda k: exp(k * ln(16.0) - 16.0 - l[k + 1])) AS q
            FROM rate, lf),
        cdf AS (
            SELECT s, r, steps, list_transform(range(1, {mixing.LEVELS} + 1), lambda k: list_sum(p[1:k])) AS c,
                   list_transform(range(1, {mixing.LEVELS} + 1), lambda k: list_sum(q[1:k])) AS c16 FROM mass),
        drawn AS (
            SELECT d.doc_id, d.source, d.text, coalesce(CAST(d.doc_id AS VARCHAR), '') AS ident, r,
                   CAST(len(list_filter(c, lambda x: x <= (CAST('0x' || md5('mix|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|0')[1:13] AS BIGINT) + 0.5) / 4503599627370496.0)) AS BIGINT)
                   + CAST(coalesce(list_sum(list_transform(range(1, steps + 1), lambda j: len(list_filter(c16, lambda x: x <= (CAST('0x' || md5('mix|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || CAST(j AS VARCHAR))[1:13] AS BIGINT) + 0.5) / 4503599627370496.0)))), 0) AS BIGINT) AS copies
            FROM documents d JOIN cdf ON cdf.s = coalesce(d.source, '')),
        copied AS (SELECT *, unnest(range(1, copies + 1)) AS k FROM drawn WHERE copies > 0)
        SELECT doc_id, source, round(r, 6) AS rate, CAST(copies AS INTEGER) AS copies, CAST(k AS INTEGER) AS copy,
               CAST('0x' || md5('mix|order|' || ident || '|' || CAST(k AS VARCHAR))[1:15] AS BIGINT) AS order_key,
               sha256(text) AS text_sha256
        FROM copied""",
    "op3_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op12_vector_codes": _codes_sql(),
}
