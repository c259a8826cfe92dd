"""Queries beyond scoring and retrieval: stored indexes, streams and joins of the star schema, each with its SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.plans.retrieval import ORACLE_SQL as RETRIEVAL_SQL
from sievework.plans.tables import evidence_docs, load, questions
from sievework.sources import index, jsonl
from sievework.sources.work import folder
from sievework.streaming import windows


def stored_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bm25_topk through an index that is written and searched."""
    path = folder(spark, "index")
    index.save_index(evidence_docs(spark, sf_dir), path, "doc_id")
    found = index.search_index(spark, path, questions(spark, sf_dir), "item_id", "doc_id", 10)
    return found.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as JSON lines and read under their schema, with each row's digest."""
    path, talk = folder(spark, "jsonl"), load(spark, sf_dir, "conversations")
    jsonl.write_jsonl(talk, path)
    return jsonl.read_jsonl(spark, path, talk.schema).select("conv_id", "turn", "role", F.sha2("text", 256).alias("sha256"))


def compressed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of compressed JSON payloads, looked up by core for the benchmark's items."""

    @F.pandas_udf(T.BinaryType())
    def deflated(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: zlib.compress(t.encode()))

    docs = load(spark, sf_dir, "documents")
    store = docs.select((F.col("doc_id") % 100).alias("core_id"), "doc_id", deflated(F.to_json(F.struct("lang", "source", "n_chars"))).alias("payload"))
    wanted = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("core_id"))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
    found = index.lookup(index.inflated(store, "payload", schema), wanted, "core_id", "doc_id")
    return found.select("core_id", "doc_id", "place", "payload.lang", "payload.source", "payload.n_chars")


def shard_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the vectors without every seventh and with one twice."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    shards = [e.filter("vec_id % 7 <> 3 and vec_id < 100"), e.filter("vec_id >= 100"), e.filter("vec_id = 101")]
    return index.shard_faults(index.merged_shards(shards, "vec_id"), "vec_id", "embedding")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts and sums of each event type, through a stream."""
    events = windows.stream_of(spark, f"{sf_dir}/events.parquet")
    found = windows.windowed(events, "ts", ["event_type"], "1 hour", [F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")], late="2 hours")
    return windows.run_to_table(found).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "events", "total")


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.sessions(load(spark, sf_dir, "events"), "ts", "user_id", "3 hours")
    return found.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "events")


def stream_first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct users and types of the stream."""
    events = windows.stream_of(spark, f"{sf_dir}/events.parquet").select("user_id", "event_type")
    return windows.run_to_table(windows.deduplicated(events, ["user_id", "event_type"]), "append")


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = load(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return item.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("orders"))


def region_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: load(spark, sf_dir, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


QUERIES = {f.__name__: f for f in (stored_index_topk, jsonl_round_trip, compressed_store, shard_checks, stream_windows, session_windows, stream_first_events, pricing_summary, region_revenue)}

ORACLE_SQL = {
    "stored_index_topk": RETRIEVAL_SQL["bm25_topk"],
    "jsonl_round_trip": "SELECT conv_id, turn, role, sha256(text) AS sha256 FROM conversations",
    "compressed_store": "SELECT doc_id % 100 AS core_id, doc_id, CAST(row_number() OVER (PARTITION BY doc_id % 100 ORDER BY doc_id) AS INTEGER) AS place, lang, source, n_chars FROM documents WHERE doc_id % 100 IN (SELECT item_id FROM benchmark)",
    "shard_checks": "SELECT vec_id, 'missing' AS fault FROM embeddings WHERE vec_id % 7 = 3 AND vec_id < 100 UNION ALL SELECT 101, 'repeated'",
    "stream_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "session_windows": """
        WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 3 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events FROM s GROUP BY user_id, k""",
    "stream_first_events": "SELECT DISTINCT user_id, event_type FROM events",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS orders FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "region_revenue": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2",
}
