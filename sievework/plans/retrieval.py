"""Queries of retrieval, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import tokens as T
from sievework.operators import dense as D
from sievework.operators import retrieval as R
from sievework.plans.tables import evidence_docs, facets, load, query_vectors, questions

TOP = 10


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.bm25(evidence_docs(spark, sf_dir), questions(spark, sf_dir), "doc_id", "item_id", TOP)
    return found.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def bm25_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.bm25(evidence_docs(spark, sf_dir), questions(spark, sf_dir), "doc_id", "item_id", TOP, excluded=F.col("doc_id") % 7 == 0)
    return found.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def corpus_df_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.document_frequency(evidence_docs(spark, sf_dir))


def corpus_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.corpus_stats(evidence_docs(spark, sf_dir)).select("n_docs", F.round("avg_length", 6).alias("avg_length"))


def lexical_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    return asked.select("item_id", T.lexical_expression(F.concat(F.col("text"), F.lit(" phase segregation of mixed halide 42 cells"))).alias("expression"))


def dense_dot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = D.dense_top(query_vectors(spark, sf_dir), facets(spark, sf_dir), "query_id", "vec_id", TOP)
    return top.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def _lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.lane_top(query_vectors(spark, sf_dir), facets(spark, sf_dir), "query_id", "lane", "vec_id", 30)


def lane_zscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lanes(spark, sf_dir).select("query_id", "lane", "vec_id", F.round("z", 9).alias("z"), "lane_rank")


def _cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("vec_id") % 3 == 0, F.lit(0.0)).otherwise(1.0 + (F.col("vec_id") % 5) / 10.0)
    return R.core_aggregate(_lanes(spark, sf_dir), "query_id", "core_id", "lane", "vec_id", 1500, weight=weight)


def core_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cores(spark, sf_dir).select("query_id", "core_id", F.round("dense_score", 6).alias("dense_score"), F.round("primary_score", 6).alias("primary_score"), F.round("support_score", 6).alias("support_score"), "dense_rank")


def _lexical_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facet hits of all questions: documents as facets, their id modulo 100 as cores."""
    asked = questions(spark, sf_dir).withColumnRenamed("item_id", "query_id")
    found = R.bm25(evidence_docs(spark, sf_dir), asked, "doc_id", "query_id", 2000)
    return found.withColumn("core_id", F.col("doc_id") % 100)


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_per_core(_lexical_facets(spark, sf_dir), "query_id", "core_id", 1200)


def lexical_first_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Some scores end in a 5 after six decimals, which engines round either way: these keep the nine that they are ranked by, as z does.
    return _lexical(spark, sf_dir).select("query_id", "core_id", "doc_id", "facet_rank", "core_rank", F.round("score", 9).alias("score"))


def _fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense = _cores(spark, sf_dir).select("query_id", "core_id", "dense_rank", "hits")
    lexical = _lexical(spark, sf_dir).select("query_id", "core_id", F.col("core_rank").alias("lexical_rank"), F.col("doc_id").alias("lexical_record"))
    return R.fused(dense, lexical, "query_id", "core_id")


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fusion(spark, sf_dir).select("query_id", "core_id", "dense_rank", "lexical_rank", F.round("rrf", 9).alias("rrf"), "rank")


def hybrid_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = evidence_docs(spark, sf_dir)
    records = docs.select(F.col("doc_id").alias("vec_id"), (F.col("doc_id") % 100).alias("core_id"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), "text")
    found = R.hybrid_results(_fusion(spark, sf_dir), records, "query_id", "core_id", "vec_id")
    return found.select("query_id", "core_id", "rank", "title", F.to_json("facets").alias("facets"), F.round("rrf", 9).alias("rrf"))


def soft_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = load(spark, sf_dir, "conversations")
    asked = talk.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    return R.soft_focus(talk.select("conv_id", "turn", "text"), asked, "conv_id", "turn").select("conv_id", "turn", F.round("score", 6).alias("score"), "rank")


QUERIES = {
    f.__name__: f
    for f in (bm25_topk, bm25_excluded, corpus_df_stats, corpus_length_stats, lexical_expression, dense_dot_topk, lane_zscore_topk, core_aggregate, lexical_first_core, rrf_fusion, hybrid_results, soft_focus)
}

BM25 = T.BM25_PATTERN


def _bm25_sql(where: str, top: int, keep: str = "true", qid: str = "item_id") -> str:
    return f"""
    tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{BM25}')) AS term FROM documents),
    len AS (SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '{BM25}')) AS n FROM documents),
    st AS (SELECT count(*) AS n_docs, avg(n) AS avg_length FROM len),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    ask AS (SELECT DISTINCT item_id AS {qid}, unnest(regexp_extract_all(lower(coalesce(text, '')), '{BM25}')) AS term FROM benchmark WHERE {where}),
    sc AS (SELECT {qid}, tf.doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_length))), 9) AS score
           FROM tf JOIN ask USING (term) JOIN dfs USING (term) JOIN len USING (doc_id), st WHERE {keep} GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY {qid} ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0),
    top AS (SELECT * FROM rk WHERE rank <= {top})"""


_STOP = "', '".join(T.QUERY_STOPWORDS)
_PHRASES = "', '".join(T.KNOWN_PHRASES)
_RSTOP = "', '".join(T.REVISION_STOPWORDS)
_DENSE = """
    q AS (SELECT vec_id // 20 AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT query_id, vec_id, label AS lane, vec_id % 100 AS core_id,
                 round(list_sum(list_transform(range(1, len(qv) + 1), lambda i: CAST(qv[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE))), 9) AS score FROM q, embeddings)"""
_LANES = (
    _DENSE
    + """,
    ls AS (SELECT query_id, lane, avg(score) AS m, greatest(stddev_pop(score), 1e-6) AS sd FROM s GROUP BY ALL),
    z AS (SELECT s.*, round((score - m) / sd, 9) AS z FROM s JOIN ls USING (query_id, lane)),
    zr AS (SELECT *, row_number() OVER (PARTITION BY query_id, lane ORDER BY z DESC, vec_id) AS lane_rank FROM z),
    lanes AS (SELECT * FROM zr WHERE lane_rank <= 30)"""
)
_CORES = (
    _LANES
    + """,
    v AS (SELECT *, round(z * CASE WHEN vec_id % 3 = 0 THEN 1.0 ELSE 1.0 + (vec_id % 5) / 10.0 END, 9) AS value FROM lanes),
    vr AS (SELECT *, row_number() OVER (PARTITION BY query_id, core_id ORDER BY value DESC, lane, vec_id) AS nth FROM v),
    c3 AS (SELECT query_id, core_id, max(value) FILTER (nth = 1) AS p,
                  0.10 * greatest(coalesce(max(value) FILTER (nth = 2), 0), 0) + 0.025 * greatest(coalesce(max(value) FILTER (nth = 3), 0), 0) AS sup
           FROM vr WHERE nth <= 3 GROUP BY ALL),
    cd AS (SELECT query_id, core_id, round(p + sup, 9) AS dense_score, round(p, 9) AS primary_score, round(sup, 9) AS support_score FROM c3),
    cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, core_id) AS dense_rank FROM cd),
    cores AS (SELECT * FROM cr WHERE dense_rank <= 1500)"""
)
_FIRST = (
    _bm25_sql("true", 2000, qid="query_id")
    + """,
    fc AS (SELECT query_id, doc_id, doc_id % 100 AS core_id, score, rank AS facet_rank, row_number() OVER (PARTITION BY query_id, doc_id % 100 ORDER BY rank) AS nth FROM top),
    lexical AS (SELECT query_id, core_id, doc_id, facet_rank, row_number() OVER (PARTITION BY query_id ORDER BY facet_rank) AS core_rank, score FROM fc WHERE nth = 1)"""
)

ORACLE_SQL = {
    "bm25_topk": f"WITH {_bm25_sql('true', TOP)} SELECT item_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top",
    "bm25_excluded": f"WITH {_bm25_sql('true', TOP, keep='tf.doc_id % 7 <> 0')} SELECT item_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top",
    "corpus_df_stats": f"""
        WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{BM25}')) AS term FROM documents),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)
        SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term""",
    "corpus_length_stats": f"SELECT count(*) AS n_docs, round(avg(len(regexp_extract_all(lower(coalesce(text, '')), '{BM25}'))), 6) AS avg_length FROM documents",
    "lexical_expression": f"""
        WITH t AS (SELECT item_id, lower(text || ' phase segregation of mixed halide 42 cells') AS x FROM benchmark),
        w AS (SELECT item_id, list_filter(['{_PHRASES}'], lambda p: contains(x, p)) AS p, list_filter(list_transform(regexp_extract_all(x, '{T.QUERY_PATTERN}'), lambda a: trim(a, '.+-')), lambda a: length(a) >= 2 AND a NOT IN ('{_STOP}') AND NOT regexp_full_match(a, '[0-9]+')) AS a FROM t),
        e AS (SELECT item_id, unnest(list_concat(p, a)) AS term, generate_subscripts(list_concat(p, a), 1) AS i FROM w),
        d AS (SELECT item_id, term, min(i) AS i FROM e GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS r FROM d)
        SELECT item_id, string_agg('"' || term || '"', ' OR ' ORDER BY i) AS expression FROM k WHERE r <= 64 GROUP BY item_id""",
    "dense_dot_topk": f"WITH {_DENSE}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {TOP}",
    "lane_zscore_topk": f"WITH {_LANES} SELECT query_id, lane, vec_id, round(z, 9) AS z, CAST(lane_rank AS INTEGER) AS lane_rank FROM lanes",
    "core_aggregate": f"WITH {_CORES} SELECT query_id, core_id, round(dense_score, 6) AS dense_score, round(primary_score, 6) AS primary_score, round(support_score, 6) AS support_score, CAST(dense_rank AS INTEGER) AS dense_rank FROM cores",
    "lexical_first_core": f"WITH {_FIRST} SELECT query_id, core_id, doc_id, CAST(facet_rank AS INTEGER) AS facet_rank, CAST(core_rank AS INTEGER) AS core_rank, round(score, 9) AS score FROM lexical WHERE core_rank <= 1200",
    "rrf_fusion": f"""
        WITH {_CORES}, {_FIRST},
        f AS (SELECT query_id, core_id, dense_rank, core_rank AS lexical_rank, round(coalesce(1.0 / (60 + dense_rank), 0) + coalesce(0.75 / (60 + core_rank), 0), 9) AS rrf
              FROM cores FULL JOIN lexical USING (query_id, core_id)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, core_id) AS rank FROM f)
        SELECT query_id, core_id, CAST(dense_rank AS INTEGER) AS dense_rank, CAST(lexical_rank AS INTEGER) AS lexical_rank, rrf, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 80""",
    "soft_focus": f"""
        WITH tk AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '{T.REVISION_PATTERN}'), lambda a: a NOT IN ('{_RSTOP}'))) AS w FROM conversations),
        w AS (SELECT conv_id, turn, unnest(w) AS word FROM tk),
        n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1),
        df AS (SELECT conv_id, word, count(*) AS df FROM w GROUP BY ALL),
        u AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1),
        ask AS (SELECT DISTINCT conv_id, unnest(list_filter(regexp_extract_all(lower(text), '{T.REVISION_PATTERN}'), lambda a: a NOT IN ('{_RSTOP}'))) AS word FROM u),
        sc AS (SELECT conv_id, turn, round(sum(ln((n + 1) / (df + 1)) + 1), 9) AS score FROM w JOIN ask USING (conv_id, word) JOIN df USING (conv_id, word) JOIN n USING (conv_id) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rank FROM sc WHERE score > 0)
        SELECT conv_id, turn, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 6""",
}
