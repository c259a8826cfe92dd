"""Lexical and dense retrieval, fusion and focus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.tokens import bm25_tokens, revision_tokens
from sievework.sources.work import table

#: Fixed values of the ranking function.
K1, B = 1.2, 0.75


def ranked(df: DataFrame, by: list[str], order: list[Column], top: int, name: str = "rank") -> DataFrame:
    """The first `top` rows of each group, numbered from 1; pruned before the shuffle by Spark's group limit."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= top)


def corpus_stats(docs: DataFrame, text: str = "text", tokens: Callable[[Column], Column] = bm25_tokens) -> DataFrame:
    """One row: the number of documents and their mean length in tokens."""
    return docs.select(F.size(tokens(F.col(text))).alias("n")).agg(F.count("*").alias("n_docs"), F.avg("n").alias("avg_length"))


def document_frequency(docs: DataFrame, text: str = "text", tokens: Callable[[Column], Column] = bm25_tokens) -> DataFrame:
    """(term, df, cf): how many documents have a term, and how often it occurs in all."""
    numbered = docs.select(F.monotonically_increasing_id().alias("d"), tokens(F.col(text)).alias("words"))
    per = numbered.select("d", F.explode("words").alias("term"))
    return per.groupBy("term", "d").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25(
    docs: DataFrame,
    questions: DataFrame,
    doc_id: str,
    question_id: str,
    top: int = 240,
    excluded: Column | None = None,
    tokens: Callable[[Column], Column] = bm25_tokens,
    positive: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """(question, document, score, rank) of the `top` documents with a positive score.

    Texts are in columns `text`. They are tokenised once, into a table of the
    frequencies of terms that some question asks for, with a row of the empty
    term for each document; numbers, lengths and document frequencies all come
    from that table. Only asked terms leave the scan, counted on the map side.
    A document's terms travel once, by document, with the questions that ask for
    each: pairs of questions and documents are made, summed and pruned in place.
    Documents for which `excluded` holds are not
    returned, but count in the number of documents, their mean length and term
    frequencies. Ties go to the lesser document. Scores are rounded to nine
    decimals before they are ranked, so equal documents have equal scores.
    """
    asked = questions.select(question_id, F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    wanted = asked.select("term").distinct().unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term")))
    words = docs.select(doc_id, (excluded if excluded is not None else F.lit(False)).alias("out"), tokens(F.col("text")).alias("words"))
    found = words.select(doc_id, "out", F.size("words").alias("length"), F.explode(F.concat(F.array(F.lit("")), "words")).alias("term")).join(wanted, "term", "left_semi")
    every = table(found.groupBy("term", doc_id, "out", "length").agg(F.count("*").alias("tf")), "bm25-terms")
    stats = every.filter("term = ''").agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), (F.sum(F.col("length") * F.col("tf")) / F.sum("tf")).alias("average"))
    n_docs, average = stats.select("n").scalar(), F.coalesce(F.nullif(stats.select("average").scalar(), F.lit(0.0)), F.lit(1.0))
    tf = every.filter("term <> ''")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = positive(n_docs, F.col("df")) if positive else F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("__idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / average))
    askers = asked.groupBy("term").agg(F.collect_list(question_id).alias("__askers")).join(df, "term")
    # Written, so that its size is known: where it is small it is sent to the documents' terms instead of these to it.
    askers = table(askers.select("term", idf.alias("__idf"), "__askers"), "askers")
    weighed = tf.filter(~F.col("out")).repartition(doc_id).join(askers, "term").select(doc_id, weight.alias("__weight"), "__askers")
    each = weighed.select(doc_id, "__weight", F.explode("__askers").alias(question_id))
    scored = each.groupBy(question_id, doc_id).agg(F.round(F.sum("__weight"), 9).alias("score")).filter("score > 0")
    return ranked(scored, [question_id], [F.desc("score"), F.asc(doc_id)], top)


def first_per_core(hits: DataFrame, question_id: str, core: str, limit: int) -> DataFrame:
    """The best facet of each core keeps its rank (`facet_rank`); cores are ranked anew."""
    best = ranked(hits.withColumnRenamed("rank", "facet_rank"), [question_id, core], [F.asc("facet_rank")], 1, "nth").drop("nth")
    return ranked(best, [question_id], [F.asc("facet_rank")], limit, "core_rank")


def core_aggregate(hits: DataFrame, query_id: str, core: str, lane: str, record: str, top: int, weight: Column | None = None, one_hit_per_lane: bool = False) -> DataFrame:
    """Cores by their best three weighted hits: p + 0.1 max(s, 0) + 0.025 max(t, 0).

    A weight of null or 0 counts as 1. With `one_hit_per_lane` a core has at most its best record of a lane.
    """
    w = F.coalesce(F.nullif(weight, F.lit(0.0)), F.lit(1.0)) if weight is not None else F.lit(1.0)
    valued = hits.withColumn("value", F.round(F.col("z") * w, 9))
    order = [F.desc("value"), F.asc(lane), F.asc(record)]
    if one_hit_per_lane:
        valued = ranked(valued, [query_id, core, lane], order, 1, "in_lane").drop("in_lane")
    three = ranked(valued, [query_id, core], order, 3, "nth")
    at = lambda n: F.max(F.when(F.col("nth") == n, F.col("value")))
    support = 0.10 * F.greatest(F.coalesce(at(2), F.lit(0.0)), F.lit(0.0)) + 0.025 * F.greatest(F.coalesce(at(3), F.lit(0.0)), F.lit(0.0))
    hits_ = F.transform(F.array_sort(F.collect_list(F.struct("nth", record))), lambda x: x[record])
    cores = three.groupBy(query_id, core).agg(F.round(at(1) + support, 9).alias("dense_score"), F.round(at(1), 9).alias("primary_score"), F.round(support, 9).alias("support_score"), hits_.alias("hits"))
    return ranked(cores, [query_id], [F.desc("dense_score"), F.asc(core)], top, "dense_rank")


def fused(dense: DataFrame, lexical: DataFrame, query_id: str, core: str, k: int = 60, lexical_weight: float = 0.75, top: int = 80) -> DataFrame:
    """Weighted reciprocal-rank fusion of (query, core, dense_rank) and (query, core, lexical_rank)."""
    both = dense.join(lexical, [query_id, core], "full_outer")
    part = lambda c, w: F.coalesce(F.lit(w) / (k + F.col(c)), F.lit(0.0))
    scored = both.withColumn("rrf", F.round(part("dense_rank", 1.0) + part("lexical_rank", lexical_weight), 9))
    return ranked(scored, [query_id], [F.desc("rrf"), F.asc(core)], top)


def hybrid_results(fusion: DataFrame, records: DataFrame, query_id: str, core: str, record: str, facets: int = 4, preview: int = 200) -> DataFrame:
    """Fused cores with their first record's title and up to `facets` previews of the records that hit."""
    first = records.groupBy(core).agg(F.min_by("title", record).alias("title"))
    # The dense hits first, then the lexical record if it is not among them.
    picked = F.slice(F.array_distinct(F.concat(F.coalesce("hits", F.array().cast("array<bigint>")), F.when(F.col("lexical_record").isNotNull(), F.array("lexical_record")).otherwise(F.array().cast("array<bigint>")))), 1, facets)
    placed = fusion.select(query_id, core, F.posexplode(picked).alias("place", record)).join(records.select(record, F.substring("text", 1, preview).alias("preview")), record)
    previews = placed.groupBy(query_id, core).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", record, "preview"))), lambda x: F.struct(x[record].alias(record), x["preview"].alias("preview"))).alias("facets"))
    return fusion.join(first, core, "left").join(previews, [query_id, core], "left").drop("hits")


def soft_focus(chunks: DataFrame, queries: DataFrame, query_id: str, chunk_id: str, top: int = 6) -> DataFrame:
    """The `top` chunks of each query by the summed inverse frequency of the words they share.

    Both have columns `query_id` and `text`; a word's frequency is among the query's own chunks.
    """
    words = chunks.select(query_id, chunk_id, F.explode(revision_tokens(F.col("text"))).alias("word"))
    n = chunks.groupBy(query_id).agg(F.count("*").alias("n"))
    df = words.groupBy(query_id, "word").agg(F.count("*").alias("df"))
    asked = queries.select(query_id, F.explode(revision_tokens(F.col("text"))).alias("word"))
    shared = words.join(asked, [query_id, "word"]).join(df, [query_id, "word"]).join(n, query_id)
    scored = shared.groupBy(query_id, chunk_id).agg(F.round(F.sum(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1), 9).alias("score")).filter("score > 0")
    return ranked(scored, [query_id], [F.desc("score"), F.asc(chunk_id)], top)
