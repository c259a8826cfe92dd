"""Queries of the full-text index, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.python import porter_tokens
from sievework.functions.tokens import lexical_phrases
from sievework.operators import retrieval as R
from sievework.sources import fulltext
from sievework.sources.work import folder
from sievework.plans.tables import evidence_docs, questions

TOP = 10


def _pairs(words: F.Column) -> F.Column:
    """Each word with the next one."""
    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))


def fulltext_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index of all documents, asked for each question's words and pairs of neighbouring words."""
    path = folder(spark, "fulltext")
    fulltext.save(evidence_docs(spark, sf_dir), path, "doc_id")
    words = fulltext.word_tokens(F.col("text"))
    asked = questions(spark, sf_dir).select("item_id", F.array_distinct(F.concat(words, _pairs(words))).alias("phrases"))
    found = fulltext.search(fulltext.load(spark, path), asked, "item_id", "doc_id", TOP)
    return found.select("item_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def fulltext_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored index holds of each term and document."""
    path = folder(spark, "fulltext")
    fulltext.save(evidence_docs(spark, sf_dir), path, "doc_id")
    return fulltext.load(spark, path).select("term", "doc_id", "tf", "length", F.array_join("positions", ",").alias("positions"))


def fts_first_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As lexical_first_core, by the full-text engine's own words, stems, phrases and ranking; documents' ids modulo 100 are cores."""
    path = folder(spark, "fulltext-stems")
    fulltext.save(evidence_docs(spark, sf_dir), path, "doc_id", tokens=porter_tokens)
    asked = questions(spark, sf_dir).select(F.col("item_id").alias("query_id"), lexical_phrases(F.col("text")).alias("phrases"))
    found = fulltext.search(fulltext.load(spark, path), asked, "query_id", "doc_id", 2000, tokens=porter_tokens)
    best = R.first_per_core(found.withColumn("core_id", F.col("doc_id") % 100), "query_id", "core_id", 1200)
    return best.select("query_id", "core_id", "doc_id", "facet_rank", "core_rank", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (fulltext_topk, fulltext_postings, fts_first_core)}

_TOKENS = """
    w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS words FROM documents),
    tok AS MATERIALIZED (SELECT doc_id, unnest(words) AS term, generate_subscripts(words, 1) - 1 AS place, len(words) AS length FROM w)"""

ORACLE_SQL = {
    "fulltext_topk": f"""
        WITH {_TOKENS},
        bw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS words FROM benchmark),
        ask AS (SELECT DISTINCT item_id, unnest(list_concat(words, list_transform(range(1, greatest(len(words), 1)), lambda i: words[i] || ' ' || words[i + 1]))) AS phrase FROM bw),
        two AS (SELECT doc_id, term || ' ' || lead(term) OVER (PARTITION BY doc_id ORDER BY place) AS phrase, length FROM tok),
        f AS (SELECT doc_id, phrase, count(*) AS f, any_value(length) AS length FROM (SELECT doc_id, term AS phrase, length FROM tok UNION ALL SELECT * FROM two WHERE phrase IS NOT NULL) WHERE phrase IN (SELECT phrase FROM ask) GROUP BY ALL),
        held AS (SELECT phrase, count(*) AS n FROM f GROUP BY 1),
        st AS (SELECT count(*) AS nd, avg(len(words)) AS average FROM w),
        sc AS (SELECT item_id, doc_id, round(sum(greatest(ln((nd - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / average))), 9) AS score
               FROM ask JOIN f USING (phrase) JOIN held USING (phrase), st GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc)
        SELECT item_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {TOP}""",
    "fulltext_postings": f"""
        WITH {_TOKENS}
        SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf, CAST(any_value(length) AS INTEGER) AS length, string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) AS positions FROM tok GROUP BY term, doc_id
        UNION ALL SELECT '', doc_id, CAST(len(words) AS INTEGER), CAST(len(words) AS INTEGER), '' FROM w""",
}
