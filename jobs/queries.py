"""Each job as a query: run twice over the whole table into one new folder, and its output read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import fulltext, units
from sievework.functions.tokens import BM25_PATTERN
from sievework.plans.texts import _SENTENCE_ROWS, INFORMATIVE_SQL, SCIENCE_SQL, WORDS_SQL
from sievework.sources.work import folder


def job1_fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's rows after a run over all files and one that finds none."""
    base, documents = folder(spark, "job1"), f"{sf_dir}/documents.parquet"
    for _ in range(2):
        fulltext.run(spark, documents, f"{base}/index", f"{base}/checkpoint")
    key = spark.read.parquet(documents).schema["doc_id"]
    return fulltext.read_index(spark, f"{base}/index", key).select("term", "doc_id", "tf", "length", F.array_join("positions", ",").alias("positions"))


def job2_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store of units after two runs over all languages."""
    base, documents = folder(spark, "job2"), f"{sf_dir}/documents.parquet"
    for _ in range(2):
        units.run(spark, documents, f"{base}/evidence")
    schema = units.units_of(spark.read.parquet(documents)).schema
    return spark.read.schema(schema).parquet(f"{base}/evidence/units")


QUERIES = {"job1_fulltext": job1_fulltext, "job2_units": job2_units}

ORACLE_SQL = {
    "job1_fulltext": f"""
        WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{BM25_PATTERN}') AS words FROM documents WHERE doc_id IS NOT NULL),
        tok AS (SELECT doc_id, unnest(words) AS term, generate_subscripts(words, 1) - 1 AS place, len(words) AS length FROM w)
        SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf, CAST(any_value(length) AS INTEGER) AS length, string_agg(CAST(place AS VARCHAR), ',' ORDER BY place) AS positions FROM tok GROUP BY term, doc_id
        UNION ALL SELECT '', doc_id, CAST(len(words) AS INTEGER), CAST(len(words) AS INTEGER), '' FROM w""",
    "job2_units": f"""
        WITH {_SENTENCE_ROWS},
        k AS (SELECT sn.doc_id, lang, source, place, sentence AS u, sha256(trim(lower(regexp_replace(sentence, '\\s+', ' ', 'g')))) AS key FROM sn JOIN documents USING (doc_id)),
        g AS (SELECT lang, key, first(doc_id ORDER BY doc_id, place) AS doc_id, first(place ORDER BY doc_id, place) AS place, first(u ORDER BY doc_id, place) AS u, first(source ORDER BY doc_id, place) AS source,
                     count(*) AS copies, count(DISTINCT doc_id) AS documents FROM k GROUP BY ALL),
        w AS (SELECT *, {WORDS_SQL} FROM g)
        SELECT lang, doc_id, CAST(place AS INTEGER) AS place, u AS unit, source, copies, documents, {SCIENCE_SQL} AS science, {INFORMATIVE_SQL} AS informative, sha256(u) AS sha256 FROM w""",
}
