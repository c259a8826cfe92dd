"""A full-text index with positions: postings by term, phrase matching, and the full-text engine's own ranking.

A document is one row for each of its terms, (bucket, term, doc, tf, positions,
length), and one row of the empty term that stands for the document itself, so
that numbers and lengths come from the same table. Terms are hashed into
buckets, which are folders: a search reads the buckets of its terms only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators.retrieval import B, K1, ranked
from sievework.sources.work import table

#: Buckets of terms, and the bucket of the documents' own rows.
BUCKETS, OWN = 32, -1
#: The least inverse frequency, a fixed value of the engine's ranking.
LEAST_IDF = 1e-6
VERSION = "positions-1"


def word_tokens(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.when(term == "", OWN).otherwise(F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int"))


def once(docs: DataFrame, doc_id: str, text: str = "text") -> DataFrame:
    """(doc, text) of ids that aren't null; of several texts of one id the least, a null text as an empty one.

    Only ids are grouped, and only texts of repeated ids travel.
    """
    given = docs.filter(F.col(doc_id).isNotNull()).select(doc_id, F.coalesce(F.col(text), F.lit("")).alias(text))
    repeated = table(given.groupBy(doc_id).agg(F.count("*").alias("n")).filter("n > 1").select(doc_id), "repeated-ids")
    if repeated.isEmpty():
        return given
    least = given.join(repeated, doc_id, "left_semi").groupBy(doc_id).agg(F.min(text).alias(text))
    return given.join(repeated, doc_id, "left_anti").unionByName(least)


def _places(words: pa.ListArray, ids: pa.Array, block: int = 1 << 20) -> Iterator[list[pa.Array]]:
    """Columns (term, doc, tf, positions, length) of documents' words, in order of terms, about `block` words at once."""
    many = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, first = np.cumsum(many), 0
    while first < len(many):
        last = max(int(np.searchsorted(ends, ends[first] - many[first] + block, side="right")), first + 1)
        n = many[first:last]
        found = words.slice(first, last - first).flatten().dictionary_encode()
        by_term = pc.sort_indices(found.dictionary).to_numpy()
        rank = np.empty(len(by_term), np.int64)
        rank[by_term] = np.arange(len(by_term))
        code, row = rank[found.indices.to_numpy()], np.repeat(np.arange(len(n)), n)
        place = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
        order = np.argsort(code, kind="stable")
        code, row, place = code[order], row[order], place[order]
        starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])]) if len(code) else np.empty(0, np.int64)
        offsets = np.r_[starts, len(code)]
        own = pa.ListArray.from_arrays(pa.array(np.zeros(len(n) + 1), pa.int32()), pa.array([], pa.int32()))
        length = pa.array(n, pa.int32())
        block_ids, at = ids.slice(first, last - first), row[starts]
        yield [pa.array([""] * len(n), pa.string()), block_ids, length, own, length]
        term = found.dictionary.cast(pa.string()).take(pa.array(by_term[code[starts]]))
        positions = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(place, pa.int32()))
        yield [term, block_ids.take(pa.array(at)), pa.array(np.diff(offsets), pa.int32()), positions, length.take(pa.array(at))]
        first = last


def postings(docs: DataFrame, doc_id: str, text: str = "text", tokens: Callable[[Column], Column] = word_tokens, buckets: int = BUCKETS, distinct: bool = False) -> DataFrame:
    """(bucket, term, doc, tf, positions, length) of documents with ids; positions count tokens from 0.

    Rows with a null id are left out; of several texts of one id the least is
    taken (`distinct`: ids are known not to repeat); a null text is empty. A
    document's words become postings where it is read: neither texts nor tokens
    travel.
    """
    one = docs.filter(F.col(doc_id).isNotNull()).select(doc_id, F.coalesce(F.col(text), F.lit("")).alias(text)) if distinct else once(docs, doc_id, text)
    words = one.select(doc_id, tokens(F.col(text)).alias("__words"))
    kinds = [("term", T.StringType()), (doc_id, docs.schema[doc_id].dataType), ("tf", T.IntegerType()), ("positions", T.ArrayType(T.IntegerType())), ("length", T.IntegerType())]
    schema = T.StructType([T.StructField(name, kind) for name, kind in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in _places(batch.column(1), batch.column(0)):
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return words.mapInArrow(run, schema).select(bucket_of(F.col("term"), buckets).alias("bucket"), *schema.fieldNames())


def laid_out(rows: DataFrame, doc_id: str) -> DataFrame:
    """Rows in files of about equal size, each of few buckets and sorted by term; a hot bucket is split."""
    return rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", doc_id)


def save(docs: DataFrame, path: str, doc_id: str, text: str = "text", tokens: Callable[[Column], Column] = word_tokens, buckets: int = BUCKETS) -> None:
    """The index of distinct documents under `path`: postings by bucket, then statistics, which make it complete.

    What was written is read back and counted: one own row for each document, and
    as many tokens at positions as documents have; a repeated or null id, or
    another count, is an error and leaves no statistics.
    """
    spark = docs.sparkSession
    given = docs.agg(F.count("*").alias("n"), F.count_distinct(doc_id).alias("d")).first()
    if given["n"] != given["d"]:
        raise ValueError("documents need distinct ids")
    rows = laid_out(postings(docs, doc_id, text, tokens, buckets, distinct=True), doc_id)
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    own = F.col("term") == ""
    stored = spark.read.schema(rows.schema).parquet(f"{path}/postings")
    stats = stored.agg(
        F.count_if(own).alias("n_docs"),
        F.coalesce(F.sum(F.when(own, F.col("tf").cast("long"))), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.sum(F.when(~own, F.size("positions").cast("long"))), F.lit(0)).alias("n_places"),
    )
    found = stats.first()
    if found["n_docs"] != given["n"] or found["n_tokens"] != found["n_places"]:
        raise ValueError(f"{given['n']} documents were given; the index has {found['n_docs']}, of {found['n_tokens']} tokens, at {found['n_places']} places")
    kinds = F.lit(rows.schema.json()).alias("schema")
    spark.createDataFrame([found]).select(F.lit(VERSION).alias("version"), F.lit(buckets).alias("buckets"), "n_docs", "n_tokens", kinds).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The stored index's rows; one without statistics or of another version is an error."""
    stats = spark.read.parquet(f"{path}/stats").first()
    if stats is None or stats["version"] != VERSION:
        raise ValueError("unsupported index version")
    return spark.read.schema(T.StructType.fromJson(json.loads(stats["schema"]))).parquet(f"{path}/postings")


def postings_of(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The index's rows of some terms, (bucket, term); only the folders of their buckets, a bounded number, are read."""
    buckets = [r["bucket"] for r in terms.select("bucket").distinct().collect()]
    return index.filter(F.col("bucket").isin(buckets)).join(terms, ["bucket", "term"], "left_semi")


def phrase_hits(index: DataFrame, phrases: DataFrame, doc_id: str, buckets: int = BUCKETS) -> DataFrame:
    """(doc, length, phrase, f): how often each phrase stands in each document that has it.

    `phrases` holds (phrase, words), distinct, with at least one word; its words
    joined by spaces are the phrase. The postings of asked words travel once, by
    document. There a word by itself is its posting; for longer phrases words are
    put in order of their places and each is extended by its neighbours, so that a
    document yields as many runs of each asked number of words as it has words,
    and the runs that are asked for are counted, whatever their number.
    """
    terms = phrases.select(F.explode("words").alias("term")).distinct().withColumn("bucket", bucket_of(F.col("term"), buckets))
    asked = postings_of(index, terms).select(doc_id, "length", "term", "positions").repartition(doc_id)
    each = asked.groupBy(doc_id, "length").agg(F.collect_list(F.struct("term", "positions")).alias("held"))
    sizes = {r["n"] for r in phrases.select(F.size("words").alias("n")).distinct().collect()}
    run = lambda place, words: F.struct(place.alias("last"), words.alias("phrase"))
    if max(sizes, default=1) > 1:
        each = each.withColumn("placed", F.sort_array(F.flatten(F.transform("held", lambda h: F.transform(h["positions"], lambda p: run(p, h["term"]))))))
    found, runs = [F.transform("held", lambda h: F.struct(h["term"].alias("phrase"), F.size(h["positions"]).cast("long").alias("f")))], "placed"
    for n in range(2, max(sizes, default=1) + 1):
        # Beyond the last word, and after a word that is not its neighbour, a run is null.
        longer = F.zip_with(runs, F.slice("placed", F.lit(n), F.size("placed")), lambda a, b: F.when(b["last"] == a["last"] + 1, run(b["last"], F.concat_ws(" ", a["phrase"], b["phrase"]))))
        runs = f"runs{n}"
        each = each.withColumn(runs, longer)
        if n in sizes:
            found.append(F.transform(F.filter(runs, lambda x: x.isNotNull()), lambda x: F.struct(x["phrase"].alias("phrase"), F.lit(1).cast("long").alias("f"))))
    rows = each.select(doc_id, "length", F.explode(F.concat(*found)).alias("hit")).select(doc_id, "length", "hit.phrase", "hit.f")
    return rows.join(phrases.select("phrase"), "phrase", "left_semi").groupBy(doc_id, "length", "phrase").agg(F.sum("f").alias("f"))


def search(index: DataFrame, asked: DataFrame, question: str, doc_id: str, top: int, phrases: str = "phrases", tokens: Callable[[Column], Column] = word_tokens, buckets: int = BUCKETS) -> DataFrame:
    """(question, doc, score, rank) of the `top` documents that hold any of a question's phrases (an array of strings).

    The engine's ranking: each phrase counts by the documents that hold it, with
    log((N - n + 0.5) / (n + 0.5)), at least 1e-6; phrases without a token fall
    away, one given twice counts twice. The engine's own number is the negated
    score. Scores are rounded to nine decimals before they are ranked; ties go to
    the lesser document. A document's hits travel once, by document, and meet
    there the questions that ask for them.
    """
    items = asked.select(question, F.explode(phrases).alias("__given")).select(question, tokens(F.col("__given")).alias("words")).filter(F.size("words") > 0)
    times = table(items.withColumn("phrase", F.array_join("words", " ")).groupBy("phrase", "words", question).agg(F.count("*").alias("times")), "asked-phrases")
    distinct = table(times.select("phrase", "words").distinct(), "phrases")
    hits = table(phrase_hits(index, distinct, doc_id, buckets), "phrase-hits")
    stats = index.filter(F.col("bucket") == OWN).agg(F.count("*").alias("n"), F.avg("length").alias("average"))
    n_docs, average = stats.select("n").scalar(), F.coalesce(F.nullif(stats.select("average").scalar(), F.lit(0.0)), F.lit(1.0))
    held = hits.groupBy("phrase").agg(F.count("*").alias("n"))
    idf = F.greatest(F.log((n_docs - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(LEAST_IDF))
    askers = times.groupBy("phrase").agg(F.collect_list(F.struct(question, "times")).alias("__askers")).join(held, "phrase")
    # Written, so that its size is known: where it is small it is sent to the documents instead of these to it.
    askers = table(askers.select("phrase", idf.alias("__idf"), "__askers"), "askers")
    share = F.col("__idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / average))
    met = hits.repartition(doc_id).join(askers, "phrase").select(doc_id, share.alias("__share"), F.explode("__askers").alias("__asker"))
    scored = met.groupBy(F.col(f"__asker.{question}").alias(question), doc_id).agg(F.round(F.sum(F.col("__share") * F.col("__asker.times")), 9).alias("score"))
    return ranked(scored, [question], [F.desc("score"), F.asc(doc_id)], top)
