"""Job 2: builds the store of evidence units from a table of documents.

Documents are split into sentences; each gets the two quality predicates of
evidence packets. Of sentences that are equal within a language, but for case and
white space, the one of the least document and place stays, with the numbers of
its copies and of documents that have it:

    output/units/lang=<language>/*.parquet     doc_id, place, unit, source, copies, documents, science, informative, sha256
    output/report/*.json                        numbers by language and source

A run over all languages replaces the store; one over some (`langs`, separated by
commas) replaces those languages' partitions and the report, and leaves the others.
Either can be repeated, with the same result.

Rows without an id are counted and left out; a null text has no units, a null
language is one of its own, which `langs` names as "null".

    python -m jobs.units --config jobs/units.json --documents /data/documents --output /data/evidence
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sievework.functions.cleaning import is_informative, is_science_unit, squeezed
from sievework.functions.sentences import sentences
from sievework.sources.work import shuffles_removed

log = logging.getLogger("jobs.units")

OPTIONS = {"documents": str, "output": str, "langs": str, "doc_id": str, "text": str, "lang": str, "source": str}


#: Ids that several rows share are told from others by so many slots at most.
SLOTS = 1 << 18


def _lines(rows: DataFrame) -> DataFrame:
    """(lang, key, doc_id, place, unit, source, opens): all sentences; of a row's equal ones, the first opens.

    A key is 16 bytes of the SHA-256: of a thousand million sentences, two that differ share one with a probability of about 1e-21.
    """
    key = lambda unit: F.substring(F.unhex(F.sha2(F.lower(squeezed(unit, " ")), 256)), 1, 16)
    cut = F.sort_array(F.transform(sentences(F.col("text")), lambda unit, i: F.struct(key(unit).alias("key"), i.alias("place"), unit.alias("unit"))))
    opens = lambda x, i: (i == 0) | (F.get("cut", i - 1)["key"] != x["key"])
    marked = F.transform("cut", lambda x, i: F.struct(x["key"].alias("key"), x["place"].alias("place"), x["unit"].alias("unit"), opens(x, i).alias("opens")))
    return rows.select("lang", "doc_id", "source", cut.alias("cut")).select("lang", "doc_id", "source", F.inline(marked))


def _counted_again(rows: DataFrame) -> DataFrame:
    """(lang, key, documents): what to add to the numbers of rows that open a key, where rows share a language and an id."""
    slot = F.pmod(F.xxhash64("lang", "doc_id"), F.lit(SLOTS))
    shared = rows.groupBy("lang", "doc_id").count().filter("count > 1").select(slot.alias("slot")).distinct()
    those = _lines(rows.withColumn("slot", slot).join(F.broadcast(shared), "slot", "left_semi"))
    return those.filter("opens").groupBy("key", "lang", "doc_id").agg((1 - F.count("*")).alias("documents")).filter("documents < 0").select("lang", "key", "documents")


def units_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", read: Observation | None = None) -> DataFrame:
    """One row for each different sentence of a language; `read` gets the numbers of rows, and of those without an id.

    Texts are shuffled once, by language and key: a document's copies are told in
    its own row, and a task's copies meet before the shuffle, so a line that a
    third of all documents share is a few rows by then. Rows with the same id are
    one document; those that may be are found by their ids alone, and only
    the keys of their sentences, not the texts, are shuffled to put the numbers right.
    """
    table = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    seen = table.observe(read, F.count("*").alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("nulls")) if read else table
    met = _lines(seen.filter("doc_id IS NOT NULL")).select("lang", "key", F.struct("doc_id", "place", "unit", "source").alias("first"), F.lit(1).alias("copies"), F.col("opens").cast("long").alias("documents"))
    again = _counted_again(table.filter("doc_id IS NOT NULL"))
    found = met.unionByName(again, allowMissingColumns=True).groupBy("key", "lang").agg(F.min("first").alias("first"), F.sum("copies").alias("copies"), F.sum("documents").alias("documents"))
    unit = F.col("first.unit")
    return found.select("lang", "first.doc_id", "first.place", "first.unit", "first.source", "copies", "documents", is_science_unit(unit).alias("science"), is_informative(unit).alias("informative"), F.sha2(unit, 256).alias("sha256"))


def run(spark: SparkSession, documents: str, output: str, langs: str | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> dict:
    """Writes the units of `documents` and their report, and returns what was read and written."""
    read, written = Observation(), Observation()
    docs = spark.read.parquet(documents)
    names = [x.strip() for x in langs.split(",")] if langs is not None else None
    if names is not None:
        docs = docs.filter(F.coalesce(F.col(lang), F.lit("null")).isin(names))
    units = units_of(docs, doc_id, text, lang, source, read).observe(written, F.count("*").alias("units"), F.coalesce(F.sum("copies"), F.lit(0)).alias("sentences"))
    schema = units.schema
    mode = "static" if names is None else "dynamic"
    with shuffles_removed(spark):
        units.write.mode("overwrite").option("partitionOverwriteMode", mode).option("compression", "zstd").partitionBy("lang").parquet(f"{output}/units")
        done = {"rows_read": read.get["rows"], "rows_without_id": read.get["nulls"], "sentences": written.get["sentences"], "units_written": written.get["units"]}
        log.info("read %d rows of %s, %d without id; wrote %d units of %d sentences to %s/units", done["rows_read"], documents, done["rows_without_id"], done["units_written"], done["sentences"], output)
        store = spark.read.schema(schema).parquet(f"{output}/units")
        report = store.groupBy("lang", "source").agg(F.count("*").alias("units"), F.sum("copies").alias("sentences"), F.count_if("science").alias("science"), F.count_if("informative").alias("informative"))
        report.coalesce(1).sortWithinPartitions("lang", "source").write.mode("overwrite").option("ignoreNullFields", "false").json(f"{output}/report")
    log.info("wrote the report of all languages to %s/report", output)
    return done


if __name__ == "__main__":
    from jobs.command import main

    main(run, "jobs.units", OPTIONS)
