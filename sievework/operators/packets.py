"""Packets of cards: for each question, its ranked papers with a quick line, a summary and direct evidence, and their registry.

Inputs:

    questions   query_id, question, family
    ranking     query_id, core_id, rank (from 1, without gaps)
    pool        query_id, core_id, title, journal, year, scientific_evidence: the public candidates, one row each
    records     core_id, record_id, kind, evidence_group, title, routing, text, value: the evidence of the papers that have some

Texts are cleaned and cut once, into tables, and questions choose among their
units. Everything that ranks is a
window over a question's papers or a paper's records, so nothing grows with the
number of packets but the number of groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.cleaning import CORE_ID, EVIDENCE_ID, is_direct_record
from sievework.operators.evidence import PAPERS, best_units, card_budget, diverse, record_score, tokenised, trimmed, with_units, words
from sievework.operators.prefix import numbered
from sievework.sources.work import table

# Lengths of a quick line and an excerpt, the least excerpt of a record, and the line of a paper without one.
QUICK_CHARS, RECORD_CHARS, LEAST_CHARS, LEAST_WORDS = 210, 330, 55, 7
NO_QUICK = "No reliable query-specific statement was extracted from the available public text."
# What a packet's text says around its content.
HEAD = "# Scientific background for one perovskite question"
LAST = "Answer directly as a perovskite expert. Do not discuss literature retrieval or data processing."
BEFORE = (
    "## How to use this background",
    "Treat the material below as background knowledge, not as a document-reading task.",
    "Use whatever is scientifically helpful and ignore material that is not relevant to the question.",
    "Preserve useful experimental conditions and numerical values, while separating reported observations from inference.",
    "Answer from the science itself rather than discussing how this background was collected or organized.",
)
# What no packet's text may show.
PRIVATE = ("expected_core_ids", "reference_expected_answer", "gold_answer")
INTERNAL = r"(?i)\[P\d{2}(?:-[ES]\d*)?\]|CORE_\d+|\b(?:block_id|result_block_id|question_answered|core_finding|training_value|asset_value):"


def ranked_papers(questions: DataFrame, ranking: DataFrame, pool: DataFrame, papers: int = PAPERS) -> DataFrame:
    """Each question's first `papers` papers with their public candidate, its label and the question's words.

    A question without exactly the ranks 1 to `papers`, or with a paper twice, and
    a ranked paper that isn't in its pool, once, raise an error when they are read.
    """
    top = ranking.filter(F.col("rank").between(1, papers)).select("query_id", "core_id", F.col("rank").cast("int").alias("rank"))
    counts = top.groupBy("query_id").agg(F.count_distinct("rank").alias("__r"), F.count_distinct("core_id").alias("__c"), F.count("*").alias("__n"))
    whole = questions.join(counts, "query_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    full = (n("__r") == papers) & (n("__c") == papers) & (n("__n") == papers)
    asked = whole.filter(F.assert_true(full, F.concat(F.col("query_id").cast("string"), F.lit(f": not {papers} ranked papers"))).isNull()).select("query_id", "question", F.coalesce("family", F.lit("")).alias("family"), words(F.coalesce("question", F.lit(""))).alias("query_words"))
    public = pool.groupBy("query_id", "core_id").agg(F.count("*").alias("__k"), F.first(F.struct("title", "journal", "year", "scientific_evidence")).alias("p"))
    met = top.join(asked, "query_id").join(public, ["query_id", "core_id"], "left")
    known = F.concat(F.col("query_id").cast("string"), F.lit(": a ranked paper isn't in the pool once: "), F.col("core_id").cast("string"))
    title = F.coalesce(F.nullif(F.trim("p.title"), F.lit("")), F.lit("Untitled paper"))
    return met.filter(F.assert_true(F.coalesce(F.col("__k"), F.lit(0)) == 1, known).isNull()).select(
        "query_id", "core_id", "rank", "question", "family", "query_words", F.format_string("P%02d", "rank").alias("paper_label"), title.alias("title"), F.trim(F.coalesce("p.journal", F.lit(""))).alias("journal"), F.col("p.year").alias("year"),
        F.coalesce("p.scientific_evidence", F.lit("")).alias("scientific_evidence"),
    )


def paper_units(papers: DataFrame) -> DataFrame:
    """(core_id, title, text_hash, units): each different public text of a paper, cut once, however many questions ask it."""
    texts = papers.select("core_id", "title", "scientific_evidence").distinct()
    cut = with_units(texts.withColumn("text_hash", F.sha2("scientific_evidence", 256)), "scientific_evidence", "title")
    return table(cut.select("core_id", "title", "text_hash", "__clean", "__units"), "paper-units")


def record_units(papers: DataFrame, records: DataFrame) -> DataFrame:
    """The direct records of ranked papers, cut once for each title that a paper has, with the words that questions are compared with."""
    direct = records.filter(is_direct_record(F.col("kind"), F.col("evidence_group"), F.col("record_id").cast("string"), F.col("text")))
    told = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("evidence_group", F.lit("")), F.coalesce("routing", F.lit("{}")), F.coalesce("text", F.lit("")))
    own = direct.select("core_id", "record_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"), F.array_distinct(words(told)).alias("told"))
    cut = with_units(own.join(papers.select("core_id", F.col("title").alias("paper")).distinct(), "core_id"), "text", "paper")
    return table(cut.drop("text"), "record-units")


def record_evidence(papers: DataFrame, records: DataFrame) -> DataFrame:
    """(query_id, core_id, record_id, place, text): each paper's direct records for its question, best first, none alike.

    Only records that share two words with the question are cut into excerpts,
    and only excerpts of 55 characters and seven words are evidence.
    """
    asked = papers.select("query_id", "core_id", "rank", "query_words", "family", F.col("title").alias("paper"))
    met = record_units(papers, records).join(asked, ["core_id", "paper"]).withColumn("score", F.round(record_score(F.col("told"), F.col("query_words"), F.col("family"), F.col("value")), 9)).filter("score is not null")
    cut = met.withColumn("__chosen", best_units("query_words", 1)).select("query_id", "core_id", "rank", "record_id", "score", trimmed(F.col("__chosen"), RECORD_CHARS).alias("excerpt"))
    # No filter, which would be moved below and make each excerpt again for each of its conditions.
    fits = (F.length("excerpt") >= LEAST_CHARS) & (F.size(words(F.col("excerpt"))) >= LEAST_WORDS)
    order = F.when(fits, F.struct((-F.col("score")).alias("s"), "record_id", "excerpt"))
    per = cut.groupBy("query_id", "core_id", "rank").agg(F.array_sort(F.collect_list(order)).alias("ranked"))
    # The greedy choice is over texts; the first record of a text is the one that was taken.
    texts = per.withColumn("__t", tokenised(F.transform("ranked", lambda x: x["excerpt"])))
    kept = texts.withColumn("kept", diverse(F.col("__t"), card_budget(F.col("rank"))["records"]))
    found = kept.select("query_id", "core_id", "ranked", F.posexplode("kept").alias("__i", "text"))
    record = F.element_at(F.filter("ranked", lambda x: x["excerpt"] == F.col("text")), 1)["record_id"]
    return found.select("query_id", "core_id", record.alias("record_id"), (F.col("__i") + 1).alias("place"), "text")


def cards(papers: DataFrame, evidence: DataFrame, records: DataFrame) -> DataFrame:
    """One row for each ranked paper: its quick line, whether it has records, its summary, and its evidence in order."""
    there = records.select("core_id").distinct().withColumn("__has", F.lit(True))
    met = papers.withColumn("text_hash", F.sha2("scientific_evidence", 256)).drop("scientific_evidence").join(paper_units(papers), ["core_id", "title", "text_hash"]).join(there, "core_id", "left")
    profile = card_budget(F.col("rank"))
    quick, summary = met.withColumn("__quick", best_units("query_words", 1)).withColumn("__summary", F.when(F.col("__has"), best_units("query_words", profile["sentences"]))), F.lit("")
    for chars in (720, 520, 320):  # what card_budget() gives
        summary = F.when(profile["chars"] == chars, trimmed(F.col("__summary"), chars)).otherwise(summary)
    whole = quick.withColumn("quick", trimmed(F.col("__quick"), QUICK_CHARS)).withColumn("summary", F.coalesce(summary, F.lit("")))
    items = evidence.groupBy("query_id", "core_id").agg(F.array_sort(F.collect_list(F.struct("place", "record_id", "text"))).alias("evidence"))
    out = whole.join(items, ["query_id", "core_id"], "left")
    return out.select(
        "query_id", "rank", "core_id", "paper_label", "title", "journal", "year", F.when(F.col("__has"), "science_rag_core").otherwise("abstract_or_facet_only").alias("evidence_level"),
        F.coalesce(F.nullif("quick", F.lit("")), F.lit(NO_QUICK)).alias("quick_map_text"), "summary", F.coalesce("evidence", F.array().cast(items.schema["evidence"].dataType)).alias("evidence"),
    )


def registry(made: DataFrame) -> DataFrame:
    """(number, query_id, rank, evidence_label, core_id, record_id, text): all items that packets show, numbered over all packets.

    The number follows question, rank, and label's place (the summary first), by
    running sums over ranges, so no task sees all items; it is the same for the
    same packets, however they were partitioned.
    """
    label = lambda i: F.concat(F.col("paper_label"), F.lit("-E"), i["place"].cast("string"))
    none = F.lit(None).cast(made.schema["evidence"].dataType.elementType["record_id"].dataType)
    summary = F.when(F.col("summary") != "", F.array(F.struct(F.lit(0).alias("place"), F.concat("paper_label", F.lit("-S")).alias("evidence_label"), none.alias("record_id"), F.col("summary").alias("text"))))
    each = F.transform("evidence", lambda i: F.struct(i["place"].alias("place"), label(i).alias("evidence_label"), i["record_id"].alias("record_id"), i["text"].alias("text")))
    items = made.select("query_id", "rank", "core_id", F.explode(F.concat(F.coalesce(summary, F.array().cast(each_type(made))), each)).alias("x")).select("query_id", "rank", "core_id", "x.*")
    return numbered(table(items, "registry-items"), ["query_id", "rank", "place"], "number").drop("place")


def each_type(made: DataFrame) -> str:
    record = made.schema["evidence"].dataType.elementType["record_id"].dataType.simpleString()
    return f"array<struct<place:int,evidence_label:string,record_id:{record},text:string>>"


def packet_texts(made: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, cards, packet, n_chars, tokens_estimate): each question's text, without identifiers.

    A text that still shows a private or internal name raises an error when it is read.
    """
    citation = F.concat_ws(", ", F.nullif("journal", F.lit("")), F.nullif(F.col("year").cast("string"), F.lit("")))
    suffix = F.when(citation != "", F.concat(F.lit(" ("), citation, F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- "), "title", suffix, F.lit(". "), "quick_map_text")
    told = F.concat(F.transform("evidence", lambda x: F.concat(F.lit("- Direct experimental evidence: "), x["text"])), F.when(F.col("summary") != "", F.array(F.concat(F.lit("- Scientific context: "), "summary"))).otherwise(F.array().cast("array<string>")))
    detail = F.when(F.size(told) > 0, F.array_join(F.concat(F.array(F.concat(F.lit("### "), "title")), told), "\n"))
    per = made.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), detail.alias("detail")))).alias("x"))
    met = per.join(questions.select("query_id", F.coalesce("question", F.lit("")).alias("question")), "query_id")
    lines = F.array_join(F.transform("x", lambda c: c["line"]), "\n")
    details = F.array_join(F.array_compact(F.transform("x", lambda c: c["detail"])), "\n\n")
    text = F.concat_ws(
        "\n", F.lit(HEAD), F.lit(""), F.lit("## Question"), "question", F.lit(""), *[F.lit(b) for b in BEFORE], F.lit(""), F.lit("## Research landscape"), lines, F.lit(""),
        F.lit("## Detailed scientific background"), details, F.lit(""), F.lit("## Question to answer now"), "question", F.lit(""), F.lit(LAST), F.lit(""),
    )
    clean = F.regexp_replace(F.regexp_replace(text, CORE_ID, "the focal paper"), EVIDENCE_ID, "")
    shown = F.col("packet").rlike(INTERNAL)
    for name in PRIVATE:
        shown = shown | F.contains("packet", F.lit(name))
    fault = F.raise_error(F.concat(F.col("query_id").cast("string"), F.lit(": a private or internal name in a packet"))).cast("string")
    sound = met.select("query_id", F.size("x").alias("cards"), clean.alias("packet")).withColumn("packet", F.when(shown, fault).otherwise(F.col("packet")))
    return sound.withColumn("n_chars", F.length("packet")).withColumn("tokens_estimate", F.ceil(F.col("n_chars") / 4))


def built(questions: DataFrame, ranking: DataFrame, pool: DataFrame, records: DataFrame, papers: int = PAPERS) -> dict[str, DataFrame]:
    """The cards, the registry, the map from each question's papers to its registry numbers, and the packets' texts.

    Cross-references are resolved by one join: the map names the first and last
    number of each paper's items, null for a paper without any.
    """
    top = table(ranked_papers(questions, ranking, pool, papers), "packet-papers")
    made = table(cards(top, record_evidence(top, records), records), "packet-cards")
    items = table(registry(made), "packet-registry")
    spans = items.groupBy("query_id", "rank").agg(F.min("number").alias("first"), F.max("number").alias("last"))
    quick_map = made.select("query_id", "rank", "core_id", "paper_label", "evidence_level", "quick_map_text").join(spans, ["query_id", "rank"], "left")
    return {"cards": made, "registry": items, "map": quick_map, "packets": packet_texts(made, questions)}
