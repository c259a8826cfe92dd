"""Evidence packets: budgets, excerpts, selection without repeats, assembly and checks."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.cleaning import EVIDENCE_STOPWORDS, clean_natural_text, clean_science_text, is_informative, is_science_unit, leaks_identifier, squeezed
from sievework.functions.sentences import ensured_sentence, list_lines, sentence_units, sentences, split_units, trimmed_at_boundary
from sievework.functions.similarity import jaccard
from sievework.functions.tokens import all_of, bm25_tokens, evidence_tokens
from sievework.operators.retrieval import ranked
from sievework.sources.work import table

# Words of each task family.
FAMILY_WORDS = {
    "mechanism_diagnostic": [
        "mechanism", "diagnostic", "spectroscopy", "carrier", "defect", "migration", "interface", "recombination", "control", "kinetic", "field",
        "hysteresis", "degradation", "photoluminescence",
    ],
    "stability_design_transfer": [
        "stability", "degradation", "lifetime", "humidity", "thermal", "illumination", "interface", "encapsulation", "migration", "control",
        "fabrication", "transfer", "failure", "design",
    ],
    "stability_failure": [
        "stability", "failure", "degradation", "negative", "limitation", "humidity", "thermal", "illumination", "migration", "interface", "control",
        "lifetime", "hysteresis",
    ],
    "design_transfer_synthesis": [
        "design", "fabrication", "process", "transfer", "composition", "interface", "stack", "performance", "efficiency", "stability", "condition",
        "control", "scalable", "mechanical", "temperature",
    ],
}
# What a card's type adds to its score, by family; 1 for any other.
TYPE_BOOST = {
    "mechanism_diagnostic": {"article_master_pack": 3.5, "mechanism_pack": 7.0, "stability_pack": 3.0, "device_performance_pack": 2.5, "fabrication_protocol_pack": 1.0, "lineage_pack": 0.5},
    "stability_design_transfer": {"article_master_pack": 3.5, "stability_pack": 7.0, "mechanism_pack": 4.0, "fabrication_protocol_pack": 3.5, "device_performance_pack": 3.0, "lineage_pack": 0.5},
    "stability_failure": {"article_master_pack": 3.5, "stability_pack": 7.0, "mechanism_pack": 5.0, "device_performance_pack": 2.5, "fabrication_protocol_pack": 2.0, "lineage_pack": 0.5},
    "design_transfer_synthesis": {"article_master_pack": 3.5, "fabrication_protocol_pack": 7.0, "device_performance_pack": 5.5, "mechanism_pack": 4.0, "stability_pack": 3.5, "lineage_pack": 1.0},
}
# Patterns that raise or lower a unit's score.
CONDITION = r"(?i)\b(?:under|after|before|compared|versus|control|condition|temperature|humidity|illumination|bias|cycle|lifetime|failure|negative|limitation)\b"
EXCERPT_CONDITION = r"(?i)\b(condition|control|compared|under|after|before|versus|vs\.?|while)\b"
METADATA = r"(?i)\b(?:subject|type|content|condition|value|metric mentions|source location):"
NUMBER = r"(?<![A-Za-z])[-+~≈<>≤≥]?\d+(?:\.\d+)?(?:\s*[×x]\s*10(?:\^)?[-+]?\d+)?"
#: Papers of a packet.
PAPERS = 40


def budget(rank: Column) -> Column:
    """Characters, topic packs, units and supplements by rank."""
    profile = lambda c, p, u, s: F.struct(F.lit(c).alias("chars"), F.lit(p).alias("packs"), F.lit(u).alias("units"), F.lit(s).alias("supplements"))
    return F.when(rank <= 8, profile(1900, 3, 8, 2)).when(rank <= 20, profile(1300, 2, 6, 1)).otherwise(profile(800, 2, 4, 1))


def card_budget(rank: Column) -> Column:
    """Evidence records, sentences and characters by rank, for the short card form."""
    profile = lambda r, s, c: F.struct(F.lit(r).alias("records"), F.lit(s).alias("sentences"), F.lit(c).alias("chars"))
    return F.when(rank <= 8, profile(3, 3, 720)).when(rank <= 20, profile(2, 2, 520)).otherwise(profile(1, 1, 320))


def words(text: Column) -> Column:
    return evidence_tokens(text, EVIDENCE_STOPWORDS)


def family_words(family: Column) -> Column:
    table = F.create_map(*[x for k, v in FAMILY_WORDS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    return F.coalesce(table[family], F.array().cast("array<string>"))


def overlap_score(shared: Column, query: Column, each: float, whole: float) -> Column:
    return shared * each + whole * shared / F.greatest(F.lit(1), F.size(query))


def unit_score(text: Column, query: Column, family: Column, embedded: Column) -> Column:
    own = words(text)
    shared = F.size(F.array_intersect(query, own))
    bonus = F.when(text.rlike(NUMBER), 1.0).otherwise(0.0) + F.when(text.rlike(CONDITION), 0.8).otherwise(0.0) + F.when(embedded, 0.35).otherwise(0.0)
    return overlap_score(shared, query, 2.2, 10.0) + 0.45 * F.size(F.array_intersect(family_words(family), own)) + bonus + F.least(F.length(text), F.lit(300)) / 750.0


def pack_score(own: Column, query: Column, family: Column, card_type: Column) -> Column:
    """A pack's score from its words."""
    boosts = F.create_map(*[x for f, t in TYPE_BOOST.items() for k, v in t.items() for x in (F.lit(f"{f}/{k}"), F.lit(v))])
    return overlap_score(F.size(F.array_intersect(query, own)), query, 2.3, 10.0) + 0.35 * F.size(F.array_intersect(family_words(family), own)) + F.coalesce(boosts[F.concat_ws("/", family, card_type)], F.lit(1.0))


def record_score(own: Column, query: Column, family: Column, value: Column) -> Column:
    """A record's rank among a paper's, from its words; null where it shares fewer than two with the question."""
    shared = F.size(F.array_intersect(query, own))
    score = overlap_score(shared, query, 2.2, 10.0) + 0.55 * F.size(F.array_intersect(family_words(family), own)) + F.log1p(F.greatest(F.lit(0.0), value)) / 2.5 + 2.0
    return F.when(shared >= 2, score)


def ranked_records(records: DataFrame, questions: DataFrame, record: str, question: str, top: int, text: str = "text", value: str = "value") -> DataFrame:
    """(question, record, score, rank) of the `top` records of each question by record_score().

    `questions` has the question's distinct words `query_words` and its family.
    A record meets a question through the words that they share, which are
    counted; only those with two or more are scored, from numbers that are
    computed once a record. Words that no question asks for, or no record has,
    don't leave their table. Ids are distinct.
    """
    asked = questions.select(question, "family", F.size("query_words").alias("__asked"), F.explode("query_words").alias("__word"))
    own = table(records.select(record, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("__value"), F.array_distinct(words(F.coalesce(F.col(text), F.lit("")))).alias("__words")), "record-words")
    wanted = asked.select("__word").distinct()
    postings = own.select(record, F.explode("__words").alias("__word")).join(wanted, "__word", "left_semi")
    shared = postings.join(asked, "__word").groupBy(question, record, "family", "__asked").agg(F.count("*").alias("__shared")).filter("__shared >= 2")
    families = [f.alias(f"__{i}") for i, f in enumerate(F.size(F.array_intersect(F.array(*[F.lit(w) for w in ws]), F.col("__words"))) for ws in FAMILY_WORDS.values())]
    numbers = own.select(record, "__value", *families)
    mine = F.lit(0)
    for i, name in enumerate(FAMILY_WORDS):
        mine = F.when(F.col("family") == name, F.col(f"__{i}")).otherwise(mine)
    each = F.col("__shared") * 2.2 + 10.0 * F.col("__shared") / F.greatest(F.lit(1), F.col("__asked"))
    score = each + 0.55 * mine + F.log1p(F.greatest(F.lit(0.0), F.col("__value"))) / 2.5 + 2.0
    scored = shared.join(numbers, record).select(question, record, F.round(score, 6).alias("score"))
    return ranked(scored, [question], [F.desc("score"), F.asc(record)], top)


def with_units(rows: DataFrame, text: str, title: str | None = None) -> DataFrame:
    """`rows` with the clean text `__clean` and its science units `__units` with their words; `title` names a column with the paper's, which goes.

    What costs most of an excerpt: where many questions ask one text, store this first.
    """
    clean = rows.withColumn("__clean", clean_science_text(F.col(text), F.col(title) if title else None))
    return clean.withColumn("__units", F.transform(F.filter(sentence_units(F.col("__clean")), is_science_unit), lambda u, i: F.struct(i.alias("i"), u.alias("u"), words(u).alias("w"))))


def best_units(query_words: str, n: Column | int) -> Column:
    """The n best of `__units` in their own order, as one text; without units the clean text, if it is science."""

    def scored(x: Column) -> Column:
        u = x["u"]
        shared = F.size(F.array_intersect(query_words, x["w"]))
        bonus = F.when(u.rlike(r"\d"), 0.8).otherwise(0.0) + F.when(u.rlike(EXCERPT_CONDITION), 0.6).otherwise(0.0)
        labels = F.size(all_of(u, METADATA))
        return F.struct((-(overlap_score(shared, F.col(query_words), 2.0, 8.0) + bonus + F.least(F.length(u), F.lit(260)) / 520.0 - 1.2 * labels)).alias("s"), x["i"].alias("i"), u.alias("u"))

    best = F.slice(F.array_sort(F.transform("__units", scored)), F.lit(1), n if isinstance(n, Column) else F.lit(n))
    chosen = F.array_join(F.transform(F.array_sort(F.transform(best, lambda x: F.struct(x["i"], x["u"]))), lambda x: x["u"]), " ")
    alone = F.when((F.length("__clean") >= 20) & is_science_unit(F.col("__clean")), F.col("__clean")).otherwise("")
    return F.when(F.size("__units") > 0, chosen).otherwise(alone)


def trimmed(text: Column, most: int) -> Column:
    return F.when(text == "", "").otherwise(trimmed_at_boundary(text, most))


def with_excerpt(rows: DataFrame, text: str, query_words: str, most: int, n: int, name: str = "excerpt") -> DataFrame:
    """`rows` with the n best science sentences of a text in their own order, trimmed."""
    chosen = with_units(rows, text).withColumn("__chosen", best_units(query_words, n))
    return chosen.withColumn(name, trimmed(F.col("__chosen"), most)).drop("__clean", "__units", "__chosen")


def tokenised(texts: Column) -> Column:
    """Texts with their words, for diverse() and distinct_units()."""
    return F.transform(texts, lambda x: F.struct(x.alias("text"), F.lower(squeezed(x, " ")).alias("plain"), words(x).alias("w")))


def _greedy(ranked: Column, n: int, alike: Callable[[Column, Column], Column]) -> Column:
    none = F.slice(ranked, 1, 0)
    kept = F.aggregate(ranked, none, lambda acc, x: F.when((F.size(acc) >= n) | F.exists(acc, lambda y: alike(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return F.transform(kept, lambda x: x["text"])


def diverse(ranked: Column, n: int, threshold: float = 0.72) -> Column:
    """The first n of an array from tokenised() of which none shares `threshold` of its words with one taken before."""
    return _greedy(ranked, n, lambda x, y: jaccard(x["w"], y["w"]) >= threshold)


def distinct_units(ranked: Column, n: int, threshold: float = 0.68) -> Column:
    """As diverse(); equal texts and ones that contain the other, both of 90 characters, are alike too."""

    def alike(x: Column, y: Column) -> Column:
        a, b = x["plain"], y["plain"]
        within = (F.least(F.length(a), F.length(b)) >= 90) & (F.contains(a, b) | F.contains(b, a))
        return (a == b) | within | (jaccard(x["w"], y["w"]) >= threshold)

    return _greedy(ranked, n, alike)


def compiled(ranking: DataFrame, docs: DataFrame, questions: DataFrame, question: str, doc: str, papers: int = PAPERS) -> DataFrame:
    """(question, evidence_id, doc, rank, text): whole sentences of ranked documents within their budgets.

    `ranking` has (question, doc, rank). Each ranked document is split and
    tokenised once, into a table of its sentences. Only overlaps, places, lengths
    and digests of a question's sentences, of at most `papers` documents, go into
    its group, where they are taken in order of rank, overlap and place, never
    one twice; the texts join what was taken. Sentences are put back in their own
    order. Documents of which nothing fits have no id.
    """
    asked = questions.select(question, F.array_distinct(bm25_tokens(F.col("text"))).alias("__q"))
    wanted = table(ranking.filter(F.col("rank") <= papers), "ranking")
    split = docs.join(wanted.select(doc).distinct(), doc, "left_semi").select(doc, F.posexplode(sentences(F.col("text"))).alias("place", "sentence"))
    key = F.md5(F.regexp_replace(F.lower("sentence"), r"(?U)\s+", " ").cast("binary"))
    cut = table(split.select(doc, "place", "sentence", F.array_distinct(bm25_tokens(F.col("sentence"))).alias("words"), key.alias("key"), F.length("sentence").alias("n")), "sentences")
    met = wanted.select(question, doc, "rank", budget(F.col("rank"))["chars"].alias("chars")).join(cut.drop("sentence"), doc).join(asked, question)
    scored = met.select(question, doc, "rank", "chars", "place", "key", "n", F.size(F.array_intersect("__q", "words")).alias("overlap"))
    schema = T.StructType([ranking.schema[question], T.StructField("evidence_id", T.StringType()), ranking.schema[doc], T.StructField("rank", T.IntegerType()), T.StructField("place", T.IntegerType())])

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        seen: set[str] = set()
        out = []
        papers_used = 0
        ordered = rows.sort_values(["rank", "overlap", "place"], ascending=[True, False, True])
        each = zip(*(ordered[c].tolist() for c in ("rank", "chars", doc, "place", "n", "key")), strict=True)
        for rank, part in groupby(each, key=lambda r: r[0]):
            room, fresh, paper = None, [], None
            for _, chars, paper, place, n, key in part:
                room = int(chars) if room is None else room
                if key not in seen and n + 1 <= room:
                    room -= n + 1
                    fresh.append(place)
                    seen.add(key)
            if fresh:
                papers_used += 1
                out += [(rows[question].iloc[0], f"E{papers_used:03d}", paper, int(rank), place) for place in fresh]
        return pd.DataFrame(out, columns=schema.fieldNames())

    taken = scored.groupBy(question).applyInPandas(choose, schema).join(cut.select(doc, "place", "sentence"), [doc, "place"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "sentence"))), lambda x: x["sentence"]), " ")
    return taken.groupBy(question, "evidence_id", doc, "rank").agg(text.alias("text"))


def topic_packs(packs: DataFrame, query: str, core: str, card: str, own: str | None = None) -> DataFrame:
    """The packs of each (query, core) that are used: the master first, then by score, as many as the rank allows.

    `packs` has rank, card_type, family, embedding_text and query words `query_words`. Lineage packs are left out of the known families.
    With `own`, a column of the pack's words() stands for its text; it and `query_words` go, so that only numbers are sorted.
    """
    mine = F.col(own) if own else words(F.coalesce("embedding_text", F.lit("")))
    score = F.round(pack_score(mine, F.col("query_words"), F.col("family"), F.col("card_type")), 9)
    kept = packs.filter(~((F.col("card_type") == "lineage_pack") & F.col("family").isin(*FAMILY_WORDS))).withColumn("pack_score", score)
    kept = kept.drop(own, "query_words") if own else kept
    master = F.when(F.col("card_type") == "article_master_pack", 0).otherwise(1)
    first = F.row_number().over(Window.partitionBy(query, core, "__m").orderBy(F.desc("pack_score"), F.asc(card)))
    one = kept.withColumn("__m", master).withColumn("__f", first).withColumn("__m", F.when((F.col("__m") == 0) & (F.col("__f") == 1), 0).otherwise(1))
    place = F.row_number().over(Window.partitionBy(query, core).orderBy("__m", F.desc("pack_score"), F.asc(card)))
    return one.withColumn("pack_place", place).filter(F.col("pack_place") <= budget(F.col("rank"))["packs"]).drop("__m", "__f")


def paper_units(packs: DataFrame, query: str, core: str, card: str) -> DataFrame:
    """Candidate sentences of the chosen packs, from the embedded text and, under stricter tests, the retrieval text."""
    fields = F.array(F.struct(F.lit(True).alias("embedded"), F.col("embedding_text").alias("text")), F.struct(F.lit(False).alias("embedded"), F.col("retrieval_text").alias("text")))
    each = packs.withColumn("__x", F.explode(fields)).select(query, core, card, "rank", "family", "query_words", "pack_place", "__x.embedded", F.posexplode(split_units(clean_natural_text(list_lines(F.coalesce("__x.text", F.lit("")))))).alias("place", "unit"))
    u = ensured_sentence(F.col("unit"))
    each = each.withColumn("unit", u).filter(is_informative(F.col("unit")))
    u = F.col("unit")
    strict = (u.rlike(NUMBER) | u.rlike(CONDITION)) & (F.size(F.array_intersect("query_words", words(u))) >= 1) & (F.length(u) <= 520) & (F.size(F.split(u, ":")) - 1 <= 2) & u.rlike(r"^\p{Lu}")
    return each.filter(F.col("embedded") | strict).withColumn("score", F.round(unit_score(u, F.col("query_words"), F.col("family"), F.col("embedded")), 9)).drop("query_words")


def _alike(a: str, others: list[str], tokens: dict[str, frozenset]) -> bool:
    x = " ".join(a.split()).lower()
    for b in others:
        y = " ".join(b.split()).lower()
        shared = len(tokens[a] & tokens[b])
        if x == y or (min(len(x), len(y)) >= 90 and (x in y or y in x)) or shared >= 0.68 * max(1, len(tokens[a] | tokens[b])):
            return True
    return False


def deep_papers(units: DataFrame, query: str, core: str, card: str) -> DataFrame:
    """(query, core, text, cards): each paper's packet from paper_units().

    One unit of each pack, then the best up to the rank's number, then its
    supplements, none alike to one before; in the order of packs and places,
    what fits the characters. If nothing fits, the first is kept whole. A
    paper's units are a bounded list.
    """
    profile = budget(F.col("rank"))
    rows = units.select("*", profile["chars"].alias("chars"), profile["units"].alias("most"), profile["supplements"].alias("more"), words(F.col("unit")).alias("tokens"))
    schema = T.StructType([units.schema[query], units.schema[core], T.StructField("text", T.StringType()), T.StructField("cards", T.ArrayType(units.schema[card].dataType)), T.StructField("n_units", T.IntegerType())])

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        ordered = part.sort_values(["score", "place", "pack_place"], ascending=[False, True, True]).to_dict("records")
        tokens = {r["unit"]: frozenset(r["tokens"]) for r in ordered}
        taken: list[dict] = []

        def take(rows: list[dict], most: int) -> None:
            n = 0
            for r in rows:
                if n >= most:
                    return
                if not _alike(r["unit"], [t["unit"] for t in taken], tokens):
                    taken.append(r)
                    n += 1

        embedded = [r for r in ordered if r["embedded"]]
        for pack in sorted({r["pack_place"] for r in ordered}):
            take([r for r in embedded if r["pack_place"] == pack], 1)
        take(embedded, max(0, int(part["most"].iloc[0]) - len(taken)))
        take([r for r in ordered if not r["embedded"]], int(part["more"].iloc[0]))
        taken.sort(key=lambda r: (r["pack_place"], not r["embedded"], r["place"]))
        chars, used, out = int(part["chars"].iloc[0]), 0, []
        for r in taken:
            size = len(r["unit"]) + bool(out)
            if used + size <= chars:
                out.append(r)
                used += size
        out = out or taken[:1]
        return pd.DataFrame([(part[query].iloc[0], part[core].iloc[0], " ".join(r["unit"] for r in out), list(dict.fromkeys(r[card] for r in out)), len(out))], columns=schema.fieldNames())

    return rows.groupBy(query, core).applyInPandas(choose, schema)


def with_abstract(rows: DataFrame, text: str, query_words: str, most: int = 900, name: str = "abstract") -> DataFrame:
    """`rows` with an abstract: whole if it is short, else its first unit and the best others, in order, within `most`."""
    stepped = rows.withColumn("__clean", clean_natural_text(F.col(text))).withColumn("__units", F.filter(F.transform(split_units(F.col("__clean")), ensured_sentence), lambda u: F.length(u) >= 30))
    ranked = F.array_sort(F.transform("__units", lambda u, i: F.struct((-unit_score(u, F.col(query_words), F.lit(""), F.lit(True))).alias("s"), i.alias("i"), F.length(u).alias("n"))))
    first = F.struct(F.array(F.lit(0)).alias("kept"), F.length(F.get("__units", F.lit(0))).alias("n"))

    def grow(acc: Column, x: Column) -> Column:
        full = ((F.size(acc["kept"]) > 1) & (acc["n"] >= most * 0.78)) | (F.size(acc["kept"]) >= 5) | F.array_contains(acc["kept"], x["i"])
        return F.struct(F.when(full, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x["i"]))).alias("kept"), F.when(full, acc["n"]).otherwise(acc["n"] + 1 + x["n"]).alias("n"))

    grown = stepped.withColumn("__kept", F.array_sort(F.aggregate(ranked, first, grow, lambda acc: acc["kept"])))
    add = lambda acc, i: F.when(F.length(acc) + F.length(F.get("__units", i)) + 1 <= most, F.trim(F.concat_ws(" ", acc, F.get("__units", i)))).otherwise(acc)
    fitted = F.aggregate("__kept", F.lit(""), add)
    whole = (F.length("__clean") <= most) | (F.size("__units") == 0)
    return grown.withColumn(name, F.when(F.col("__clean") == "", "").when(whole, ensured_sentence(F.col("__clean"))).otherwise(fitted)).drop("__clean", "__units", "__kept")


def source_tier(ranking: DataFrame, deep: DataFrame, abstract: DataFrame, keys: list[str], core: str) -> DataFrame:
    """Which source each ranked paper has: its own packs, an abstract, or only its title."""
    a = deep.select(core).distinct().withColumn("__deep", F.lit(True))
    b = abstract.select(core).distinct().withColumn("__abstract", F.lit(True))
    met = ranking.join(a, core, "left").join(b, core, "left")
    return met.select(*keys, F.when(F.col("__deep"), "science_core").when(F.col("__abstract"), "frozen_abstract").otherwise("bibliographic_only").alias("tier"))


def heading(title: Column, journal: Column, year: Column) -> Column:
    details = F.concat_ws(", ", F.nullif(F.trim(journal), F.lit("")), F.nullif(F.trim(year.cast("string")), F.lit("")))
    return F.concat(F.lit("### "), F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("Untitled study")), F.when(details != "", F.concat(F.lit(" ("), details, F.lit(")"))).otherwise(""))


def packet_texts(blocks: DataFrame, questions: DataFrame, question: str, most: int = 70_000) -> DataFrame:
    """One text per question: the question, its evidence blocks in order, and the question again; with counts.

    A packet over `most` characters raises an error when it is read.
    """
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("evidence_id", "text"))), lambda x: F.concat(F.lit("["), x["evidence_id"], F.lit("] "), x["text"])), "\n\n")
    body = blocks.groupBy(question).agg(ordered.alias("body"), F.count("*").alias("blocks"))
    text = F.concat(F.lit("## Question\n"), F.col("text"), F.lit("\n\n## Evidence\n"), F.col("body"), F.lit("\n\n## Question\n"), F.col("text"), F.lit("\n"))
    met = body.join(questions.select(question, "text"), question).select(question, "blocks", text.alias("packet"))
    sized = met.withColumn("n_chars", F.length("packet")).withColumn("tokens_estimate", F.ceil(F.col("n_chars") / 4))
    return sized.filter(F.assert_true(F.col("n_chars") <= most, F.lit("a packet is too long")).isNull())


def numbers_of(text: Column) -> Column:
    return F.array_distinct(F.transform(all_of(text, "(?U)" + NUMBER), lambda t: F.lower(F.regexp_replace(t, r"(?U)\s+", ""))))


def packet_checks(blocks: DataFrame, docs: DataFrame, doc: str) -> DataFrame:
    """Each block with whether its numbers are the source's, and whether it shows an internal identifier."""
    met = blocks.join(docs.select(doc, F.col("text").alias("source")), doc)
    lost = F.size(F.array_except(numbers_of(F.col("text")), numbers_of(F.col("source"))))
    return met.select(*[c for c in blocks.columns], (lost == 0).alias("numbers_kept"), leaks_identifier(F.col("text")).alias("leaks"))


def packet_report(packets: DataFrame, size: str) -> DataFrame:
    """One row: number, least, median, 90 and 95 % and greatest size, by nearest rank."""
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {size})")
    return packets.agg(F.count("*").alias("packets"), F.min(size).alias("least"), at(0.5).alias("median"), at(0.9).alias("p90"), at(0.95).alias("p95"), F.max(size).alias("greatest"))


def packet_quality(blocks: DataFrame, docs: DataFrame, question: str, doc: str, source: Column) -> DataFrame:
    """One row: PASS if no block shows an identifier or changes a number, and counts of what was found.

    `source` names what a block was made from; slots are counted by it. A
    sentence that a block has twice, but for case and white space, is a duplicate.
    """
    units = F.transform(split_units(F.col("text")), lambda u: F.lower(squeezed(u, " ")))
    checked = packet_checks(blocks.withColumn("__source", source), docs, doc).withColumn("__again", F.size(units) - F.size(F.array_distinct(units)))
    checked = table(checked.select(question, doc, "__source", "__again", "leaks", "numbers_kept"), "checked-blocks")
    slots = checked.groupBy("__source").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__source", "n")))).alias("source_slots"))
    counted = checked.agg(
        F.count_distinct(question).alias("queries"),
        F.count("*").alias("paper_slots"),
        F.count_distinct(doc).alias("unique_papers"),
        F.count_if("leaks").alias("identifier_leaks"),
        F.count_if(~F.col("numbers_kept")).alias("numeric_mismatches"),
        F.coalesce(F.sum("__again"), F.lit(0)).alias("duplicate_sentences"),
    )
    status = F.when((F.col("identifier_leaks") == 0) & (F.col("numeric_mismatches") == 0), "PASS").otherwise("FAIL")
    return counted.withColumn("status", status).withColumn("source_slots", F.coalesce(slots.select("source_slots").scalar(), F.create_map().cast("map<string,bigint>")))
