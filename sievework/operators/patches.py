"""Checking, gating, choosing and applying patches to answers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.sentences import sentence_key
from sievework.functions.tokens import all_of, compare_text, word_count

# The enumerations of candidates and reviews.
EFFECTS = ("CORRECTS_CAUSAL_ERROR", "FILLS_REQUIRED_CAUSAL_LINK", "LIMITS_OR_BOUNDS", "ADDS_REQUIRED_CONTROL", "ADDS_DECISION_THRESHOLD")
OPERATIONS = ("REPLACE_ANCHOR", "APPEND_AFTER_ANCHOR")
HARD_RISKS = ("MATERIAL_COMPOSITION_MISMATCH", "DEVICE_STACK_MISMATCH", "PROCESS_CONDITION_MISMATCH", "MEASUREMENT_REGIME_MISMATCH", "UNSUPPORTED_NUMERIC_DETAIL", "VIOLATES_EXPLICIT_INTERVENTION_CONSTRAINT", "SEMANTIC_REDUNDANCY", "CONFLICTS_WITH_RETAINED_ANSWER")
SOFT_RISKS = ("EXTERNAL_FACT_AS_TARGET_OBSERVATION", "OVERSTRONG_CAUSAL_CLAIM", "OVERCOMMITTED_PREDICTION")
PRIORITIES = {"CORRECTS_ERROR": 0, "FILLS_MISSING_OBLIGATION": 1, "MATERIAL_DECISION_GAIN": 2, "ELABORATION_ONLY": 9}
# Patterns of the gate.
ONE_CHANGE = r"(?i)\bone\s+major\s+(?:materials?\s+)?change\b"
OTHER_ROUTE = r"(?i)\b(?:switch(?:ing)?\s+to|stronger[- ]contact|contact\s+redesign)\b"
SHAPE = r"(?i)\b(?:non[- ]monotonic|biphasic|inflection|sharp threshold|peak at)\b"
UNIT_NUMBER = r"(?<![A-Za-z])\d+(?:\.\d+)?(?:\s?(?:%|mm|cm|nm|um|µm|h|s|min|K|C|V|mA|mW))?"
GATES = r"^(?:G[0-6]_|HARD_RISK_|VERIFIER_REJECT)"
#: Limits: evidence ids of a candidate, words that all patches may add, the soft target of one, patches of a revision.
MOST_EVIDENCE, MOST_WORDS, SOFT_WORDS, MOST_PATCHES = 5, 320, 160, 6


def reasons(*pairs: tuple[str, Column]) -> Column:
    """The names whose conditions hold, in order; an unknown condition does not."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in pairs]))


def added_words(operation: Column, revised: Column, anchor: Column) -> Column:
    return F.when(operation == "APPEND_AFTER_ANCHOR", word_count(revised)).otherwise(F.greatest(F.lit(0), word_count(revised) - word_count(F.coalesce(anchor, F.lit("")))))


def validated_candidates(rows: DataFrame, query: str = "query_id", place: str = "place") -> DataFrame:
    """Candidates with their known evidence ids, added words and the reasons against them.

    `rows` has the candidate's fields, its anchor's text (null if unknown),
    `known_evidence`, `known_obligation` and its place. An id counts as used by
    the first candidate that is otherwise fine.
    """
    c = F.col
    ids = F.slice(F.array_distinct(F.array_intersect(F.transform("evidence_chunk_ids", lambda v: F.trim(v)), c("known_evidence"))), 1, MOST_EVIDENCE)
    blank = lambda n: F.trim(F.coalesce(c(n), F.lit(""))) == ""
    base = rows.withColumns({"evidence_chunk_ids": ids, "added_words": added_words(c("operation"), F.trim("revised_text"), c("anchor_text"))})
    own = reasons(
        ("invalid_candidate_id", blank("candidate_id")),
        ("unknown_obligation_id", ~c("known_obligation")),
        ("invalid_effect_class", ~F.coalesce(c("effect_class"), F.lit("")).isin(*EFFECTS)),
        ("invalid_operation", ~F.coalesce(c("operation"), F.lit("")).isin(*OPERATIONS)),
        ("unknown_target_anchor", c("anchor_text").isNull()),
        ("empty_revision", blank("revised_text")),
        ("invalid_evidence_ids", F.size("evidence_chunk_ids") == 0),
        ("missing_consequence_fields", blank("scientific_delta") | blank("counterfactual_consequence")),
        ("invalid_confidence", ~F.lower(F.coalesce(c("confidence"), F.lit(""))).isin("high", "medium")),
    )
    checked = base.withColumn("reasons", own).withColumn("over_soft_target", c("added_words") > SOFT_WORDS)
    first = checked.filter(F.size("reasons") == 0).groupBy(query, "candidate_id").agg(F.min(place).alias("__first"))
    again = checked.join(first, [query, "candidate_id"], "left")
    return again.withColumn("reasons", F.when((F.size("reasons") == 0) & (c(place) > c("__first")), F.array(F.lit("invalid_candidate_id"))).otherwise(c("reasons"))).drop("__first")


def unit_numbers(text: Column) -> Column:
    return F.array_distinct(all_of(text, "(?U)" + UNIT_NUMBER))


#: The ratio from which an appended text repeats a sentence.
NEAR = 0.93


def gate_reasons(similarity: Column) -> Column:
    """The sorted reasons of the gate for a row of candidate, review and query.

    `similarity` is the revised text's greatest ratio with a sentence of the
    base answer, exact where it reaches NEAR. Columns: candidate_id, anchor_known, anchor_text, operation,
    revised_text, evidence_ok, leak_count, question, base_answer, condition_id,
    and the review's fields.
    """
    c = F.col
    down = c("decision") == "ACCEPT_AFTER_DOWNGRADE"
    bounded = F.trim(F.coalesce(c("bounded_revision"), F.lit("")))
    revised = F.trim(F.coalesce(c("revised_text"), F.lit("")))
    effective = F.when(down, bounded).otherwise(revised)
    context = F.concat_ws(" ", "question", "base_answer")
    append = c("operation") == "APPEND_AFTER_ANCHOR"
    violation = c("question").rlike(ONE_CHANGE) & revised.rlike(OTHER_ROUTE)
    invented = (F.size(F.array_except(unit_numbers(effective), unit_numbers(context))) > 0) & ~(down & (c("evidence_role") == "EXTERNAL_PRECEDENT"))
    sparse = c("condition_id") == "S"
    hard = F.array_intersect(F.when(violation, F.array_union(c("risk_flags"), F.array(F.lit("VIOLATES_EXPLICIT_INTERVENTION_CONSTRAINT")))).otherwise(c("risk_flags")), F.array(*[F.lit(x) for x in HARD_RISKS]))
    soft = F.arrays_overlap(c("risk_flags"), F.array(*[F.lit(x) for x in SOFT_RISKS]))
    own = reasons(
        ("G0_INVALID_STRUCTURE", (F.coalesce(c("candidate_id").cast("string"), F.lit("")) == "") | ~c("anchor_known") | ~c("operation").isin(*OPERATIONS) | (revised == "")),
        ("G0_INVALID_EVIDENCE_TRACE", ~c("evidence_ok")),
        ("G0_TARGET_ARTICLE_LEAKAGE", c("leak_count") != 0),
        ("VERIFIER_REJECT", c("decision") == "REJECT"),
        ("G1_ELABORATION_ONLY", c("necessity") == "ELABORATION_ONLY"),
        ("G2_SYSTEM_MISMATCH", c("target_system_match") == "MISMATCH"),
        ("G4_ONE_MAJOR_CHANGE_VIOLATION", violation),
        ("G4_CONSTRAINT_NOT_CONFIRMED", (c("constraint_check") != "PASS") | ~c("constraint_preserved")),
        ("G6_REDUNDANT", c("novel_information") == "REDUNDANT"),
        ("G6_LOW_INFORMATION_GAIN", (c("novel_information") == "LOW") & (c("necessity") != "CORRECTS_ERROR")),
        ("G6_MISSING_OBLIGATION_GAIN", (F.coalesce(c("obligation_gain"), F.lit("")) == "") & (c("decision") != "REJECT")),
        ("G5_DOWNGRADE_REQUIRED", soft & ~down),
        ("G2_UNKNOWN_REQUIRES_DOWNGRADE", (c("target_system_match") == "UNKNOWN") & ~(down & c("evidence_role").isin("EXTERNAL_PRECEDENT", "HYPOTHESIS", "GENERAL_DOMAIN_KNOWLEDGE"))),
        ("G3_EXTERNAL_FACT_AS_TARGET_OBSERVATION", sparse & (c("evidence_role") == "TARGET_OBSERVATION") & (c("prompt_support") != "EXPLICIT")),
        ("G5_EMPTY_BOUNDED_REVISION", down & (bounded == "")),
        ("G5_UNREQUESTED_BOUNDED_REVISION", ~down & (bounded != "")),
        ("G2_NEW_NUMERIC_DETAIL", invented),
        ("G5_OVERCOMMITTED_PATTERN", sparse & (c("evidence_role") == "HYPOTHESIS") & effective.rlike(SHAPE) & ~context.rlike(SHAPE)),
        ("G6_NO_TEXTUAL_DELTA", compare_text(effective) == compare_text(F.coalesce(c("anchor_text"), F.lit("")))),
        ("G6_ALREADY_PRESENT", append & F.contains(compare_text(c("base_answer")), compare_text(effective))),
        ("G6_NEAR_DUPLICATE", append & (similarity >= NEAR)),
    )
    given = F.coalesce(c("reason_codes"), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(given, own, F.transform(hard, lambda x: F.concat(F.lit("HARD_RISK_"), x)))))


def eligible(found: Column) -> Column:
    return ~F.exists(found, lambda r: r.rlike(GATES))


def order_key() -> Column:
    """How eligible candidates are ordered: need, decision, match, novelty, id."""
    rank = lambda c, table, other: F.coalesce(F.create_map(*[F.lit(x) for p in table.items() for x in p])[F.col(c)], F.lit(other))
    return F.struct(rank("necessity", PRIORITIES, 9), F.when(F.col("decision") == "ACCEPT", 0).otherwise(1), rank("target_system_match", {"MATCH": 0, "PARTIAL_MATCH": 1, "UNKNOWN": 2}, 3), rank("novel_information", {"HIGH": 0, "MEDIUM": 1, "LOW": 2}, 3), F.col("candidate_id").cast("string"))


def budgeted(rows: DataFrame, query: str, order: Column, most: int = 2, words: int | None = None) -> DataFrame:
    """`rows` with `verdict`: selected, or why not, taking each query's candidates in order.

    One per obligation, one per anchor, at most `most`, and if given at most
    `words` added in all. What is taken depends on what was before, so it runs
    per query over its candidates, of which a query has a handful. Rows of one id
    stay rows of their own.
    """
    names = [query, "obligation_id", "target_anchor_id", "added_words"]
    schema = T.StructType([*rows.schema.fields, T.StructField("verdict", T.StringType())])

    def choose(batch: pa.Table) -> pa.Table:
        taken: list[tuple] = []
        total, out = 0, {}
        columns = {n: batch.column(n).to_pylist() for n in names}
        for i in sorted(range(batch.num_rows), key=batch.column("__order").to_pylist().__getitem__):
            obligation, anchor, added = (columns[n][i] for n in names[1:])
            if any(obligation == t[0] for t in taken):
                out[i] = "G7_DUPLICATE_OBLIGATION"
            elif any(anchor == t[1] for t in taken):
                out[i] = "G7_DUPLICATE_ANCHOR"
            elif len(taken) >= most:
                out[i] = "G7_PATCH_BUDGET"
            elif words is not None and total + added > words:
                out[i] = "total_added_words"
            else:
                out[i], total = "selected", total + added
                taken.append((obligation, anchor))
        return batch.drop_columns("__order").append_column("verdict", pa.array([out[i] for i in range(batch.num_rows)]))

    place = F.row_number().over(Window.partitionBy(query).orderBy(order))
    return rows.withColumn("__order", place).groupBy(query).applyInArrow(choose, schema)


def critic_selected(reviews: DataFrame, candidates: DataFrame, query: str, decision: str = "critic_decision", ids: str = "selected_ids", most: int = MOST_PATCHES, words: int = MOST_WORDS) -> DataFrame:
    """(query, selected, reasons): the candidates that a critic's list keeps, in the critic's own order.

    NONE selects nothing, without a reason. Another decision than PATCH, no list,
    more than `most` ids, repeated ids, or an unknown id reject the whole list.
    Of a sound list, a candidate is passed over whose anchor or obligation one
    before has taken, or that would take the added words over `words`.
    `candidates` has candidate_id, obligation_id, target_anchor_id and added_words.
    """
    said = F.transform(F.col(ids), lambda x: F.trim(x.cast("string")))
    entry = F.struct(F.col("candidate_id").cast("string").alias("id"), F.col("obligation_id").cast("string").alias("obligation"), F.col("target_anchor_id").cast("string").alias("anchor"), F.col("added_words").cast("long").alias("added"))
    known = candidates.groupBy(query).agg(F.collect_list(entry).alias("__known"))
    met = reviews.join(known, query, "left").withColumn("__ids", said)
    # Of candidates with one id, the last counts.
    chosen = F.transform("__ids", lambda x: F.element_at(F.filter("__known", lambda c: c["id"] == x), -1))
    verdict = F.upper(F.coalesce(F.col(decision), F.lit("")))
    unknown = F.exists("__ids", lambda x: ~F.coalesce(F.exists("__known", lambda c: c["id"] == x), F.lit(False)))
    fault = (
        F.when((verdict != "PATCH") | F.col("__ids").isNull(), "invalid_critic_decision")
        .when((F.size("__ids") > most) | (F.size(F.array_distinct("__ids")) != F.size("__ids")), "critic_selection_count_or_duplicates")
        .when(unknown, "critic_selected_unknown_candidate")
    )
    none = F.array().cast("array<string>")
    begin = F.struct(none.alias("selected"), none.alias("reasons"), none.alias("anchors"), none.alias("obligations"), F.lit(0).cast("long").alias("total"))

    def take(acc: Column, c: Column) -> Column:
        why = F.when(F.array_contains(acc["anchors"], c["anchor"]), "_duplicate_anchor").when(F.array_contains(acc["obligations"], c["obligation"]), "_duplicate_obligation").when(acc["total"] + c["added"] > words, "_total_added_words")
        more = lambda name, x, ok: F.when(ok, F.concat(acc[name], F.array(x))).otherwise(acc[name]).alias(name)
        fine = why.isNull()
        return F.struct(more("selected", c["id"], fine), more("reasons", F.concat(c["id"], why), ~fine), more("anchors", c["anchor"], fine), more("obligations", c["obligation"], fine), (acc["total"] + F.when(fine, c["added"]).otherwise(0)).alias("total"))

    walked = F.aggregate(chosen, begin, take)
    sound = (verdict != "NONE") & fault.isNull()
    found = met.withColumn("__fault", F.when(verdict != "NONE", fault)).withColumn("__walk", F.when(sound, walked))
    return found.select(query, F.coalesce("__walk.selected", none).alias("selected"), F.when(F.col("__fault").isNotNull(), F.array("__fault")).otherwise(F.coalesce("__walk.reasons", none)).alias("reasons"))


def applied(base: DataFrame, anchors: DataFrame, patches: DataFrame, query: str, answer: str) -> DataFrame:
    """Each answer with all its patches, the number of anchors changed, and a log entry for each of them in the answer's order.

    Several patches of one anchor are joined: replacements first, then what is
    appended, each in order of the candidate's id. An entry names the anchor, its
    candidates, their operations and number, and what was done. A blank text,
    another operation or an unknown anchor raises an error. The text is put together from its spans: what is between anchors,
    and each changed anchor. Anchors are (anchor_id, start, end, anchor_text).
    """
    rank = F.when(F.col("operation") == "REPLACE_ANCHOR", 0).otherwise(1)
    entries = F.array_sort(F.collect_list(F.struct(rank.alias("o"), F.col("candidate_id").cast("string").alias("id"), F.trim("revised_text").alias("t"), "operation")))
    grouped = patches.groupBy(query, "target_anchor_id").agg(entries.alias("p"), F.min(rank).alias("first"))
    wrong = F.exists("p", lambda x: ~F.coalesce(x["operation"].isin(*OPERATIONS), F.lit(False)))
    fault = F.when(F.col("anchor_text").isNull(), "unknown anchor").when(wrong, "unknown operation").when(F.exists("p", lambda x: F.coalesce(x["t"], F.lit("")) == ""), "a patch needs a text")
    each = lambda f: F.transform("p", lambda x: x[f])
    action = F.when(F.col("first") == 0, "replace_then_append_all_same_anchor_candidates").otherwise("append_all_same_anchor_candidates")
    entry = F.struct("target_anchor_id", each("id").alias("candidate_ids"), each("operation").alias("operations"), F.size("p").alias("candidate_count"), action.alias("action"))
    met = grouped.join(anchors.withColumnRenamed("anchor_id", "target_anchor_id"), [query, "target_anchor_id"], "left")
    met = met.filter(F.assert_true(fault.isNull(), fault).isNull()).withColumn("text", F.array_join(each("t"), " ")).withColumn("entry", entry)
    changed = F.when(F.col("first") == 0, F.col("text")).otherwise(F.concat_ws(" ", "anchor_text", "text"))
    spans = met.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("start", "end", changed.alias("text"), "entry"))).alias("spans"))
    met = base.join(spans, query, "left")
    whole = F.col(answer)
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    built = F.aggregate(
        F.coalesce(F.transform("spans", lambda x: x.dropFields("entry")), F.array().cast("array<struct<start:int,end:int,text:string>>")),
        begin,
        lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(whole, acc["at"] + 1, s["start"] - acc["at"]), s["text"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(whole, acc["at"] + 1, F.length(whole))),
    )
    return met.select(query, F.trim(built).alias("revised_answer"), F.coalesce(F.size("spans"), F.lit(0)).alias("actions"), F.transform("spans", lambda x: x["entry"]).alias("log"))


def checked_base(base: DataFrame, query: str, answer: str, digest: str) -> DataFrame:
    """Base answers whose SHA-256, without white space around them, is the recorded one; another raises an error when it is read."""
    text = F.regexp_replace(F.coalesce(F.col(answer), F.lit("")), r"(?U)^\s+|\s+$", "")
    return base.filter(F.assert_true(F.coalesce(F.sha2(text, 256) == F.col(digest), F.lit(False)), F.concat(F.col(query).cast("string"), F.lit(": the base answer is not the recorded one"))).isNull()).withColumn(answer, text)


def rematerialised(base: DataFrame, anchors: DataFrame, patches: DataFrame, query: str, answer: str, effect: str = "effect_class") -> DataFrame:
    """Each answer with its accepted patches, and (candidate_id, target_anchor_id, action) of each in the order of the answer.

    A replacement that neither corrects a causal error nor contains its anchor's
    sentence keeps the anchor and goes after it. A blank text, another operation
    or an unknown anchor raises an error. Several patches of one anchor are joined as by applied().
    """
    known = anchors.select(query, F.col("anchor_id").alias("target_anchor_id"), "start", "anchor_text")
    key = sentence_key(F.col("anchor_text"))
    contained = (key != "") & F.contains(sentence_key(F.col("revised_text")), key)
    fault = (
        F.when(F.col("anchor_text").isNull(), F.concat(F.lit("unknown anchor: "), F.coalesce("target_anchor_id", F.lit(""))))
        .when(F.trim(F.coalesce("revised_text", F.lit(""))) == "", F.lit("an accepted patch needs a text"))
        .when(~F.coalesce(F.col("operation").isin(*OPERATIONS), F.lit(False)), F.concat(F.lit("unknown operation: "), F.coalesce("operation", F.lit(""))))
    )
    action = (
        F.when(fault.isNotNull(), F.raise_error(fault).cast("string"))
        .when(F.col("operation") == "APPEND_AFTER_ANCHOR", "append_then_deduplicate")
        .when(F.coalesce(F.col(effect), F.lit("")) == "CORRECTS_CAUSAL_ERROR", "destructive_replace_allowed_causal_correction")
        .when(contained, "replace_already_preserves_anchor")
        .otherwise("noncorrective_replace_preserved_anchor")
    )
    judged = patches.join(known, [query, "target_anchor_id"], "left").withColumn("action", action)
    keeps = F.col("action").isin("append_then_deduplicate", "noncorrective_replace_preserved_anchor")
    placed = judged.withColumn("operation", F.when(keeps, "APPEND_AFTER_ANCHOR").otherwise("REPLACE_ANCHOR"))
    entry = F.struct("start", F.col("candidate_id").cast("string").alias("candidate_id"), "target_anchor_id", "action")
    actions = judged.groupBy(query).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x.dropFields("start")).alias("actions"))
    text = applied(base, anchors, placed.drop("start", "anchor_text", "action"), query, answer).drop("actions", "log")
    return text.join(actions, query, "left")


def reason_counts(rows: DataFrame, reasons_: str) -> DataFrame:
    return rows.select(F.explode(reasons_).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def prompt(template: str, **columns: Column) -> Column:
    """A template with {names} filled by columns; null is empty."""
    out = F.lit(template)
    for name, value in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def numbered_lines(items: Column, id_field: str, text_field: str, between: str = "\n") -> Column:
    """'[id] text' of each item, as prompts list anchors and evidence."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("["), x[id_field], F.lit("] "), x[text_field])), between)


def revised(base: DataFrame, anchors: DataFrame, candidates: DataFrame, query: str, answer: str) -> DataFrame:
    """Answers after the whole revision: gate, order, budget of two, patches, repeats removed.

    `candidates` has the columns of gate_reasons(), its ratio as `similarity`,
    and added_words. An answer without an eligible patch stays, but for repeats.
    """
    from sievework.functions.sentences import deduplicated

    gated = candidates.withColumn("gate_reasons", gate_reasons(F.col("similarity")))
    fine = gated.filter(eligible(F.col("gate_reasons"))).withColumn("revised_text", F.when(F.col("decision") == "ACCEPT_AFTER_DOWNGRADE", F.col("bounded_revision")).otherwise(F.col("revised_text")))
    chosen = budgeted(fine, query, order_key()).filter("verdict = 'selected'")
    patched = applied(base, anchors, chosen, query, answer)
    return deduplicated(patched, query, "revised_answer").withColumnRenamed("text", "revised_answer").join(patched.select(query, "actions"), query)
