"""Queries of evidence packets, patches, training data and validation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import cleaning as C
from sievework.functions import sentences as D
from sievework.functions import tokens as T
from sievework.functions.python import keyword_string, near_ratio, obligations
from sievework.functions.sentences import Anchors, sentences
from sievework.operators import evidence as E
from sievework.operators import patches as P
from sievework.operators import retrieval as R
from sievework.operators import scoring as S
from sievework.operators import training as L
from sievework.operators import validation as V
from sievework.plans.retrieval import _bm25_sql
from sievework.plans.tables import evidence_docs, load, questions
from sievework.plans.texts import _evidence
from sievework.sources.work import table


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(evidence_docs(spark, sf_dir), questions(spark, sf_dir), "doc_id", "item_id", 40).select("item_id", "doc_id", "rank")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.compiled(_ranking(spark, sf_dir), evidence_docs(spark, sf_dir), questions(spark, sf_dir), "item_id", "doc_id")


def evidence_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("item_id", "evidence_id", "doc_id", "rank", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


def packet_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = E.packet_checks(_blocks(spark, sf_dir), evidence_docs(spark, sf_dir), "doc_id")
    return checked.groupBy("item_id").agg(F.count("*").alias("blocks"), F.count_if("numbers_kept").alias("numbers_kept"), F.count_if("leaks").alias("leaks"))


def packet_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.packet_report(E.packet_texts(_blocks(spark, sf_dir), questions(spark, sf_dir), "item_id"), "n_chars")


def packet_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 41).select(F.col("id").alias("rank"), E.budget(F.col("id"))["chars"].alias("chars"), E.budget(F.col("id"))["units"].alias("units"), E.card_budget(F.col("id"))["chars"].alias("card_chars"))


def source_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return E.source_tier(_ranking(spark, sf_dir), docs.filter("lang = 'en' and doc_id % 3 = 0"), docs.filter("doc_id % 3 <> 2"), ["item_id", "rank", "doc_id"], "doc_id")


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of each question's ranked documents, and which of them are kept as diverse."""
    top = _ranking(spark, sf_dir).join(evidence_docs(spark, sf_dir), "doc_id")
    met = top.join(questions(spark, sf_dir).select("item_id", E.words(F.col("text")).alias("q")), "item_id")
    cut = E.with_excerpt(met, "text", "q", 330, 2).select("item_id", "rank", "excerpt")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "excerpt"))), lambda x: x["excerpt"])
    kept = cut.groupBy("item_id").agg(ordered.alias("x")).withColumn("x", E.tokenised(F.col("x"))).select("item_id", F.size("x").alias("excerpts"), E.diverse(F.col("x"), 5).alias("kept"), E.distinct_units(F.col("x"), 5).alias("units"))
    return kept.select("item_id", "excerpts", F.size("kept").alias("kept"), F.size("units").alias("units"), F.sha2(F.array_join("kept", "\n"), 256).alias("sha256"))


def deep_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic packs from documents: the core is the id modulo 50, types in turn, the retrieval text that of the document itself."""
    families = F.array(*[F.lit(f) for f in E.FAMILY_WORDS])
    types = F.array(*[F.lit(t) for t in E.TYPE_BOOST["stability_failure"]])
    packs = load(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("core_id"), F.col("doc_id").alias("card_id"), F.element_at(types, (F.col("doc_id") % 6 + 1).cast("int")).alias("card_type"), F.col("text").alias("embedding_text"), F.col("text").alias("retrieval_text"))
    asked = questions(spark, sf_dir).select("item_id", E.words(F.col("text")).alias("query_words"), F.element_at(families, (F.col("item_id") % 4 + 1).cast("int")).alias("family"))
    ranked = asked.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(25)))).withColumn("core_id", F.pmod(F.col("item_id") + F.col("rank"), F.lit(50)))
    # Texts are split into words once, and only those of chosen packs join them again.
    light = table(packs.select("core_id", "card_id", "card_type", E.words(F.coalesce("embedding_text", F.lit(""))).alias("own")), "pack-words")
    chosen = table(E.topic_packs(light.join(ranked, "core_id"), "item_id", "core_id", "card_id", "own"), "chosen-packs")
    chosen = chosen.join(packs.select("card_id", "embedding_text", "retrieval_text"), "card_id").join(asked.select("item_id", "query_words"), "item_id")
    found = E.deep_papers(E.paper_units(chosen, "item_id", "core_id", "card_id"), "item_id", "core_id", "card_id")
    return found.select("item_id", "core_id", "n_units", F.size("cards").alias("cards"), F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


def abstract_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = evidence_docs(spark, sf_dir).withColumn("q", F.array(F.lit("the"), F.lit("control")))
    found = E.with_abstract(docs, "text", "q")
    return found.select("doc_id", F.length("abstract").alias("n_chars"), F.sha2("abstract", 256).alias("sha256"))


def _pick(values: tuple[str, ...] | list[str], number: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


NEEDS, DECISIONS, ROLES = list(P.PRIORITIES), ("ACCEPT", "REJECT", "ACCEPT_AFTER_DOWNGRADE"), ("TARGET_OBSERVATION", "EXTERNAL_PRECEDENT", "GENERAL_DOMAIN_KNOWLEDGE", "HYPOTHESIS")
MATCHES, SUPPORTS, CHECKS, NOVELTY = ("MATCH", "PARTIAL_MATCH", "UNKNOWN", "MISMATCH"), ("EXPLICIT", "INFERRED", "ABSENT"), ("PASS", "PASS", "PASS", "FAIL"), ("HIGH", "MEDIUM", "LOW", "REDUNDANT")


def patch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and reviews from events: a user's events are the candidates of its query."""
    i = F.col("event_id")
    e = load(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type"))
    return e.select(
        F.col("user_id").alias("query_id"),
        i.alias("candidate_id"),
        (i % 5).alias("obligation_id"),
        F.concat(F.lit("S00"), (F.floor(i / 7) % 4 + 1).cast("string")).alias("target_anchor_id"),
        _pick(("APPEND_AFTER_ANCHOR", "REPLACE_ANCHOR"), F.floor(i / 3)).alias("operation"),
        F.concat(F.lit("Add the "), F.col("event_type"), F.lit(" control"), F.when(i % 6 == 0, F.concat(F.lit(" at "), (i % 9).cast("string"), F.lit(" mm"))).otherwise("")).alias("revised_text"),
        F.when(i % 11 == 0, F.lit("A bounded claim.")).otherwise("").alias("bounded_revision"),
        (i % 13 != 0).alias("anchor_known"),
        F.lit("Base sentence of the answer.").alias("anchor_text"),
        (i % 17 != 0).alias("evidence_ok"),
        F.when(i % 97 == 0, 1).otherwise(0).alias("leak_count"),
        F.lit("Is there one major change?").alias("question"),
        F.lit("Base sentence of the answer. It names 3 mm.").alias("base_answer"),
        F.when(F.col("user_id") % 2 == 0, "S").otherwise("E").alias("condition_id"),
        _pick(DECISIONS, F.floor(i / 2)).alias("decision"),
        _pick(NEEDS, F.floor(i / 5)).alias("necessity"),
        _pick(ROLES, i).alias("evidence_role"),
        _pick(MATCHES, F.floor(i / 11)).alias("target_system_match"),
        _pick(SUPPORTS, i).alias("prompt_support"),
        _pick(CHECKS, F.floor(i / 19)).alias("constraint_check"),
        (i % 23 != 0).alias("constraint_preserved"),
        _pick(NOVELTY, F.floor(i / 29)).alias("novel_information"),
        F.when(i % 31 == 0, F.lit("")).otherwise("gain").alias("obligation_gain"),
        F.when(i % 37 == 0, F.array(F.lit("DEVICE_STACK_MISMATCH"))).when(i % 41 == 0, F.array(F.lit("OVERSTRONG_CAUSAL_CLAIM"))).otherwise(F.array().cast("array<string>")).alias("risk_flags"),
        F.array().cast("array<string>").alias("reason_codes"),
        (i % 4 * 40 + 10).cast("int").alias("added_words"),
    )


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = patch_rows(spark, sf_dir)
    return rows.withColumn("reasons", P.gate_reasons(F.lit(0.0)))


def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("candidate_id", F.array_join("reasons", ",").alias("reasons"), P.eligible(F.col("reasons")).alias("eligible"))


def gate_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate with the ratio computed: how many candidates have each reason."""
    rows = patch_rows(spark, sf_dir).withColumn("ratio", near_ratio(T.compare_text(F.col("revised_text")), F.transform(sentences(F.col("base_answer")), T.compare_text), P.NEAR))
    return P.reason_counts(rows.withColumn("reasons", P.gate_reasons(F.col("ratio"))), "reasons")


def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.reason_counts(_gated(spark, sf_dir), "reasons")


def _budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = _gated(spark, sf_dir).filter(P.eligible(F.col("reasons")))
    return P.budgeted(fine, "query_id", P.order_key())


def patch_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _budgeted(spark, sf_dir).select("query_id", "candidate_id", "verdict")


def critic_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Critics' lists of up to four of a user's newest events: some say NONE, some repeat an id or name an unknown one."""
    i = F.col("candidate_id")
    rows = patch_rows(spark, sf_dir).withColumn("added_words", (i % 4 * 60 + 10).cast("int"))
    lists = rows.groupBy("query_id").agg(F.slice(F.reverse(F.array_sort(F.collect_list("candidate_id"))), 1, 4).alias("l"))
    q = F.col("query_id")
    odd = F.when(q % 7 == 3, F.concat("l", F.slice("l", 1, 1))).when(q % 7 == 5, F.concat("l", F.array(F.lit(-1).cast("bigint")))).otherwise(F.col("l"))
    reviews = lists.select("query_id", F.transform(odd, lambda x: x.cast("string")).alias("selected_ids"), F.when(q % 7 == 1, "none").when(q % 7 == 2, "MAYBE").otherwise("patch").alias("critic_decision"))
    found = P.critic_selected(reviews, rows, "query_id")
    return found.select("query_id", F.array_join("selected", ",").alias("selected"), F.array_join("reasons", ",").alias("reasons"))


def patch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two patches of each assistant turn, at its first and second anchor."""
    talk = load(spark, sf_dir, "conversations").filter("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text")
    anchors = talk.lateralJoin(Anchors(F.col("text").outer())).drop("text")
    chosen = anchors.filter("anchor_id in ('S001', 'S002')").select("query_id", F.col("anchor_id").alias("target_anchor_id"), F.col("anchor_id").alias("candidate_id"), F.when(F.col("anchor_id") == "S001", "APPEND_AFTER_ANCHOR").otherwise("REPLACE_ANCHOR").alias("operation"), F.lit("New words.").alias("revised_text"))
    found = P.applied(talk, anchors, chosen, "query_id", "text")
    return found.select("query_id", "actions", F.to_json("log").alias("log"), F.length("revised_answer").alias("n_chars"), F.sha2("revised_answer", 256).alias("sha256"))


def patch_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole revision of each query's base answer."""
    rows = patch_rows(spark, sf_dir).withColumn("similarity", F.lit(0.0))
    base = rows.groupBy("query_id").agg(F.first("base_answer").alias("text"))
    anchors = base.lateralJoin(Anchors(F.col("text").outer())).drop("text")
    there = anchors.groupBy("query_id").agg(F.collect_set("anchor_id").alias("there"))
    rows = rows.join(there, "query_id").withColumn("anchor_known", F.col("anchor_known") & F.array_contains("there", F.col("target_anchor_id"))).drop("there")
    return P.revised(base, anchors, rows, "query_id", "text").select("query_id", "revised_answer", "actions", F.size("removed").alias("removed"))


def record_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of each question as evidence records; their value is their length."""
    asked = questions(spark, sf_dir).select("item_id", E.words(F.col("text")).alias("query_words"), F.lit("stability_failure").alias("family"))
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", F.col("n_chars").alias("value"))
    return E.ranked_records(docs, asked, "doc_id", "item_id", 5)


def constraint_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("text"), F.lit(" Use one control only; must be fixed. Without changing it, ONE CONTROL ONLY; must be fixed."))
    return questions(spark, sf_dir).select("item_id", F.array_join(D.constraints(text), "|").alias("found"))


def prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = load(spark, sf_dir, "conversations").filter("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("item"), "text", F.lit("general").alias("route"), F.when(F.col("turn") % 3 == 0, "length").otherwise("stop").alias("finish"))
    return S.prediction_rows(talk, "item", "m", "text", "route", "finish").drop("answer")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt of each question and its evidence blocks."""
    blocks = _blocks(spark, sf_dir).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "text"))).alias("e"))
    met = blocks.join(questions(spark, sf_dir), "item_id")
    return met.select("item_id", F.sha2(P.prompt("# Question\n{q}\n# Evidence\n{e}", q=F.col("text"), e=P.numbered_lines(F.col("e"), "evidence_id", "text")), 256).alias("sha256"))


def candidate_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("candidate_id")
    rows = patch_rows(spark, sf_dir).select(
        "query_id", F.when(i % 7 == 0, F.lit("C1")).otherwise(F.concat(F.lit("C"), i.cast("string"))).alias("candidate_id"), i.alias("place"), (i % 5 != 4).alias("known_obligation"),
        _pick((*P.EFFECTS, "STYLE"), i).alias("effect_class"), _pick((*P.OPERATIONS, "DELETE"), F.floor(i / 4)).alias("operation"), F.when(i % 13 != 0, F.col("anchor_text")).alias("anchor_text"),
        "revised_text", F.when(i % 8 == 0, F.lit(" ")).otherwise("delta").alias("scientific_delta"), F.lit("else").alias("counterfactual_consequence"), _pick(("high", "Medium", "low"), i).alias("confidence"),
        F.array(F.lit("E001"), F.concat(F.lit(" E00"), (i % 6).cast("string")), F.lit("E999")).alias("evidence_chunk_ids"), F.array(*[F.lit(f"E00{k}") for k in range(2, 5)]).alias("known_evidence"),
    )
    found = P.validated_candidates(rows)
    return found.select("query_id", "place", "candidate_id", F.array_join("evidence_chunk_ids", ",").alias("evidence"), "added_words", F.array_join("reasons", ",").alias("reasons"))


def enum_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    known, other = V.flags(F.array(F.upper("event_type"), F.lit("DEVICE_STACK_MISMATCH ")), P.HARD_RISKS)
    return e.select("event_id", V.enumerated(F.concat(F.lit(" "), F.col("event_type")), ("CLICK", "VIEW"), "OTHER").alias("kind"), F.array_join(known, ",").alias("risks"), other.alias("unknown"))


def key_alignment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.misaligned(load(spark, sf_dir, "labels"), load(spark, sf_dir, "documents"), "doc_id")


def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.repeated(load(spark, sf_dir, "documents").withColumn("md5", F.md5(F.col("text").cast("binary"))), ["md5"])


def first_per_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.first_per(load(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang"], ["doc_id"], 5)


def canonical_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = load(spark, sf_dir, "benchmark").select(F.lit(" ").alias("id"), F.col("item_id").alias("benchmark_id"), F.col("text").alias("prompt"), (F.col("item_id") % 4).cast("string").alias("task_family"))
    routes = spark.createDataFrame([("0", "Mechanism."), ("1", "Stability.")], "family string, instruction string")
    found = V.routed(V.canonical_questions(raw), routes, "family", "Answer.")
    condition = V.condition_code(F.when(F.col("id").cast("int") % 2 == 0, F.lit("experimental_context")).otherwise("limited_context"))
    return found.select("id", "family", "route", condition.alias("condition"), F.concat_ws("|", F.col("messages")[0]["content"], F.col("messages")[1]["content"]).alias("messages"))


def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("So: "), F.col("props"), F.lit(" done"))).otherwise("nothing")
    return e.select("event_id", F.get_json_object(V.json_object(said), "$.k").cast("bigint").alias("k"))


def reviewed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reviewers said of events: JSON, the same as YAML, or neither; how many of each were read, and the sum of what they hold."""
    e = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    said = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("k: "), k.cast("string"), F.lit("\nreviews:\n  - id: C1\n"))).otherwise("[nothing")
    found = e.select((F.col("event_id") % 3).alias("kind"), V.reviewed_object(said).alias("x")).select("kind", "x.*")
    return found.groupBy("kind", "note").agg(F.count("*").alias("events"), F.coalesce(F.sum(F.get_json_object("payload", "$.k").cast("bigint")), F.lit(0)).alias("total"))


def _word_ids(text: F.Column) -> F.Column:
    """A whitespace tokenizer for tests: a word's id is the first 16 bits of its MD5."""
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int"))


def contiguous_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = evidence_docs(spark, sf_dir).select("doc_id", _word_ids(F.col("text")).alias("ids"))
    found = L.contiguous_blocks(docs, "doc_id", "ids", 1024, 1, 0)
    return found.select("block", "valid", F.md5(F.array_join("input_ids", ",").cast("binary")).alias("ids_md5"))


def nextfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns in one order, longer ones cut, packed into blocks of 512."""
    turns = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.size(_word_ids(F.col("text"))).alias("whole"))
    pieces = turns.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("whole") - 1) / 512)).cast("int"))))
    rows = pieces.select(F.lit("all").alias("shard"), (F.col("id") * 10_000 + F.col("piece")).alias("piece_id"), F.least(F.lit(512), F.col("whole") - 512 * F.col("piece")).alias("n"))
    return L.next_fit(rows, "shard", "piece_id", "n", 512)


def weighted_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = load(spark, sf_dir, "conversations")
    turns = talk.groupBy("conv_id").agg(F.max_by("text", "turn").alias("answer"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("prefix"))
    made = turns.select("conv_id", L.weighted_example(_word_ids(F.col("prefix")), _word_ids(F.col("answer")), F.lit(2.0), 128, 96).alias("e"))
    return made.select("conv_id", F.size("e.input_ids").alias("n"), F.size(F.filter("e.labels", lambda x: x != L.IGNORED)).alias("learned"), F.round(F.aggregate("e.weights", F.lit(0.0), lambda a, b: a + b), 6).alias("weight"))


def sft_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = load(spark, sf_dir, "conversations")
    message = F.struct(F.col("role").alias("role"), F.col("text").alias("content"))
    per = talk.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]).alias("messages"))
    return per.select("conv_id", F.size("messages").alias("turns"), L.valid_chat(F.col("messages")).alias("valid"))


def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(0, 1001).select(F.col("id").alias("step"), F.round(L.learning_rate(F.col("id"), 100, 1000), 9).alias("factor"))


def checkpoint_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.kept_checkpoints(spark.range(50, 2050, 50).withColumnRenamed("id", "step"), "step", 3, 500)


def moving_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.moving_mean(load(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")
    return found.select("user_id", "event_id", F.round("recent_mean", 6).alias("recent_mean"))


def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.pending(load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels"), "doc_id")


def sha_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return load(spark, sf_dir, "documents").select("doc_id", F.octet_length(t).alias("bytes"), F.sha2(t, 256).alias("sha256"))


def direct_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: kind, group and marker in turn by the id."""
    i = F.col("doc_id")
    kind, group, name = _pick(("atomic_unit", "Atomic", "parent"), i), _pick((*C.DIRECT_GROUPS, "lineage"), F.floor(i / 3)), F.concat(_pick((*C.DIRECT_MARKERS, "story"), F.floor(i / 5)), F.lit("_"), i.cast("string"))
    return load(spark, sf_dir, "documents").select("doc_id", C.is_direct_record(kind, group, name, F.col("text")).alias("direct"))


def row_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of questions: nested terms that repeat in another case."""
    words = F.split("text", " ")
    row = F.to_json(F.struct(words.alias("keywords"), F.struct(F.upper("text").alias("all"), F.array(F.transform(words, F.upper)).alias("each")).alias("query_plan")))
    return questions(spark, sf_dir).select("item_id", keyword_string(row).alias("keywords"))


def obligation_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Obligations of questions: ids repeat for every third, requirements are blank for every fifth."""
    i = F.col("item_id")
    one = lambda n: F.struct(F.when(i % 3 == 0, "O1").otherwise(F.lit(f"O{n}")).alias("id"), F.when(i % 5 == 0, " ").otherwise(F.col("text")).alias("requirement"), F.array(F.lit("S001"), F.lit("S009")).alias("draft_anchor_ids"))
    found = obligations(F.to_json(F.struct(F.array(one(1), one(2)).alias("obligations"))), F.array(F.lit("S001")))
    return questions(spark, sf_dir).select("item_id", found.alias("x")).select("item_id", F.size("x.valid").alias("valid"), "x.reasons")


def rematerialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements at the first two anchors of each assistant turn; the second corrects an error."""
    talk = load(spark, sf_dir, "conversations").filter("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text")
    anchors = talk.lateralJoin(Anchors(F.col("text").outer())).drop("text")
    first = F.col("anchor_id") == "S001"
    chosen = anchors.filter("anchor_id in ('S001', 'S002')").select("query_id", F.col("anchor_id").alias("target_anchor_id"), F.col("anchor_id").alias("candidate_id"), F.lit("REPLACE_ANCHOR").alias("operation"), F.lit("A control is needed.").alias("revised_text"), F.when(first, "LIMITS_OR_BOUNDS").otherwise("CORRECTS_CAUSAL_ERROR").alias("effect_class"))
    found = P.rematerialised(talk, anchors, chosen, "query_id", "text")
    return found.select("query_id", F.transform("actions", lambda x: x["action"]).alias("actions"), F.sha2("revised_answer", 256).alias("sha256"))


def packet_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of all blocks; a third of the documents count as abstracts."""
    source = F.when(F.col("doc_id") % 3 == 0, "frozen_abstract").otherwise("science_core")
    found = E.packet_quality(_blocks(spark, sf_dir), evidence_docs(spark, sf_dir), "item_id", "doc_id", source)
    return found.withColumn("source_slots", F.to_json("source_slots"))


def exact_scoring_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as predictions and references, documents of the same number as support records."""
    asked = questions(spark, sf_dir)
    told = evidence_docs(spark, sf_dir).select(F.col("doc_id").alias("item_id"), F.col("text").alias("support"))
    found = S.exact_rows(asked.withColumnRenamed("text", "answer"), asked.withColumnRenamed("text", "reference"), told, "item_id", "support")
    return found.select("item_id", F.length("answer").alias("answer_chars"), F.length("reference").alias("reference_chars"), F.sha2("support", 256).alias("support_sha256"))


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as messages, the ids of all their turns, and of all but the last."""
    message = F.struct(F.col("role").alias("role"), F.col("text").alias("content"))
    per = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]).alias("messages"))
    ids = lambda m: _word_ids(F.concat_ws(" ", F.transform(m, lambda x: x["content"])))
    return per.select("conv_id", "messages", ids(F.slice("messages", 1, F.size("messages") - 1)).alias("prefix"), ids(F.col("messages")).alias("full"))


def chat_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.encoded_chats(_chats(spark, sf_dir), "messages", "prefix", "full", 600)
    return found.select("conv_id", "fault", F.size("labels").alias("n"), F.size(F.filter("labels", lambda x: x != L.IGNORED)).alias("targets"))


def example_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations' last turns learned, in one shuffled order, packed into blocks of 512."""
    chats = _chats(spark, sf_dir).filter(F.size("full") > F.size("prefix"))
    answer = F.slice("full", F.size("prefix") + 1, F.size("full"))
    rows = chats.select(F.lit("all").alias("shard"), "conv_id", L.weighted_example(F.col("prefix"), answer, F.lit(2.0), 512, 96).alias("e")).select("shard", "conv_id", "e.*", (1.0 + F.col("conv_id") % 3).alias("weight"))
    blocks = L.packed_examples(rows, "shard", "conv_id", "input_ids", "labels", "weights", 512, 0, "weight")
    return blocks.select("shard", "block", "valid", "learned", "samples", "sample_weight", F.md5(F.array_join("input_ids", ",").cast("binary")).alias("ids_md5"))


def base_hash_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = evidence_docs(spark, sf_dir)
    space = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    found = P.checked_base(docs.withColumn("digest", F.sha2(space, 256)), "doc_id", "text", "digest")
    return found.select("doc_id", F.sha2("text", 256).alias("sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        evidence_compile, packet_qc, packet_report, packet_budget, source_tier, excerpts, deep_packets, abstract_compile, gate_reasons, gate_similarity, reason_counts, patch_budget, critic_selection, patch_apply,
        patch_revision, record_ranking, constraint_phrases, prediction_rows, prompts, candidate_validation, enum_normalise, key_alignment_check, repeated_keys, first_per_family, canonical_questions, json_objects, reviewed_objects, contiguous_packing, nextfit_packing, weighted_examples, sft_filter,
        direct_records, row_keywords, obligation_validation, rematerialise, packet_quality, exact_scoring_join, chat_encoding, example_packing, base_hash_check, lr_schedule, checkpoint_retention, moving_loss, resume_antijoin, sha_manifest,
    )
}


def _list(values: tuple[str, ...] | list[str], number: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({number}) % {len(values)} + 1]"


_ROWS = f"""
    e AS (SELECT event_id AS i, user_id, event_type FROM events),
    r AS (SELECT user_id AS query_id, i AS candidate_id, {_list(("APPEND_AFTER_ANCHOR", "REPLACE_ANCHOR"), "i // 3")} AS op, 'Add the ' || event_type || ' control' || CASE WHEN i % 6 = 0 THEN ' at ' || (i % 9) || ' mm' ELSE '' END AS rev,
                 CASE WHEN i % 11 = 0 THEN 'A bounded claim.' ELSE '' END AS bnd, i, user_id % 2 = 0 AS sparse, {_list(DECISIONS, "i // 2")} AS dec, {_list(NEEDS, "i // 5")} AS need, {_list(ROLES, "i")} AS role, {_list(MATCHES, "i // 11")} AS mt,
                 {_list(SUPPORTS, "i")} AS sup, {_list(CHECKS, "i // 19")} AS chk, {_list(NOVELTY, "i // 29")} AS nov FROM e),
    d AS (SELECT *, dec = 'ACCEPT_AFTER_DOWNGRADE' AS down, CASE WHEN dec = 'ACCEPT_AFTER_DOWNGRADE' THEN bnd ELSE rev END AS eff FROM r),
    g AS (SELECT *, list_sort(list_distinct(list_filter([
        CASE WHEN i % 13 = 0 THEN 'G0_INVALID_STRUCTURE' END, CASE WHEN i % 17 = 0 THEN 'G0_INVALID_EVIDENCE_TRACE' END, CASE WHEN i % 97 = 0 THEN 'G0_TARGET_ARTICLE_LEAKAGE' END, CASE WHEN dec = 'REJECT' THEN 'VERIFIER_REJECT' END,
        CASE WHEN need = 'ELABORATION_ONLY' THEN 'G1_ELABORATION_ONLY' END, CASE WHEN mt = 'MISMATCH' THEN 'G2_SYSTEM_MISMATCH' END, CASE WHEN chk <> 'PASS' OR i % 23 = 0 THEN 'G4_CONSTRAINT_NOT_CONFIRMED' END,
        CASE WHEN nov = 'REDUNDANT' THEN 'G6_REDUNDANT' END, CASE WHEN nov = 'LOW' AND need <> 'CORRECTS_ERROR' THEN 'G6_LOW_INFORMATION_GAIN' END, CASE WHEN i % 31 = 0 AND dec <> 'REJECT' THEN 'G6_MISSING_OBLIGATION_GAIN' END,
        CASE WHEN i % 37 = 0 THEN 'HARD_RISK_DEVICE_STACK_MISMATCH' END, CASE WHEN i % 41 = 0 AND i % 37 <> 0 AND NOT down THEN 'G5_DOWNGRADE_REQUIRED' END,
        CASE WHEN mt = 'UNKNOWN' AND NOT (down AND role IN ('EXTERNAL_PRECEDENT', 'HYPOTHESIS', 'GENERAL_DOMAIN_KNOWLEDGE')) THEN 'G2_UNKNOWN_REQUIRES_DOWNGRADE' END,
        CASE WHEN sparse AND role = 'TARGET_OBSERVATION' AND sup <> 'EXPLICIT' THEN 'G3_EXTERNAL_FACT_AS_TARGET_OBSERVATION' END, CASE WHEN down AND bnd = '' THEN 'G5_EMPTY_BOUNDED_REVISION' END, CASE WHEN NOT down AND bnd <> '' THEN 'G5_UNREQUESTED_BOUNDED_REVISION' END,
        CASE WHEN NOT down AND i % 6 = 0 AND i % 9 <> 3 THEN 'G2_NEW_NUMERIC_DETAIL' END, CASE WHEN op = 'APPEND_AFTER_ANCHOR' AND eff = '' THEN 'G6_ALREADY_PRESENT' END], lambda x: x IS NOT NULL))) AS reasons FROM d)"""

_IDS = "list_transform(list_filter(string_split_regex({e}, '\\s+'), lambda w: w <> ''), lambda w: CAST('0x' || md5(w)[1:4] AS INTEGER))"

def _nextfit_sql(rows: str, order: str, flush: bool) -> str:
    """`placed`: the rows of a query with column n, in an order, with their block of 512 and place; the rows that begin blocks are found one by one."""
    full = "OR s - n >= (SELECT s - n FROM o WHERE i = st.i) + 512" if flush else ""
    return f"""o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {order}) AS i, sum(n) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS s FROM ({rows})),
        st AS (SELECT min(i) AS i FROM o UNION ALL SELECT (SELECT min(i) FROM o WHERE i > st.i AND (s > (SELECT s - n FROM o WHERE i = st.i) + 512 {full})) FROM st WHERE i IS NOT NULL),
        bg AS (SELECT o.*, CASE WHEN st.i IS NULL THEN 0 ELSE 1 END AS b FROM o LEFT JOIN st ON st.i = o.i),
        placed AS (SELECT *, CAST(sum(b) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS block, CAST(i - max(CASE WHEN b = 1 THEN i END) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS place FROM bg)"""


ORACLE_SQL = {
    "source_tier": f"""WITH {_bm25_sql('true', 40)} SELECT item_id, CAST(rank AS INTEGER) AS rank, top.doc_id, CASE WHEN lang = 'en' AND top.doc_id % 3 = 0 THEN 'science_core' WHEN top.doc_id % 3 <> 2 THEN 'frozen_abstract' ELSE 'bibliographic_only' END AS tier
        FROM top JOIN documents d ON d.doc_id = top.doc_id""",
    "contiguous_packing": f"""WITH t AS (SELECT doc_id, list_append({_IDS.format(e="coalesce(text, '')")}, 1) AS l FROM documents), u AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS id FROM t WHERE len(l) > 1),
        p AS (SELECT id, row_number() OVER (ORDER BY doc_id, i) - 1 AS pos FROM u), b AS (SELECT pos // 1024 AS block, list(id ORDER BY pos) AS ids FROM p GROUP BY 1)
        SELECT block, CAST(len(ids) AS INTEGER) AS valid, md5(array_to_string(list_concat(ids, list_transform(range(1024 - len(ids)), lambda x: 0)), ',')) AS ids_md5 FROM b""",
    "weighted_examples": f"""WITH t AS (SELECT conv_id, arg_max(text, turn) AS a, string_agg(text, ' ' ORDER BY turn) AS p FROM conversations GROUP BY 1), n AS (SELECT conv_id, least(len({_IDS.format(e='a')}), 32) AS k, len({_IDS.format(e='p')}) AS m FROM t)
        SELECT conv_id, CAST(k + least(m, 128 - k) AS INTEGER) AS n, CAST(k AS INTEGER) AS learned, 2.0::DOUBLE AS weight FROM n""",
    "packet_budget": "SELECT r AS rank, CAST(CASE WHEN r <= 8 THEN 1900 WHEN r <= 20 THEN 1300 ELSE 800 END AS INTEGER) AS chars, CAST(CASE WHEN r <= 8 THEN 8 WHEN r <= 20 THEN 6 ELSE 4 END AS INTEGER) AS units, CAST(CASE WHEN r <= 8 THEN 720 WHEN r <= 20 THEN 520 ELSE 320 END AS INTEGER) AS card_chars FROM range(1, 41) t(r)",
    "gate_reasons": f"WITH {_ROWS} SELECT candidate_id, coalesce(array_to_string(reasons, ','), '') AS reasons, len(list_filter(reasons, lambda x: regexp_matches(x, '{P.GATES}'))) = 0 AS eligible FROM g",
    "reason_counts": f"WITH {_ROWS} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM g) GROUP BY reason",
    "candidate_validation": f"""WITH e AS (SELECT event_id AS i, user_id AS query_id, event_type FROM events),
        c AS (SELECT *, CASE WHEN i % 7 = 0 THEN 'C1' ELSE 'C' || i END AS candidate_id, {_list((*P.EFFECTS, "STYLE"), "i")} AS eff, {_list((*P.OPERATIONS, "DELETE"), "i // 4")} AS op, i % 6 AS k, 'Add the ' || event_type || ' control' || CASE WHEN i % 6 = 0 THEN ' at ' || (i % 9) || ' mm' ELSE '' END AS rev FROM e),
        w AS (SELECT *, CASE WHEN k BETWEEN 2 AND 4 THEN 'E00' || k ELSE '' END AS evidence, len(string_split(rev, ' ')) AS n FROM c),
        x AS (SELECT *, list_filter([CASE WHEN i % 5 = 4 THEN 'unknown_obligation_id' END, CASE WHEN eff = 'STYLE' THEN 'invalid_effect_class' END, CASE WHEN op = 'DELETE' THEN 'invalid_operation' END, CASE WHEN i % 13 = 0 THEN 'unknown_target_anchor' END, CASE WHEN evidence = '' THEN 'invalid_evidence_ids' END,
                     CASE WHEN i % 8 = 0 THEN 'missing_consequence_fields' END, CASE WHEN i % 3 = 2 THEN 'invalid_confidence' END], lambda v: v IS NOT NULL) AS rs FROM w),
        f AS (SELECT *, min(i) FILTER (len(rs) = 0) OVER (PARTITION BY query_id, candidate_id) AS first FROM x)
        SELECT query_id, i AS place, candidate_id, evidence, CAST(CASE WHEN op = 'APPEND_AFTER_ANCHOR' THEN n ELSE greatest(0, n - CASE WHEN i % 13 = 0 THEN 0 ELSE 5 END) END AS INTEGER) AS added_words,
               CASE WHEN len(rs) = 0 AND i > first THEN 'invalid_candidate_id' ELSE coalesce(array_to_string(rs, ','), '') END AS reasons FROM f""",
    "prediction_rows": "SELECT conv_id * 100 + turn AS benchmark_id, 'm' AS model, sha256(coalesce(text, '')) AS answer_sha256, 'general' AS prompt_route, CASE WHEN turn % 3 = 0 THEN 'length' ELSE 'stop' END AS finish_reason, turn % 3 = 0 AND trim(coalesce(text, '')) <> '' AS nonempty_length_limited_retained FROM conversations WHERE role = 'assistant'",
    "constraint_phrases": "SELECT item_id, 'one control only; must be fixed|Without changing it, ONE CONTROL ONLY; must be fixed|must be fixed' AS found FROM benchmark",
    "record_ranking": f"""WITH q AS (SELECT item_id, {_evidence('text')} AS q FROM benchmark), d AS (SELECT doc_id, n_chars, {_evidence('text')} AS w FROM documents),
        s AS (SELECT item_id, doc_id, len(list_intersect(q, w)) AS k, len(q) AS n, len(list_intersect({E.FAMILY_WORDS['stability_failure']!r}, w)) AS f, n_chars FROM q, d),
        r AS (SELECT item_id, doc_id, round(k * 2.2 + 10.0 * k / greatest(1, n) + 0.55 * f + ln(1 + n_chars) / 2.5 + 2, 6)::DOUBLE AS score FROM s WHERE k >= 2),
        o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r)
        SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM o WHERE rank <= 5""",
    "enum_normalise": "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN upper(event_type) ELSE 'OTHER' END AS kind, 'DEVICE_STACK_MISMATCH' AS risks, true AS unknown FROM events",
    "key_alignment_check": "SELECT doc_id, 'left' AS side FROM (SELECT DISTINCT doc_id FROM labels) WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'right' FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "repeated_keys": "SELECT md5(text) AS md5, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "first_per_family": "SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 5",
    "canonical_questions": "SELECT CAST(item_id AS VARCHAR) AS id, CAST(item_id % 4 AS VARCHAR) AS family, CASE WHEN item_id % 4 < 2 THEN CAST(item_id % 4 AS VARCHAR) ELSE 'general' END AS route, CASE WHEN item_id % 2 = 0 THEN 'E' ELSE 'S' END AS condition, CASE item_id % 4 WHEN 0 THEN 'Mechanism.' WHEN 1 THEN 'Stability.' ELSE 'Answer.' END || '|' || trim(text) AS messages FROM benchmark",
    "json_objects": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events",
    "sft_filter": """WITH t AS (SELECT conv_id, list(role ORDER BY turn) AS r, list(text ORDER BY turn) AS x, count(*) AS n FROM conversations GROUP BY 1)
        SELECT conv_id, CAST(n AS INTEGER) AS turns, array_to_string(r, ',') = 'system,user,assistant' AND len(list_filter(x, lambda y: trim(coalesce(y, '')) = '')) = 0 AS valid FROM t""",
    "exact_scoring_join": "SELECT item_id, CAST(length(coalesce(b.text, '')) AS INTEGER) AS answer_chars, CAST(length(coalesce(b.text, '')) AS INTEGER) AS reference_chars, sha256(coalesce(d.text, '')) AS support_sha256 FROM benchmark b JOIN documents d ON d.doc_id = b.item_id",
    "chat_encoding": f"""WITH t AS (SELECT conv_id, list(role ORDER BY turn) AS r, list(text ORDER BY turn) AS x, string_agg(text, ' ' ORDER BY turn) AS f, arg_max(text, turn) AS l FROM conversations GROUP BY 1),
        n AS (SELECT conv_id, array_to_string(r, ',') <> 'system,user,assistant' OR len(list_filter(x, lambda y: trim(coalesce(y, '')) = '')) > 0 AS bad, len({_IDS.format(e='f')}) AS m, len({_IDS.format(e='l')}) AS k FROM t),
        v AS (SELECT *, CASE WHEN bad THEN 'roles' WHEN m > 600 THEN 'length' WHEN k < 4 THEN 'targets' END AS fault FROM n)
        SELECT conv_id, fault, CAST(CASE WHEN fault IS NULL THEN m END AS INTEGER) AS n, CAST(CASE WHEN fault IS NULL THEN k END AS INTEGER) AS targets FROM v""",
    "nextfit_packing": f"""WITH RECURSIVE t AS (SELECT conv_id * 100 + turn AS id, len({_IDS.format(e="coalesce(text, '')")}) AS whole FROM conversations),
        u AS (SELECT id, whole, unnest(range(greatest(0, (whole - 1) // 512) + 1)) AS piece FROM t), {_nextfit_sql("SELECT id * 10000 + piece AS piece_id, least(512, whole - 512 * piece) AS n FROM u", "piece_id", False)}
        SELECT 'all' AS shard, piece_id, block, place FROM placed""",
    "example_packing": f"""WITH RECURSIVE c AS (SELECT conv_id, list(text ORDER BY turn) AS x FROM conversations GROUP BY 1),
        d AS (SELECT conv_id, {_IDS.format(e="array_to_string(x, ' ')")} AS f, {_IDS.format(e="array_to_string(x[1:len(x) - 1], ' ')")} AS p FROM c),
        a AS (SELECT conv_id, p, f[len(p) + 1:][1:416] AS a FROM d WHERE len(f) > len(p)),
        x AS (SELECT conv_id, list_concat(p[greatest(len(p) - (512 - len(a)), 0) + 1:], a) AS ids, len(a) AS k, 1.0 + conv_id % 3 AS weight FROM a),
        {_nextfit_sql("SELECT conv_id, ids, k, weight, len(ids) AS n FROM x", "md5('0|' || conv_id), conv_id", True)},
        b AS (SELECT block, CAST(sum(n) AS INTEGER) AS valid, CAST(sum(k) AS INTEGER) AS learned, count(*) AS samples, sum(weight)::DOUBLE AS sample_weight, flatten(list(ids ORDER BY i)) AS l FROM placed GROUP BY block)
        SELECT 'all' AS shard, block, valid, learned, samples, sample_weight, md5(array_to_string(list_concat(l, CASE WHEN block = max(block) OVER () THEN list_transform(range(512 - valid), lambda z: 0) ELSE [] END), ',')) AS ids_md5 FROM b""",
    "base_hash_check": "SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS sha256 FROM documents",
    "lr_schedule": "SELECT s AS step, round(CASE WHEN s < 100 THEN s / 100.0 ELSE greatest(0, 0.5 * (1 + cos(pi() * least(1.0, (s - 100) / 900.0)))) END, 9)::DOUBLE AS factor FROM range(0, 1001) t(s)",
    "checkpoint_retention": "SELECT s AS step, row_number() OVER (ORDER BY s DESC) <= 3 OR s % 500 = 0 AS kept FROM range(50, 2050, 50) t(s)",
    "moving_loss": "SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS recent_mean FROM events",
    "resume_antijoin": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "sha_manifest": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS INTEGER) AS bytes, sha256(coalesce(text, '')) AS sha256 FROM documents",
}
