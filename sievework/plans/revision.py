"""Queries of assembled revisions and of packets, over inputs made from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.sentences import Anchors, stripped
from sievework.functions import cleaning as C
from sievework.functions.sentences import sentences
from sievework.operators import assembly as A
from sievework.operators import packets as K
from sievework.operators import retrieval as R
from sievework.operators.evidence import FAMILY_WORDS
from sievework.plans.tables import evidence_docs, load, questions
from sievework.sources.publish import published
from sievework.sources.work import folder, table


def _mostly(usual: str, others: tuple[str, ...], number: Column, every: int) -> Column:
    """`usual`, but for each `every`th number one of the others."""
    return F.when(number % every == 0, F.element_at(F.array(*[F.lit(o) for o in others]), (F.floor(number / every) % len(others) + 1).cast("int"))).otherwise(usual)


def assembly_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Queries, packets, proposals and reviews: each assistant turn is a base answer, its conversation the evidence.

    Each of its anchors has a candidate; of ten, one has no review. Some repeat their anchor or the answer, bring numbers, or are blank.
    """
    talk = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", stripped(F.coalesce("text", F.lit(""))).alias("text"))
    per = talk.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n- ").alias("evidence"))
    answers = talk.filter("role = 'assistant' and text <> ''").withColumn("query_id", F.col("conv_id") * 100 + F.col("turn"))
    n = F.col("query_id")
    said = lambda prefix: F.concat(F.lit(prefix), n.cast("string"))
    queries = answers.join(per, "conv_id").select(
        "query_id", n.alias("selection_order"), said("B").alias("benchmark_id"), F.when(F.col("conv_id") % 2 == 0, "E").otherwise("S").alias("condition_id"), said("CH").alias("challenge_id"), said("Q").alias("question_id"),
        F.lit("open").alias("task_type"), "question", F.col("text").alias("base_answer"), F.sha2("text", 256).alias("base_answer_sha256"), F.lit("m").alias("base_model_id"),
    )
    packets = answers.join(per, "conv_id").select("query_id", F.concat(F.lit("## Turns\n- "), F.col("evidence")).alias("model_facing_evidence"), F.lit(1).alias("selected_evidence_count"), F.array(F.lit("E001")).alias("selected_evidence_ids"), F.when(n % 31 == 0, 1).otherwise(0).alias("target_article_exact_hit_count"))
    anchors = queries.select("query_id", "base_answer").lateralJoin(Anchors(F.col("base_answer").outer())).withColumn("h", F.pmod(F.xxhash64("query_id", "anchor_id"), F.lit(1_000_003)))
    h = F.col("h")
    text = (
        F.when(h % 17 == 0, F.col("anchor_text"))
        .when(h % 17 == 1, F.concat(F.lit(" "), F.substring("base_answer", 1, 40)))
        .when(h % 17 == 2, F.concat(F.lit("It holds at "), (h % 9).cast("string"), F.lit(" mm.")))
        .when(h % 17 == 3, " ")
        .otherwise(F.concat(F.lit("A matched control tests claim "), F.upper(F.conv(h.cast("string"), 10, 16)).substr(-3, 3), F.lit(" of it.")))
    )
    candidate = F.struct(
        F.concat(F.lit("C"), F.substring("anchor_id", 2, 9)).alias("candidate_id"), F.concat(F.lit("O"), (h % 7).cast("string")).alias("obligation_id"), _mostly("APPEND_AFTER_ANCHOR", ("REPLACE_ANCHOR",), h, 3).alias("operation"),
        F.when(h % 29 == 0, "S999").otherwise(F.col("anchor_id")).alias("target_anchor_id"), text.alias("revised_text"), F.when(h % 23 == 0, F.array(F.lit("E001"), F.lit("E999"))).otherwise(F.array(F.lit("E001"))).alias("evidence_chunk_ids"),
    )
    review = F.struct(
        candidate["candidate_id"].alias("candidate_id"), _mostly("ACCEPT", ("REJECT", "ACCEPT_AFTER_DOWNGRADE"), h, 5).alias("decision"), _mostly("FILLS_MISSING_OBLIGATION", tuple(A.P.PRIORITIES), h, 4).alias("necessity"),
        _mostly("GENERAL_DOMAIN_KNOWLEDGE", ("TARGET_OBSERVATION", "EXTERNAL_PRECEDENT", "HYPOTHESIS"), h, 6).alias("evidence_role"), _mostly("MATCH", ("PARTIAL_MATCH", "UNKNOWN", "MISMATCH"), h, 7).alias("target_system_match"),
        _mostly("EXPLICIT", ("ABSENT",), h, 8).alias("prompt_support"), _mostly("PASS", ("FAIL",), h, 19).alias("constraint_check"), F.lit("OBSERVED").alias("claim_strength"), _mostly("HIGH", ("MEDIUM", "LOW", "REDUNDANT"), h, 9).alias("novel_information"),
        F.when(h % 5 == 0, F.when(h % 10 == 5, " A bounded claim. ").otherwise("")).otherwise("").alias("bounded_revision"), F.when(h % 37 == 0, "").otherwise("gain").alias("obligation_gain"), F.lit("fits").alias("evidence_compatibility"),
        (h % 41 != 0).alias("constraint_preserved"), F.when(h % 11 == 0, F.array(F.lit("DEVICE_STACK_MISMATCH"))).when(h % 11 == 1, F.array(F.lit("OVERSTRONG_CAUSAL_CLAIM"))).otherwise(F.array().cast("array<string>")).alias("risk_flags"), F.array().cast("array<string>").alias("reason_codes"),
    )
    each = anchors.select("query_id", "anchor_id", candidate.alias("c"), F.when(h % 10 != 9, review).alias("r"))
    listed = lambda c, name: F.transform(F.array_sort(F.collect_list(F.struct("anchor_id", F.col(c).alias("x")))), lambda y: y["x"]).alias(name)
    proposals = each.groupBy("query_id").agg(listed("c", "valid_candidates"))
    reviews = each.groupBy("query_id").agg(listed("r", "l")).select("query_id", F.array(F.lit("one control")).alias("explicit_constraints"), F.filter("l", lambda x: x.isNotNull()).alias("candidate_reviews"))
    return queries, packets, proposals, reviews


def revision_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions and audit of an assembled and published revision, one row for each base answer."""
    path = folder(spark, "revision")
    # The assembly reads its inputs many times: they are made once.
    A.assemble(spark, *[table(df, "assembly-input") for df in assembly_inputs(spark, sf_dir)], path)
    told = published(spark, path, "audit").select("query_id", "raw_answer_sha256", "eligible_before_budget", "final_words", F.size("removed_exact_duplicate_sentences").alias("removed"), F.array_join(F.transform("assembly_actions", lambda a: a["candidate_id"]), ",").alias("actions"))
    reasons = published(spark, path, "candidates").select("query_id", F.array_join(F.transform("candidates", lambda c: F.array_join(c["gate_reasons"], ",")), ";").alias("reasons"))
    found = published(spark, path, "predictions").select("query_id", "condition_id", "proposed_patch_count", "accepted_patch_count", "changed", "final_answer_sha256")
    return found.join(told, "query_id").join(reasons, "query_id")


def packet_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Questions, their 40 documents by BM25 (filled up by the least ids), these as candidates, and sentences of English documents as records."""
    docs, asked = evidence_docs(spark, sf_dir), questions(spark, sf_dir)
    found = R.bm25(docs, asked, "doc_id", "item_id", K.PAPERS).select("item_id", "doc_id", "rank")
    fill = asked.select("item_id").join(docs.orderBy("doc_id").limit(K.PAPERS).select("doc_id"), how="cross").select("item_id", "doc_id", (F.lit(K.PAPERS) + 1).alias("rank"))
    both = found.unionByName(fill).groupBy("item_id", "doc_id").agg(F.min("rank").alias("r"))
    ranking = R.ranked(both, ["item_id"], [F.asc("r"), F.asc("doc_id")], K.PAPERS).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("core_id"), "rank")
    whole = load(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    i = F.col("core_id")
    pool = ranking.select("query_id", "core_id").join(whole.withColumnRenamed("doc_id", "core_id"), "core_id").select("query_id", "core_id", F.concat(F.lit("Study "), i.cast("string")).alias("title"), F.col("source").alias("journal"), (2000 + F.col("n_chars") % 25).alias("year"), F.col("text").alias("scientific_evidence"))
    each = whole.filter("lang = 'en'").select(F.col("doc_id").alias("core_id"), F.posexplode(sentences(F.col("text"))).alias("place", "text"))
    p = F.col("place")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    records = each.select(
        "core_id", F.concat(pick(C.DIRECT_MARKERS, p), F.lit("_"), i.cast("string"), F.lit("_"), p.cast("string")).alias("record_id"), pick(("atomic_unit", "Atomic", "parent"), i + p).alias("kind"), pick((*C.DIRECT_GROUPS, "lineage"), p).alias("evidence_group"),
        F.lit("").alias("title"), F.lit("{}").alias("routing"), "text", F.length("text").alias("value"),
    )
    family = F.element_at(F.array(*[F.lit(f) for f in FAMILY_WORDS]), (F.col("item_id") % len(FAMILY_WORDS) + 1).cast("int"))
    return asked.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"), family.alias("family")), ranking, pool, records


def packet_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items that the questions' packets show, by their numbers."""
    found = K.built(*packet_inputs(spark, sf_dir))["registry"]
    return found.select("number", "query_id", "rank", "core_id", "evidence_label", "record_id", F.sha2("text", 256).alias("sha256"))


def packet_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's packet, with the numbers of its first and last item and its papers of each level."""
    made = K.built(*packet_inputs(spark, sf_dir))
    per = made["map"].groupBy("query_id").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count_if(F.col("evidence_level") == "science_rag_core").alias("deep"))
    return made["packets"].join(per, "query_id").select("query_id", "cards", "first", "last", "deep", "n_chars", F.sha2("packet", 256).alias("sha256"))


QUERIES = {f.__name__: f for f in (revision_assembly, packet_registry, packet_cards)}
ORACLE_SQL: dict[str, str] = {}
