"""Assembly of a revision: candidates are gated and budgeted, answers patched, and the outputs published together.

Inputs, one row a query each:

    queries     query_id, selection_order, benchmark_id, condition_id, challenge_id, question_id, task_type, question, base_answer, base_answer_sha256, base_model_id
    packets     query_id, model_facing_evidence, selected_evidence_count, selected_evidence_ids, target_article_exact_hit_count
    proposals   query_id, valid_candidates: an array of candidates
    reviews     query_id, explicit_constraints, candidate_reviews: an array of reviews

Outputs: candidates, predictions, audit, finalized (predictions in a folder for
each condition) and regressions, and a manifest with counts and digests.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.python import near_ratio
from sievework.functions.sentences import Anchors, deduplicated, evidence_chunks, split_at, stripped
from sievework.functions.tokens import compare_text, word_count
from sievework.operators import patches as P
from sievework.sources.publish import content, publish
from sievework.sources.work import table

# The folders of the conditions, and the review of a candidate that has none.
FOLDERS = {"E": "01_evidence_conditioned_main", "S": "02_sparse_information_extension"}
NO_REVIEW = {
    "decision": "REJECT",
    "necessity": "ELABORATION_ONLY",
    "evidence_role": "HYPOTHESIS",
    "target_system_match": "UNKNOWN",
    "prompt_support": "ABSENT",
    "constraint_check": "UNCERTAIN",
    "claim_strength": "SPECULATIVE",
    "novel_information": "LOW",
    "bounded_revision": "",
    "obligation_gain": "",
    "evidence_compatibility": "Verifier output was unusable; conservative rejection applied.",
}
MISSING_REVIEW = "MISSING_REVIEW_AT_ASSEMBLY"
# Risks that the gate itself finds, by the reason that says so.
FOUND_RISKS = {"G4_ONE_MAJOR_CHANGE_VIOLATION": "VIOLATES_EXPLICIT_INTERVENTION_CONSTRAINT", "G2_NEW_NUMERIC_DETAIL": "UNSUPPORTED_NUMERIC_DETAIL", "G5_OVERCOMMITTED_PATTERN": "OVERCOMMITTED_PREDICTION"}
#: Patches of an answer.
BUDGET = 2

REVIEW_FIELDS = (*NO_REVIEW, "constraint_preserved", "risk_flags", "reason_codes")


@dataclass(frozen=True)
class Regression:
    """What must hold for one query: its answer `contains` or `lacks` the phrases, or candidates with one exist and are all `rejected`."""

    name: str
    query_id: str
    kind: str
    phrases: tuple[str, ...]


# What earlier revisions got wrong.
REGRESSIONS = (
    Regression("E_EC07_Q2_matched_duration_control_retained", "S20E_S20-EC07_Q2", "contains", ("same total ambient time",)),
    Regression("E_EC09_Q4_contact_redesign_rejected", "S20E_S20-EC09_Q4", "rejected", ("stronger-contact redesign should be triggered",)),
    Regression("S_EC08_Q1_external_geometry_not_target_fact", "S20S_S20-EC08_Q1", "lacks", ("1.4 mm gap", "pressed fai")),
    Regression("S_EC07_Q4_overcommitted_nonmonotonic_rejected", "S20S_S20-EC07_Q4", "rejected", ("non-monotonic kinetic signature",)),
)


def repeated_ids(name: str, rows: DataFrame) -> DataFrame:
    again = rows.groupBy("query_id").agg(F.count("*").alias("n")).filter("n > 1")
    return again.select(F.lit(name).alias("input"), F.col("query_id").cast("string").alias("query_id"), F.lit("repeated").alias("fault"))


def uncovered(queries: DataFrame, inputs: dict[str, DataFrame]) -> DataFrame:
    """(input, query_id, fault): queries that an input lacks, and ids that the queries or an input have more than once."""
    found = repeated_ids("queries", queries)
    for name, rows in inputs.items():
        lacking = queries.join(rows, "query_id", "left_anti").select(F.lit(name).alias("input"), F.col("query_id").cast("string").alias("query_id"), F.lit("missing").alias("fault"))
        found = found.unionByName(lacking).unionByName(repeated_ids(name, rows.join(queries, "query_id", "left_semi")))
    return found


def gated_candidates(queries: DataFrame, anchors: DataFrame, packets: DataFrame, proposals: DataFrame, reviews: DataFrame) -> DataFrame:
    """A row for each candidate, with its review, its anchor's text, the text that would be used, and the gate's reasons.

    Candidates are numbered in their list's order (`place`). Of several reviews of
    one candidate the last counts; one without a review is rejected.
    """
    none = F.array().cast("array<string>")
    evidence = packets.select("query_id", F.transform(evidence_chunks(F.col("model_facing_evidence")), lambda x: x["id"]).alias("__known"), F.coalesce(F.col("target_article_exact_hit_count").cast("int"), F.lit(0)).alias("leak_count"))
    each = proposals.select("query_id", F.posexplode("valid_candidates").alias("place", "candidate"))
    told = reviews.select("query_id", F.posexplode("candidate_reviews").alias("__n", "review")).groupBy("query_id", F.col("review.candidate_id").cast("string").alias("__of")).agg(F.max_by("review", "__n").alias("review"))
    rows = each.withColumn("__of", F.coalesce(F.col("candidate.candidate_id").cast("string"), F.lit(""))).join(told, ["query_id", "__of"], "left")
    anchor = anchors.select("query_id", F.col("anchor_id").alias("__anchor"), "anchor_text")
    met = rows.join(queries.select("query_id", "question", "base_answer", "condition_id"), "query_id").join(evidence, "query_id")
    met = met.withColumn("__anchor", F.coalesce(F.col("candidate.target_anchor_id").cast("string"), F.lit(""))).join(anchor, ["query_id", "__anchor"], "left")
    absent = F.col("review").isNull()
    field = lambda n: F.when(absent, F.lit(NO_REVIEW[n])).otherwise(F.col(f"review.{n}")).alias(n)
    linked = F.coalesce(F.col("candidate.evidence_chunk_ids"), none)
    wide = met.select(
        "query_id", "place", "question", "base_answer", "condition_id", "leak_count", "anchor_text", "candidate.*",
        *[field(n) for n in NO_REVIEW],
        F.coalesce(F.col("review.constraint_preserved"), F.lit(False)).alias("constraint_preserved"),
        F.coalesce(F.col("review.risk_flags"), none).alias("risk_flags"),
        F.when(absent, F.array(F.lit(MISSING_REVIEW))).otherwise(F.coalesce(F.col("review.reason_codes"), none)).alias("reason_codes"),
        F.col("anchor_text").isNotNull().alias("anchor_known"),
        ((F.size(linked) > 0) & (F.size(F.array_except(linked, F.col("__known"))) == 0)).alias("evidence_ok"),
    )
    effective = stripped(F.coalesce(F.when(F.col("decision") == "ACCEPT_AFTER_DOWNGRADE", F.col("bounded_revision")).otherwise(F.col("revised_text")), F.lit("")))
    whole = F.transform(F.filter(split_at(F.col("base_answer"), r"(?U)(?<=[.!?])\s+"), lambda s: stripped(s) != ""), compare_text)
    close = wide.withColumn("effective_revised_text", effective).withColumn("__near", near_ratio(compare_text(F.col("effective_revised_text")), whole, P.NEAR))
    gated = close.withColumn("gate_reasons", P.gate_reasons(F.col("__near")))
    found = F.array_compact(F.array(*[F.when(F.array_contains("gate_reasons", reason), F.lit(risk)) for reason, risk in FOUND_RISKS.items()]))
    return gated.withColumn("risk_flags", F.array_sort(F.array_union("risk_flags", found))).withColumn("eligible_after_gates", P.eligible(F.col("gate_reasons"))).drop("__near", "anchor_known", "evidence_ok", "leak_count", "reason_codes", "question", "base_answer", "anchor_text")


def chosen_candidates(gated: DataFrame, most: int = BUDGET) -> DataFrame:
    """The gated candidates with `selected`: in order, one an obligation and an anchor, `most` a query; others say why not."""
    names = ["query_id", "place", "obligation_id", "target_anchor_id", "necessity", "decision", "target_system_match", "novel_information", "candidate_id"]
    light = gated.filter("eligible_after_gates").select(*names, F.lit(0).alias("added_words"))
    verdicts = P.budgeted(light, "query_id", P.order_key(), most).select("query_id", "place", "verdict")
    met = gated.join(verdicts, ["query_id", "place"], "left").withColumn("eligible_before_budget", F.col("eligible_after_gates"))
    selected = F.coalesce(F.col("verdict") == "selected", F.lit(False))
    why = F.when(F.col("verdict").isNotNull() & ~selected, F.array_sort(F.array_union("gate_reasons", F.array("verdict")))).otherwise(F.col("gate_reasons"))
    return met.withColumns({"gate_reasons": why, "selected_for_assembly": selected, "eligible_after_gates": selected}).drop("verdict")


def assembled(queries: DataFrame, packets: DataFrame, proposals: DataFrame, reviews: DataFrame, most: int = BUDGET) -> dict[str, DataFrame]:
    """The candidates, predictions and audit of all queries, one row each.

    A base answer of another digest than recorded, and an answer that is empty
    after assembly, raise an error when they are read. Candidates are gated once,
    into a table.
    """
    base = P.checked_base(queries, "query_id", "base_answer", "base_answer_sha256")
    anchors = base.select("query_id", "base_answer").lateralJoin(Anchors(F.col("base_answer").outer())).drop("base_answer")
    gated = table(gated_candidates(base, anchors, packets, proposals, reviews), "assembly-gated")
    each = table(chosen_candidates(gated, most), "assembly-candidates")
    used = each.filter("selected_for_assembly")
    patches = used.select("query_id", "target_anchor_id", "candidate_id", "operation", F.col("effective_revised_text").alias("revised_text"))
    raw = table(P.applied(base.select("query_id", "base_answer"), anchors, patches, "query_id", "base_answer").select("query_id", F.col("revised_answer").alias("raw")), "assembly-answers")
    clean = deduplicated(raw, "query_id", "raw").withColumnRenamed("text", "final_answer")
    # Actions in the order of the answer: by the place of the anchor.
    act = F.struct("start", F.struct("candidate_id", "obligation_id", "target_anchor_id", "operation", F.col("decision").alias("verifier_decision")).alias("action"))
    placed = used.join(anchors.select("query_id", F.col("anchor_id").alias("target_anchor_id"), "start", "end"), ["query_id", "target_anchor_id"])
    gain = F.length("effective_revised_text") + F.when(F.col("operation") == "APPEND_AFTER_ANCHOR", 1).otherwise(F.col("start") - F.col("end"))
    actions = placed.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(act)), lambda x: x["action"]).alias("assembly_actions"), F.sum(gain).alias("patch_chars"))
    listed = each.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(*[c for c in each.columns if c not in ("query_id", "place", "condition_id", "eligible_before_budget")]).alias("c")))), lambda x: x["c"]).alias("candidates"),
        F.count_if("eligible_before_budget").alias("eligible_before_budget"),
    )
    text = F.coalesce("final_answer", F.lit(""))
    met = base.join(raw, "query_id").join(clean, "query_id", "left").join(listed, "query_id", "left").join(actions, "query_id", "left")
    met = met.join(packets.select("query_id", "selected_evidence_count", "selected_evidence_ids"), "query_id").join(reviews.select("query_id", "explicit_constraints"), "query_id")
    filled = F.when(text != "", text).otherwise(F.raise_error(F.concat(F.col("query_id").cast("string"), F.lit(": empty assembled answer"))).cast("string"))
    candidates = F.coalesce("candidates", F.array().cast(listed.schema["candidates"].dataType))
    selected = F.filter(candidates, lambda c: c["selected_for_assembly"])
    met = met.withColumns(
        {
            "final_answer": filled,
            "candidates": candidates,
            "accepted_patches": selected,
            "selected_candidate_ids": F.array_sort(F.transform(selected, lambda c: c["candidate_id"].cast("string"))),
            "removed_sentences": F.coalesce("removed", F.array().cast("array<string>")),
            "assembly_actions": F.coalesce("assembly_actions", F.array().cast(actions.schema["assembly_actions"].dataType)),
        }
    )
    met = table(met.withColumn("final_answer_sha256", F.sha2("final_answer", 256)), "assembly")
    proposed, accepted = F.size("candidates"), F.size("accepted_patches")
    head = ["selection_order", "query_id", "condition_id"]
    return {
        "candidates": met.select(*head, "explicit_constraints", "candidates", "selected_candidate_ids"),
        "predictions": met.select(
            *head, "benchmark_id", "challenge_id", "question_id", "task_type", F.col("base_model_id").alias("concrete_model_id"), "base_answer_sha256", "selected_evidence_count", "selected_evidence_ids", F.lit(0).alias("target_article_exact_hit_count"),
            proposed.alias("proposed_patch_count"), accepted.alias("accepted_patch_count"), "accepted_patches", F.size("removed_sentences").alias("removed_exact_duplicate_sentence_count"), "final_answer", "final_answer_sha256",
            (F.col("final_answer") != F.col("base_answer")).alias("changed"), F.lit(False).alias("reference_or_rubric_read"), F.lit("COMPLETE").alias("status"), F.lit("").alias("error"),
        ),
        "audit": met.select(
            *head, "base_answer_sha256", F.sha2("raw", 256).alias("raw_answer_sha256"), "final_answer_sha256", proposed.alias("proposed"), "eligible_before_budget", accepted.alias("accepted"), "selected_candidate_ids", "assembly_actions",
            F.col("removed_sentences").alias("removed_exact_duplicate_sentences"), word_count(F.col("base_answer")).alias("base_words"), word_count(F.col("final_answer")).alias("final_words"), F.length("base_answer").alias("base_chars"), F.length("raw").alias("raw_chars"), F.coalesce("patch_chars", F.lit(0)).alias("patch_chars"),
        ),
    }


def regressions(predictions: DataFrame, candidates: DataFrame, checks: tuple[Regression, ...] = REGRESSIONS) -> DataFrame:
    """(name, passed) of the checks whose queries were assembled."""
    spark = predictions.sparkSession
    rows = spark.createDataFrame([(c.name, c.query_id, c.kind, list(c.phrases)) for c in checks], "name string, query_id string, kind string, phrases array<string>")
    has = lambda text: F.exists("phrases", lambda p: F.contains(F.lower(F.coalesce(text, F.lit(""))), p))
    named = lambda df, *columns: df.select(F.col("query_id").cast("string").alias("query_id"), *columns)
    met = rows.join(named(predictions, "final_answer"), "query_id").join(named(candidates, "candidates"), "query_id")
    of = F.filter("candidates", lambda c: has(c["revised_text"]))
    rejected = (F.size(of) > 0) & ~F.exists(of, lambda c: c["selected_for_assembly"])
    return met.select("name", F.when(F.col("kind") == "rejected", rejected).when(F.col("kind") == "contains", has(F.col("final_answer"))).otherwise(~has(F.col("final_answer"))).alias("passed"))


def crossed(stored: dict[str, DataFrame], queries: DataFrame) -> DataFrame:
    """(query_id, fault): where the stored outputs contradict each other, the queries, or what patches may change."""
    keyed = lambda df, name, *columns: df.select(F.col("query_id").alias("id"), F.lit(1).alias(name), *columns)
    p = keyed(stored["predictions"], "p", "proposed_patch_count", "accepted_patches", "final_answer", F.col("final_answer_sha256").alias("final_p"), F.col("base_answer_sha256").alias("base_p"))
    a = keyed(stored["audit"], "a", F.col("final_answer_sha256").alias("final_a"), "raw_answer_sha256", "accepted", "base_chars", "raw_chars", "patch_chars", F.col("selected_candidate_ids").alias("ids_a"))
    c = keyed(stored["candidates"], "c", F.size("candidates").alias("n"), F.col("selected_candidate_ids").alias("ids_c"))
    q = keyed(queries, "q", F.col("base_answer_sha256").alias("base_q"))
    per = q
    for other in (p, a, c):
        per = per.join(other, "id", "full_outer")
    counted = per.groupBy("id").agg(F.count("*").alias("rows"), F.bool_or(F.col("q").isNull() | F.col("p").isNull() | F.col("a").isNull() | F.col("c").isNull()).alias("lone"))
    rows = counted.filter((F.col("rows") > 1) | F.col("lone")).select(F.col("id").cast("string").alias("query_id"), F.lit("rows").alias("fault"))
    fault = (
        F.when(F.col("base_p") != F.col("base_q"), "base")
        .when((F.col("final_p") != F.col("final_a")) | (F.sha2("final_answer", 256) != F.col("final_p")), "digest")
        .when((F.col("proposed_patch_count") != F.col("n")) | (F.size("accepted_patches") != F.col("accepted")) | (F.col("ids_a") != F.col("ids_c")) | (F.size("ids_c") != F.col("accepted")), "counts")
        # Without a patch the answer before removals is the base; with patches it has grown by just what they bring.
        .when((F.col("accepted") == 0) & (F.col("raw_answer_sha256") != F.col("base_q")), "unpatched")
        .when(F.col("raw_chars") != F.col("base_chars") + F.col("patch_chars"), "outside patches")
    )
    wrong = per.filter("not (q is null or p is null or a is null or c is null)").select(F.col("id").cast("string").alias("query_id"), fault.alias("fault")).filter("fault is not null")
    final = stored["finalized"].select("query_id", "final_answer_sha256")
    expected = stored["predictions"].filter(F.col("condition_id").isin(*FOLDERS)).select("query_id", "final_answer_sha256")
    apart = expected.exceptAll(final).unionByName(final.exceptAll(expected)).select(F.col("query_id").cast("string").alias("query_id"), F.lit("finalized").alias("fault"))
    return rows.unionByName(wrong).unionByName(apart)


def _facts(stored: dict[str, DataFrame], inputs: dict[str, DataFrame], most: int) -> dict:
    """What the manifest says of a run: counts, reasons, checks, and digests of the inputs; each is a small aggregate."""
    p = stored["predictions"].agg(
        F.count("*").alias("questions"),
        F.coalesce(F.sum("proposed_patch_count"), F.lit(0)).alias("proposed_candidates"),
        F.coalesce(F.sum("accepted_patch_count"), F.lit(0)).alias("accepted_patches"),
        F.count_if("changed").alias("answers_changed"),
        F.count_if(~F.col("changed")).alias("answers_unchanged"),
        F.coalesce(F.sum("removed_exact_duplicate_sentence_count"), F.lit(0)).alias("removed_exact_duplicate_sentences"),
    )
    words = stored["audit"].agg(F.avg("base_words").alias("mean_base_words"), F.avg("final_words").alias("mean_final_words"))
    conditions = {r["condition_id"]: r["n"] for r in stored["predictions"].groupBy("condition_id").agg(F.count("*").alias("n")).orderBy("condition_id").collect()}
    rejected = stored["candidates"].select(F.explode("candidates").alias("c")).filter("not c.selected_for_assembly")
    given = F.when(F.size("c.gate_reasons") > 0, F.col("c.gate_reasons")).otherwise(F.array(F.lit("UNSPECIFIED_REJECTION")))
    counts = P.reason_counts(rejected.select(_counted(given).alias("reasons")), "reasons")
    checks = {r["name"]: r["passed"] for r in stored["regressions"].collect()}
    return {
        "status": "PASS" if all(checks.values()) else "FAIL",
        **p.first().asDict(),
        **words.first().asDict(),
        "condition_counts": {str(k): v for k, v in conditions.items()},
        "rejection_reason_counts": {r["reason"]: r["n"] for r in counts.collect()},
        "patch_budget": most,
        "one_patch_per_obligation": True,
        "regression_checks": checks,
        "source_digests": {name: content(df).first()["digest"] for name, df in inputs.items()},
    }


def _counted(reasons: Column) -> Column:
    """The reasons that count against a candidate: its budget verdict alone if it passed the gates."""
    late = F.filter(reasons, lambda r: r.startswith("G7_"))
    return F.when(F.size(late) > 0, late).otherwise(reasons)


def assemble(spark: SparkSession, queries: DataFrame, packets: DataFrame, proposals: DataFrame, reviews: DataFrame, path: str, checks: tuple[Regression, ...] = REGRESSIONS, most: int = BUDGET) -> int:
    """Assembles all queries and publishes the outputs under `path` as one version, whose number is returned.

    An input that lacks a query or has one twice is an error before anything is
    written, and outputs that contradict each other are one before anything is
    published. A failing regression check doesn't stop it: the manifest's status is FAIL.
    """
    inputs = {"packets": packets, "proposals": proposals, "reviews": reviews}
    if lacking := [tuple(r) for r in uncovered(queries, inputs).take(5)]:
        raise ValueError(f"assembly inputs don't cover the queries: {lacking}")
    made = assembled(queries, packets, proposals, reviews, most)
    folder = F.create_map(*[F.lit(x) for pair in FOLDERS.items() for x in pair])[F.col("condition_id")]
    made["finalized"] = made["predictions"].filter(F.col("condition_id").isin(*FOLDERS)).withColumn("folder", folder)
    made["regressions"] = regressions(made["predictions"], made["candidates"], checks)
    return publish(spark, path, made, lambda stored: crossed(stored, queries), lambda stored: _facts(stored, {"queries": queries} | inputs, most), {"finalized": ["folder"]})
