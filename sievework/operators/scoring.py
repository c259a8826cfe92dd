"""Scoring of text answers against references, key points and support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.similarity import coverage, term_cosine, token_f1
from sievework.functions.tokens import feature_tokens, numbers, specific_terms, strict_tokens

# Words that mark reasoning, by scorer.
STRICT_MARKERS = "because therefore thus whereas while contrast compared indicates suggests supports mechanism trade tradeoff rather however thereby leads causes consistent explains".split()
FEATURE_MARKERS = "because therefore thus whereas while contrast compared indicates suggests supports mechanism however thereby leads causes consistent explains rather not instead".split()
# Weights and full marks of the component row.
WEIGHTS = {"adequacy": 0.20, "rubric": 0.20, "precision": 0.40, "decision": 0.20}
KEY_FULL, CLAIM_FULL, PRECISION_FULL, DECISION_FULL, KEY_MISSING, MASTERY = 0.50, 0.36, 0.72, 0.50, 0.18, 0.80
#: The six inputs of an item's score.
COMPONENTS = ("adequacy", "rubric", "decision", "precision", "gate", "missing")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def round_half(x: Column) -> Column:
    """To the nearest half, ties to the even one, within 0 to 4."""
    return clamp(F.bround(x * 2, 0) / 2, 0.0, 4.0)


def safe_double(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def missing_cap(missing: Column) -> Column:
    return F.when(missing >= 3, 50.0).when(missing == 2, 70.0).when(missing == 1, 85.0).otherwise(100.0)


def item_score(adequacy: Column, rubric: Column, decision: Column, precision: Column, gate: Column, missing: Column) -> Column:
    """An item's score from its six components: capped by missing keys, at most 20 below the plain mean."""
    plain = (adequacy + 100 * rubric + 100 * decision) / 3
    scaled = plain * F.sqrt(clamp(gate)) * F.sqrt(clamp(precision / 0.75))
    return F.round(F.greatest(F.least(scaled, missing_cap(missing)), plain - 20.0), 6)


def component_fault(adequacy: Column, rubric: Column, decision: Column, precision: Column, gate: Column, missing: Column) -> Column:
    """Why components can't be scored, or null."""
    every = (adequacy, rubric, decision, precision, gate, missing)
    infinite = F.lit(False)
    for c in every:
        infinite = infinite | c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    outside = F.lit(False)
    for c in (rubric, decision, precision, gate):
        outside = outside | ~c.between(0, 1)
    return (
        F.when(infinite, "not_finite")
        .when(~adequacy.between(0, 100), "adequacy_out_of_range")
        .when(outside, "component_out_of_range")
        .when((missing != F.floor(missing)) | ~missing.between(0, 4), "missing_count_not_0_to_4")
    )


def quality_label(x: Column, strong: float, adequate: float, weak: float) -> Column:
    return F.when(x >= strong, "strong").when(x >= adequate, "adequate").when(x >= weak, "weak").otherwise("absent")


def strict_key_points(keys: Column, answer_tokens: Column) -> Column:
    """For each key point: its coverage, credit and value."""

    def one(key: Column) -> Column:
        words, nums = F.array_distinct(strict_tokens(key)), numbers(key, caret=True)
        share = coverage(words, answer_tokens)
        bonus = F.when(F.size(nums) == 0, 0.0).when(F.size(F.array_intersect(nums, answer_tokens)) > 0, 0.15).otherwise(-0.10)
        value = clamp(share + bonus)
        full = (value >= 0.56) | ((F.size(words) <= 3) & (value >= 0.67))
        credit = F.when(full, "full").when(value >= 0.30, "partial").otherwise("none")
        return F.struct(F.round(share, 4).alias("overlap"), credit.alias("credit"), F.when(full, 1.0).when(value >= 0.30, 0.5).otherwise(0.0).alias("value"))

    return F.transform(keys, one)


def _mean(values: Column, field: str | None = None) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x[field] if field else x))
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(0.0)


def strict_scores(rows: DataFrame, answer: str, reference: str, support: str, keys: str) -> DataFrame:
    """`rows` with the strict score (0 to 4 by halves), its parts, flags and labels. Null texts are empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    points = F.coalesce(F.col(keys), F.array().cast("array<string>"))
    joined = F.array_join(points, " ")
    base = rows.withColumns({"__a": strict_tokens(text(answer)), "__r": strict_tokens(text(reference)), "__s": strict_tokens(text(support))})
    base = base.withColumns({"key_points": strict_key_points(points, F.col("__a"))})
    base = base.withColumns(
        {
            "key_fraction": _mean(F.col("key_points"), "value"),
            "reference_cosine": term_cosine(F.col("__a"), F.col("__r")),
            "reference_coverage": coverage(F.col("__r"), F.col("__a")),
            "source_coverage": coverage(F.col("__s"), F.col("__a")),
            "specific_coverage": coverage(specific_terms(F.concat_ws(" ", text(reference), text(support), joined), caret=True), specific_terms(text(answer), caret=True)),
            "numeric_coverage": coverage(numbers(F.concat_ws(" ", text(reference), joined), caret=True), numbers(text(answer), caret=True)),
            "answer_tokens": F.size("__a"),
            "markers": F.size(F.array_intersect(F.array(*[F.lit(m) for m in STRICT_MARKERS]), F.col("__a"))),
        }
    )
    n, m, k = F.col("answer_tokens"), F.col("markers"), F.col("key_fraction")
    base = base.withColumns(
        {
            "evidence_signal": F.greatest(F.col("specific_coverage"), 0.65 * F.col("source_coverage") + 0.35 * F.col("numeric_coverage")),
            "reasoning": F.when((n >= 50) & (m >= 2), 0.4).when((n >= 35) & (m >= 1), 0.3).when(n >= 20, 0.2).otherwise(0.0),
        }
    )
    signal = F.greatest(F.least(F.col("reference_cosine") / 0.45, F.lit(1.0)), F.least(F.col("reference_coverage") / 0.45, F.lit(1.0)))
    raw = 2.0 * k + 0.8 * signal + 0.8 * F.least(F.col("evidence_signal") / 0.45, F.lit(1.0)) + F.col("reasoning")
    rules = [
        ("very_short_answer_cap_1", n < 18, 1.0),
        ("low_key_point_coverage_cap_2", k < 0.25, 2.0),
        ("low_reference_alignment_cap_2", (F.col("reference_coverage") < 0.12) & (F.col("reference_cosine") < 0.18), 2.0),
        ("weak_article_specific_evidence_cap_2", (F.col("evidence_signal") < 0.08) & (k < 0.50), 2.0),
        ("empty_answer", F.regexp_replace(text(answer), r"(?U)\s+", "") == "", 0.0),
    ]
    cap = F.least(*[F.when(rule, limit).otherwise(4.0) for _, rule, limit in rules])
    base = base.withColumns({"raw_score": raw, "cap": cap, "flags": F.array_compact(F.array(*[F.when(rule, F.lit(flag)) for flag, rule, _ in rules]))})
    sure = F.least(k, F.greatest(F.col("reference_cosine"), F.col("reference_coverage")), F.greatest(F.col("evidence_signal"), F.lit(0.01)))
    return (
        base.withColumn("strict_score", round_half(F.least(F.col("raw_score"), F.col("cap"))))
        .withColumns({"evidence_quality": quality_label(F.col("evidence_signal"), 0.40, 0.24, 0.10), "reasoning_quality": quality_label(F.col("reasoning"), 0.4, 0.3, 0.2), "confidence": F.when((F.size("flags") > 0) | (sure < 0.12), "low").when(sure < 0.25, "medium").otherwise("high")})
        .withColumn("needs_review", (F.size("flags") > 0) | (F.col("strict_score") <= 2.5) | (F.col("confidence") != "high"))
        .drop("__a", "__r", "__s")
    )


def feature_key_points(keys: Column, answer: Column) -> Column:
    """For each key point: semantic coverage, whether its numbers are there, and its credit."""
    said, nums = feature_tokens(answer), numbers(answer)

    def one(key: Column) -> Column:
        words, own = F.array_distinct(feature_tokens(key)), numbers(key)
        share = coverage(words, said)
        fine = (F.size(own) == 0) | (F.size(F.array_intersect(own, nums)) > 0)
        half = (share >= 0.28) | ((F.size(words) <= 3) & (share >= 0.34))
        return F.struct(share.alias("share"), F.round(share, 4).alias("overlap"), fine.alias("numeric_ok"), F.when((share >= 0.50) & fine, 1.0).when(half, 0.5).otherwise(0.0).alias("value"))

    return F.transform(keys, one)


def answer_features(rows: DataFrame, answer: str, reference: str, support: str, keys: str) -> DataFrame:
    """`rows` with nine features of the answer, rounded to four decimals, and its key points as f_*."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    joined = F.concat_ws(" ", text(reference), F.array_join(F.col(keys), " "))
    base = rows.withColumns({"__a": feature_tokens(text(answer)), "__r": feature_tokens(joined), "__s": feature_tokens(text(support))})
    wanted = numbers(joined)
    return base.withColumns(
        {
            "f_key_points": feature_key_points(F.col(keys), text(answer)),
            "f_tokens": F.size("__a"),
            "f_ref_cosine": F.round(term_cosine(F.col("__a"), F.col("__r")), 4),
            "f_ref_coverage": F.round(coverage(F.col("__r"), F.col("__a")), 4),
            "f_source_coverage": F.round(coverage(F.col("__s"), F.col("__a")), 4),
            "f_specific_coverage": F.round(coverage(specific_terms(F.concat_ws(" ", joined, text(support))), specific_terms(text(answer))), 4),
            "f_numeric_coverage": F.round(coverage(wanted, numbers(text(answer)), empty=1.0), 4),
            "f_markers": F.size(F.array_intersect(F.array(*[F.lit(m) for m in FEATURE_MARKERS]), F.col("__a"))),
        }
    ).withColumn("f_key_fraction", F.round(_mean(F.col("f_key_points"), "value"), 4)).drop("__a", "__r", "__s")


def rescued(rows: DataFrame, answer: str, strict: str = "strict_score", strict_key: str = "key_fraction", flags: str = "flags") -> DataFrame:
    """`rows` of strict_scores() and answer_features() with the rescued score, at most half a point higher, and why."""
    s, n = F.col(strict), F.col("f_tokens")
    ref = F.greatest("f_ref_cosine", "f_ref_coverage")
    evidence = (F.col("f_specific_coverage") >= 0.25) | (F.col("f_numeric_coverage") >= 0.45) | (ref >= 0.42)
    aligned = (ref >= 0.38) | ((F.col("f_ref_cosine") >= 0.32) & (F.col("f_ref_coverage") >= 0.28))
    keyed = (F.col("f_key_fraction") >= 0.50) | (F.round(F.col(strict_key), 4) >= 0.50)
    broad = (n >= 45) & aligned & evidence & keyed
    high = (n >= 55) & (F.col("f_key_fraction") >= 0.65) & (ref >= 0.35) & evidence
    to3, to35 = (s <= 2.5) & broad, (s <= 3.0) & high
    target = F.greatest(s, F.when(to3, 3.0).otherwise(0.0), F.when(to35, 3.5).otherwise(0.0))
    new = round_half(F.least(target, s + 0.5))
    empty = (F.regexp_replace(F.coalesce(F.col(answer), F.lit("")), r"(?U)\s+", "") == "") | F.array_contains(flags, "empty_answer")
    short = (n < 22) | F.array_contains(flags, "very_short_answer_cap_1")
    reason = F.when(s >= 4.0, "already_4").when(empty, "no_rescue_empty").when(short, "no_rescue_short").when(new <= s, "no_rescue").when(to35, "v1_high_coverage_to_3_5").otherwise("v1_science_complete_to_3")
    score = F.when((s >= 4.0) | empty | short | (new <= s), s).otherwise(new)
    strong = high | (broad & (ref >= 0.45) & (F.col("f_specific_coverage") >= 0.35))
    return rows.withColumns({"rescued_score": score, "rescue_reason": reason, "strong_low_score": strong})


def claims(text: Column) -> Column:
    """Sentences of at least four feature tokens, the first of each token set."""
    boundary = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[.!?;])\s+|\n+", "\u0001")
    parts = F.filter(F.transform(F.split(boundary, "\u0001"), lambda s: F.struct(s.alias("claim"), feature_tokens(s).alias("t"))), lambda x: F.size(x["t"]) >= 4)
    keyed = F.transform(parts, lambda x: F.struct(x["claim"].alias("claim"), F.array_join(F.array_sort(F.array_distinct(x["t"])), " ").alias("key")))
    return F.aggregate(keyed, F.array().cast("array<struct<claim:string,key:string>>"), lambda acc, x: F.when(F.exists(acc, lambda y: y["key"] == x["key"]), acc).otherwise(F.concat(acc, F.array(x))), lambda acc: F.transform(acc, lambda y: y["claim"]))


def claim_support(answer: Column, gold: Column) -> Column:
    """Each claim's best token F1 with any gold claim, as a share of full support."""
    said = F.transform(gold, lambda g: F.array_distinct(feature_tokens(g)))

    def one(claim: Column) -> Column:
        own = F.array_distinct(feature_tokens(claim))
        best = F.coalesce(F.array_max(F.transform(said, lambda g: token_f1(own, g))), F.lit(0.0))
        return clamp(best / CLAIM_FULL)

    return F.transform(claims(answer), one)


def component_rows(rows: DataFrame, answer: str, reference: str, anchor: str, keys: str, accepted: str) -> DataFrame:
    """Component rows from texts: adequacy, rubric, precision, decision, gate, missing keys, and two scores.

    There must be four key points; other rows raise an error when they are read.
    """
    support = F.concat_ws("\n", F.when(F.trim(F.coalesce(F.col(anchor), F.lit(""))) != "", F.col(anchor)), F.concat(F.lit("Accepted equivalents: "), F.array_join(F.col(accepted), " | ")))
    checked = rows.withColumn("__support", support).filter(F.assert_true(F.size(keys) == 4, F.lit("four key points are expected")).isNull())
    scored = strict_scores(checked, answer, reference, "__support", keys)
    first = rescued(answer_features(scored, answer, reference, "__support", keys), answer)
    gold = F.concat(claims(F.col(reference)), F.col(keys), F.col(accepted), claims(F.col(anchor)))
    overlaps = F.transform(F.col("f_key_points"), lambda x: x["overlap"])
    with_claims = first.withColumns({"__claims": claim_support(F.col(answer), gold), "__overlaps": overlaps})
    raw = with_claims.withColumns(
        {
            "adequacy": F.round(25.0 * F.col("rescued_score"), 6),
            "rubric": F.round(_mean(F.transform("__overlaps", lambda x: clamp(x / KEY_FULL))), 6),
            "claim_mean": F.round(_mean(F.col("__claims")), 6),
            "precision": F.round(clamp(_mean(F.col("__claims")) / PRECISION_FULL), 6),
            "decision": F.round(clamp(F.element_at("__overlaps", -1) / DECISION_FULL), 6),
            "missing": F.size(F.filter("__overlaps", lambda x: x < KEY_MISSING)),
        }
    ).withColumn("gate", F.round(F.least(F.lit(1.0), F.col("adequacy") / 100 / MASTERY), 6))
    weighted = 100 * (WEIGHTS["adequacy"] * F.col("adequacy") / 100 + WEIGHTS["rubric"] * F.col("rubric") + WEIGHTS["precision"] * F.col("precision") + WEIGHTS["decision"] * F.col("decision"))
    soft = F.round(F.least(weighted * F.sqrt(clamp(F.col("gate"))), missing_cap(F.col("missing"))), 6)
    return raw.withColumns({"soft_gate_score": soft, "item_score": item_score(*[F.col(c) for c in COMPONENTS])}).drop("__support", "__claims", "__overlaps")


def exact_rows(predictions: DataFrame, references: DataFrame, supports: DataFrame, item: str, support: str) -> DataFrame:
    """Predictions with their reference and support record; each prediction must have exactly one of either.

    A prediction without a reference or support record, or with several, raises
    an error when it is read, as does a null id. An empty support text counts
    only if its record is there; a null text is no record.
    """
    gold = references.withColumn("__refs", F.count("*").over(Window.partitionBy(item)))
    told = supports.filter(F.col(support).isNotNull()).withColumn("__supports", F.count("*").over(Window.partitionBy(item)))
    met = predictions.join(gold, item, "left").join(told.select(item, support, "__supports"), item, "left")
    fault = (
        F.when(F.coalesce(F.trim(F.col(item).cast("string")), F.lit("")) == "", "an item needs an id")
        .when(F.col("__supports").isNull(), "an item has no support record")
        .when(F.col("__refs").isNull(), "an item has no reference")
        .when((F.col("__refs") > 1) | (F.col("__supports") > 1), "an item has several references or support records")
    )
    return met.filter(F.assert_true(fault.isNull(), fault).isNull()).drop("__refs", "__supports")


def mcq_accuracy(questions: DataFrame, predictions: DataFrame, position: str, expected: int) -> DataFrame:
    """Exact matches of options by position (from 1); any other number of rows or positions raises an error."""
    same = (F.upper(F.trim("predicted_option")) == F.upper(F.trim("correct_option"))).cast("long")
    met = questions.join(predictions, position, "full_outer")
    whole = (F.count("*") == expected) & (F.count("predicted_option") == expected) & (F.count("correct_option") == expected) & (F.min(position) == 1) & (F.max(position) == expected)
    counted = met.agg(F.count("*").alias("items"), F.sum(same).alias("correct"), whole.alias("whole"))
    return counted.filter(F.assert_true("whole", F.lit("positions must cover the questions once")).isNull()).select("items", "correct", (F.col("correct") / F.col("items")).alias("accuracy"))


def board(rows: DataFrame, model: str, score: str) -> DataFrame:
    return rows.groupBy(model).agg(F.count("*").alias("items"), F.avg(score).alias("arithmetic"), F.median(score).alias("median"))


def prediction_rows(answers: DataFrame, item: str, label: str, answer: str, route: str, finish: str) -> DataFrame:
    """Prediction records: the answer with its digest, route, and whether it was cut but kept."""
    text = F.coalesce(F.col(answer), F.lit(""))
    return answers.select(F.col(item).alias("benchmark_id"), F.lit(label).alias("model"), text.alias("answer"), F.sha2(text, 256).alias("answer_sha256"), F.col(route).alias("prompt_route"), F.col(finish).alias("finish_reason"), ((F.col(finish) == "length") & (F.trim(text) != "")).alias("nonempty_length_limited_retained"))
