"""Ranking data and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.prefix import running_sum
from sievework.operators.retrieval import ranked
from sievework.sources.work import table


def valid_groups(rows: DataFrame, query: str, candidate: str, text: str, grade: str) -> DataFrame:
    """Per query: candidates, grade levels, and the first reason why it can't be ranked, if any."""
    per = rows.groupBy(query).agg(
        F.count("*").alias("candidates"),
        F.count_distinct(candidate).alias("__distinct"),
        F.count_distinct(text).alias("__texts"),
        F.count_distinct(grade).alias("grade_levels"),
        F.count_if(~F.col(grade).between(0, 3) | F.col(grade).isNull()).alias("__outside"),
    )
    reason = (
        F.when(F.col("__distinct") < F.col("candidates"), "duplicate_candidate")
        .when(F.col("__texts") > 1, "inconsistent_query")
        .when(F.col("__outside") > 0, "grade_out_of_range")
        .when(F.col("grade_levels") < 2, "one_grade_level")
    )
    return per.select(query, "candidates", "grade_levels", reason.alias("reason"))


def placed(rows: DataFrame, query: str, score: str, grade: str, tie: str) -> DataFrame:
    """Each candidate's rank by score and by grade within its query."""
    by = lambda *o: F.row_number().over(Window.partitionBy(query).orderBy(*o))
    return rows.withColumn("rank", by(F.desc(score), F.asc(tie))).withColumn("ideal_rank", by(F.desc(grade), F.asc(tie)))


def _gain(grade: Column, rank: Column, k: int) -> Column:
    return F.sum(F.when(rank <= k, (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)).otherwise(0.0))


def ranking_metrics(rows: DataFrame, query: str, score: str, grade: str, tie: str, k: int = 10, padded: bool = True) -> DataFrame:
    """Precision of useful (2 or more) and direct (3) candidates, success, mean grade and nDCG at k, per query.

    Padded: divided by k, and nDCG is 1 where no gain is possible. Otherwise
    divided by the candidates there are, at most k, and nDCG is 0 there.
    """
    top = placed(rows, query, score, grade, tie)
    g, r = F.col(grade), F.col("rank")
    at = F.lit(float(k)) if padded else F.least(F.lit(float(k)), F.count("*"))
    share = lambda least: F.sum(((r <= k) & (g >= least)).cast("double")) / at
    per = top.groupBy(query).agg(
        share(2).alias("useful_precision"),
        share(3).alias("direct_precision"),
        F.max(((r <= k) & (g >= 3)).cast("double")).alias("success"),
        (F.sum(F.when(r <= k, g.cast("double")).otherwise(0.0)) / at).alias("mean_grade"),
        _gain(g, r, k).alias("__dcg"),
        _gain(g, F.col("ideal_rank"), k).alias("__ideal"),
    )
    ndcg = F.when(F.col("__ideal") > 0, F.col("__dcg") / F.col("__ideal")).otherwise(F.lit(1.0 if padded else 0.0))
    return per.withColumn("ndcg", ndcg).drop("__dcg", "__ideal")


def source_recall(rows: DataFrame, query: str, score: str, grade: str, tie: str, at: tuple[int, ...] = (1, 5, 10, 20, 40)) -> DataFrame:
    """Whether each query's first grade of 3 is among the first k, and its reciprocal rank."""
    first = placed(rows, query, score, grade, tie).groupBy(query).agg(F.min(F.when(F.col(grade) >= 3, F.col("rank"))).alias("first"))
    return first.select(query, *[F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0)).alias(f"recall_{k}") for k in at], F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def macro_mean(per_query: DataFrame, query: str) -> DataFrame:
    metrics = [c for c in per_query.columns if c != query]
    return per_query.agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in metrics])


def dataset_summary(rows: DataFrame, query: str, grade: str, family: str, confidence: str) -> DataFrame:
    """One row: counts of queries, rows, grades (rounded half to even) and families, and confidence."""
    level = F.bround(F.col(grade).cast("double"), 0)
    return rows.agg(
        F.count_distinct(query).alias("queries"),
        F.count("*").alias("candidates"),
        *[F.count_if(level == g).alias(f"grade_{g}") for g in range(4)],
        F.count_distinct(family).alias("families"),
        F.min(confidence).alias("confidence_min"),
        F.avg(confidence).alias("confidence_mean"),
        F.max(confidence).alias("confidence_max"),
    )


def lambda_loss(rows: DataFrame, query: str, candidate: str, score: str, grade: str, confidence: str, k: int = 10) -> DataFrame:
    """The confidence-weighted pairwise loss of each query, pairs weighing their change of nDCG at k.

    A pair has a candidate with a higher grade and one with a lower. How many
    there are follows from the grades' numbers. Only pairs of which one is among
    the first k by score weigh anything, so the k meet the others, k rows for
    each: a query's list may be of any length, and no window sorts it whole.
    Rows without a score, grade or confidence raise an error when they are read.
    """
    missing = F.col(score).isNull() | F.col(grade).isNull() | F.col(confidence).isNull()
    light = rows.filter(F.assert_true(~missing, F.lit("a candidate without a score, grade or confidence")).isNull()).select(query, candidate, F.col(score).alias("score"), F.col(grade).cast("double").alias("grade"), F.col(confidence).alias("conf"))
    every = table(light.withColumn("row", F.monotonically_increasing_id()), "loss-rows")
    first = ranked(every, [query], [F.desc("score"), F.asc(candidate), F.asc("row")], k)
    best = ranked(every, [query], [F.desc("grade"), F.asc(candidate), F.asc("row")], k, "place")
    ideal = best.groupBy(query).agg(_gain(F.col("grade"), F.col("place"), k).alias("ideal"))
    top = table(first.select(query, "row", "score", "grade", "conf", (1 / F.log2(F.col("rank") + 1)).alias("discount")), "loss-first")
    rest = every.join(top.select("row"), "row", "left_anti").select(query, "row", "score", "grade", "conf", F.lit(0.0).alias("discount"))
    a, b = top.select(query, *[F.col(c).alias(f"a_{c}") for c in top.columns if c != query]), top.unionByName(rest)
    met = a.join(b, query).join(ideal, query)
    # Of two among the first, the pair is met from both sides: it counts from that of the higher grade.
    once = (F.col("a_grade") > F.col("grade")) | ((F.col("a_grade") < F.col("grade")) & (F.col("discount") == 0))
    delta = F.abs((F.pow(F.lit(2.0), "a_grade") - F.pow(F.lit(2.0), "grade")) * (F.col("a_discount") - F.col("discount"))) / F.col("ideal")
    weight = delta * F.sqrt(F.col("a_conf") * F.col("conf"))
    ahead = F.when(F.col("a_grade") > F.col("grade"), F.col("a_score") - F.col("score")).otherwise(F.col("score") - F.col("a_score"))
    sums = met.filter(once).groupBy(query).agg(F.sum(weight * F.log1p(F.exp(-ahead))).alias("loss"), F.sum(weight).alias("weight"))
    levels = every.groupBy(query, "grade").agg(F.count("*").alias("n"))
    below = Window.partitionBy(query).orderBy("grade").rowsBetween(Window.unboundedPreceding, -1)
    pairs = levels.withColumn("p", F.col("n") * F.coalesce(F.sum("n").over(below), F.lit(0))).groupBy(query).agg(F.sum("p").alias("pairs")).filter("pairs > 0")
    return pairs.join(sums, query, "left").select(query, "pairs", F.coalesce(F.try_divide("loss", "weight"), F.lit(0.0)).alias("loss"))


def hashed(seed: str, *parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *parts).cast("binary"))


def stratified_sample(rows: DataFrame, query: str, candidate: str, grade: str, confidence: str, size: int = 8, trusted: int = 6, seed: str = "0") -> DataFrame:
    """Up to `size` candidates of each query, taking grades in turn (3, 0, 2, 1), in hashed order.

    Candidates with a confidence of 0.75 or more fill up to `trusted` places;
    the others fill the rest.
    """
    turn = F.element_at(F.create_map(*[F.lit(x) for x in (3, 0, 0, 1, 2, 2, 1, 3)]), F.col(grade).cast("int"))
    sure = (F.col(confidence) >= 0.75).alias("trusted")
    key = hashed(seed, F.col(query).cast("string"), F.col(candidate).cast("string"))
    in_grade = rows.withColumn("trusted", sure).withColumn("__nth", F.row_number().over(Window.partitionBy(query, "trusted", grade).orderBy(key)))
    placed_ = in_grade.withColumn("place", F.row_number().over(Window.partitionBy(query, "trusted").orderBy("__nth", turn)))
    return placed_.filter(F.when(F.col("trusted"), F.col("place") <= trusted).otherwise(F.col("place") <= size - trusted)).drop("__nth")


def epoch_lists(queries: DataFrame, query: str, lists: int, seed: int) -> DataFrame:
    """(query, list, seed) in a random order: `lists` examples of each query (an integer), with a seed of its own."""
    numbered = running_sum(queries.select(query).distinct().withColumn("__one", F.lit(1)), query, "__one", "__g").drop("__one")
    each = numbered.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(lists - 1))))
    seeded = each.withColumn("seed", (F.lit(seed) + F.col("__g") * 1009 + F.col("list") * 9176).cast("long"))
    return seeded.drop("__g").orderBy(hashed(str(seed), F.col("seed").cast("string")))


def overlap(train: DataFrame, validation: DataFrame, key: str) -> DataFrame:
    return train.select(key).intersect(validation.select(key))


def best_epoch(epochs: DataFrame, epoch: str, metric: str, tie: str) -> DataFrame:
    """The epoch with the greatest metric, ties by `tie`, then the earliest."""
    return epochs.agg(F.max_by(F.struct(epoch, metric, tie), F.struct(metric, tie, -F.col(epoch))).alias("b")).select("b.*")


def margin_scores(rows: DataFrame, margin: str) -> DataFrame:
    """Probability (the margin clipped to +-60) and binary entropy of a yes-no margin, and the rank inputs."""
    clipped = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col(margin).cast("double")))
    p = 1 / (1 + F.exp(-clipped))
    part = lambda q: F.when(q > 0, -q * F.log(q)).otherwise(0.0)
    return rows.withColumn("probability", p).withColumn("entropy", part(F.col("probability")) + part(1 - F.col("probability")))


def adapter_delta(rows: DataFrame, base: str, adapted: str) -> DataFrame:
    return rows.withColumn("delta", F.col(adapted) - F.col(base))
