"""Queries of scores, statistics and ranking metrics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import ranking as K
from sievework.operators import scoring as S
from sievework.operators import stats as J
from sievework.plans.tables import load


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component rows from events: the type is the model, the event the item."""
    e, i = load(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        F.col("event_type").alias("model"),
        i.alias("item"),
        (i % 4).alias("family"),
        F.least(F.lit(100.0), F.col("value")).alias("adequacy"),
        ((i % 101) / 100).alias("rubric"),
        ((i % 83) / 82).alias("decision"),
        ((i % 67) / 66).alias("precision"),
        ((i % 41) / 40).alias("gate"),
        (i % 5).alias("missing"),
    )


def scored_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).withColumn("score", S.item_score(*[F.col(c) for c in S.COMPONENTS]))


def item_score_v43(spark: SparkSession, sf_dir: str) -> DataFrame:
    fault = S.component_fault(*[F.col(c) for c in S.COMPONENTS])
    return scored_ledger(spark, sf_dir).withColumn("fault", fault).select("model", "item", "score", "fault")


def board_mean_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.board(scored_ledger(spark, sf_dir), "model", "score")
    return found.select("model", "items", F.round("arithmetic", 6).alias("arithmetic"), F.round("median", 6).alias("median"))


def huber_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = J.huber_by(scored_ledger(spark, sf_dir), ["model"], "score")
    return found.select("model", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "huber", "robust_scale")], "downweighted")


def rollup_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: means over model and family, each and all."""
    return scored_ledger(spark, sf_dir).cube("model", "family").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("items"), F.round(F.avg("score"), 6).alias("mean_score"))


def grouping_sets_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: means by model and by family, and overall."""
    scored = scored_ledger(spark, sf_dir)
    return scored.groupingSets([["model"], ["family"], []], "model", "family").agg(F.count("*").alias("items"), F.round(F.avg("score"), 6).alias("mean_score"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' mean values of two event types, as paired scores; the study is the user modulo 10."""
    e = load(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view"))
    mean = lambda t: F.round(F.avg(F.when(F.col("event_type") == t, F.col("value"))), 6)
    both = e.groupBy("user_id").agg(mean("click").alias("pro"), mean("view").alias("flash")).filter("pro is not null and flash is not null")
    return both.select("user_id", (F.col("user_id") % 10).alias("study"), F.lit("E").alias("condition"), "pro", "flash")


def anchored_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = J.anchored_score(pairs(spark, sf_dir), 87.1665, "condition", "user_id", "pro", "flash")
    return found.select("condition", "items", F.round("paired_increment", 6).alias("paired_increment"), F.round("anchored_score", 6).alias("anchored_score"))


def win_tie_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.win_tie_loss(pairs(spark, sf_dir), "pro", "flash")


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = J.paired_bootstrap(pairs(spark, sf_dir), "user_id", "pro", "flash")
    return found.select("items", "iterations", *[F.round(c, 6).alias(c) for c in ("difference", "low", "high")])


def study_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = J.study_means(pairs(spark, sf_dir), "study", "condition", "pro", "flash").withColumn("zero", F.lit(0.0))
    found = J.paired_bootstrap(means, "study", "difference", "zero", seed=20260913)
    return found.select("items", "iterations", *[F.round(c, 6).alias(c) for c in ("difference", "low", "high")])


def agreement_pearson_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = scored_ledger(spark, sf_dir).groupBy("model", "family").agg(F.round(F.avg("score"), 6).alias("automatic"), F.round(F.avg("adequacy"), 6).alias("human"))
    found = J.agreement(means, "human", "automatic")
    return found.select("n_groups", F.round("pearson_r", 6).alias("pearson_r"), F.round("spearman_rho", 6).alias("spearman_rho"))


def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("event_type").agg(*[J.nearest_rank("value", q).alias(f"p{round(q * 100)}") for q in (0.5, 0.9, 0.95)], F.min("value").alias("low"), F.max("value").alias("high"))


def reproduce_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board against itself as recorded: a model's mean is shifted by 1e-5 or 1e-3 to test agreement at four decimals."""
    found = S.board(scored_ledger(spark, sf_dir), "model", "score").select("model", F.round("arithmetic", 6).alias("arithmetic"))
    shift = F.when(F.length("model") % 2 == 0, 0.0).otherwise(0.01)
    return J.reproduced(found, found.withColumn("arithmetic", F.col("arithmetic") + shift), "model", "arithmetic").select("model", "agrees")


def token_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = load(spark, sf_dir, "lineitem").select((F.col("l_discount") * 30).alias("loss"), F.col("l_quantity").alias("tokens"))
    return J.token_weighted_loss(blocks, "loss", "tokens").select(F.round("mean_loss", 6).alias("mean_loss"), F.round("perplexity", 5).alias("perplexity"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded candidates of twenty queries from the labelled documents; the score is an integer hash."""
    d = F.col("doc_id")
    return load(spark, sf_dir, "labels").select(
        (d % 20).alias("query"),
        d.alias("candidate"),
        F.concat(F.lit("query "), (d % 20).cast("string")).alias("text"),
        (F.col("quality") * 2 + (1 - F.col("toxic"))).alias("grade"),
        ((d * 7919 + 13) % 1000 / 1000).alias("score"),
        ((d * 31 + 7) % 100 / 99).alias("confidence"),
        (d % 3).alias("family"),
    )


def group_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.valid_groups(candidates(spark, sf_dir), "query", "candidate", "text", "grade")


def _rounded(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, *[F.round(c, 6).alias(c) for c in df.columns if c != key])


def ranking_metrics_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(K.ranking_metrics(candidates(spark, sf_dir), "query", "score", "grade", "candidate"), "query")


def ranking_metrics_unpadded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(K.ranking_metrics(candidates(spark, sf_dir), "query", "score", "grade", "candidate", padded=False), "query")


def ranking_macro_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(K.macro_mean(K.ranking_metrics(candidates(spark, sf_dir), "query", "score", "grade", "candidate"), "query"), "queries")


def source_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(K.source_recall(candidates(spark, sf_dir), "query", "score", "grade", "candidate"), "query")


def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.dataset_summary(candidates(spark, sf_dir), "query", "grade", "family", "confidence")
    return found.select(*[F.round(c, 6).alias(c) if c.startswith("confidence") else F.col(c) for c in found.columns])


def lambdarank_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.lambda_loss(candidates(spark, sf_dir), "query", "candidate", "score", "grade", "confidence")
    return found.select("query", "pairs", F.round("loss", 6).alias("loss"))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.stratified_sample(candidates(spark, sf_dir), "query", "candidate", "grade", "confidence").select("query", "candidate", "grade", "trusted", "place")


def epoch_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.epoch_lists(candidates(spark, sf_dir), "query", 3, 17)


def train_validation_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir)
    return K.overlap(rows.filter("query % 3 <> 0"), rows.filter("query % 3 <> 1"), "query")


def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = load(spark, sf_dir, "events").groupBy((F.col("event_id") % 8).alias("epoch")).agg(F.round(F.avg("value"), 1).alias("precision"), F.round(F.max("value"), 3).alias("ndcg"))
    return K.best_epoch(per, "epoch", "precision", "ndcg")


def margin_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    margin = (F.col("score") - 0.5) * 200
    rows = K.adapter_delta(candidates(spark, sf_dir).withColumn("base", margin).withColumn("adapted", margin + F.col("grade")), "base", "adapted")
    return K.margin_scores(rows, "base").select("candidate", F.round("probability", 6).alias("probability"), F.round("entropy", 6).alias("entropy"), F.round("delta", 6).alias("delta"))


def mcq_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "benchmark")
    asked = rows.select((F.col("item_id") + 1).alias("position"), F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (F.col("item_id") % 4 + 1).cast("int")).alias("correct_option"))
    said = asked.select("position", F.when(F.col("position") % 5 == 0, F.lit("B")).otherwise(F.concat(F.lit(" "), F.lower("correct_option"))).alias("predicted_option"))
    return S.mcq_accuracy(asked, said, "position", rows.count())


QUERIES = {
    f.__name__: f
    for f in (
        item_score_v43, board_mean_median, huber_board, rollup_cube, grouping_sets_board, anchored_score, win_tie_loss, paired_bootstrap, study_bootstrap, agreement_pearson_spearman,
        nearest_rank_percentiles, reproduce_board, token_loss, group_validation, ranking_metrics_padded, ranking_metrics_unpadded, ranking_macro_mean, source_recall_mrr, dataset_summary,
        lambdarank_loss, stratified_sample, epoch_lists, train_validation_overlap, best_epoch, margin_scores, mcq_accuracy,
    )
}

_LEDGER = """
    l AS (SELECT event_type AS model, event_id AS item, event_id % 4 AS family, least(100.0::DOUBLE, value) AS adequacy, (event_id % 101) / 100.0::DOUBLE AS rubric, (event_id % 83) / 82.0::DOUBLE AS decision,
                 (event_id % 67) / 66.0::DOUBLE AS precision, (event_id % 41) / 40.0::DOUBLE AS gate, event_id % 5 AS missing FROM events),
    p AS (SELECT *, (adequacy + 100 * rubric + 100 * decision) / 3 AS plain, CASE WHEN missing >= 3 THEN 50.0 WHEN missing = 2 THEN 70.0 WHEN missing = 1 THEN 85.0 ELSE 100.0 END AS cap FROM l),
    s AS (SELECT *, round(greatest(least(plain * sqrt(greatest(0, least(1, gate))) * sqrt(greatest(0, least(1, precision / 0.75))), cap), plain - 20), 6) AS score FROM p)"""
_PAIRS = """
    m AS (SELECT user_id, round(avg(value) FILTER (event_type = 'click'), 6) AS pro, round(avg(value) FILTER (event_type = 'view'), 6) AS flash FROM events GROUP BY 1),
    pr AS (SELECT user_id, user_id % 10 AS study, 'E' AS condition, pro, flash FROM m WHERE pro IS NOT NULL AND flash IS NOT NULL)"""


def _boot(source: str, order: str, seed: int, times: int = 400) -> str:
    return f"""
    nb AS (SELECT row_number() OVER (ORDER BY {order}) - 1 AS i, d FROM {source}), cnt AS (SELECT count(*) AS n FROM nb),
    dr AS (SELECT (id // n) AS r, CAST('0x' || md5('{seed}|' || CAST(id AS VARCHAR))[1:15] AS BIGINT) % n AS i FROM cnt, LATERAL (SELECT unnest(range({times} * n)) AS id)),
    ms AS (SELECT r, sum(d) / max(n) AS m FROM dr JOIN nb USING (i), cnt GROUP BY r),
    o AS (SELECT m, row_number() OVER (ORDER BY m) AS k FROM ms)
    SELECT (SELECT count(*) FROM nb) AS items, CAST({times} AS INTEGER) AS iterations, round((SELECT avg(d) FROM nb), 6) AS difference, round(max(m) FILTER (k = {-(-times // 40)}), 6) AS low, round(max(m) FILTER (k = {-(-times * 39 // 40)}), 6) AS high FROM o"""


_CAND = """
    c AS (SELECT doc_id % 20 AS query, doc_id AS candidate, quality * 2 + (1 - toxic) AS grade, (doc_id * 7919 + 13) % 1000 / 1000.0::DOUBLE AS score, (doc_id * 31 + 7) % 100 / 99.0::DOUBLE AS confidence, doc_id % 3 AS family FROM labels),
    pl AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS rank, row_number() OVER (PARTITION BY query ORDER BY grade DESC, candidate) AS ideal FROM c),
    g AS (SELECT *, pow(2.0, grade) - 1 AS gain, log2(rank + 1) AS lr, log2(ideal + 1) AS li FROM pl)"""


def _metrics(at: str, none: str) -> str:
    return f"""WITH {_CAND},
    q AS (SELECT query, {at} AS cnt_at, count(*) FILTER (rank <= 10 AND grade >= 2) AS useful, count(*) FILTER (rank <= 10 AND grade >= 3) AS direct, max(CASE WHEN rank <= 10 AND grade >= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS success,
                 sum(CASE WHEN rank <= 10 THEN grade ELSE 0 END)::DOUBLE AS total, sum(CASE WHEN rank <= 10 THEN gain / lr ELSE 0.0 END) AS dcg, sum(CASE WHEN ideal <= 10 THEN gain / li ELSE 0.0 END) AS best FROM g GROUP BY query),
    mt AS (SELECT query, round(useful / cnt_at, 6) AS useful_precision, round(direct / cnt_at, 6) AS direct_precision, success, round(total / cnt_at, 6) AS mean_grade, round(CASE WHEN best > 0 THEN dcg / best ELSE {none} END, 6) AS ndcg, useful / cnt_at AS u0, direct / cnt_at AS d0, total / cnt_at AS t0, CASE WHEN best > 0 THEN dcg / best ELSE {none} END AS n0 FROM q)"""


_AT = ", ".join(f"round(coalesce((first <= {k})::INTEGER::DOUBLE, 0), 6) AS recall_{k}" for k in (1, 5, 10, 20, 40))

ORACLE_SQL = {
    "item_score_v43": f"WITH {_LEDGER} SELECT model, item, score, CAST(NULL AS VARCHAR) AS fault FROM s",
    "board_mean_median": f"WITH {_LEDGER} SELECT model, count(*) AS items, round(avg(score), 6) AS arithmetic, round(median(score), 6) AS median FROM s GROUP BY model",
    "huber_board": f"""
        WITH RECURSIVE {_LEDGER},
        md AS (SELECT model, count(*) AS n, avg(score) AS mean, median(score) AS median FROM s GROUP BY model),
        sc AS (SELECT md.*, sd.scale FROM md JOIN (SELECT s.model, median(abs(score - median)) / 0.6744897501960817 AS scale FROM s JOIN md USING (model) GROUP BY s.model) sd USING (model)),
        it AS (SELECT model, 0 AS k, median AS center FROM sc
               UNION ALL
               SELECT it.model, it.k + 1, sum(score * 1.345 / greatest(abs((score - center) / scale), 1.345)) / sum(1.345 / greatest(abs((score - center) / scale), 1.345))
               FROM it JOIN s ON s.model = it.model JOIN sc ON sc.model = it.model WHERE it.k < 60 GROUP BY it.model, it.k),
        fin AS (SELECT model, arg_max(center, k) AS huber FROM it GROUP BY model)
        SELECT sc.model, sc.n, round(mean, 6) AS mean, round(median, 6) AS median, round(huber, 6) AS huber, round(scale, 6) AS robust_scale,
               CAST((SELECT count(*) FROM s WHERE s.model = sc.model AND abs((score - huber) / scale) > 1.345) AS BIGINT) AS downweighted
        FROM sc JOIN fin USING (model)""",
    "rollup_cube": f"WITH {_LEDGER} SELECT model, family, CAST(grouping_id(model, family) AS INTEGER) AS level, count(*) AS items, round(avg(score), 6) AS mean_score FROM s GROUP BY CUBE (model, family)",
    "grouping_sets_board": f"WITH {_LEDGER} SELECT model, family, count(*) AS items, round(avg(score), 6) AS mean_score FROM s GROUP BY GROUPING SETS ((model), (family), ())",
    "anchored_score": f"WITH {_PAIRS} SELECT condition, count(*) AS items, round(avg(pro - flash), 6) AS paired_increment, round(87.1665 + avg(pro - flash), 6) AS anchored_score FROM pr GROUP BY condition",
    "win_tie_loss": f"WITH {_PAIRS} SELECT count(*) FILTER (pro > flash) AS wins, count(*) FILTER (pro = flash) AS ties, count(*) FILTER (pro < flash) AS losses, count(*) FILTER (pro - flash >= 5) AS gains, count(*) FILTER (pro - flash <= -5) AS drops FROM pr",
    "paired_bootstrap": f"WITH {_PAIRS}, src AS (SELECT user_id, pro - flash AS d FROM pr), {_boot('src', 'user_id', 20260903, 10_000)}",
    "study_bootstrap": f"WITH {_PAIRS}, src AS (SELECT study, avg(pro - flash) AS d FROM pr GROUP BY study), {_boot('src', 'study', 20260913, 10_000)}",
    "agreement_pearson_spearman": f"""
        WITH {_LEDGER}, m AS (SELECT round(avg(score), 6) AS y, round(avg(adequacy), 6) AS x FROM s GROUP BY model, family),
        r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM m)
        SELECT count(*) AS n_groups, round(corr(x, y), 6) AS pearson_r, round(corr(rx, ry), 6) AS spearman_rho FROM r""",
    "nearest_rank_percentiles": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, min(value) AS low, max(value) AS high FROM events GROUP BY event_type",
    "reproduce_board": f"WITH {_LEDGER} SELECT model, length(model) % 2 = 0 AS agrees FROM s GROUP BY model",
    "token_loss": "WITH m AS (SELECT sum(l_discount * 30 * l_quantity) / sum(l_quantity) AS x FROM lineitem) SELECT round(x, 6) AS mean_loss, round(exp(least(x, 20)), 5) AS perplexity FROM m",
    "group_validation": f"WITH {_CAND} SELECT query, count(*) AS candidates, count(DISTINCT grade) AS grade_levels, CASE WHEN count(DISTINCT grade) < 2 THEN 'one_grade_level' END AS reason FROM c GROUP BY query",
    "ranking_metrics_padded": _metrics("10.0::DOUBLE", "1.0") + " SELECT query, useful_precision, direct_precision, success, mean_grade, ndcg FROM mt",
    "ranking_metrics_unpadded": _metrics("least(10.0::DOUBLE, count(*))", "0.0") + " SELECT query, useful_precision, direct_precision, success, mean_grade, ndcg FROM mt",
    "ranking_macro_mean": _metrics("10.0::DOUBLE", "1.0") + " SELECT count(*) AS queries, round(avg(u0), 6) AS useful_precision, round(avg(d0), 6) AS direct_precision, round(avg(success), 6) AS success, round(avg(t0), 6) AS mean_grade, round(avg(n0), 6) AS ndcg FROM mt",
    "source_recall_mrr": f"WITH {_CAND}, f AS (SELECT query, min(rank) FILTER (grade >= 3) AS first FROM pl GROUP BY query) SELECT query, {_AT}, round(coalesce(1.0 / first, 0), 6) AS reciprocal_rank FROM f",
    "dataset_summary": f"""WITH {_CAND} SELECT count(DISTINCT query) AS queries, count(*) AS candidates, count(*) FILTER (grade = 0) AS grade_0, count(*) FILTER (grade = 1) AS grade_1, count(*) FILTER (grade = 2) AS grade_2, count(*) FILTER (grade = 3) AS grade_3,
        count(DISTINCT family) AS families, round(min(confidence), 6) AS confidence_min, round(avg(confidence), 6) AS confidence_mean, round(max(confidence), 6) AS confidence_max FROM c""",
    "lambdarank_loss": f"""
        WITH {_CAND}, b AS (SELECT query, sum(CASE WHEN ideal <= 10 THEN gain / li ELSE 0.0 END) AS best FROM g GROUP BY query),
        d AS (SELECT *, CASE WHEN rank <= 10 THEN 1 / lr ELSE 0.0 END AS disc FROM g),
        pr AS (SELECT h.query, abs((h.gain - w.gain) * (h.disc - w.disc)) / best * sqrt(h.confidence * w.confidence) AS weight, ln(1 + exp(-(h.score - w.score))) AS loss
               FROM d h JOIN d w ON h.query = w.query AND h.grade > w.grade JOIN b ON b.query = h.query WHERE best > 0)
        SELECT query, count(*) AS pairs, round(CASE WHEN sum(weight) = 0 THEN 0 ELSE sum(weight * loss) / sum(weight) END, 6) AS loss FROM pr GROUP BY query""",
    "stratified_sample": f"""
        WITH {_CAND}, k AS (SELECT *, confidence >= 0.75 AS trusted, md5('0|' || CAST(query AS VARCHAR) || '|' || CAST(candidate AS VARCHAR)) AS h FROM c),
        n AS (SELECT *, row_number() OVER (PARTITION BY query, trusted, grade ORDER BY h) AS nth FROM k),
        o AS (SELECT *, row_number() OVER (PARTITION BY query, trusted ORDER BY nth, CASE grade WHEN 3 THEN 0 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 3 END) AS place FROM n)
        SELECT query, candidate, grade, trusted, CAST(place AS INTEGER) AS place FROM o WHERE place <= CASE WHEN trusted THEN 6 ELSE 2 END""",
    "epoch_lists": f"WITH {_CAND}, q AS (SELECT query, row_number() OVER (ORDER BY query) - 1 AS g FROM (SELECT DISTINCT query FROM c)) SELECT query, CAST(l AS INTEGER) AS list, 17 + g * 1009 + l * 9176 AS seed FROM q, LATERAL (SELECT unnest(range(3)) AS l)",
    "train_validation_overlap": f"WITH {_CAND} SELECT DISTINCT query FROM c WHERE query % 3 = 2",
    "best_epoch": "WITH p AS (SELECT event_id % 8 AS epoch, round(avg(value), 1) AS precision, round(max(value), 3) AS ndcg FROM events GROUP BY 1) SELECT epoch, precision, ndcg FROM p ORDER BY precision DESC, ndcg DESC, epoch LIMIT 1",
    "margin_scores": f"""WITH {_CAND}, m AS (SELECT candidate, grade, (score - 0.5) * 200 AS b FROM c), p AS (SELECT *, 1 / (1 + exp(-greatest(-60, least(60, b)))) AS p FROM m)
        SELECT candidate, round(p, 6) AS probability, round(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END + CASE WHEN 1 - p > 0 THEN -(1 - p) * ln(1 - p) ELSE 0 END, 6) AS entropy, round(CAST(grade AS DOUBLE), 6) AS delta FROM p""",
    "mcq_accuracy": "WITH q AS (SELECT item_id + 1 AS p, ['A', 'B', 'C', 'D'][item_id % 4 + 1] AS c FROM benchmark), m AS (SELECT CASE WHEN p % 5 = 0 THEN 'B' ELSE c END = c AS ok FROM q) SELECT count(*) AS items, count(*) FILTER (ok) AS correct, count(*) FILTER (ok) / count(*) AS accuracy FROM m",
}
