"""Small cases with known results."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sievework.functions import cleaning, python, sentences, similarity, tokens
from sievework.operators import evidence, patches, prefix, ranking, retrieval, scoring, stats, training, validation
from sievework.sources import index, jsonl


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_item_score_floor(spark):
    values = [F.lit(float(x)) for x in (100, 1, 1, 1, 1)]
    assert one(spark, scoring.item_score(*values, F.lit(4)))[0] == 80.0


def test_component_faults(spark):
    good = [F.lit(float(x)) for x in (100, 1, 1, 1, 1)]
    assert one(spark, scoring.component_fault(*good, F.lit(1.5)))[0] == "missing_count_not_0_to_4"
    assert one(spark, scoring.component_fault(*good, F.lit(5.0)))[0] == "missing_count_not_0_to_4"
    assert one(spark, scoring.component_fault(F.lit(float("nan")), *good[1:], F.lit(0.0)))[0] == "not_finite"
    assert one(spark, scoring.component_fault(*good, F.lit(2.0)))[0] is None


def test_round_half_ties_to_even(spark):
    found = [one(spark, scoring.round_half(F.lit(x)))[0] for x in (0.25, 0.75, 1.25, 5.0, -1.0)]
    assert found == [0.0, 1.0, 1.0, 4.0, 0.0]


def test_huber_without_spread_is_the_mean():
    assert stats.huber_array(np.array([100.0, 100, 100, 0]))[:2] == (75.0, 0.0)


def test_huber_small_and_large_agree(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(x)) for k in "ab" for x in np.concatenate([rng.normal(5, 2, 80), [90.0, -70.0]])]
    df = spark.createDataFrame(rows, "g string, value double")
    small = {r["g"]: r for r in stats.huber_by(df, ["g"], "value").collect()}
    large = {r["g"]: r for r in stats.huber_large(df, ["g"]).collect()}
    for g in "ab":
        assert small[g]["huber"] == pytest.approx(large[g]["huber"], abs=1e-8)
        assert small[g]["downweighted"] == large[g]["downweighted"] > 0


def test_bootstrap_of_a_constant_difference(spark):
    pairs = spark.createDataFrame([(1, 5.0, 2.0), (2, 6.0, 3.0), (3, 7.0, 4.0)], "i int, a double, b double")
    r = stats.paired_bootstrap(pairs, "i", "a", "b", 40).first()
    assert (r["difference"], r["low"], r["high"]) == (3.0, 3.0, 3.0)
    assert stats.exact_paired_bootstrap([5, 6, 7], [2, 3, 4], 40)["ci95"] == pytest.approx([3.0, 3.0])
    with pytest.raises(ValueError):
        stats.paired_bootstrap(pairs, "i", "a", "b", 10)


def test_mixed_conditions_are_refused(spark):
    rows = spark.createDataFrame([("E", 1, 2.0, 1.0), ("S", 2, 3.0, 1.0)], "c string, i int, a double, b double")
    with pytest.raises(ValueError):
        stats.study_means(rows, "i", "c", "a", "b")
    with pytest.raises(PySparkException):
        stats.anchored_score(rows, 80.0, "c", "i", "a", "b").collect()


def test_search_and_exclusion(spark):
    docs = spark.createDataFrame([("D1", "thermal drift of films"), ("D2", "reversible bias and reversible light")], "id string, text string")
    asked = spark.createDataFrame([(1, "reversible bias"), (2, "unknownword")], "q int, text string")
    assert [(r["q"], r["id"]) for r in retrieval.bm25(docs, asked, "id", "q").collect()] == [(1, "D2")]
    assert retrieval.bm25(docs, asked, "id", "q", excluded=F.col("id") == "D2").count() == 0
    assert retrieval.bm25(docs.limit(0), asked, "id", "q").count() == 0


def test_one_hit_per_lane(spark):
    hits = spark.createDataFrame([(1, "c", "x", 1, 3.0), (1, "c", "x", 2, 2.0), (1, "c", "y", 3, 1.0)], "q int, core string, lane string, rec int, z double")
    every = retrieval.core_aggregate(hits, "q", "core", "lane", "rec", 5).first()
    single = retrieval.core_aggregate(hits, "q", "core", "lane", "rec", 5, one_hit_per_lane=True).first()
    assert every["dense_score"] == pytest.approx(3.225) and single["dense_score"] == pytest.approx(3.1)


def test_fusion(spark):
    dense = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "q int, core string, dense_rank int")
    lexical = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "q int, core string, lexical_rank int")
    found = [(r["core"], r["rrf"]) for r in retrieval.fused(dense, lexical, "q", "core").orderBy("rank").collect()]
    assert [c for c, _ in found] == ["b", "a", "c"] and found[0][1] == round(1 / 62 + 0.75 / 61, 9)


def test_stems(spark):
    words = {"carriers": "carrier", "stabilization": "stable", "migrations": "migration", "heated": "heated", "annealing": "anneal", "gas": "gas"}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r["w"]: r["s"] for r in df.select("w", tokens.stem(F.col("w")).alias("s")).collect()} == words


def test_porter():
    known = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "happy": "happi", "adjustable": "adjust", "sky": "sky", "controlling": "control", "rate": "rate"}
    assert {w: python.porter(w) for w in known} == known


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=6), st.lists(st.sampled_from("ab"), max_size=6))
def test_similarity_bounds(spark, a, b):
    x, y = (F.array(*[F.lit(t) for t in z]).cast("array<string>") for z in (a, b))
    c, j = one(spark, similarity.term_cosine(x, y), similarity.jaccard(F.array_distinct(x), F.array_distinct(y)))
    assert 0 <= c <= 1 + 1e-9 and 0 <= j <= 1
    if a and sorted(a) == sorted(b):
        assert c == pytest.approx(1)


def test_anchors_and_patches(spark):
    text = "First point is here. Second one follows.\n\nThird stands alone."
    assert [text[a:b] for a, b in sentences.anchor_spans(text)] == ["First point is here.", "Second one follows.", "Third stands alone."]
    base = spark.createDataFrame([(1, text)], "q int, t string")
    anchors = base.lateralJoin(sentences.Anchors(F.col("t").outer())).drop("t")
    rows = [(1, "S001", "C1", "APPEND_AFTER_ANCHOR", "More."), (1, "S001", "C2", "APPEND_AFTER_ANCHOR", "Again."), (1, "S003", "C3", "REPLACE_ANCHOR", "Gone.")]
    found = patches.applied(base, anchors, spark.createDataFrame(rows, "q int, target_anchor_id string, candidate_id string, operation string, revised_text string"), "q", "t").first()
    assert found["revised_answer"] == "First point is here. More. Again. Second one follows.\n\nGone." and found["actions"] == 2


def test_exact_repeats_go(spark):
    a, b = "The same long sentence number 90 is here.", "The same long sentence number 91 is here."
    df = spark.createDataFrame([(1, f"{a} {a} {b}")], "i int, text string")
    r = sentences.deduplicated(df, "i", "text").first()
    assert r["text"] == f"{a} {b}" and r["removed"] == [a]


def test_budget_takes_one(spark):
    rows = spark.createDataFrame([(1, "C1", "O1", "S1", 10, 2), (1, "C2", "O2", "S2", 10, 1)], "q int, candidate_id string, obligation_id string, target_anchor_id string, added_words int, place int")
    found = {r["candidate_id"]: r["verdict"] for r in patches.budgeted(rows, "q", F.struct("place"), most=1).collect()}
    assert found == {"C2": "selected", "C1": "G7_PATCH_BUDGET"}


def test_next_fit(spark):
    rows = spark.createDataFrame([(0, i, n) for i, n in enumerate((3, 3, 5, 8, 1))], "g int, k int, n int")
    found = [(r["block"], r["place"]) for r in training.next_fit(rows, "g", "k", "n", 8).orderBy("k").collect()]
    assert found == [(0, 0), (0, 1), (1, 0), (2, 0), (3, 0)]
    with pytest.raises(PySparkException):
        training.next_fit(rows, "g", "k", "n", 4).collect()


def test_contiguous_blocks(spark):
    docs = spark.createDataFrame([(1, [5, 5, 5]), (2, []), (3, [7, 7])], "k int, ids array<int>")
    found = [(r["input_ids"], r["valid"]) for r in training.contiguous_blocks(docs, "k", "ids", 4, 1, 0).orderBy("block").collect()]
    assert found == [([5, 5, 5, 1], 4), ([7, 7, 1, 0], 3)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=40))
def test_running_sum(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "k int, v int")
    found = [r["s"] for r in prefix.running_sum(df, "k", "v", "s").orderBy("k").collect()]
    assert found == [sum(values[:i]) for i in range(len(values))]


def test_ndcg_variants(spark):
    rows = spark.createDataFrame([(1, 1, 0.9, 0), (1, 2, 0.8, 0)], "q int, c int, s double, g int")
    assert ranking.ranking_metrics(rows, "q", "s", "g", "c").first()["ndcg"] == 1.0
    assert ranking.ranking_metrics(rows, "q", "s", "g", "c", padded=False).first()["ndcg"] == 0.0


def test_evidence_never_repeats_a_sentence(spark):
    docs = spark.createDataFrame([(1, "Alpha beta gamma. Shared words here."), (2, "Shared words here. Delta epsilon."), (3, "x" * 2001)], "d int, text string")
    ranking_ = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (7, 3, 3)], "q int, d int, rank int")
    found = evidence.compiled(ranking_, docs, spark.createDataFrame([(7, "alpha")], "q int, text string"), "q", "d").orderBy("rank").collect()
    assert [(r["evidence_id"], r["text"]) for r in found] == [("E001", "Alpha beta gamma. Shared words here."), ("E002", "Delta epsilon.")]


def test_excerpt_keeps_order(spark):
    text = "The control sample was held under light for 10 hours. Nothing else of note was seen in any of it. The control films under bias showed degradation after 20 hours."
    df = spark.createDataFrame([(text, ["control", "degradation"])], "t string, q array<string>")
    assert evidence.with_excerpt(df, "t", "q", 400, 2).first()["excerpt"].startswith("The control sample was held")


def test_canonical_questions(spark):
    df = spark.createDataFrame([(" ", "b1", "What?")], "id string, benchmark_id string, prompt string")
    assert tuple(validation.canonical_questions(df).first()) == ("b1", "What?", None)
    with pytest.raises(PySparkException):
        validation.canonical_questions(df.withColumn("prompt", F.lit(" "))).collect()
    codes = spark.createDataFrame([("experimental_context",), ("S",), (None,)], "c string").select(validation.condition_code(F.col("c"))).collect()
    assert [r[0] for r in codes] == ["E", "S", None]


def test_cleaning(spark):
    text = "Paper title: Some long title here. CORE_12 reported_raw_metric: 5 &amp; more EVID_99A ok"
    assert one(spark, cleaning.clean_science_text(F.lit(text)))[0] == "the focal paper Reported result: 5 & more ok"
    assert one(spark, cleaning.leaks_identifier(F.lit("see CORE_12")))[0]


def test_jsonl_round_trip(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('﻿{"a": 1}\n\n{"a": 2}\n', encoding="utf-8")
    schema = spark.range(1).select(F.col("id").alias("a")).schema
    assert sorted(r["a"] for r in jsonl.read_jsonl(spark, f"file://{path}", schema).collect()) == [1, 2]
    assert jsonl.read_jsonl(spark, f"file://{tmp_path}/none", schema, missing_ok=True).count() == 0
    with pytest.raises(PySparkException):
        jsonl.read_jsonl(spark, f"file://{tmp_path}/none", schema)
    jsonl.write_jsonl(spark.range(3), f"file://{tmp_path}/out")
    with pytest.raises(PySparkException):
        jsonl.write_jsonl(spark.range(3), f"file://{tmp_path}/out")


def test_integrity(spark):
    have = spark.createDataFrame([("a", 1, "x"), ("c", 1, "x")], "name string, bytes int, sha256 string")
    want = spark.createDataFrame([("a", 1, "y"), ("b", 1, "x"), ("../d", 1, "x")], "name string, bytes int, sha256 string")
    assert {r["name"]: r["fault"] for r in jsonl.integrity(have, want).collect()} == {"a": "digest", "b": "missing", "c": "unexpected", "../d": "outside"}


def test_batches_split_on_failure(spark):
    def client(rows):
        if len(rows) > 1:
            raise OSError
        return [{"id": rows[0]["id"], "answer": "ok"}]

    df = spark.range(5).withColumn("answer", F.lit(None).cast("string"))
    assert jsonl.answered(df, df.schema, client).filter("answer = 'ok'").count() == 5


def test_index_needs_distinct_ids(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (1, "c")], "d int, text string")
    with pytest.raises(ValueError):
        index.save_index(docs, f"file://{tmp_path}/index", "d")
