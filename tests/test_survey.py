"""Small cases with known results, and plain versions of what carries state."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sievework.functions import cleaning, python, sentences
from sievework.operators import evidence, patches, scoring, stats, training, validation
from sievework.sources import jsonl


def test_direct_records(spark):
    rows = [("RAG_Atomic", "Table_Reasoning", "x_stage1_limitation_1", "A film."), ("parent", "table_reasoning", "stage1_limitation", "A film."), ("atomic", "lineage", "stage1_limitation", "A film."), ("atomic", "table_reasoning", "story", "A film."), ("atomic", "table_reasoning", "stage1_limitation", "table 1 table 2"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "k string, g string, i string, t string")
    assert [r[0] for r in df.select(cleaning.is_direct_record(*[F.col(c) for c in "kgit"])).collect()] == [True] + [False] * 5


def test_row_keywords(spark):
    rows = [json.dumps({"terms": ["b", {"x": [" A ", 3, None]}], "keywords": "a", "other": "no", "raw_content": "STRASSE straße"}), json.dumps({"terms": ["x" * 3999, "yy"]}), "[1]", None]
    found = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "r string").coalesce(1).select(python.keyword_string("r")).collect()]
    assert found == ["a b STRASSE straße", "x" * 3999 + " ", "", ""]
    deep = 100_000
    assert python.flat_terms(["a", ["b", {"x": "c", "y": [" "]}], "d"]) == ["a", "b", "c", "d"]
    text = json.dumps({"terms": "a"})[:-1] + ', "other": ' + "[" * deep + "]" * deep + "}"
    assert [r[0] for r in spark.createDataFrame([(text,)], "r string").select(python.keyword_string("r")).collect()] in ([""], ["a"])
    nested = "x"
    for _ in range(deep):
        nested = [nested]
    assert python.flat_terms(nested) == ["x"]


def test_obligations(spark):
    ok = {"id": " O1 ", "requirement": "r", "draft_anchor_ids": ["S001", "S9"], "missing_or_weak_dimensions": ["", "w"]}
    rows = [(json.dumps({"obligations": [ok, 3, ok, {"id": "O2"}]}), ["S001"]), (json.dumps({"obligations": []}), None), ("{}", []), (None, None)]
    found = [r[0] for r in spark.createDataFrame(rows, "p string, a array<string>").coalesce(1).select(python.obligations("p", "a")).collect()]
    assert [r["reasons"] for r in found] == [["obligation_2_not_object", "obligation_3_invalid_identity", "obligation_4_invalid_identity"], ["no_valid_obligations"], ["obligations_not_list"], ["obligations_not_list"]]
    assert found[0]["valid"][0].asDict() == {"id": "O1", "requirement": "r", "kind": "", "draft_anchor_ids": ["S001"], "coverage": "", "missing_or_weak_dimensions": ["w"]}


def test_rematerialised(spark):
    base = spark.createDataFrame([(1, "First point is here. Second one follows.\n\nThird stands alone.")], "q int, t string")
    anchors = base.lateralJoin(sentences.Anchors(F.col("t").outer())).drop("t")
    schema = "q int, target_anchor_id string, candidate_id string, operation string, revised_text string, effect_class string"
    rows = [(1, "S001", "C1", "REPLACE_ANCHOR", "More.", "LIMITS_OR_BOUNDS"), (1, "S002", "C2", "REPLACE_ANCHOR", "Now second one follows!", None), (1, "S003", "C3", "REPLACE_ANCHOR", "Gone.", "CORRECTS_CAUSAL_ERROR")]
    found = patches.rematerialised(base, anchors, spark.createDataFrame(rows, schema), "q", "t").first()
    assert found["revised_answer"] == "First point is here. More. Now second one follows!\n\nGone."
    assert [a["action"] for a in found["actions"]] == ["noncorrective_replace_preserved_anchor", "replace_already_preserves_anchor", "destructive_replace_allowed_causal_correction"]
    for bad in ((1, "S009", "C", "REPLACE_ANCHOR", "x", ""), (1, "S001", "C", "REPLACE_ANCHOR", " ", ""), (1, "S001", "C", "OTHER", "x", "")):
        with pytest.raises(PySparkException):
            patches.rematerialised(base, anchors, spark.createDataFrame([bad], schema), "q", "t").collect()


def test_critic_selection(spark):
    schema = "q int, candidate_id string, obligation_id string, target_anchor_id string, added_words int"
    known = [(q, f"C{i}", f"O{i % 4}", f"S{i % 5}", 100) for q in range(1, 9) for i in range(1, 8)]
    lists = [(1, "PATCH", ["C3", " C1 ", "C2"]), (2, "none", ["C9"]), (3, "OTHER", ["C1"]), (4, "patch", None), (5, "PATCH", [f"C{i}" for i in range(1, 8)]), (6, "PATCH", ["C1", "C1"]), (7, "PATCH", ["C1", "C9"]), (8, "PATCH", ["C5", "C1", "C6", "C2", "C3", "C4"]), (9, "PATCH", ["C1"]), (10, "PATCH", [])]
    found = patches.critic_selected(spark.createDataFrame(lists, "q int, critic_decision string, selected_ids array<string>"), spark.createDataFrame(known, schema), "q")
    got = {r["q"]: (r["selected"], r["reasons"]) for r in found.collect()}
    assert got[1] == (["C3", "C1", "C2"], []) and got[2] == ([], []) and got[10] == ([], [])
    assert got[3] == got[4] == ([], ["invalid_critic_decision"]) and got[5] == got[6] == ([], ["critic_selection_count_or_duplicates"])
    assert got[7] == got[9] == ([], ["critic_selected_unknown_candidate"])
    assert got[8] == (["C5", "C6", "C3"], ["C1_duplicate_obligation", "C2_duplicate_obligation", "C4_total_added_words"])


def test_action_log(spark):
    base = spark.createDataFrame([(1, "First point is here. Second one follows."), (2, "Alone.")], "q int, t string")
    anchors = base.lateralJoin(sentences.Anchors(F.col("t").outer())).drop("t")
    schema = "q int, target_anchor_id string, candidate_id string, operation string, revised_text string"
    rows = [(1, "S002", "C1", "APPEND_AFTER_ANCHOR", "Later."), (1, "S001", "C3", "APPEND_AFTER_ANCHOR", "More."), (1, "S001", "C2", "REPLACE_ANCHOR", "New.")]
    found = {r["q"]: r for r in patches.applied(base, anchors, spark.createDataFrame(rows, schema), "q", "t").collect()}
    assert found[1]["revised_answer"] == "New. More. Second one follows. Later." and found[2]["revised_answer"] == "Alone."
    assert [(e["target_anchor_id"], e["candidate_ids"], e["candidate_count"], e["action"]) for e in found[1]["log"]] == [("S001", ["C2", "C3"], 2, "replace_then_append_all_same_anchor_candidates"), ("S002", ["C1"], 1, "append_all_same_anchor_candidates")]
    for bad in ((1, "S009", "C", "REPLACE_ANCHOR", "x"), (1, "S001", "C", "REPLACE_ANCHOR", " "), (1, "S001", "C", "OTHER", "x")):
        with pytest.raises(PySparkException):
            patches.applied(base, anchors, spark.createDataFrame([bad], schema), "q", "t").collect()


def test_budget_keeps_repeated_ids_apart(spark):
    rows = spark.createDataFrame([(1, "C", "O1", "S1", 1, k) for k in range(2)] + [(1, "C", "O2", "S2", 1, 5)], "q int, candidate_id string, obligation_id string, target_anchor_id string, added_words int, k int")
    found = patches.budgeted(rows, "q", F.struct("k")).collect()
    assert sorted((r["k"], r["verdict"]) for r in found) == [(0, "selected"), (1, "G7_DUPLICATE_OBLIGATION"), (5, "selected")]


def test_base_digest(spark):
    import hashlib

    rows = spark.createDataFrame([(1, " a b\n", hashlib.sha256(b"a b").hexdigest())], "q int, t string, d string")
    assert patches.checked_base(rows, "q", "t", "d").first()["t"] == "a b"
    with pytest.raises(PySparkException):
        patches.checked_base(rows.withColumn("d", F.lit("0")), "q", "t", "d").collect()


def test_exact_rows(spark):
    said = spark.createDataFrame([(1, "x")], "i int, answer string")
    gold = spark.createDataFrame([(1, "r"), (2, "s")], "i int, reference string")
    told = lambda *rows: spark.createDataFrame(list(rows), "i int, support string")
    assert [tuple(r) for r in scoring.exact_rows(said, gold, told((1, "")), "i", "support").collect()] == [(1, "x", "r", "")]
    for bad in (told((2, "t")), told((1, None)), told((1, "t"), (1, "u"))):
        with pytest.raises(PySparkException):
            scoring.exact_rows(said, gold, bad, "i", "support").collect()
    for rows in ([(3, "x")], [(None, "x")]):
        with pytest.raises(PySparkException):
            scoring.exact_rows(spark.createDataFrame(rows, "i int, answer string"), gold, told((1, "t"), (3, "t")), "i", "support").collect()


def test_encoded_chats(spark):
    three = [("system", "s"), ("user", "u"), ("assistant", "a")]
    rows = [(1, three, [1, 2], [1, 2, 3, 4, 5, 6]), (2, three[:2], [1], [1, 2, 3, 4, 5]), (3, three, [1, 9], [1, 2, 3, 4, 5, 6]), (4, three, [1], list(range(1, 20))), (5, three, [1], [1, 2]), (6, [*three[:2], ("assistant", " ")], [1], [1, 2, 3, 4, 5]), (7, three + three, [1], [1, 2, 3, 4, 5])]
    found = training.encoded_chats(spark.createDataFrame(rows, "i int, m array<struct<role:string,content:string>>, p array<int>, f array<int>"), "m", "p", "f", 10)
    got = {r["i"]: (r["fault"], r["labels"]) for r in found.collect()}
    assert got[1] == (None, [-100, -100, 3, 4, 5, 6])
    assert [got[i][0] for i in range(2, 8)] == ["roles", "prefix", "length", "targets", "roles", "roles"]


def test_packed_examples(spark):
    import hashlib
    import random

    draw = random.Random(4)
    rows = [(g, k, [k] * (n := draw.randint(1, 10)), [-100] * (n - 1) + [k], [0.5] * n, float(1 + k % 3)) for g in range(3) for k in range(g * 100, g * 100 + 40)]
    df = spark.createDataFrame(rows, "g int, k int, ids array<int>, labels array<int>, w array<double>, sw double")
    blocks = training.packed_examples(df, "g", "k", "ids", "labels", "w", 10, -1, "sw", seed=3)
    found = blocks.orderBy("g", "block").collect()
    for g in range(3):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (hashlib.md5(f"3|{r[1]}".encode()).hexdigest(), r[1]))
        want, held = [], []
        for r in order:
            if held and len(held) + len(r[2]) > 10:
                want.append(held)
                held = []
            held = held + r[2]
            if len(held) == 10:
                want.append(held)
                held = []
        if held:
            want.append(held + [-1] * (10 - len(held)))
        assert [r["input_ids"] for r in found if r["g"] == g] == want
    assert all(len(r["labels"]) == len(r["weights"]) == len(r["input_ids"]) for r in found)
    assert all(r["conserved"] for r in training.conserved(blocks, df, "g", "sw").collect())
    assert not all(r["conserved"] for r in training.conserved(blocks.filter("block > 0"), df, "g", "sw").collect())


def test_huber_of_large_groups_is_the_same(spark):
    rows = spark.range(4000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 50 == 0, 1e3).otherwise(F.sin(F.col("id"))).alias("x")).unionByName(spark.createDataFrame([(None, 1.0), (None, 2.0), (9, 4.0)], "g long, x double"))
    small, large = ({r["g"]: r for r in stats.huber_by(rows, ["g"], "x", most=m).collect()} for m in (10**6, 100))
    assert set(small) == set(large) == {0, 1, 2, 9, None}
    for g, a in small.items():
        assert all(a[c] == pytest.approx(large[g][c], abs=1e-10) for c in ("n", "mean", "median", "huber", "robust_scale", "downweighted"))


def test_verified_files(spark, tmp_path):
    import hashlib

    root = f"file://{tmp_path}"
    for at, text in (("a/x.jsonl", '{"id": 1}\n'), ("b/x.jsonl", '{"id": 2}\n{"id": 3}\n'), ("b/with space+é.jsonl", "\n")):
        (tmp_path / at).parent.mkdir(exist_ok=True)
        (tmp_path / at).write_text(text)
    found = {r["name"]: r["sha256"] for r in jsonl.file_digests(spark, root).collect()}
    assert set(found) == {"a/x.jsonl", "b/x.jsonl", "b/with space+é.jsonl"} and found["a/x.jsonl"] == hashlib.sha256(b'{"id": 1}\n').hexdigest()
    listed = spark.createDataFrame([("a/x.jsonl", 10, found["a/x.jsonl"]), ("b/../../y", 1, ""), ("/z", 1, ""), ("b/../a/w", 1, "")], "name string, bytes long, sha256 string")
    assert {tuple(r) for r in jsonl.integrity(jsonl.file_digests(spark, root), listed).collect()} == {("b/x.jsonl", "unexpected"), ("b/with space+é.jsonl", "unexpected"), ("b/../../y", "outside"), ("/z", "outside"), ("b/../a/w", "missing")}
    schema = spark.createDataFrame([], "id int").schema
    says = {"status": "READY", "schema": "v1", "rows": 1, "files": {"x.jsonl": {"bytes": 10, "sha256": found["a/x.jsonl"]}}}
    assert jsonl.verified_scan(spark, f"{root}/a", schema, says, "v1").first()["id"] == 1
    for bad in (says | {"status": "DRAFT"}, says | {"schema": "v2"}, says | {"rows": 2}, says | {"files": {}}, says | {"files": {"x.jsonl": {"bytes": 10, "sha256": "0"}}}):
        with pytest.raises(ValueError):
            jsonl.verified_scan(spark, f"{root}/a", schema, bad, "v1")


def test_release_faults(spark):
    a, b = spark.createDataFrame([("1",), ("2",)], "id string"), spark.createDataFrame([("2",)], "id string")
    assert {tuple(r) for r in jsonl.release_faults({"a": a, "b": b}, {"a": 2, "b": 2}, "id", 3).collect()} == {("b", "rows"), ("all", "keys")}
    assert jsonl.release_faults({"a": a}, {"a": 2}, "id", 2).isEmpty()


def test_configuration(spark, tmp_path):
    (tmp_path / "c.json").write_text('\ufeff{"_note": 1, "seed_value": 7, "none": null, "on": true, "off": false, "rate": 0.5}')
    assert jsonl.flags_of(jsonl.read_config(spark, f"file://{tmp_path}/c.json")) == ["--seed-value", "7", "--on", "--rate", "0.5"]


def test_packet_quality(spark):
    blocks = spark.createDataFrame([(1, 1, "The whole film is 5 nm thick under light in air. The whole film is 5 nm thick under light in air. Other words are here for the second unit."), (1, 2, "It is 6 nm in CORE_12."), (2, 1, "Fine.")], "q int, d int, text string")
    docs = spark.createDataFrame([(1, "It is 5 nm. Fine."), (2, "It is 7 nm.")], "d int, text string")
    r = evidence.packet_quality(blocks, docs, "q", "d", F.when(F.col("d") == 1, "a").otherwise("b")).first()
    assert (r["status"], r["queries"], r["paper_slots"], r["unique_papers"], r["identifier_leaks"], r["numeric_mismatches"], r["source_slots"]) == ("FAIL", 2, 3, 2, 1, 1, {"a": 2, "b": 1})
    assert r["duplicate_sentences"] == 1
    assert evidence.packet_quality(blocks.filter("text = 'Fine.'"), docs, "q", "d", F.lit("a")).first()["status"] == "PASS"


def test_verbs_and_labels(spark):
    body = "and the long unit of many words about films under light with a thing that {} it in air"
    units = [("Reach " + body).format(v) for v in ("reach", "reaches", "reachs", "establishes", "gived", "finded", "suppress", "suppresses", "gave", "nothing")]
    got = [r[0] for r in spark.createDataFrame([(u.replace("Reach ", "Now "),) for u in units], "t string").coalesce(1).select(cleaning.is_informative(F.col("t"))).collect()]
    assert got == [False, True, False, True, False, False, False, True, True, False]
    texts = ["control_or_baseline: x", "summary: a section: b result_summary: c", "Kept document: DOC_1 body goes Claim: stays", "raw value: 3 why_it_matters: y", "Type: Two words. Content: z"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(cleaning.clean_science_text(F.col("t"))).collect()]
    assert got == ["Control/Baseline: x", "a Source: b  c".replace("  ", " "), "Kept Claim: stays", "Value: 3 Significance: y", "z"]


def test_private_text(spark):
    df = spark.createDataFrame([('{"a": 1}',), (None,), (f'{{"{sorted(validation.PRIVATE)[0]}" : 1}}',)], "t string")
    assert [r[0] for r in df.coalesce(1).select(validation.private_text(F.col("t"))).collect()] == [False, False, True]


def test_reviewed_object(spark):
    yaml = pytest.importorskip("yaml")
    rows = ['{"a": 1}', "So: {\"a\": 1} done", "a: 1\nb:\n  - x: 2024-01-02", "a: [1", "just words", "- 1\n- 2", "", None, "a: 2024-99-99", "? [1, 2]\n: 3", "a: &x\n  b: *x", "[" * 50_000]
    found = [tuple(r) for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string").orderBy("i").select(validation.reviewed_object(F.col("r")).alias("x")).select("x.*").collect()]
    assert [n for _, n in found[:3]] == ["", "", "SERIALIZATION_FALLBACK_YAML"] and json.loads(found[2][0]) == {"a": 1, "b": [{"x": "2024-01-02"}]}
    assert all(n == "PARSE_FAILURE" and p is None for p, n in found[3:]) and yaml.safe_load("a: 1") == {"a": 1}
