"""Assembled revisions against a plain version, and what publication promises."""

import collections
import difflib
import hashlib
import os
import re
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from sievework.operators import assembly
from sievework.plans import catalogue, revision
from sievework.sources import publish
from sievework.streaming import status, windows
from tests.test_plain import plain_anchors

FOLDER = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not there")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def plain_chunks(text):
    parts = [p.strip() for p in re.split(r"\n(?=##\s|[-*]\s|\d+[.)]\s)", text) if p.strip()]
    n = 0
    for p in parts:
        if len(p) <= 2200:
            n += 1
            continue
        open_ = ""
        for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9(\[])", p):
            if open_ and len(f"{open_} {s}".strip()) > 1800:
                n, open_ = n + 1, s
            else:
                open_ = f"{open_} {s}".strip()
        n += bool(open_)
    return {f"E{i:03d}" for i in range(1, n + 1)}


def plain_key(s):
    s = s.translate(str.maketrans("‘’“”–—−", "''\"\"---"))
    return re.sub(r"[.!?]+$", "", re.sub(r"\s+", " ", s).strip().lower()).strip()


def plain_deduplicated(text):
    seen, removed, parts = set(), [], []
    for part in re.split(r"\n\s*\n", text):
        kept = []
        for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9(\[])", part):
            if not (s := s.strip()):
                continue
            if (k := plain_key(s)) in seen and len(k) >= 24:
                removed.append(s)
            else:
                kept.append(s)
            seen.add(k)
        if kept:
            parts.append(" ".join(kept))
    return "\n\n".join(parts), removed


def norm(t):
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9.%+-]+", " ", t.lower())).strip()


NUMBERS = r"(?<![A-Za-z])\d+(?:\.\d+)?(?:\s?(?:%|mm|cm|nm|um|µm|h|s|min|K|C|V|mA|mW))?"
HARD = {"DEVICE_STACK_MISMATCH"}
SOFT = {"OVERSTRONG_CAUSAL_CLAIM"}


def plain_gate(q, leak, c, r, spans, known):
    base = q["base_answer"]
    anchor = {f"S{i:03d}": base[a:b] for i, (a, b) in enumerate(spans, 1)}
    revised, down = (c["revised_text"] or "").strip(), r["decision"] == "ACCEPT_AFTER_DOWNGRADE"
    effective = (r["bounded_revision"] if down else revised).strip()
    out = set(r["reason_codes"])
    say = lambda name, cond: out.add(name) if cond else None
    say("G0_INVALID_STRUCTURE", c["target_anchor_id"] not in anchor or not revised)
    say("G0_INVALID_EVIDENCE_TRACE", not set(c["evidence_chunk_ids"]) <= known)
    say("G0_TARGET_ARTICLE_LEAKAGE", leak)
    say("VERIFIER_REJECT", r["decision"] == "REJECT")
    say("G1_ELABORATION_ONLY", r["necessity"] == "ELABORATION_ONLY")
    say("G2_SYSTEM_MISMATCH", r["target_system_match"] == "MISMATCH")
    say("G4_CONSTRAINT_NOT_CONFIRMED", r["constraint_check"] != "PASS" or not r["constraint_preserved"])
    say("G6_REDUNDANT", r["novel_information"] == "REDUNDANT")
    say("G6_LOW_INFORMATION_GAIN", r["novel_information"] == "LOW" and r["necessity"] != "CORRECTS_ERROR")
    say("G6_MISSING_OBLIGATION_GAIN", not r["obligation_gain"] and r["decision"] != "REJECT")
    out |= {f"HARD_RISK_{x}" for x in HARD & set(r["risk_flags"])}
    say("G5_DOWNGRADE_REQUIRED", SOFT & set(r["risk_flags"]) and not down)
    say("G2_UNKNOWN_REQUIRES_DOWNGRADE", r["target_system_match"] == "UNKNOWN" and not (down and r["evidence_role"] != "TARGET_OBSERVATION"))
    say("G3_EXTERNAL_FACT_AS_TARGET_OBSERVATION", q["condition_id"] == "S" and r["evidence_role"] == "TARGET_OBSERVATION" and r["prompt_support"] != "EXPLICIT")
    say("G5_EMPTY_BOUNDED_REVISION", down and not effective)
    say("G5_UNREQUESTED_BOUNDED_REVISION", not down and r["bounded_revision"])
    new = set(re.findall(NUMBERS, effective)) - set(re.findall(NUMBERS, q["question"] + " " + base))
    say("G2_NEW_NUMERIC_DETAIL", new and not (down and r["evidence_role"] == "EXTERNAL_PRECEDENT"))
    say("G6_NO_TEXTUAL_DELTA", norm(effective) == norm(anchor.get(c["target_anchor_id"], "")))
    if c["operation"] == "APPEND_AFTER_ANCHOR":
        say("G6_ALREADY_PRESENT", norm(effective) in norm(base))
        near = max((difflib.SequenceMatcher(None, norm(effective), norm(s)).ratio() for s in re.split(r"(?<=[.!?])\s+", base) if s.strip()), default=0)
        say("G6_NEAR_DUPLICATE", near >= 0.93)
    return sorted(out), effective


MISSING = {"decision": "REJECT", "necessity": "ELABORATION_ONLY", "evidence_role": "HYPOTHESIS", "target_system_match": "UNKNOWN", "prompt_support": "ABSENT", "constraint_check": "UNCERTAIN", "novel_information": "LOW", "bounded_revision": "", "obligation_gain": "", "constraint_preserved": False, "risk_flags": [], "reason_codes": ["MISSING_REVIEW_AT_ASSEMBLY"]}


def plain_assembly(q, packet, candidates, reviews):
    base, spans = q["base_answer"], plain_anchors(q["base_answer"])
    known = plain_chunks(packet["model_facing_evidence"])
    by_id = {r["candidate_id"]: r for r in reviews}
    rows = []
    for c in candidates:
        r = by_id.get(c["candidate_id"], MISSING)
        rows.append([c, r, *plain_gate(q, packet["target_article_exact_hit_count"], c, r, spans, known)])
    need = {"CORRECTS_ERROR": 0, "FILLS_MISSING_OBLIGATION": 1, "MATERIAL_DECISION_GAIN": 2}
    fine = [x for x in rows if not x[2]]
    fine.sort(key=lambda x: (need.get(x[1]["necessity"], 9), x[1]["decision"] != "ACCEPT", {"MATCH": 0, "PARTIAL_MATCH": 1, "UNKNOWN": 2}.get(x[1]["target_system_match"], 3), {"HIGH": 0, "MEDIUM": 1, "LOW": 2}.get(x[1]["novel_information"], 3), x[0]["candidate_id"]))
    taken = []
    for x in fine:
        if x[0]["obligation_id"] in [t[0]["obligation_id"] for t in taken]:
            x[2] = ["G7_DUPLICATE_OBLIGATION"]
        elif x[0]["target_anchor_id"] in [t[0]["target_anchor_id"] for t in taken]:
            x[2] = ["G7_DUPLICATE_ANCHOR"]
        elif len(taken) >= 2:
            x[2] = ["G7_PATCH_BUDGET"]
        else:
            taken.append(x)
    raw, place = base, {f"S{i:03d}": s for i, s in enumerate(spans, 1)}
    taken.sort(key=lambda x: place[x[0]["target_anchor_id"]])
    for c, _, _, text in reversed(taken):
        a, b = place[c["target_anchor_id"]]
        raw = raw[:b] + " " + text + raw[b:] if c["operation"] == "APPEND_AFTER_ANCHOR" else raw[:a] + text + raw[b:]
    final, removed = plain_deduplicated(raw)
    return {"condition_id": q["condition_id"], "proposed_patch_count": len(rows), "accepted_patch_count": len(taken), "changed": final != base, "final_answer_sha256": sha(final), "raw_answer_sha256": sha(raw), "eligible_before_budget": len(fine), "final_words": len(final.split()), "removed": len(removed), "actions": ",".join(x[0]["candidate_id"] for x in taken), "reasons": ";".join(",".join(x[2]) for x in rows)}


@needs_tables
def test_assembly_is_the_plain_one(spark):
    queries, packets, proposals, reviews = ({r["query_id"]: r.asDict(recursive=True) for r in df.collect()} for df in revision.assembly_inputs(spark, FOLDER))
    want = {k: plain_assembly(q, packets[k], proposals[k]["valid_candidates"], reviews[k]["candidate_reviews"]) for k, q in queries.items()}
    found = {r["query_id"]: {c: r[c] for c in r.asDict() if c != "query_id"} for r in catalogue.QUERIES["revision_assembly"](spark, FOLDER).collect()}
    assert found == want
    seen = collections.Counter(x for w in want.values() for r in w["reasons"].split(";") for x in r.split(","))
    assert {"", "MISSING_REVIEW_AT_ASSEMBLY", "G0_INVALID_STRUCTURE", "G2_NEW_NUMERIC_DETAIL", "G6_NO_TEXTUAL_DELTA", "G6_NEAR_DUPLICATE"} <= set(seen) and any(w["accepted_patch_count"] == 2 for w in want.values())


REVIEW = {"decision": "ACCEPT", "necessity": "FILLS_MISSING_OBLIGATION", "evidence_role": "GENERAL_DOMAIN_KNOWLEDGE", "target_system_match": "MATCH", "prompt_support": "EXPLICIT", "constraint_check": "PASS", "claim_strength": "OBSERVED", "novel_information": "HIGH", "bounded_revision": "", "obligation_gain": "gain", "evidence_compatibility": "fits"}


def small_inputs(spark, bases):
    q = "query_id string, selection_order long, benchmark_id string, condition_id string, challenge_id string, question_id string, task_type string, question string, base_answer string, base_answer_sha256 string, base_model_id string"
    queries = spark.createDataFrame([(k, i, "b", c, "ch", "q", "t", "How?", t, sha(t), "m") for i, (k, c, t) in enumerate(bases)], q)
    packets = spark.createDataFrame([(k, "Some evidence.", 1, ["E001"], 0) for k, _, _ in bases], "query_id string, model_facing_evidence string, selected_evidence_count int, selected_evidence_ids array<string>, target_article_exact_hit_count int")
    one = [("C1", "O1", "APPEND_AFTER_ANCHOR", "S001", "A control of equal length is needed.", ["E001"]), ("C2", "O2", "REPLACE_ANCHOR", "S002", "Peel the stronger-contact layer.", ["E001"])]
    proposals = spark.createDataFrame([(k, one) for k, _, _ in bases], "query_id string, valid_candidates array<struct<candidate_id:string,obligation_id:string,operation:string,target_anchor_id:string,revised_text:string,evidence_chunk_ids:array<string>>>")
    fields = ",".join(f"{n}:string" for n in REVIEW)
    rows = [[("C1", *REVIEW.values(), True, [], []), ("C2", *(REVIEW | {"decision": "REJECT"}).values(), True, [], [])] for _ in bases]
    reviews = spark.createDataFrame([(k, ["one control"], r) for (k, _, _), r in zip(bases, rows)], f"query_id string, explicit_constraints array<string>, candidate_reviews array<struct<candidate_id:string,{fields},constraint_preserved:boolean,risk_flags:array<string>,reason_codes:array<string>>>")
    return queries, packets, proposals, reviews


BASES = [("A", "E", "First claim of the answer. Second one."), ("B", "S", "Only this.\n\nOnly this.  And that it is so is certain. And that it is so is certain."), ("C", "X", "Odd one.")]


def test_manifest_and_checks(spark, tmp_path):
    inputs, path = small_inputs(spark, BASES), str(tmp_path / "out")
    checks = (
        assembly.Regression("kept", "A", "contains", ("equal length",)), assembly.Regression("gone", "B", "lacks", ("peel the",)), assembly.Regression("refused", "A", "rejected", ("stronger-contact",)), assembly.Regression("absent", "Z", "contains", ("x",)),
    )
    assert assembly.assemble(spark, *inputs, path, checks) == 1
    m = publish.manifest(spark, path)
    facts = m["facts"]
    assert facts["regression_checks"] == {"kept": True, "gone": True, "refused": True} and facts["status"] == "PASS"
    assert facts["questions"] == 3 and facts["condition_counts"] == {"E": 1, "S": 1, "X": 1} and facts["proposed_candidates"] == 6 and facts["accepted_patches"] == 3 and facts["answers_changed"] == 3
    assert facts["removed_exact_duplicate_sentences"] == 1 and facts["rejection_reason_counts"]["VERIFIER_REJECT"] == 3 and set(facts["source_digests"]) == {"queries", "packets", "proposals", "reviews"}
    assert {t["name"]: t["rows"] for t in m["tables"]} == {"candidates": 3, "predictions": 3, "audit": 3, "finalized": 2, "regressions": 3}
    answers = {r["query_id"]: r["final_answer"] for r in publish.published(spark, path, "predictions", verify=True).collect()}
    assert answers["A"] == "First claim of the answer. A control of equal length is needed. Second one." and answers["B"].count("certain") == 1
    assert sorted(os.listdir(f"{path}/runs/{m['run']}/finalized"))[-2:] == ["folder=01_evidence_conditioned_main", "folder=02_sparse_information_extension"]
    # Again: the same outputs under the next version; a failing check is published as such.
    assert assembly.assemble(spark, *inputs, path, (assembly.Regression("kept", "A", "lacks", ("equal length",)),)) == 2
    again = publish.manifest(spark, path)
    digests = lambda x: {t["name"]: t["digest"] for t in x["tables"] if t["name"] != "regressions"}
    assert again["facts"]["status"] == "FAIL" and digests(again) == digests(m) and publish.manifest(spark, path, 1) == m


def test_bad_inputs_publish_nothing(spark, tmp_path):
    queries, packets, proposals, reviews = small_inputs(spark, BASES)
    path = str(tmp_path / "out")
    for bad in ((queries, packets.filter("query_id <> 'A'"), proposals, reviews), (queries, packets, proposals.unionAll(proposals), reviews), (queries.unionAll(queries), packets, proposals, reviews)):
        with pytest.raises(ValueError, match="cover"):
            assembly.assemble(spark, *bad, path)
    with pytest.raises(Exception, match="the base answer is not the recorded one"):
        assembly.assemble(spark, queries.withColumn("base_answer", F.concat("base_answer", F.lit("!"))), packets, proposals, reviews, path)
    assert publish.manifest(spark, path) is None
    # No query, no candidates and no reviews are whole inputs too.
    assert assembly.assemble(spark, *[df.limit(0) for df in small_inputs(spark, BASES)], path) == 1
    none = proposals.withColumn("valid_candidates", F.slice("valid_candidates", 1, 0))
    assert assembly.assemble(spark, queries, packets, none, reviews.withColumn("candidate_reviews", F.lit(None).cast(reviews.schema["candidate_reviews"].dataType)), path) == 2
    assert {r["query_id"]: r["changed"] for r in publish.published(spark, path, "predictions").collect()} == {"A": False, "B": True, "C": False}


def test_contradicting_outputs_publish_nothing(spark, tmp_path, monkeypatch):
    inputs, path = small_inputs(spark, BASES), str(tmp_path / "out")
    assert assembly.assemble(spark, *inputs, path) == 1
    whole = assembly.assembled

    def spoiled(change):
        def made(*args):
            out = whole(*args)
            return out | {n: f(out[n]) for n, f in change.items()}

        return made

    for change in (
        {"audit": lambda df: df.filter("query_id <> 'A'")},
        {"predictions": lambda df: df.withColumn("final_answer", F.upper("final_answer"))},
        {"audit": lambda df: df.withColumn("accepted", F.col("accepted") + 1)},
        {"audit": lambda df: df.withColumn("raw_chars", F.col("raw_chars") + 1)},
        {"candidates": lambda df: df.unionAll(df)},
    ):
        monkeypatch.setattr(assembly, "assembled", spoiled(change))
        with pytest.raises(ValueError, match="nothing is published"):
            assembly.assemble(spark, *inputs, path)
    # A fault between two outputs: the first are written, none is published.
    monkeypatch.setattr(assembly, "assembled", spoiled({"audit": lambda df: df.withColumn("accepted", F.raise_error(F.lit("lost")).cast("int"))}))
    with pytest.raises(Exception, match="lost"):
        assembly.assemble(spark, *inputs, path)
    assert publish.manifest(spark, path)["version"] == 1 and len(os.listdir(f"{path}/runs")) == 7


def test_a_reader_sees_one_version(spark, tmp_path):
    path = str(tmp_path / "p")
    two = lambda n: {"a": spark.range(n).withColumn("v", F.lit(n)), "b": spark.range(2 * n).withColumn("v", F.lit(n))}
    assert publish.publish(spark, path, two(3)) == 1
    held = publish.published(spark, path, "a")
    seen = []

    def look(stored):
        """While the next version is written and checked, readers have the one before."""
        seen.append((publish.manifest(spark, path)["version"], publish.published(spark, path, "a").count(), publish.published(spark, path, "b").count()))
        return spark.createDataFrame([], "fault string")

    assert publish.publish(spark, path, two(5), look, form="json") == 2
    assert seen == [(1, 3, 6)] and held.count() == 3
    assert {publish.published(spark, path, n).select("v").distinct().first()[0] for n in "ab"} == {5}
    os.makedirs(f"{path}/manifests/version=3/_temporary/0")  # a run that died while it wrote its manifest
    assert publish.manifest(spark, path)["version"] == 2
    with pytest.raises(ValueError):
        publish.published(spark, path, "c")


def test_content(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "k int, t string")
    same = publish.content(df).first()
    assert publish.content(df.repartition(3).select("t", "k")).first() == same and same["rows"] == 3
    for other in (df.distinct(), df.fillna(""), df.withColumn("k", F.col("k") + 1), df.limit(0)):
        assert publish.content(other).first() != same


def test_log_entries_replace_themselves(spark, tmp_path):
    path, rows = str(tmp_path / "log"), spark.createDataFrame([(1, 0.5)], "step int, loss double")
    for entry in (1, 2, 2):
        publish.append_entry(rows.withColumn("step", F.lit(entry)), path, "r", entry)
    assert sorted(map(tuple, publish.read_log(spark, path, rows.schema).collect())) == [(1, 0.5, "r", 1), (2, 0.5, "r", 2)]


def test_status_of_a_stream(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "status")
    spark.range(10).coalesce(1).write.parquet(source)
    listener = status.StatusTable(spark, path, total=10)
    spark.streams.addListener(listener)
    try:
        query = windows.stream_of(spark, source).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            if os.path.isdir(path) and status.latest(spark, path).filter("state = 'done'").count():
                break
    finally:
        spark.streams.removeListener(listener)
    assert [r["state"] for r in status.history(spark, path).orderBy("at").collect()] == ["started", "running", "done"]
    last = status.latest(spark, path).first()
    assert (last["run"], last["done"], last["total"], last["error"]) == (str(query.id), 10, 10, None) and last["rate"] > 0


def test_status_outlives_its_driver(spark, tmp_path):
    """A driver that dies in its second micro-batch has left what it did; its next run goes on under the same id."""
    source, path, done = (str(tmp_path / n) for n in ("in", "status", "out"))
    for i in range(3):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.parquet(f"{source}/part={i}")
    script = textwrap.dedent(f"""
        import os, sys
        from pyspark.sql import SparkSession
        from sievework.streaming import status
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        spark.streams.addListener(status.StatusTable(spark, {path!r}, total=30))
        def put(batch, n):
            if sys.argv[1] == "die" and n == 2:
                while not (os.path.isdir({path!r}) and status.history(spark, {path!r}).filter("done = 20").count()):
                    pass
                os._exit(9)
            batch.write.mode("overwrite").parquet({done!r} + f"/batch={{n}}")
        rows = spark.readStream.schema("id long, part int").option("maxFilesPerTrigger", 1).parquet({source!r})
        q = rows.writeStream.foreachBatch(put).option("checkpointLocation", {str(tmp_path / 'c')!r}).trigger(availableNow=True).start()
        q.awaitTermination()
        while not status.latest(spark, {path!r}).filter("state = 'done'").count():
            pass
    """)
    run = lambda how: subprocess.run([sys.executable, "-c", script, how], env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, timeout=180)
    assert run("die").returncode == 9
    left = status.latest(spark, path).first()
    assert (left["state"], left["done"]) == ("running", 20) and left["seconds_left"] > 0
    assert run("on").returncode == 0
    assert status.latest(spark, path).count() == 1 and status.latest(spark, path).first()["state"] == "done"
    assert spark.read.parquet(done).count() == 30
