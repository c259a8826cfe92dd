"""Queries that SQL can't express, against plain versions over a whole test table."""

import collections
import hashlib
import math
import os
import re

import duckdb
import pytest

from sievework.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not there")
SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


@pytest.fixture(scope="module")
def tables():
    path = lambda t: f"{FOLDER}/{t}.parquet" + ("/*.parquet" if os.path.isdir(f"{FOLDER}/{t}.parquet") else "")
    rows = lambda t, c: duckdb.sql(f"SELECT {c} FROM '{path(t)}'").fetchall()
    return {"documents": [(k, t or "") for k, t in rows("documents", "doc_id, text")], "benchmark": [(k, t or "") for k, t in rows("benchmark", "item_id, text")], "conversations": rows("conversations", "conv_id, turn, role, text")}


def bm25_words(text):
    return re.findall(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*", text.lower())


def plain_ranking(docs, questions, top):
    tf = {k: collections.Counter(bm25_words(t)) for k, t in docs}
    length = {k: sum(c.values()) for k, c in tf.items()}
    mean, df = sum(length.values()) / len(docs), collections.Counter(w for c in tf.values() for w in c)
    for q, text in questions:
        asked = set(bm25_words(text))
        scores = {}
        for k, c in tf.items():
            s = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length[k] / mean)) for w in asked if w in c)
            if round(s, 9) > 0:
                scores[k] = round(s, 9)
        yield q, text, sorted(scores, key=lambda k: (-scores[k], k))[:top]


def plain_sentences(text):
    return [s for x in re.split(r"(?<=[.!?])\s+|\n+", text) if (s := x.strip())]


def plain_blocks(docs, questions):
    text_of = dict(docs)
    for q, text, ranked in plain_ranking(docs, questions, 40):
        asked, seen, number = set(bm25_words(text)), set(), 0
        for rank, k in enumerate(ranked, 1):
            room = 1900 if rank <= 8 else 1300 if rank <= 20 else 800
            found = list(enumerate(plain_sentences(text_of[k])))
            taken = []
            for place, s in sorted(found, key=lambda x: (-len(asked & set(bm25_words(x[1]))), x[0])):
                key = re.sub(r"\s+", " ", s.lower())
                if key not in seen and len(s) + 1 <= room:
                    room -= len(s) + 1
                    taken.append((place, s))
                    seen.add(key)
            if taken:
                number += 1
                yield q, f"E{number:03d}", k, rank, " ".join(s for _, s in sorted(taken))


def test_evidence_compile(spark, tables):
    found = catalogue.QUERIES["evidence_compile"](spark, FOLDER).collect()
    want = {(q, e, k, r, len(t), hashlib.sha256(t.encode()).hexdigest()) for q, e, k, r, t in plain_blocks(tables["documents"], tables["benchmark"])}
    assert len(found) == len(want) and {(r["item_id"], r["evidence_id"], r["doc_id"], r["rank"], r["n_chars"], r["sha256"]) for r in found} == want


def test_packet_reports(spark, tables):
    sizes = []
    per = collections.defaultdict(list)
    for q, e, _, _, t in plain_blocks(tables["documents"], tables["benchmark"]):
        per[q].append((e, t))
    for q, text in tables["benchmark"]:
        if q in per:
            body = "\n\n".join(f"[{e}] {t}" for e, t in sorted(per[q]))
            sizes.append(len(f"## Question\n{text}\n\n## Evidence\n{body}\n\n## Question\n{text}\n"))
    sizes.sort()
    at = lambda x: sizes[max(0, math.ceil(x * len(sizes)) - 1)]
    r = catalogue.QUERIES["packet_report"](spark, FOLDER).first()
    assert tuple(r) == (len(sizes), sizes[0], at(0.5), at(0.9), at(0.95), sizes[-1])
    q = catalogue.QUERIES["packet_quality"](spark, FOLDER).first()
    assert (q["queries"], q["paper_slots"], q["numeric_mismatches"], q["status"]) == (len(per), sum(map(len, per.values())), 0, "PASS" if q["identifier_leaks"] == 0 else "FAIL")


def test_patch_budget_and_critic(spark):
    from sievework.plans import preparation

    rows = [r.asDict() for r in preparation._gated(spark, FOLDER).collect()]
    gates = re.compile(r"^(?:G[0-6]_|HARD_RISK_|VERIFIER_REJECT)")
    need = {"CORRECTS_ERROR": 0, "FILLS_MISSING_OBLIGATION": 1, "MATERIAL_DECISION_GAIN": 2, "ELABORATION_ONLY": 9}
    order = lambda r: (need.get(r["necessity"], 9), r["decision"] != "ACCEPT", {"MATCH": 0, "PARTIAL_MATCH": 1, "UNKNOWN": 2}.get(r["target_system_match"], 3), {"HIGH": 0, "MEDIUM": 1, "LOW": 2}.get(r["novel_information"], 3), str(r["candidate_id"]))
    want = {}
    for q in {r["query_id"] for r in rows}:
        obligations, anchors = set(), set()
        for r in sorted((r for r in rows if r["query_id"] == q and not any(gates.match(x) for x in r["reasons"])), key=order):
            if r["obligation_id"] in obligations:
                verdict = "G7_DUPLICATE_OBLIGATION"
            elif r["target_anchor_id"] in anchors:
                verdict = "G7_DUPLICATE_ANCHOR"
            elif len(obligations) >= 2:
                verdict = "G7_PATCH_BUDGET"
            else:
                verdict = "selected"
                obligations.add(r["obligation_id"])
                anchors.add(r["target_anchor_id"])
            want[q, r["candidate_id"]] = verdict
    found = {(r["query_id"], r["candidate_id"]): r["verdict"] for r in catalogue.QUERIES["patch_budget"](spark, FOLDER).collect()}
    assert found == want and len(set(want.values())) >= 3


def plain_anchors(draft):
    spans = []
    for m in re.finditer(r"\S(?:.*?\S)?(?=\n\s*\n|$)", draft, re.S):
        starts = sorted({m.start(), *[x.end() for x in re.compile(r"[.!?](?=\s+(?:[A-Z0-9(\[]|However\b|Thus\b|First\b|Second\b|Finally\b))").finditer(draft, *m.span())]})
        for a, b in zip(starts, [*starts[1:], m.end()], strict=True):
            piece = draft[a:b]
            a, b = a + len(piece) - len(piece.lstrip()), b - (len(piece) - len(piece.rstrip()))
            if b > a:
                spans.append((a, b))
    return spans


def test_patch_apply(spark, tables):
    want = {}
    for conv, turn, role, text in tables["conversations"]:
        if role != "assistant":
            continue
        text = text or ""
        spans = plain_anchors(text)[:2]
        out, at = "", 0
        for i, (a, b) in enumerate(spans):
            out += text[at:a] + (text[a:b] + " New words." if i == 0 else "New words.")
            at = b
        out = (out + text[at:]).strip()
        want[conv * 100 + turn] = (len(spans), len(out), hashlib.sha256(out.encode()).hexdigest())
    found = catalogue.QUERIES["patch_apply"](spark, FOLDER).collect()
    assert {r["query_id"]: (r["actions"], r["n_chars"], r["sha256"]) for r in found} == want
    assert all((r["log"] or "[]").count("candidate_count") == r["actions"] for r in found)
