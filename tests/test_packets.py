"""Packets of cards and their registry against a plain version, and bad inputs."""

import html
import hashlib
import math
import os
import re

import pytest
from pyspark.sql import functions as F

from sievework.functions.cleaning import EVIDENCE_STOPWORDS, DIRECT_GROUPS
from sievework.operators import packets, prefix
from sievework.operators.evidence import FAMILY_WORDS
from sievework.plans import catalogue, revision

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not there")


def plain_words(text):
    return {t for t in (x.lower() for x in re.findall(PATTERN, text)) if t not in EVIDENCE_STOPWORDS}


from sievework.functions.tokens import EVIDENCE_PATTERN as PATTERN  # noqa: E402


def plain_clean(text):
    """For texts without any of the phrases and identifiers that are removed."""
    text = html.unescape(text).replace("–", "-").replace("—", "-")
    return re.sub(r"\s+", " ", re.sub(r"^\s*\d{1,3}\.\s+", "", text)).strip(" ;,:.-")


def plain_science(unit):
    ws = [w.lower() for w in re.findall(PATTERN, unit)]
    return not (len(ws) >= 24 and len(set(ws)) / len(ws) < 0.43)


def plain_trim(text, most):
    text = text.strip(" ;,:.-")
    if len(text) <= most:
        return text
    head = text[: most + 1]
    cut = max(head.rfind(x) for x in (". ", "; ", ", "))
    space = head.rfind(" ")
    return (head[: cut + 1] if cut >= int(most * 0.6) else head[:space] if space > 0 else head[:most]).rstrip(" ;,:.-") + "."


def plain_excerpt(text, query, most, n):
    clean = plain_clean(text)
    units = []
    for u in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9(])|\n+", clean):
        u = u.strip(" ;,:-")
        if len(u) >= 35:
            units += [u] if len(u) <= 650 else [p for x in re.split(r";\s+", u) if len(p := x.strip(" ;,:-")) >= 35]
    units = [u for u in units if plain_science(u)]
    if not units:
        return plain_trim(clean, most) if len(clean) >= 20 and plain_science(clean) else ""

    def score(u):
        shared = len(query & plain_words(u))
        condition = re.search(r"\b(condition|control|compared|under|after|before|versus|vs\.?|while)\b", u, re.I)
        return shared * 2.0 + 8.0 * shared / max(1, len(query)) + (0.8 if re.search(r"\d", u) else 0) + (0.6 if condition else 0) + min(len(u), 260) / 520

    best = sorted(range(len(units)), key=lambda i: (-round(score(units[i]), 9), i))[:n]
    return plain_trim(" ".join(units[i] for i in sorted(best)), most)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def plain_packet(q, ranking, pool, records):
    query = plain_words(q["question"])
    cards, quick_lines, details = [], [], []
    for rank, core in enumerate(ranking, 1):
        p = pool[core]
        own = records.get(core, [])
        quick = plain_excerpt(p["scientific_evidence"], query, 210, 1) or packets.NO_QUICK
        records_, sentences, chars = (3, 3, 720) if rank <= 8 else (2, 2, 520) if rank <= 20 else (1, 1, 320)
        items = []
        if own:
            if summary := plain_excerpt(p["scientific_evidence"], query, chars, sentences):
                items.append((f"P{rank:02d}-S", None, summary))
            ranked = []
            for r in own:
                if "atomic" not in r["kind"].lower() or r["evidence_group"] not in DIRECT_GROUPS or not plain_science(r["text"]):
                    continue
                ws = plain_words(f"{r['title']} {r['evidence_group']} {r['routing']} {r['text']}")
                shared = len(query & ws)
                if shared < 2:
                    continue
                score = shared * 2.2 + 10.0 * shared / max(1, len(query)) + 0.55 * len(set(FAMILY_WORDS[q["family"]]) & ws) + math.log1p(r["value"]) / 2.5 + 2.0
                x = plain_excerpt(r["text"], query, 330, 1)
                if len(x) >= 55 and len(plain_words(x)) >= 7:
                    ranked.append((-round(score, 9), r["record_id"], x))
            kept = []
            for _, i, x in sorted(ranked):
                if len(kept) < records_ and not any(jaccard(plain_words(x), plain_words(y)) >= 0.72 for _, y in kept):
                    kept.append((i, x))
            items += [(f"P{rank:02d}-E{k}", i, x) for k, (i, x) in enumerate(kept, 1)]
        cards.append((rank, core, bool(own), items))
        quick_lines.append(f"- {p['title']} ({p['journal']}, {p['year']}). {quick}")
        told = [f"- Direct experimental evidence: {x}" for label, _, x in items if "-E" in label] + [f"- Scientific context: {x}" for label, _, x in items if "-S" in label]
        if told:
            details.append("\n".join([f"### {p['title']}", *told]))
    lines = [packets.HEAD, "", "## Question", q["question"], "", *packets.BEFORE, "", "## Research landscape", *quick_lines, "", "## Detailed scientific background", "\n\n".join(details), "", "## Question to answer now", q["question"], "", packets.LAST, ""]
    return cards, "\n".join(lines)


@needs_tables
def test_packets_are_the_plain_ones(spark):
    asked, ranking, pool, records = (df.collect() for df in revision.packet_inputs(spark, FOLDER))
    ranked, of, own = {}, {}, {}
    for r in sorted(ranking, key=lambda r: (r["query_id"], r["rank"])):
        ranked.setdefault(r["query_id"], []).append(r["core_id"])
    for r in pool:
        of[r["query_id"], r["core_id"]] = r.asDict()
    for r in records:
        own.setdefault(r["core_id"], []).append(r.asDict())
    want, texts = [], {}
    for q in sorted(asked, key=lambda r: r["query_id"]):
        k = q["query_id"]
        cards, text = plain_packet(q.asDict(), ranked[k], {c: of[k, c] for c in ranked[k]}, own)
        texts[k] = (text, sum(deep for _, _, deep, _ in cards))
        want += [(k, rank, core, label, record, hashlib.sha256(x.encode()).hexdigest()) for rank, core, _, items in cards for label, record, x in items]
    found = catalogue.QUERIES["packet_registry"](spark, FOLDER).orderBy("number").collect()
    assert [r["number"] for r in found] == list(range(1, len(want) + 1))
    assert [(r["query_id"], r["rank"], r["core_id"], r["evidence_label"], r["record_id"], r["sha256"]) for r in found] == want
    assert {w[3][4:] for w in want} >= {"S", "E1", "E2"} and len(want) > len(texts)
    numbers = {}
    for i, w in enumerate(want, 1):
        numbers.setdefault(w[0], []).append(i)
    for r in catalogue.QUERIES["packet_cards"](spark, FOLDER).collect():
        text, deep = texts[r["query_id"]]
        mine = numbers.get(r["query_id"], [None])
        assert (r["cards"], r["first"], r["last"], r["deep"], r["n_chars"], r["sha256"]) == (40, mine[0], mine[-1], deep, len(text), hashlib.sha256(text.encode()).hexdigest())


TEXT = "The matched control shows slow ion migration under bias for 90 hours in humid air. A second plain line of text follows here for length."


def small(spark, **change):
    rows = {
        "questions": [("A", "How does ion migration under bias change?", "mechanism_diagnostic"), ("B", "How does ion migration under bias change?", None)],
        "ranking": [(q, c, r) for q in "AB" for r, c in ((1, "x"), (2, "y"))] + [("A", "z", 3)],
        "pool": [(q, c, None if c == "y" else "T", None, None, TEXT if c == "x" else None) for q in "AB" for c in "xy"],
        "records": [("x", f"stage1_limitation_{i}", "atomic", "table_reasoning", None, None, t, v) for i, (t, v) in enumerate([(TEXT, 5.0), (TEXT, None), ("Ion migration under bias, CORE_12 EVID99 measured in another way, gives eight more words here", 1.0), (None, 1.0), ("", 2.0)])] + [("y", None, None, None, None, None, None, None)],
    } | change
    kinds = {"questions": "query_id string, question string, family string", "ranking": "query_id string, core_id string, rank int", "pool": "query_id string, core_id string, title string, journal string, year int, scientific_evidence string", "records": "core_id string, record_id string, kind string, evidence_group string, title string, routing string, text string, value double"}
    return [spark.createDataFrame(rows[n], kinds[n]) for n in kinds]


def test_small_packets(spark):
    made = packets.built(*small(spark), papers=2)
    items = [(r["number"], r["query_id"], r["evidence_label"], r["record_id"]) for r in made["registry"].orderBy("number").collect()]
    # Of two equal records the greater value is taken; the second is like it. A paper with records but no usable one has its quick line.
    assert items == [(1, "A", "P01-S", None), (2, "A", "P01-E1", "stage1_limitation_0"), (3, "A", "P01-E2", "stage1_limitation_2"), (4, "B", "P01-S", None), (5, "B", "P01-E1", "stage1_limitation_0"), (6, "B", "P01-E2", "stage1_limitation_2")]
    told = {(r["query_id"], r["rank"]): r for r in made["map"].collect()}
    assert (told["A", 1]["first"], told["A", 1]["last"], told["A", 2]["first"]) == (1, 3, None) and told["B", 2]["quick_map_text"] == packets.NO_QUICK and told["B", 2]["evidence_level"] == "science_rag_core"
    text = made["packets"].filter("query_id = 'A'").first()["packet"]
    assert "CORE_" not in text and "EVID" not in text and "the focal paper" in text and "- Untitled paper. " in text and text.count("How does ion migration") == 2


def test_bad_packets(spark):
    whole = small(spark)
    for at, bad in ((1, whole[1].filter("rank <> 2")), (1, whole[1].withColumn("core_id", F.lit("x"))), (2, whole[2].filter("core_id <> 'y'")), (2, whole[2].unionAll(whole[2])), (0, whole[0].withColumn("question", F.lit("What is the gold_answer?"))), (0, whole[0].withColumn("question", F.lit("Is core_finding: here?")))):
        given = [*whole]
        given[at] = bad
        with pytest.raises(Exception, match="not 2 ranked papers|in the pool once|internal name"):
            packets.built(*given, papers=2)["packets"].collect()
    empty = packets.built(*[df.limit(0) for df in whole], papers=2)
    assert all(df.count() == 0 for df in empty.values())


def test_numbered(spark):
    rows = [(k % 7 if k % 11 else None, k % 3, f"r{k}") for k in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, c string").repartition(5)
    for parts in ("1", "7"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            found = prefix.numbered(df, ["a", "b", "c"], "n").orderBy("n").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert [r["n"] for r in found] == list(range(1, 501))
        assert [(r["a"], r["b"], r["c"]) for r in found] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert prefix.numbered(df.limit(0), ["a"], "n").count() == 0
