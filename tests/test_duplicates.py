"""Pairs without all pairs: duplicates of a group, pairwise losses and records that share words, against plain versions."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sievework.functions.cleaning import EVIDENCE_STOPWORDS
from sievework.functions.tokens import EVIDENCE_PATTERN
from sievework.operators import duplicates, evidence, ranking

WORDS = "ion bias field carrier defect layer contact phase humid stress cycle order grain tin lead iodide bromide film".split()


def plain_words(text):
    return {w for w in (x.lower() for x in re.findall(EVIDENCE_PATTERN, text or "")) if w not in EVIDENCE_STOPWORDS}


def plain_pairs(rows, threshold):
    out = set()
    for g, a, s in rows:
        for h, b, t in rows:
            if g is None or g != h or a >= b:
                continue
            x, y = (re.sub(r"\s+", " ", u or "").strip().lower() for u in (s, t))
            v, w = plain_words(s), plain_words(t)
            if x == y or (min(len(x), len(y)) >= 90 and (x in y or y in x)) or len(v & w) / max(1, len(v | w)) >= threshold:
                out.add((g, a, b))
    return out


@pytest.mark.parametrize("threshold", [0.1, 0.5, 0.68, 1.0])
def test_duplicate_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(duplicates, "PART_ROWS", 3)
    r = random.Random(int(threshold * 100))
    long = "".join(r.choice("abcdef字") for _ in range(400))
    rows = []
    for g in ("p", "q", None):
        texts = [" ".join(r.choice(WORDS) for _ in range(r.randint(0, 30))) for _ in range(25)]
        texts += [None, "", " ", texts[0].upper(), texts[0] + "  ", texts[1], texts[1]]
        # One contains the other, at and below the bound, with words and without.
        texts += [long, long[37:127], long[37:126], long[100:300], long[310:], f"x{texts[2]} {texts[3]} {texts[4]}y", f"{texts[2]} {texts[3]} {texts[4]}"]
        rows += [(g, i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "g string, k int, t string").repartition(4)
    found = [tuple(x) for x in duplicates.duplicate_pairs(df, "g", "k", "t", threshold).collect()]
    assert len(found) == len(set(found)) and set(found) == plain_pairs(rows, threshold)
    assert duplicates.duplicate_pairs(df.limit(0), "g", "k", "t", threshold).count() == 0


def test_one_group_with_half_of_all_rows(spark):
    """Ten thousand rows of one group, half of them copies: links are between texts, and no pair of copies is made."""
    rows = [("hot", i, "One line that everyone repeats." if i % 2 else f"Line number {i} of word{i % 50} and term{i}") for i in range(10_000)]
    links, members = duplicates.duplicate_links(spark.createDataFrame(rows, "g string, k int, t string"), "g", "k", "t", 0.9)
    assert members.count() == 10_000 and members.select("id").distinct().count() == 5_001 and links.count() == 0


def plain_loss(rows, k):
    out = {}
    for q in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == q]
        rank = {r[1]: i for i, r in enumerate(sorted(mine, key=lambda r: (-r[2], r[1])), 1)}
        best = sum((2 ** r[3] - 1) / math.log2(i + 1) for i, r in enumerate(sorted(mine, key=lambda r: -r[3])[:k], 1))
        disc = lambda r: 1 / math.log2(rank[r[1]] + 1) if rank[r[1]] <= k else 0.0  # noqa: E731, B023
        n, loss, weight = 0, 0.0, 0.0
        for a in mine:
            for b in mine:
                if a[3] > b[3]:
                    w = abs((2 ** a[3] - 2 ** b[3]) * (disc(a) - disc(b))) / best * math.sqrt(a[4] * b[4])
                    n, loss, weight = n + 1, loss + w * math.log1p(math.exp(b[2] - a[2])), weight + w
        if n:
            out[q] = (n, loss / weight if weight else 0.0)
    return out


def test_lambda_loss(spark):
    r = random.Random(3)
    rows = [(q, c, round(r.random(), 1), r.choice([0, 0, 0, 1, 2, 3]), r.random()) for q, n in ((1, 60), (2, 3), (3, 1), (4, 8)) for c in range(n)]
    rows += [(5, c, 0.5, 0, 1.0) for c in range(5)] + [(6, c, 0.5, c % 2, 0.0) for c in range(4)]
    df = spark.createDataFrame(rows, "q int, c int, s double, g int, f double")
    for k in (1, 5, 10):
        found = {x["q"]: (x["pairs"], x["loss"]) for x in ranking.lambda_loss(df, "q", "c", "s", "g", "f", k).collect()}
        want = plain_loss(rows, k)
        assert set(found) == set(want) and all(found[q][0] == want[q][0] and found[q][1] == pytest.approx(want[q][1], abs=1e-9) for q in want)
    with pytest.raises(Exception, match="without a score"):
        ranking.lambda_loss(spark.createDataFrame([(1, 1, None, 1, 1.0)], df.schema), "q", "c", "s", "g", "f").collect()


def test_long_list_makes_few_pairs(spark):
    """A list of twenty thousand candidates has 133 million pairs; ten of them meet the others."""
    df = spark.range(20_000).selectExpr("0 as q", "id as c", "cast(id % 977 as double) / 977 as s", "cast(id % 3 as int) as g", "1.0 as f")
    n = [6667, 6667, 6666]
    assert ranking.lambda_loss(df, "q", "c", "s", "g", "f").first()["pairs"] == n[0] * n[1] + n[0] * n[2] + n[1] * n[2]


def test_ranked_records(spark):
    r = random.Random(4)
    families = [*evidence.FAMILY_WORDS, "other", None]
    docs = [(i, " ".join(r.choice(WORDS + ["the", "control"]) for _ in range(r.randint(0, 12))) if i else None, r.choice([None, -1, 0, 7, 900])) for i in range(60)]
    asked = [(j, sorted(plain_words(" ".join(r.choice(WORDS) for _ in range(r.randint(0, 9))))), r.choice(families)) for j in range(12)]
    found = evidence.ranked_records(spark.createDataFrame(docs, "d int, text string, value int"), spark.createDataFrame(asked, "j int, query_words array<string>, family string"), "d", "j", 5)
    want = set()
    for j, query, family in asked:
        scored = []
        for d, text, value in docs:
            own = plain_words(text)
            shared = len(set(query) & own)
            if shared >= 2:
                scored.append((-round(shared * 2.2 + 10.0 * shared / max(1, len(query)) + 0.55 * len(set(evidence.FAMILY_WORDS.get(family, ())) & own) + math.log1p(max(0, value or 0)) / 2.5 + 2.0, 6), d))
        want |= {(j, d, -s, i) for i, (s, d) in enumerate(sorted(scored)[:5], 1)}
    assert {(x["j"], x["d"], x["score"], x["rank"]) for x in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_a_text_gives_few_blocks_and_its_part_is_met_at_any_place(spark):
    """A text of n characters is hashed n / 45 times, and each part of 90 characters or more still meets it."""
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh é𝛼") for _ in range(400)).strip()
    rows = [(1, 0, text)] + [(1, 1 + i, text[i : i + size]) for i, size in enumerate([90, 91, 134, 135] * 60) if i + size <= len(text)]
    df = spark.createDataFrame(rows, "g int, k int, t string")
    found = duplicates.duplicate_pairs(df, "g", "k", "t", 1.0).collect()
    assert {tuple(r) for r in found} == plain_pairs(rows, 1.0)
    blocks = df.filter("k = 0").select(F.size(duplicates._blocks(F.col("t"), True)).alias("n"), F.length("t").alias("chars")).first()
    assert blocks["n"] == blocks["chars"] // 45
