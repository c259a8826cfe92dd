"""The full-text index against the engine that its words, phrases and ranking follow (SQLite's FTS5), and its sink."""

import os
import random
import sqlite3

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.functions.python import engine_stem, engine_words, porter_tokens
from sievework.functions.tokens import lexical_expression, lexical_phrases
from sievework.plans import fulltext as plans
from sievework.sources import fulltext
from sievework.sources.work import folder

FOLDER = "/root/testdata/sf0.001"


def engine(texts, tokenize="porter unicode61"):
    """An engine's own index of {id: text}."""
    con = sqlite3.connect(":memory:")
    try:
        con.execute(f"CREATE VIRTUAL TABLE t USING fts5(text, content='', tokenize='{tokenize}')")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no full-text search")
    con.executemany("INSERT INTO t(rowid, text) VALUES (?, ?)", texts.items())
    return con


def engine_tokens(con):
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    out = {}
    for term, doc, _ in con.execute("SELECT term, doc, offset FROM v ORDER BY doc, offset"):
        out.setdefault(doc, []).append(term)
    return out


def test_words_and_stems_equal_the_engine():
    rng = random.Random(1)
    ends = "ational tional enci anci izer bli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti logi icate ative alize iciti ical ful ness al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize e ll s es ies sses ed ing eed y".split()
    texts = {}
    for i in range(300):
        found = []
        for _ in range(60):
            w = "".join(rng.choice("bcdfglmnprstvwxyaeiou") for _ in range(rng.randrange(5)))
            found.append(w + "".join(rng.choice(ends) for _ in range(rng.randrange(4))))
        texts[i] = " ".join(found)
    letters = [chr(c) for a, b in ((0x20, 0x2FF), (0x300, 0x377), (0x384, 0x386), (0x400, 0x520), (0x5D0, 0x5EA), (0x1E00, 0x1EFF), (0x3041, 0x3096), (0x4E00, 0x4E40)) for c in range(a, b)]
    for i in range(300, 900):
        texts[i] = "".join(rng.choice(letters) if rng.random() < 0.5 else rng.choice("aeiou nrst ") for _ in range(60))
    found = engine_tokens(engine(texts))
    for i, t in texts.items():
        assert [engine_stem(w) for w in engine_words(t)] == found.get(i, []), ascii(t)


def test_ranking_and_phrases_equal_the_engine(spark):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "heat cell film light layer".split() for b in ("", "s", "ing", "ed")] + ["the", "of", "and"]
    texts = {i: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))) for i in range(1, 150)} | {150: "", 151: None, 152: "a a a a"}
    asked = {0: ["heat"], 1: ["heat cell", "films"], 2: ["the heated cell", "of", "of"], 3: ["nowhere", "heat nowhere"], 4: ["!!", "light-layer"], 5: ["a a", "a a a"], 6: ["cell and the film"]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    path = folder(spark, "index")
    fulltext.save(docs, path, "doc_id", tokens=porter_tokens)
    rows = fulltext.search(fulltext.load(spark, path), spark.createDataFrame(list(asked.items()), "q int, phrases array<string>"), "q", "doc_id", 1000, tokens=porter_tokens).collect()
    con = engine({k: v or "" for k, v in texts.items()})
    for q, phrases in asked.items():
        match = " OR ".join(f'"{p}"' for p in phrases)
        want = [(k, s) for k, s in con.execute("SELECT rowid, bm25(t) AS s FROM t WHERE t MATCH ? ORDER BY s, rowid", (match,))]
        found = sorted((r["rank"], r["doc_id"], r["score"]) for r in rows if r["q"] == q)
        assert sorted((round(-s, 6), k) for k, s in want) == sorted((round(s, 6), k) for _, k, s in found), phrases
        by_rank = sorted(want, key=lambda x: (-round(-x[1], 9), x[0]))
        assert [k for k, _ in by_rank] == [k for _, k, _ in found], phrases


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not there")
def test_first_cores_equal_the_engine(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    con = engine(docs)
    asked = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", lexical_expression(F.col("text")).alias("e")).collect()
    want = {}
    for r in asked:
        seen, rank = set(), 0
        rows = con.execute("SELECT rowid, bm25(t) AS s FROM t WHERE t MATCH ? ORDER BY s, rowid LIMIT 2000", (r["e"],)).fetchall()
        for place, (k, s) in enumerate(sorted(rows, key=lambda x: (-round(-x[1], 9), x[0])), 1):
            if k % 100 not in seen and rank < 1200:
                seen.add(k % 100)
                rank += 1
                want[r["item_id"], k % 100] = (k, place, rank, round(-s, 5))
    found = {(r["query_id"], r["core_id"]): (r["doc_id"], r["facet_rank"], r["core_rank"], round(r["score"], 5)) for r in plans.fts_first_core(spark, FOLDER).collect()}
    assert {k: v[:3] for k, v in found.items()} == {k: v[:3] for k, v in want.items()}
    assert all(abs(found[k][3] - want[k][3]) < 2e-5 for k in want)


def test_sink_refuses_and_checks(spark, monkeypatch):
    with pytest.raises(ValueError, match="distinct"):
        fulltext.save(spark.createDataFrame([(1, "a"), (1, "b")], "doc_id int, text string"), folder(spark, "index"), "doc_id")
    with pytest.raises(ValueError, match="distinct"):
        fulltext.save(spark.createDataFrame([(1, "a"), (None, "b")], "doc_id int, text string"), folder(spark, "index"), "doc_id")
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id int, text string")
    path = folder(spark, "index")
    whole = fulltext.laid_out
    monkeypatch.setattr(fulltext, "laid_out", lambda rows, key: whole(rows.filter("term <> 'c'"), key))
    with pytest.raises(ValueError, match="places"):
        fulltext.save(docs, path, "doc_id")
    monkeypatch.setattr(fulltext, "laid_out", lambda rows, key: whole(rows.filter(~((F.col("term") == "") & (F.col("doc_id") == 2))), key))
    with pytest.raises(ValueError, match="2 documents were given; the index has 1"):
        fulltext.save(docs, path, "doc_id")
    monkeypatch.setattr(fulltext, "laid_out", whole)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):  # nothing was complete so far
        fulltext.load(spark, path)
    fulltext.save(docs, path, "doc_id")
    assert fulltext.load(spark, path).filter("bucket = -1").count() == 2


def test_empty_tables(spark):
    path = folder(spark, "index")
    fulltext.save(spark.createDataFrame([], "doc_id int, text string"), path, "doc_id")
    asked = spark.createDataFrame([(1, ["a"]), (2, None), (3, [])], "q int, phrases array<string>")
    assert fulltext.search(fulltext.load(spark, path), asked, "q", "doc_id", 5).count() == 0
    fulltext.save(spark.createDataFrame([(1, "a")], "doc_id int, text string"), path, "doc_id")
    assert [tuple(r)[:2] for r in fulltext.search(fulltext.load(spark, path), asked, "q", "doc_id", 5).collect()] == [(1, 1)]
    assert fulltext.search(fulltext.load(spark, path), asked.limit(0), "q", "doc_id", 5).count() == 0


def test_a_search_reads_its_buckets_and_columns(spark):
    docs = spark.createDataFrame([(i, f"t{i} shared") for i in range(40)], "doc_id int, text string")
    path = folder(spark, "index")
    fulltext.save(docs, path, "doc_id")
    terms = spark.createDataFrame([("t1",)], "term string").withColumn("bucket", fulltext.bucket_of(F.col("term")))
    found = fulltext.postings_of(fulltext.load(spark, path), terms).select("doc_id", "tf")
    assert [tuple(r) for r in found.collect()] == [(1, 1)]
    scan = next(x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x)
    assert "bucket#" in scan.split("PartitionFilters")[1].split("]")[0] and "positions" not in scan.split("ReadSchema")[1]


def test_phrases_of_expressions(spark):
    row = spark.createDataFrame([("What limits phase segregation of the 12.5 nm film?",)], "text string").select(lexical_phrases(F.col("text")).alias("p"), lexical_expression(F.col("text")).alias("e")).first()
    assert row["e"] == " OR ".join(f'"{p}"' for p in row["p"])


def test_texts_and_tokens_stay_where_they_are_read(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, None), (None, "x"), (3, "zz"), (3, "a ü a")], "doc_id int, text string")
    rows = fulltext.postings(docs.filter("doc_id < 3"), "doc_id")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    found = sorted((r["doc_id"], r["term"], r["tf"], r["positions"], r["length"]) for r in fulltext.postings(docs, "doc_id").collect())
    assert found == [(1, "", 3, [], 3), (1, "a", 1, [1], 3), (1, "b", 2, [0, 2], 3), (2, "", 0, [], 0), (3, "", 3, [], 3), (3, "a", 2, [0, 2], 3), (3, "ü", 1, [1], 3)]


def test_blocks_of_words_make_the_same_postings():
    rng = random.Random(3)
    texts = [[rng.choice("abcdé") for _ in range(rng.choice((0, 1, 7, 40)))] for _ in range(50)]
    want = sorted((i, w, [k for k, x in enumerate(t) if x == w], len(t)) for i, t in enumerate(texts) for w in set(t)) + [(i, "", [], len(t)) for i, t in enumerate(texts)]
    for block in (1, 30, 1 << 20):
        words = pa.array([[]] + texts, pa.list_(pa.string())).slice(1)
        parts = list(fulltext._places(words, pa.array(range(50)), block))
        found = [(d, t, p, n) for term, doc, tf, places, length in parts for t, d, f, p, n in zip(*(x.to_pylist() for x in (term, doc, tf, places, length)), strict=True) if f == (len(p) if t else n)]
        assert sorted(found) == sorted(want)


def test_phrases_of_frequent_words_are_not_matched_with_each_document(spark):
    """Of 400 pairs of words that all documents have, each document holds 39 at most: no join makes rows for the others."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(20)]
    docs = spark.createDataFrame([(i, " ".join(rng.sample(words, 20) + rng.sample(words, 20))) for i in range(100)], "doc_id int, text string")
    path = folder(spark, "index")
    fulltext.save(docs, path, "doc_id")
    phrases = spark.createDataFrame([(f"{a} {b}", [a, b]) for a in words for b in words], "phrase string, words array<string>")
    hits = fulltext.phrase_hits(fulltext.load(spark, path), phrases, "doc_id")
    found = {(r["doc_id"], r["phrase"]): r["f"] for r in hits.collect()}
    want = {}
    for r in docs.collect():
        split = r["text"].split()
        for pair in zip(split, split[1:], strict=False):
            want[r["doc_id"], " ".join(pair)] = want.get((r["doc_id"], " ".join(pair)), 0) + 1
    assert found == want

    joined = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return walk(node.plan())
        if "Join" in node.nodeName():
            joined.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(hits._jdf.queryExecution().executedPlan())
    assert joined and max(joined) <= 100 * 40
