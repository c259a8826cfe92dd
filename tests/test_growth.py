"""Steps that must not multiply with the input: what is shuffled, and what is computed once."""

from pyspark.sql import functions as F

from sievework.functions import cleaning as C
from sievework.functions import tokens as T
from sievework.functions.sentences import stripped
from sievework.operators import evidence as E
from sievework.operators import retrieval as R
from sievework.sources.index import save_index, search_index


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(spark):
    docs = spark.createDataFrame([(i, f"The film held word{i % 7} under light. It stayed {i} hours in air.") for i in range(40)], "doc_id bigint, text string")
    asked = spark.createDataFrame([(i, f"What holds word{i} in light?") for i in range(5)], "item_id bigint, text string")
    return docs, asked


def test_pairs_of_questions_and_documents_are_not_shuffled(spark):
    docs, asked = tables(spark)
    found = plan(R.bm25(docs, asked, "doc_id", "item_id", 3))
    exchanges = [x for x in found.splitlines() if "Exchange hashpartitioning(" in x]
    assert any("hashpartitioning(doc_id#" in x for x in exchanges)
    assert not [x for x in exchanges if "item_id#" in x.split("hashpartitioning(")[1] and "doc_id#" in x.split("hashpartitioning(")[1].split("]")[0]]


def test_a_ranking_is_computed_once_for_its_packets(spark):
    docs, asked = tables(spark)
    found = E.compiled(R.bm25(docs, asked, "doc_id", "item_id", 3), docs, asked, "item_id", "doc_id")
    assert "Window" not in plan(found)
    assert found.count() > 0


def test_packs_are_sorted_without_texts_or_words(spark):
    rows = [(1, i, "article_master_pack" if i % 3 == 0 else "stability_pack", f"Humidity degradation of control{i % 5} interfaces", 7, 1 + i // 9, "other", ["humidity", "control4"]) for i in range(18)]
    packs = spark.createDataFrame(rows, "core bigint, card bigint, card_type string, embedding_text string, item bigint, rank int, family string, query_words array<string>")
    whole = E.topic_packs(packs, "item", "core", "card")
    packs = packs.select("*", E.words(F.col("embedding_text")).alias("own")).drop("embedding_text")
    found = E.topic_packs(packs, "item", "core", "card", "own")
    assert not [x for x in plan(found).splitlines() if " Sort [" in x and "own#" in x] and not {"own", "query_words"} & set(found.columns)
    keys = ["item", "core", "card", "pack_place", "pack_score"]
    assert sorted(map(tuple, found.select(keys).collect())) == sorted(map(tuple, whole.select(keys).collect()))


def test_a_stored_index_does_not_shuffle_pairs(spark, tmp_path):
    docs, asked = tables(spark)
    save_index(docs, f"file://{tmp_path}/index", "doc_id")
    found = search_index(spark, f"file://{tmp_path}/index", asked, "item_id", "doc_id", 3)
    exchanges = [x.split("hashpartitioning(")[1].split("]")[0] for x in plan(found).splitlines() if "Exchange hashpartitioning(" in x]
    assert exchanges and not [x for x in exchanges if "item_id#" in x and "doc_id#" in x]
    want = R.bm25(docs, asked, "doc_id", "item_id", 3).select("item_id", "doc_id", "rank")
    assert sorted(map(tuple, found.select("item_id", "doc_id", "rank").collect())) == sorted(map(tuple, want.collect()))


def test_questions_that_ask_for_a_term_are_not_shuffled_with_documents(spark):
    docs, asked = tables(spark)
    found = plan(R.bm25(docs, asked, "doc_id", "item_id", 3))
    assert "BroadcastHashJoin [term#" in found and "Exchange hashpartitioning(term#" not in found


def test_a_question_is_sorted_once_for_all_its_papers(spark, monkeypatch):
    import pandas as pd

    sorts, whole = [], pd.DataFrame.sort_values
    docs, asked = tables(spark)
    held = []
    from pyspark.sql.group import GroupedData

    applied = GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, f, schema: held.append(f) or applied(self, f, schema))
    E.compiled(R.bm25(docs, asked, "doc_id", "item_id", 5), docs, asked, "item_id", "doc_id")
    monkeypatch.setattr(pd.DataFrame, "sort_values", lambda *a, **k: sorts.append(1) or whole(*a, **k))
    rows = [(7, 10 + r, r, 30, p, "k" if p == 2 else f"{r}-{p}", 9, p % 2) for r in (2, 1) for p in range(4)]
    found = held[0](pd.DataFrame(rows, columns=["item_id", "doc_id", "rank", "chars", "place", "key", "n", "overlap"]))
    assert len(sorts) == 1
    assert found.values.tolist() == [[7, f"E00{r}", 10 + r, r, p] for r in (1, 2) for p in ((1, 3, 0))]


def test_texts_are_normalised_by_what_they_keep(spark):
    """As by replacing all else, but without a replacement for each gap, which took most of the time."""
    texts = ["", " ", "A  b", "\n.Lead-in 3.5e^-2 ½ µmKİİx+ ", "x y z 10^-3 5%\t7", "ÄÖ", "a" * 3000 + " é " * 500, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t, full = F.col("t"), F.coalesce("t", F.lit(""))
    ascii_ = lambda x: F.trim(F.regexp_replace(F.lower(F.regexp_replace(x, r"[^\x00-\x7F]+", " ")), r"[^a-z0-9.+-]+", " "))
    compare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^a-z0-9.%+-]+", " "), r"\s+", " "))
    found = rows.select(T.normalise(t).alias("a"), T.normalise(t, True).alias("b"), T.compare_text(t).alias("c"))
    assert found.collect() == rows.select(ascii_(full).alias("a"), ascii_(F.replace(full, F.lit("^-"), F.lit(" "))).alias("b"), compare.alias("c")).collect()
    assert "regexp_replace" not in plan(found)


def test_a_unit_is_searched_once_for_words_and_verbs(spark):
    """The verbs' alternatives branch by letters, and a unit's words are found once, with the results as before."""
    verbs = [w for x in C.VERB[len(r"(?i)\b(?:") : -len(r")\b")].split("|") for w in ([x[:-1], x[:-2]] if x.endswith("?") else [x])]
    units = [f"{a}{v}{b}" for v in verbs for a, b in (("", ""), ("The film ", " it"), ("x", ""), ("", "x"), ("It (", ")."))]
    units += ["", "see for , and it", "for and are", "fort and are", "OF,AND", "from , to", "the , and  the", "the , and then", "Ab 1 " * 12, "Ab 1 " * 11 + "Ab", "Word " * 30, "Table 1 and table 2 and"]
    units += [" ".join(f"W{i}" for i in range(n)) for n in (5, 6, 23, 24, 40)] + [" ".join(f"w{i % k}" for i in range(30)) for k in (11, 12, 13, 14)]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(units)], "i int, u string")
    u = F.col("u")
    words = lambda pattern: F.transform(T.all_of(u, pattern), F.lower)
    w, v = words(T.EVIDENCE_PATTERN), words(r"[A-Za-z][A-Za-z0-9+./-]*")
    science = ~C.has_any(u, C.NON_SCIENCE) & (F.size(F.split(F.lower(u), "table ")) - 1 < 2) & ~((F.size(w) >= 24) & (C.variety(w) < 0.43))
    begins = (u == "") | u.rlike(r"^(?:\p{Lu}|\p{Nd}|[(\[])") | F.lower(u).rlike("^(?:p-i-n|n-i-p)")
    informative = begins & ~C.has_any(u, C.GENERIC) & ~u.rlike(C.MALFORMED) & (F.size(v) >= 6) & ~((F.length(u) >= 70) & ~u.rlike(C.VERB)) & ~((F.size(v) >= 24) & (C.variety(v) < 0.40))
    found = rows.select(C.is_science_unit(u).alias("s"), C.is_informative(u).alias("f"), u.rlike(C._VERB).alias("v"), u.rlike(C._MALFORMED).alias("m"))
    assert found.collect() == rows.select(science.alias("s"), informative.alias("f"), u.rlike(C.VERB).alias("v"), u.rlike(C.MALFORMED).alias("m")).collect()
    assert plan(rows.select(C.is_science_unit(u).alias("s"))).count("regexp_extract_all") == 1


def test_white_space_is_stripped_as_by_its_property(spark):
    texts = [f"{chr(c)}\n a{chr(c)}b {chr(c)}" for c in [*range(0x00, 0x30), *range(0x7F, 0xB0), 0x1680, 0x180E, *range(0x1FFF, 0x2070), 0x3000, 0xFEFF]] + ["", "\r\n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.select(stripped(F.col("t"))).collect() == rows.select(F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).collect()
    assert "regexp_replace" not in plan(rows.select(stripped(F.col("t"))))
