"""Counts at every prefix against the library, which encodes every prefix anew."""

import os
import random

import pytest

from sievework.llm import token_counts
from sievework.llm.token_counts import PrefixCounter, longest_prefixes, prefix_counts, stored, tokens_before, totals

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
FOLDER = "/root/testdata/sf0.001"

FIXED = [
    "",
    "a",
    "  two  spaces\t\n",
    "don't we'll they're I'd x's 've'r 'll 'ree 'Re",
    "<|endoftext|>",
    "ab<|endoftext|>cd <|startoftext|>!!<|endoftext|><|endoftext|",
    "<|<|endoftext|>|>",
    "!!'re !!'r ''s",
    "İstanbul ΣΑΣ straße ﬁ Å Ω",
    "é́ 한한≠x̸ ́a ạ̧́b ≠",
    "日本語テキスト क़ ୆ା",
    "1234 5,6  a　b \x1c\x1d a\x1eb \x85 x",
    "\U0001f600\U0001f468‍\U0001f469 �\x00\x7f",
    "a" * 300,
    "ab" * 200,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    return lambda text: len(whole.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(PATH)


def at_every_prefix(library, text):
    return [library(text[:i]) for i in range(len(text) + 1)]


@pytest.mark.parametrize("text", FIXED)
def test_fixed_texts(library, counter, text):
    assert counter.counts(text).tolist() == at_every_prefix(library, text)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(library, counter, seed):
    rng = random.Random(seed)
    letters = ["abcdefghij'st re ll", "etaoin shrdlu'", "ABÉé éè'̈x!?.,;0123 ", "ạ̧́eo한 ≠≠", "日本語。、デ ", "<|endoftext|>start "]
    blocks = [(32, 0x500), (0x900, 0x1200), (0x1E00, 0x3100), (0xA000, 0xD7FF), (0x10000, 0x1F900)]
    for _ in range(250):
        chosen = rng.choice(letters) if rng.random() < 0.7 else "".join(chr(rng.randrange(*rng.choice(blocks))) for _ in range(12))
        text = "".join(rng.choice(chosen) for _ in range(rng.randrange(30)))
        if rng.random() < 0.2:
            text += rng.choice(["<|endoftext|>", "<|startoftext|>"]) + text[:5]
        assert counter.counts(text).tolist() == at_every_prefix(library, text), ascii(text)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    counter = PrefixCounter(PATH)
    for text in FIXED * 2:
        assert counter.counts(text)[-1] == library(text)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))


def test_rows_stay_rows(spark, library):
    rows = [(1, "one two three", "x"), (None, "null key", "x"), (None, "null key", "x"), (2, None, "x"), (3, "", "x"), (1, "one two three", "x"), (4, " \n ", None), (5, "long words " * 20_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, counts string")
    found = sorted(map(tuple, totals(prefix_counts(docs, PATH)).collect()), key=repr)
    assert found == sorted([(k, len(t or ""), len((t or "").encode()), library(t or "")) for k, t, _ in rows], key=repr)
    assert totals(prefix_counts(docs.limit(0), PATH)).count() == 0


@pytest.mark.parametrize("block", [1, 3, 8192])
def test_every_prefix_is_stored(spark, library, block):
    docs = spark.createDataFrame(list(enumerate(FIXED)), "doc_id int, text string")
    kept = stored(docs, PATH, block=block)
    rows = {}
    for r in kept.orderBy("doc_id", "first").collect():
        whole = rows.setdefault(r["doc_id"], [])
        assert r["first"] == len(whole) and len(r["counts"]) <= block
        whole += r["counts"]
    assert rows == {i: at_every_prefix(library, t) for i, t in enumerate(FIXED)}

    asked = [(i, n) for i, t in enumerate(FIXED) for n in (0, 1, 4, len(t), len(t) + 9)] + [(0, None), (0, -1), (None, 0), (99, 0)]
    answers = tokens_before(kept, spark.createDataFrame(asked, "doc_id int, n_chars long"), block=block)
    assert {(r["doc_id"], r["n_chars"]): r["n_tokens"] for r in answers.collect()} == {(i, n): library(FIXED[i][:n]) for i, n in asked if i is not None and i < 99 and n is not None and n >= 0}

    for budget in (0, 1, 5, 10**6):
        cut = {r["doc_id"]: r["cut_chars"] for r in longest_prefixes(kept, budget).collect()}
        assert cut == {i: max(n for n, c in enumerate(at_every_prefix(library, t)) if c <= budget) for i, t in enumerate(FIXED)}


def test_answers_of_repeated_keys(spark, library):
    docs = spark.createDataFrame([(1, "abc def"), (1, "abc def"), (1, "other words here"), (None, "x y")], "doc_id int, text string")
    kept = stored(docs, PATH, block=4)
    cut = longest_prefixes(kept, 1)
    assert sorted((r["doc_id"], r["n_chars"]) for r in cut.filter("doc_id is not null").collect()) == [(1, 7), (1, 16)]
    found = tokens_before(kept, spark.createDataFrame([(1, 7), (1, 7)], "doc_id int, n_chars int"), block=4)
    assert sorted(r["n_tokens"] for r in found.collect()) == sorted([library("abc def"), library("other w")])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not there")
def test_query_equals_library(spark, library):
    from sievework.llm.queries import op11_token_counts

    found = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in op11_token_counts(spark, FOLDER).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert found == {k: (len(t.encode()), library(t), library(t) > 2048) for k, t in texts.items()}
