"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd inputs."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm import components, exact_dedup, mixing, packing, quality, setsketch, sharding, suffix_tree, syncmers, warc, words, wrappers
from sievework.llm.queries import vocabulary

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = "The quick brown fox, number 7, jumps over lazy dogs. " * 4000
BASE = " ".join(f"word{i}" for i in range(120))
ODD = [
    (1, "Same text here, again and again.", "en", "a", 1),
    (2, "Same  text\there, again and again.", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (None, "A text without a key", "en", "", 1),
    (6, LONG, "en", "a", 1),
    (7, BASE, "en", "a", 1),
    (8, BASE.replace("word60", "other"), "en", "a", 1),
    (9, "É à l'été <|endoftext|> ’s 12,5%", "fr", "a", 1),
    (9, "É à l'été <|endoftext|> ’s 12,5%", "fr", "a", 1),
    (11, " \n\t ", "en", "c", 3),
    (12, "x", "en", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    # Extra columns whose names clash with those that operators add.
    clash = ["size", "shard", "slot", "kept", "score", "mix_copy", "component_id", "predicted", "n_shingles"]
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1 if i % 2 else 0) for i in range(40)], "doc_id long, quality int")


# Mixing


def test_mixing_counts_follow_the_rates(spark):
    docs = spark.createDataFrame([(i, "t", "en", "big" if i % 10 else "small", 1) for i in range(4000)], SCHEMA)
    found = mixing.poisson_mix(docs, weights={"big": 1.0, "small": 1.0})
    n = {r["source"]: r["count"] for r in found.groupBy("source").count().collect()}
    assert abs(n["big"] - 2000) < 200 and abs(n["small"] - 2000) < 300
    per = {r["mix_copies"] for r in found.filter("source = 'small'").collect()}
    assert len(per) > 3 and found.filter("mix_copy > mix_copies").count() == 0
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in mixing.poisson_mix(docs, weights={"big": 1.0, "small": 1.0}).collect()]


def test_mixing_large_rate(spark):
    docs = spark.createDataFrame([(i, "t", "en", "x" if i else "rare", 1) for i in range(400)], SCHEMA)
    n = mixing.poisson_mix(docs, weights={"rare": 1.0}).count()
    assert 300 < n < 500


def test_mixing_odd(odd, empty):
    found = mixing.poisson_mix(odd, temperature=1.0)
    assert set(odd.columns) <= set(found.columns) and found.count() > 0
    assert mixing.poisson_mix(empty).count() == 0
    assert mixing.poisson_mix(odd, weights={"none": 1.0}).count() == 0


# Quality


def test_quality_held_out(spark):
    rng = np.random.default_rng(3)
    vocab = ["the", "and", "tion", "house", "river", "stone", "light", "under", "green", "walk"]
    rows = []
    for i in range(300):
        w = [str(x) for x in rng.choice(vocab, 60)]
        bad = i % 3 == 0
        if bad:
            w = [x + "###" for x in w] if i % 2 else [w[0]] * 60
        rows.append((i, " ".join(w), int(not bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in quality.scored(docs, labels).collect()}
    held = [i for i, _, _ in rows if found[i]["held_out"]]
    assert held and all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert np.mean([found[i]["predicted"] == q for i, _, q in rows if found[i]["held_out"]]) > 0.9


def test_quality_reads_the_whole_text(labels):
    net = quality.fit([b"plain words here " * 5] * 20 + [b"### $$$ ### " * 5] * 20, np.array([1] * 20 + [0] * 20), steps=200)
    good = b"plain words here " * 400
    a, b = net.good([good, good + b"### $$$ ### " * 20])
    assert a > 0.5 > b


def test_quality_odd(odd, empty, labels):
    found = quality.scored(odd, labels)
    assert found.count() == len(ODD) and found.filter("score < 0 or score > 1 or score is null").count() == 0
    assert quality.scored(empty, labels).count() == 0
    assert quality.scored(odd, labels.limit(0)).select("score").distinct().count() == 1


# Exact copies


def brute_copies(rows):
    groups = collections.defaultdict(list)
    for k, t, *_ in rows:
        norm = "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in t or "")
        while "  " in norm:
            norm = norm.replace("  ", " ")
        groups[norm].append(k)
    return groups


@pytest.mark.parametrize("files", ["1", "100"])
def test_exact_copies(spark, odd, tmp_path, files):
    path = f"file://{tmp_path}/docs"
    odd.write.parquet(path)
    found = exact_dedup.exact_duplicates(spark, path, maxFilesPerTrigger=files).collect()
    groups = brute_copies(ODD)
    assert len(found) == len(ODD) and sum(r["kept"] for r in found) == len(groups)
    for norm, keys in groups.items():
        mine = [r for r in found if r["text_digest"] == hashlib.sha256(norm.encode()).hexdigest()]
        assert len(mine) == len(keys) and {r["group_size"] for r in mine} == {len(keys)}
        assert {r["keep_id"] for r in mine} == {min((k for k in keys if k is not None), default=None)}


def test_exact_copies_survive_equal_digests(spark, odd, tmp_path):
    path = f"file://{tmp_path}/docs"
    odd.write.parquet(path)
    weak = exact_dedup.exact_duplicates(spark, path, digest=lambda t: F.substring(F.sha2(t, 256), 1, 0)).collect()
    strong = exact_dedup.exact_duplicates(spark, path).collect()
    key = lambda r: (str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"])
    assert sorted(map(key, weak)) == sorted(map(key, strong))


def test_exact_copies_empty(empty, odd):
    assert exact_dedup.without_copies(empty).count() == 0
    kept = exact_dedup.without_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(brute_copies(ODD))


# Sharding


def test_shards(spark, empty, odd):
    rng = np.random.default_rng(5)
    rows = [(i, "copy of one text" if i % 3 == 0 else "w " * int(rng.integers(1, 200)) + str(i)) for i in range(3000)]
    found = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    size = {i: len(t.encode()) + 1 for i, t in rows}
    assert all(found["size"] == found["doc_id"].map(size)) and len(found) == 3000
    assert all(found["text_crc32"] == found["doc_id"].map({i: zlib.crc32(t.encode()) for i, t in rows}))
    per = found.groupby("shard")["size"].sum()
    assert len(per) == 8 and per.max() - per.min() < 2 * found["size"].max() + per.sum() / 1000
    for _, part in found.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert sharding.sharded(empty).count() == 0
    assert sharding.sharded(odd, 3).count() == len(ODD)


# Scoring


def test_scores_against_brute_force(spark):
    rng = np.random.default_rng(7)
    vocab = ["the", "of", "and", *[f"w{i}x" for i in range(60)]]
    rows = [(i, " ".join(str(x) for x in rng.choice(vocab, int(rng.integers(0, 40))))) for i in range(150)]
    found = suffix_tree.suffix_tree_scores(spark.createDataFrame(rows, "doc_id long, text string"), lambda k: suffix_tree.fold(k) != 1, often=30).collect()
    train = [t.lower().split() for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    count = collections.Counter(w for t in train for w in t)
    n, v = sum(count.values()) + len(train), len(count) + 1
    p = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    text = dict(rows)
    for r in found:
        mine = text[r["doc_id"]].lower().split()
        assert r["base_score"] == pytest.approx(sum(p(count[w]) for w in mine) + p(len(train)))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(mine) + 1, sum(count[w] > 0 for w in mine) + 1, n)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) and r["score"] < 0


def test_tree_states_are_longest_suffixes():
    rng = np.random.default_rng(11)
    texts = [bytes(rng.choice(list(b"abc"), 50)) for _ in range(60)]
    depth = 3
    data, real = suffix_tree.byte_stream(texts, depth)
    counts = {}
    for d in range(depth + 1):
        grams = np.zeros(len(data) - depth, np.uint64)
        for j in range(d, -1, -1):
            grams = grams << np.uint64(8) | data[depth - j : len(data) - j]
        counts[d] = np.unique(grams[real[depth:]], return_counts=True)
    tree = suffix_tree.grow(counts, depth, 2, 1000)
    assert len(tree.logp) > 3
    whole = tree.score(data)
    for at in range(0, len(whole), 97):  # started anywhere, the last bytes alone decide
        part = tree.score(data[max(0, at - depth) : at + depth + 1])
        assert whole[at] == pytest.approx(part[-1], abs=1e-6) or at < depth
    width = len(set(suffix_tree.BYTES) - set(b"abc "))
    known = tree.logp[:, :-1]
    assert np.allclose((10.0**known).sum(1) + width * 10.0 ** tree.logp[:, -1], 1, atol=1e-4)


def test_scores_odd(odd, empty):
    found = suffix_tree.suffix_tree_scores(odd, lambda k: suffix_tree.fold(k) != 1)
    assert found.count() == len(ODD) and found.filter("score is null or base_score is null").count() == 0
    assert suffix_tree.suffix_tree_scores(empty, lambda k: True).count() == 0
    none = suffix_tree.suffix_tree_scores(odd, lambda k: False).collect()
    assert {r["n_known"] for r in none} == {0} and {r["train_tokens"] for r in none} == {0}


# Packing


def check_packing(rows, found, capacity):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(vocabulary())
    want = sorted(([*encoder.encode(t or "", add_special_tokens=False).ids, 2] for _, t, *_ in rows))
    by_sequence = collections.defaultdict(list)
    for r in found:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
    texts = collections.defaultdict(list)
    for r in found:
        texts[r["doc_id"]].append((r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4").tolist()))
    got = []
    for parts in texts.values():
        ids = [x for start, _, piece in sorted(parts) for x in piece]
        assert {n for _, n, _ in parts} == {len(ids)}
        assert [s for s, _, _ in sorted(parts)] == np.cumsum([0, *[len(p) for _, _, p in sorted(parts)]])[:-1].tolist()
        got.append(ids)
    assert sorted(got) == want


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_round_trip(odd, capacity):
    numbered = odd.withColumn("doc_id", F.monotonically_increasing_id())
    check_packing(ODD, packing.pack(numbered, vocabulary(), capacity=capacity).collect(), capacity)
    assert len({r["doc_id"] for r in packing.pack(odd, vocabulary(), capacity=capacity).collect()}) == len({r[0] for r in ODD})


def test_packing_empty(empty):
    assert packing.pack(empty, vocabulary()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_word_ids_are_the_tokenizers(texts):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(vocabulary())
    found = [np.frombuffer(x, "<u4").tolist() for x in packing.encoder(vocabulary()).encode(t.encode() for t in texts)]
    assert found == [encoder.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=40))
def test_assignment_leaves_no_padding(lengths):
    rows = packing.assign(lengths, 64, 1.0, 0.01)
    assert sum(r[2] for r in rows) == sum(lengths)
    used = collections.Counter()
    for _, _, n, s, _ in rows:
        used[s] += n
    assert all(n == 64 or n & (n - 1) == 0 for n in used.values())


# Pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><header><h2>Site</h2></header><!-- no --><div class="side-bar sidebar">Side</div>
<article><h1>{title}</h1><p>First <b>bold</b> &amp; more.<p>Second&nbsp;one<br>line.</p>{extra}</article>
<section class="comments"><p>Nice!</p></section><form><p>Name</p></form><footer>&copy; Site</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "http://a.org/1", PAGE.format(title="One", extra="")), (2, "http://a.org/2", PAGE.format(title="Two", extra="<ul><li>x</li><li>y</li></ul>")), (3, None, None), (4, "http://a.org/3", ""), (5, "http://b.org/", "<p>Only a paragraph"), (6, "http://b.org/2", "<article><p>Cut off")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r for r in wrappers.extracted(pages).collect()}
    assert found[1]["text"] == "One First bold & more. Second one line."
    assert found[2]["text"] == "Two First bold & more. Second one line. x y"
    assert [found[i]["text"] for i in (3, 4, 5, 6)] == ["", "", "Only a paragraph", "Cut off"]
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())
    assert wrappers.extracted(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<body class="has-sidebar"><div class="content with-sidebar"><article class="post ad-free"><header class="article-header"><h1>T</h1></header><p>A</p><div class="sidebar">S</div></article></div><div class="sidebar"><p>no</p></div></body>', "T A"),
        ('<body><div id="header">H</div><div class="content"><p>A b</p><p>C</p></div><div id="comments"><article class="comment">c</article></div><footer>f</footer></body>', "A b C"),
        ('<main><section class="post"><p>x</p></section></main><div class="menu">m</div>', "x"),
        ('<div class="cookieNotice">We use</div><p>y</p><noscript>z</noscript>', "y"),
    ],
)
def test_marks(page, text):
    tree = wrappers.parsed(page)
    assert wrappers.main_text(page, wrappers.form_of(tree)) == text


def test_wrapper_has_optional_and_repeated_groups():
    a = wrappers.form_of(wrappers.parsed("<div><p>a</p><p>b</p></div>"))
    b = wrappers.form_of(wrappers.parsed("<div><p>a</p><ul><li>x</li></ul></div>"))
    both = wrappers.inferred([a, b])
    assert wrappers.shape(both) == ["e", "", [["e", "div", [["+", [["e", "p", [["t"]]]]], ["?", ["e", "ul", [["e", "li", [["t"]]]]]]]]]]
    for page in ("<div><p>a</p></div>", "<div><p>a</p><p>b</p><p>c</p><ul><li>x</li></ul></div>"):
        assert wrappers.matched(both, wrappers.parsed(page)) is not None
    assert wrappers.matched(both, wrappers.parsed("<div><h1>a</h1></div>")) is None


def test_template_texts_are_fixed(spark):
    page = "<body><div><p>Welcome to our site</p></div><section><p>{0}</p></section></body>"
    bodies = [" ".join(f"word{i}x{j}" for j in range(60)) for i in range(6)]
    pages = spark.createDataFrame([(i, "http://c.org/x", page.format(x)) for i, x in enumerate(bodies)], "page_id long, url string, html string")
    assert {r["text"] for r in wrappers.extracted(pages).collect()} == set(bodies)


# Records


def test_records(spark):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nX-Fold: a\r\n b\r\n\r\n<title>T \xe9</title><p>Caf\xe9</p><a href='/x?a=1&amp;b'>go</a><script>no</script>"
    rows = [("<urn:1>", "http://a/", "2024-01-01T00:00:00Z", block), (None, None, None, None), ("<urn:3>", "http://b/", None, b"no header")]
    df = spark.createDataFrame(rows, "record_id string, target_uri string, date string, block binary")
    found = warc.derivatives(df).collect()
    assert len(found) == 6 and warc.derivatives(df.limit(0)).count() == 0
    meta, text = [next(r for r in found if r["refers_to"] == "<urn:1>" and r["record_type"] == k) for k in ("metadata", "conversion")]
    assert text["block"].decode() == "Café\ngo" and text["concurrent_to"] == meta["record_id"] and meta["concurrent_to"] == text["record_id"]
    assert [(h["name"], h["value"]) for h in text["headers"]] == [("Content-Type", "text/html; charset=latin-1"), ("X-Fold", "a b")]
    assert b"outlink: /x?a=1&b\r\n" in meta["block"] and "title: T é\r\n".encode() in meta["block"]
    for r in found:
        assert r["block_digest"] == warc.sha1(bytes(r["block"])) and r["content_length"] == len(r["block"])
    back = list(warc.read_records(b"".join(warc.serialised(r.asDict()) for r in found)))
    assert [b for _, b in back] == [bytes(r["block"]) for r in found]
    assert [f["WARC-Refers-To"] for f, _ in back] == [r["refers_to"] for r in found]


# Fingerprints


def test_fingerprints(spark, odd, empty):
    rows = sorted(((k, t or "") for k, t, *_ in ODD), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    found = syncmers.fingerprints(odd).collect()
    assert len(found) == len(ODD) and syncmers.fingerprints(empty).count() == 0
    want = []
    for i, (k, t) in enumerate(rows):
        after, cut = rows[(i + 1) % len(rows)][1], len(t) // 4
        want.append((str(k), len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in found) == sorted(want)
    by = {r["doc_id"]: r for r in found}
    assert by[7]["near_next"] > 0.5 and all(0 <= r["near_next"] <= 1 for r in found)


def test_ranges_meet_at_their_ends(spark):
    rows = [(i * 3 % 5003, f"text {i} " * (i % 7)) for i in range(5003)]
    found = {r["doc_id"]: r["edited_sha256"] for r in syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ordered = sorted(rows)
    for i, (k, t) in enumerate(ordered):
        after, cut = ordered[(i + 1) % len(ordered)][1], len(t) // 4
        assert found[k] == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.text(min_size=40, max_size=200), st.integers(0, 30), st.text(max_size=20))
def test_anchors_are_context_free(text, cut, front):
    points = lambda s: np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    whole, places = syncmers.anchors(points(front + text))
    part, _ = syncmers.anchors(points(text))
    kmers = len(text) - syncmers.K + 1
    inside = {int(h) for h, p in zip(whole, places, strict=True) if p >= len(front)}
    if kmers > 60 and len(part) < len(text) - syncmers.INNER + 1 and len(whole) < len(front + text) - syncmers.INNER + 1:
        assert {int(h) for h in part} == inside


# Near copies


def brute_components(rows, size, percent):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    keys = collections.defaultdict(list)
    for i, r in enumerate(rows):
        keys[root(i)].append(r[0])
    return sets, [min((k for k in keys[root(i)] if k is not None), default=None) for i in range(len(rows))]


def families(seed, n, edits):
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(n):
        base = [f"f{f}w{int(x)}" for x in rng.integers(0, 500, 90)]
        for _ in range(12):
            copy = list(base)
            for at in rng.integers(0, 90, int(rng.integers(0, edits))):
                copy[at] = f"edit{int(rng.integers(0, 10**6))}"
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize(("size", "percent", "edits"), [(3, 85, 6), (5, 80, 5), (3, 85, 12)])
def test_near_copies(spark, size, percent, edits):
    rows = families(edits, 20, edits)
    found = {r["doc_id"]: r for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()}
    sets, want = brute_components(rows, size, percent)
    assert [found[k]["component_id"] for k, _ in rows] == want
    assert [found[k]["n_shingles"] for k, _ in rows] == [len(s) for s in sets]
    assert all(found[k]["kept"] == (k == c) for (k, _), c in zip(rows, want, strict=True))


def test_near_copies_odd(odd, empty):
    found = setsketch.near_duplicates(odd).collect()
    _, want = brute_components(ODD, 5, 80)
    assert collections.Counter((r["doc_id"], r["component_id"]) for r in found) == collections.Counter((r[0], w) for r, w in zip(ODD, want, strict=True))
    groups = collections.Counter(r["component_id"] for r in found if r["text"] and r["text"].strip())
    assert sum(r["kept"] for r in found if r["text"] and r["text"].strip()) == len(groups)
    assert all(r["kept"] for r in found if not (r["text"] or "").strip())
    assert setsketch.near_duplicates(empty).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[500:2500]
    sketch = lambda x: setsketch.registers(setsketch.minima(words.mix(x), np.array([0])))[:, 0]
    assert (setsketch.merge(sketch(a), sketch(b)) == sketch(np.concatenate([a, b]))).all()
    assert setsketch.likelihood_estimates(sketch(a)[None], sketch(b)[None], np.array([2000]), np.array([2000]))[0] == pytest.approx(1500 / 2500, abs=0.12)


@pytest.mark.parametrize(("nodes", "links", "chain"), [(60, 50, False), (40, 0, True), (5, 0, False)])
def test_components(spark, nodes, links, chain):
    rng = np.random.default_rng(nodes)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, nodes, (links, 2))]
    if chain:
        order = rng.permutation(nodes).tolist()
        pairs += list(zip(order, order[1:], strict=False))
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    least = {n: n for p in pairs for n in p if p[0] != p[1]}
    for _ in range(nodes):
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert found == least


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5), st.integers(1, 4))
def test_words_and_shingles(texts, size):
    data = [t.encode() for t in texts]
    hashes, counts = words.hashed_words(data)
    split = [t.lower().split() for t in data]
    assert counts.tolist() == [len(x) for x in split]
    flat = [w for x in split for w in x]
    assert len({(w, int(h)) for w, h in zip(flat, hashes, strict=True)}) == len(set(flat)) == len(set(hashes.tolist()))
    found, many = words.shingles(hashes, counts, size)
    assert many.tolist() == [max(len(x) - size + 1, min(len(x), 1)) for x in split] and len(found) == many.sum()
