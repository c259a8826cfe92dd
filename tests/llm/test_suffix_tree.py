"""Scores against a plain model of dictionaries, and sums of probabilities."""

import collections
import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from sievework.llm import suffix_tree as S

FRONT, SPACE = S.FRONT, S.SPACE


class Plain:
    """The model in dictionaries: byte contexts up to `depth`, and words before."""

    def __init__(self, texts, depth, least, often, unigram, alphabet=S.BYTES):
        self.depth, self.often, self.unigram = depth, often, unigram
        streams = [[FRONT] * depth + [b for w in t.split() for b in w + b" "] for t in texts]
        runs = [collections.Counter(tuple(s[i - d : i + 1]) for s in streams for i in range(depth, len(s))) for d in range(depth + 1)]
        ends = {k[-1] for r in runs for k in r} | {SPACE}
        self.all = sorted(set(alphabet) | ends)
        smooth = {b: runs[0][(b,)] + 0.5 for b in self.all}
        self.p = {(): {b: x / sum(smooth.values()) for b, x in smooth.items()}}
        gain = {}
        for d in range(1, depth + 1):
            after = collections.defaultdict(dict)
            for k, n in runs[d].items():
                after[k[:-1]][k[-1]] = n
            if d == 1:
                after.setdefault((SPACE,), {}), after.setdefault((FRONT,), {})
            for c, mass in after.items():
                total = max(runs[d - 1][c], sum(mass.values()))
                forced = c in ((SPACE,), (FRONT,))
                if (total < least and not forced) or c[1:] not in self.p:
                    continue
                parent = dict(self.p[c[1:]])
                if forced:
                    parent[SPACE] = 0.0
                    parent = {b: x / sum(parent.values()) for b, x in parent.items()}
                rest = max(total - sum(mass.values()) + len(mass), 1)
                self.p[c] = {b: (mass.get(b, 0) + rest * parent[b]) / (sum(mass.values()) + rest) for b in self.all}
                gain[c] = sum(n * math.log(n / total / parent[b]) for b, n in mass.items()) - 0.5 * len(mass) * math.log(max(total, 2)) if not forced else 1
        kept = {c for c, g in gain.items() if g > 0}
        for d in range(depth, 0, -1):
            for c in [c for c in kept if len(c) == d and d > 1]:
                if c[:-1] in gain:
                    kept.add(c[:-1])
                else:
                    kept.discard(c)
                kept.add(c[1:])
        self.kept = kept | {()}
        words = [t.split() for t in texts]
        self.count = collections.Counter(w for t in words for w in t)
        self.n, self.ends = sum(self.count.values()), len(texts)
        self.end = (self.ends + 0.5) / (self.n + self.ends + 1)
        self.among = self.n + 0.5 * (len(self.count) + 1)
        self.frequent = {w for w, c in self.count.items() if c >= often}
        self.after = collections.defaultdict(collections.Counter)
        self.seen = collections.defaultdict(list)
        for t in words:
            before = b""
            for i, w in enumerate(t):
                if i and t[i - 1] not in self.frequent:
                    self.after[t[i - 1]][w] += 1
                    self.seen[t[i - 1]].append((w, self.word(w, before)))
                before += w + b" "

    def spelled(self, word, before):
        log, history = 0.0, [FRONT] * self.depth + list(before)
        for b in [*word, SPACE]:
            d = next(d for d in range(self.depth, -1, -1) if tuple(history[len(history) - d :]) in self.kept)
            log += math.log(self.p[tuple(history[len(history) - d :])][b])
            history.append(b)
        return math.exp(log)

    def word(self, w, before):
        known = self.unigram * (self.count[w] + 0.5) / self.among if self.count[w] else 0
        return known + (self.unigram * 0.5 / self.among + 1 - self.unigram) * self.spelled(w, before)

    def next(self, w, prev, before):
        p = self.word(w, before)
        follow = self.after.get(prev)
        if follow and prev not in self.frequent:
            t, k = sum(follow.values()), len(follow)
            ratio = sum(math.log(follow[x] / t / q) for x, q in self.seen[prev])
            if t >= 2 and ratio > 0.5 * k * math.log(t):
                p = (follow[w] + k * p) / (t + k)
        return (1 - self.end) * p

    def score(self, text):
        total, before, prev = math.log10(self.end), b"", None
        for w in text.split():
            total += math.log10(self.next(w, prev, before))
            before, prev = before + w + b" ", w
        return total


def corpus(seed):
    rng = np.random.default_rng(seed)
    vocab = ["the", "of", "and", "aba", "a", *[f"w{i}x" for i in range(30)]]
    return [(i, " ".join(str(x) for x in rng.choice(vocab, int(rng.integers(0, 25)), p=[0.2, 0.15, 0.1, 0.1, 0.15, *[0.01] * 30])) + (" w1x w2x tail" if i % 6 == 0 else "")) for i in range(120)]


@pytest.mark.parametrize("seed,often", [(1, 30), (2, 10**9), (3, 1)])
def test_score(spark, seed, often):
    rows = corpus(seed)
    found = S.suffix_tree_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), lambda k: S.fold(k) != 1, depth=2, often=often).collect()
    model = Plain([t.encode() for i, t in rows if S.fold(i) != 1], 2, 2, often, 0.4)
    text = dict(rows)
    for r in found:
        assert r["score"] == pytest.approx(model.score(text[r["doc_id"]].encode()), abs=1e-3)
    if often > 1:
        retained = [p for p in model.after if p not in model.frequent and any(model.next(w, p, b"") != model.next(w, None, b"") for w in model.after[p])]
        assert len(retained) > 3


def test_frequent_words_are_contexts(spark):
    """No word is too frequent to be a context, in one part or dealt by pair, and rows that are alike stay apart."""
    rng = np.random.default_rng(4)
    rows = corpus(4) + [(500 + i, " ".join(f"the n{int(x)}" for x in rng.integers(0, 12, 8))) for i in range(200)]
    rows += rows[-3:]
    found = S.suffix_tree_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), lambda k: S.fold(k) != 1, depth=2).collect()
    model = Plain([t.encode() for i, t in rows if S.fold(i) != 1], 2, 2, math.inf, 0.4)
    assert model.count[b"the"] > 1000 and model.next(b"n1", b"the", b"the ") > 1.2 * model.next(b"n1", None, b"the ")
    text = dict(rows)
    assert sorted(r["doc_id"] for r in found) == sorted(i for i, _ in rows)
    for r in found:
        assert r["score"] == pytest.approx(model.score(text[r["doc_id"]].encode()), abs=1e-3)
        tokens = text[r["doc_id"]].encode().split()
        assert (r["n_tokens"], r["n_known"]) == (len(tokens) + 1, sum(model.count[w] > 0 for w in tokens) + 1)


def test_packed_words_come_back():
    rng = np.random.default_rng(6)
    columns = [rng.choice([0, 1, 2, 5, -(2**63), 2**63 - 1, 77], 3000) for _ in range(2)]
    plain, text = np.round(-rng.random(3000) * 9, 1), np.sort(rng.integers(0, 9, 3000))
    n = np.array([50, 9, 4, 4, 4, 4])
    model = S.Model(None, np.arange(6), n, 99, 20, 3, 1, 1, 0.1, 1, 0.4)
    count = collections.Counter()
    for row in S.packed(model, *columns, plain, text, np.arange(9) * 11 - 40, np.arange(9) % 2 == 0, np.arange(3000) % 2):
        prev, word, log, at, times, known, ids, learned = S.unpacked(*(row[c][0] for c in ("__size", "__texts", "__packed")))
        assert (learned == (ids + 40) // 11 % 2 ^ 1).all()
        for *x, k in zip(prev.tolist(), word.tolist(), np.round(log, 1).tolist(), ids[at].tolist(), known.tolist(), times.tolist(), strict=True):
            count[tuple(x)] += k
    want = collections.Counter(zip(*[c.tolist() for c in columns], np.round(plain.astype(np.float32), 1).tolist(), (text * 11 - 40).tolist(), (np.arange(3000) % 2).tolist(), strict=True))
    assert count == want


def test_parts_in_pieces(monkeypatch):
    """Some words before at a time give the same sums and counts as all at once."""
    rng = np.random.default_rng(7)
    prev, word, text = rng.integers(0, 40, 2000), rng.integers(0, 40, 2000), np.sort(rng.integers(0, 9, 2000))
    model = S.Model(None, np.arange(40), np.where(np.arange(40) < 3, 99, 4), 999, 20, 1, 1, 1, 0.1, 1, 0.4)
    rows = list(S.packed(model, prev, word, -1.0 - word / 8, text, np.arange(9), np.arange(9) % 2 == 0))
    batch = pa.RecordBatch.from_pydict({c: [x for r in rows for x in r[c]] for c in rows[0]})

    def found(part):
        monkeypatch.setattr(S, "PART", part)
        pieces = list(S.contexts(model, iter([batch])))
        sums, seen = collections.defaultdict(lambda: np.zeros(3)), collections.Counter()
        for c in pieces:
            for p, *x in zip(c["prev"].tolist(), c["t"], c["k"], c["ratio"], strict=True):
                sums[p] += x
            for x in zip(c["prev"][c["of"]].tolist(), c["n"].tolist(), c["plain"].tolist(), c["id"].tolist(), c["times"].tolist(), strict=True):
                seen[x] += 1
        return len(pieces), sums, seen

    (one, sums, seen), (several, others, again) = found(10**6), found(1000)
    assert one == 1 and several > 3 and seen == again and sums.keys() == others.keys()
    assert all(sums[p] == pytest.approx(others[p]) for p in sums)


def test_contexts_grow_with_the_corpus(spark):
    """Twice as many passages that repeat give twice as many word contexts, however small their share."""
    rng = np.random.default_rng(5)
    filler = [f"f{i}" for i in range(2000)]

    def raised(passages):
        rows = [(i, " ".join(str(x) for x in rng.choice(filler, 40))) for i in range(200 * passages)]
        planted = [(10**6 + 2 * p + c, f"rare{p}a rare{p}b rare{p}c rare{p}d") for p in range(passages) for c in range(2)]
        found = S.suffix_tree_scores(spark.createDataFrame(rows + planted, "doc_id long, text string"), lambda k: True).filter("doc_id >= 1000000").collect()
        return sum(r["score"] > r["base_score"] + 5 for r in found)

    assert raised(2) == 4 and raised(4) == 8


def test_next_tokens_sum_to_one():
    """Over an alphabet of two letters, the words of up to ten letters and the end have nearly all the probability."""
    texts = [b"ab ba ab b", b"a a ab ba", b"b ab ab ab ba", b"aab ab"] * 3
    model = Plain(texts, 2, 2, 5, 0.4, alphabet=b"ab ")
    every = [bytes(w) for n in range(1, 11) for w in itertools.product(b"ab", repeat=n)]
    for prev, before in ((None, b""), (b"aab", b"aab "), (b"ab", b"b ab ")):
        total = model.end + sum(model.next(w, prev, before) for w in every)
        assert 0.93 < total <= 1 + 1e-9


def test_spellings_of_the_tree_sum_to_one():
    texts = [b"ab ba ab b", b"a a ab ba", b"b ab ab ab ba", b"aab ab"] * 3
    depth = 2
    data, real = S.byte_stream(texts, depth)
    counts = {}
    for d in range(depth + 1):
        grams = np.zeros(len(data) - depth, np.uint64)
        for j in range(d, -1, -1):
            grams = grams << np.uint64(8) | data[depth - j : len(data) - j]
        counts[d] = np.unique(grams[real[depth:]], return_counts=True)
    tree = S.grow(counts, depth, 2, 1000, alphabet=b"ab ")
    every = [bytes(w) + b" " for n in range(1, 12) for w in itertools.product(b"ab", repeat=n)]
    for before in (b"\xff\xff", b"b ", b"\xff "):
        total = 0.0
        for w in every:
            total += 10.0 ** float(tree.score(np.frombuffer(before + w, np.uint8)).sum())
        assert 0.93 < total <= 1 + 1e-3


def test_long_words_and_texts(spark):
    rows = [(1, "x" * 5000 + " y " + "é" * 3000), (2, "x" * 5000), (3, "word " * 50_000), (4, "z" * 1024 + " " + "z" * 1025), (5, None), (5, None)]
    found = {r["doc_id"]: r for r in S.suffix_tree_scores(spark.createDataFrame(rows, "doc_id long, text string"), lambda k: k != 4).collect()}
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in found.values())
    assert found[1]["n_known"] == 4 and found[4]["n_known"] == 1
