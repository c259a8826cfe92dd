"""Exact token counts at every prefix of a text, by prefix dynamic programming over a byte-pair vocabulary.

For each prefix of a word, the last token of the prefix's encoding is known from
shorter prefixes: a sequence of tokens is the encoding of its text exactly if
every two neighbours are the encoding of theirs, so the last token is the one
that ends the prefix and can follow the last token of what stands before it. The
count at a prefix is one more than the count there. Word ends have tokens of
their own, so every prefix is also closed: its count is that of the text cut
there, as the library would encode that cut.

Words are counted once each and looked up afterwards; a text's counts are its
words' counts on top of the tokens before them. They are stored in rows of at
most `block` prefixes, and questions of truncation and budget are joins and
array functions on that table.

Defined results:
- prefixes are counted in code points; prefix 0 has no tokens; a null text is empty;
- rows stay rows: null and repeated keys are counted row by row (`totals`); questions by key (`tokens_before`,
  `longest_prefixes`) tell texts of one key apart, and answer equal rows once;
- special strings in a text are one token each, as the library's default has it, and a cut within one is plain text;
- columns besides key and text are left out, whatever their names.

Time is linear in a text, but in the square of a run of combining marks on one letter.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.work import column, folder

#: Prefixes of a row of the stored table, and numbers held before a batch of rows is handed on.
BLOCK, BATCH = 8192, 1 << 20
#: Runs, words and pairs of tokens that a worker remembers, and as many older ones; the longest word kept, in code points.
REMEMBERED, LONGEST = 300_000, 64
#: Unicode's white space, at which the tokenizer always cuts.
SPACE = re.compile("[\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Words of printable Latin-1 in lower case, as the tokenizer's own pattern splits them, and what such a text may hold.
LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
SIMPLE = re.compile("[!-~\xa1-\xac\xae-\xff]*")
END = "</w>"


class PrefixCounter:
    """Counts at every prefix by the vocabulary of a tokenizer file: byte-level pairs with word ends, white space dropped."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        model = kind["model"]
        steps = [x["type"] for x in (kind["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END or model.get("dropout") or model.get("ignore_merges") or steps != ["Split", "ByteLevel"] or any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in kind["added_tokens"]):
            raise ValueError("not a tokenizer of byte-level pairs with word ends")
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        #: Tokens by number, what each was merged from, and when; single letters never were.
        ids = {token: i for i, token in enumerate(model["vocab"])}
        made = {a + b: (i, ids[a], ids[b]) for i, (a, b) in enumerate(merges)}
        if len(made) < len(merges):
            raise ValueError("a token is merged in more than one way")
        self.size = len(ids)
        self.ranks = {ids[a] * self.size + ids[b]: i for i, (a, b) in enumerate(merges)}
        self.made = [made.get(token, (-1, 0, 0)) for token in ids]
        alone = [True] * self.size
        for token in sorted(ids, key=len):  # halves are shorter
            rank, left, right = self.made[ids[token]]
            alone[ids[token]] = rank < 0 or (alone[left] and alone[right] and self._apart(left, right, rank))
        #: Letters of the tokens that are their own text's encoding: (size, token within a word or -1, token at its end or -1).
        usable = {token for token, i in ids.items() if alone[i]}
        self.tokens = ahocorasick.Automaton()
        for letters in {t.removesuffix(END) for t in usable} - {""}:
            self.tokens.add_word(letters, (len(letters), ids[letters] if letters in usable else -1, ids[letters + END] if letters + END in usable else -1))
        self.tokens.make_automaton()
        self.follows: dict[int, bool] = {}
        names = sorted((a["content"] for a in kind["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names)) or r"(?!)")
        whole = Tokenizer.from_file(path)
        self.normalised, self.split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        #: What was met lately, and before: when the former are too many they become the latter, which go.
        self.runs: dict[str, bytes] = {}
        self.parts: dict[str, list[int] | bytes] = {}
        self.older_runs: dict[str, bytes] = {}
        self.older_parts: dict[str, list[int] | bytes] = {}
        self.letters = str.maketrans({chr(c): "".join(letter for letter, _ in self.split(chr(c))) for c in range(0xA1, 0x100) if c != 0xAD})
        self.seconds: frozenset[str] | None = None

    def _apart(self, left: int, right: int, until: int) -> bool:
        """Whether two encodings' neighbouring tokens stay apart in all merges before the one numbered `until`.

        Their merges are undone from the last: at each step the tokens at the seam are those that stood there at that time,
        and they would have been merged then if their merge comes earlier, or is the same one and stands further left.
        """
        ranks, made, size = self.ranks, self.made, self.size
        while True:
            if ranks.get(left * size + right, until) < until:
                return False
            a, b = made[left], made[right]
            if a[0] < 0 and b[0] < 0:
                return True
            if a[0] > b[0]:  # the same merge further left came first
                until, left = min(until, a[0]), a[2]
            else:
                until, right = min(until, b[0] + 1), b[1]

    def word(self, letters: str) -> list[int] | bytes:
        """Tokens of each prefix of a word, from one letter (byte) on, each closed as a word.

        Of the tokens that end at a letter, the one that can follow the last token of what stands before it is the last
        token there: one within a word for the prefixes that go on, one at a word's end for the closed prefix.
        """
        found = self.parts.get(letters)
        if found is not None:
            return found
        found = self.older_parts.get(letters)
        if found is not None:
            self.parts[letters] = found
            return found
        follows, size = self.follows, self.size
        last, count, closed = [-1] * (len(letters) + 1), [0] * (len(letters) + 1), [0] * len(letters)
        for at, (n, inner, final) in self.tokens.iter(letters):
            begin = at + 1 - n
            before = last[begin]
            if begin and before < 0:
                continue
            if inner >= 0 and last[at + 1] < 0:
                fits = True
                if begin:
                    pair = before * size + inner
                    fits = follows.get(pair)
                    if fits is None:
                        fits = follows[pair] = self._apart(before, inner, size)
                if fits:
                    last[at + 1], count[at + 1] = inner, count[begin] + 1
            if final >= 0 and not closed[at]:
                fits = True
                if begin:
                    pair = before * size + final
                    fits = follows.get(pair)
                    if fits is None:
                        fits = follows[pair] = self._apart(before, final, size)
                if fits:
                    closed[at] = count[begin] + 1
        if not all(closed):
            raise ValueError("a byte without a token")
        if len(letters) <= LONGEST:
            self.parts[letters] = bytes(closed)
        return closed

    def _tail(self, text: str) -> int:
        """Tokens of a short normalised text."""
        return sum(self.word(letters)[-1] for letters, _ in self.split(text))

    def _steps(self, text: str) -> list[str]:
        """The text in pieces that are normalised by themselves: a letter with all that may combine with it."""
        if self.seconds is None:
            # What ends a canonical pair, and Hangul's vowels and final consonants.
            pairs = (unicodedata.decomposition(chr(c)).split(" ") for c in range(0x110000))
            self.seconds = frozenset(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and p[0][0] != "<") | frozenset(map(chr, (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))))
        out: list[str] = []
        for c in text:
            if out and (unicodedata.combining(c) or c in self.seconds):
                out[-1] += c
            else:
                out.append(c)
        return out

    def _latin(self, text: str) -> list[int]:
        """Tokens of each prefix of a printable Latin-1 text, which is its own normal form but for its case."""
        out: list[int] = []
        before = 0
        for part in LATIN.findall(text.lower()):
            if part.isascii():
                counts = self.word(part)
                if len(part) == 3 and part[0] == "'" and part[1].isalpha():  # within a contraction the apostrophe and a letter are two words
                    counts = [counts[0], self._tail(part[:2]), counts[2]]
            else:  # a count stands at a letter's last byte
                word = self.word(part.translate(self.letters))
                counts = [word[end - 1] for end in accumulate(1 if c < "\x80" else 2 for c in part)]
            out += [before + c for c in counts] if before else counts
            before = out[-1]
        return out

    def _segment(self, text: str) -> list[int]:
        """Tokens of each prefix of a text without white space and special strings."""
        if SIMPLE.fullmatch(text):
            return self._latin(text)
        steps = list(text) if unicodedata.is_normalized("NFC", text) else self._steps(text)
        norms = ["".join(c.lower() for c in unicodedata.normalize("NFC", s)) for s in steps]
        plain = "".join(norms)
        if plain != self.normalised(text):  # the library's tables of characters differ
            return [self._tail(self.normalised(text[:i])) for i in range(1, len(text) + 1)]
        counts = [0] * (len(plain) + 1)
        starts, before = [], 0
        for letters, (first, end) in self.split(plain):
            part, word, byte = plain[first:end], self.word(letters), -1
            for i, c in enumerate(part, first + 1):  # letters are bytes: a code point's count stands at its last byte
                byte += len(c.encode())
                counts[i] = before + word[byte]
            if len(part) == 3 and part[0] == "'" and part[1].isalpha():
                counts[first + 2] = before + self._tail(part[:2])
            starts.append((first, before))
            before = counts[end]
        ends = list(accumulate(map(len, norms)))
        if len(steps) == len(text):
            return [counts[e] for e in ends]
        out: list[int] = []
        firsts = [s for s, _ in starts]
        for step, norm, end in zip(steps, norms, ends):
            begin = end - len(norm)
            # A prefix that ends within a piece: the word that holds the piece, or touches it, is split anew.
            word, base = starts[max(0, bisect_left(firsts, begin) - 1)] if begin else (0, 0)
            out += [base + self._tail(plain[word:begin] + self.normalised(step[:j])) for j in range(1, len(step))]
            out.append(counts[end])
        return out

    def run(self, text: str) -> list[int]:
        """Tokens of each prefix of a text without white space, and of all of it once more."""
        out: list[int] = []
        at = 0
        for m in self.special.finditer(text) if "<" in text else ():
            base = out[-1] if out else 0
            if m.start() > at:
                out += [base + c for c in self._segment(text[at : m.start()])]
            whole = (out[-1] if out else 0) + 1
            out += [base + self._segment(text[at:i])[-1] for i in range(m.start() + 1, m.end())] + [whole]
            at = m.end()
        if at < len(text):
            base = out[-1] if out else 0
            found = self._segment(text[at:])
            out += [base + c for c in found] if base else found
        out.append(out[-1] if out else 0)
        return out

    def counts(self, text: str) -> np.ndarray:
        """Tokens of the first 0, 1, ... code points of a text."""
        runs = SPACE.split(text)
        known, older, flat = self.runs, self.older_runs, []
        held: list[bytes] = []
        for run in runs:
            found = known.get(run)
            if found is None:
                found = older.get(run)
                if found is None:
                    each = self.run(run)
                    if len(run) > LONGEST or max(each) > 255:
                        flat += [np.frombuffer(b"".join(held), np.uint8), np.array(each, np.int32)]
                        held = []
                        continue
                    found = bytes(each)
                known[run] = found
            held.append(found)
        flat.append(np.frombuffer(b"".join(held), np.uint8))
        flat = np.concatenate(flat).astype(np.int32)
        ends = np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)) + 1)
        finals = flat[ends - 1]
        base = (np.cumsum(finals) - finals).astype(np.int32)
        out = np.empty(len(text) + 1, np.int32)
        out[0] = 0
        # Each run stands with the white space after it, which adds nothing; after the last run there is none.
        out[1:] = (flat + np.repeat(base, np.diff(ends, prepend=0)))[:-1]
        if len(self.runs) > REMEMBERED:
            self.runs, self.older_runs = {}, self.runs
        if len(self.parts) > REMEMBERED:
            self.parts, self.older_parts = {}, self.parts
        if len(self.follows) > 2 * REMEMBERED:
            self.follows.clear()
        return out


@functools.lru_cache(maxsize=1)
def counter_of(path: str) -> PrefixCounter:
    """A worker's counter, kept from task to task."""
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(key, text_hash, first, counts, is_last, n_chars, n_bytes, n_tokens): the tokens of the first `first`, `first` + 1, ... code points.

    Rows of one text go on at each other's end; the last one, `is_last`, ends with the whole text's count. `path` is the
    tokenizer's file, on every machine. Nothing is shuffled.
    """
    schema = T.StructType(
        [docs.schema[key], T.StructField("text_hash", T.LongType()), T.StructField("first", T.LongType()), T.StructField("counts", T.ArrayType(T.IntegerType(), False)), T.StructField("is_last", T.BooleanType()), T.StructField("n_chars", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        kind = None
        rows: list[tuple] = []
        held = 0

        def batch_of() -> pa.RecordBatch:
            keys, hashes, firsts, parts, lasts, chars, sizes, totals_ = zip(*rows)
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts), pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(hashes, pa.int64()), pa.array(firsts, pa.int64()), lists, pa.array(lasts, pa.bool_()), *(pa.array(x, pa.int64()) for x in (chars, sizes, totals_))], names=schema.fieldNames())

        for batch in batches:
            kind = column(batch, key).type
            for k, hashed, value in zip(column(batch, key).to_pylist(), column(batch, "text_hash").to_pylist(), column(batch, "__text")):
                whole = value.as_py() or ""
                found = counter.counts(whole)
                for first in range(0, len(found), block):
                    rows.append((k, hashed, first, found[first : first + block], first + block >= len(found), len(whole), len(whole.encode()), int(found[-1])))
                    held += len(rows[-1][3])
                    if held >= BATCH:
                        yield batch_of()
                        rows, held = [], 0
        if rows:
            yield batch_of()

    read = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return read.withColumn("text_hash", F.xxhash64("__text")).mapInArrow(run, schema)


def stored(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The table of all prefixes' counts, written to the shared folder.

    Neighbouring counts differ little, so they are written as differences instead of by a dictionary.
    """
    found = prefix_counts(docs, path, key, text, block)
    place = folder(docs.sparkSession, "prefix-counts")
    found.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").option("parquet.writer.version", "PARQUET_2_0").parquet(place)
    return docs.sparkSession.read.schema(found.schema).parquet(place)


def totals(counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_chars, n_bytes, n_tokens) of each row that was counted, from the row with its last prefix."""
    return counts.filter("is_last").select(key, "n_chars", "n_bytes", "n_tokens")


def tokens_before(counts: DataFrame, asked: DataFrame, key: str = "doc_id", place: str = "n_chars", block: int = BLOCK) -> DataFrame:
    """(key, text_hash, place, n_tokens): the tokens of the text cut after `place` code points, of the whole text beyond its end.

    `asked` holds (key, place); a key that has no text, a null and a place below 0 have no answer. A place meets one row
    of `counts` only, by its block.
    """
    ask = asked.select(F.col(key), F.col(place).cast("long").alias("__at")).filter("__at >= 0").distinct()
    ends = counts.filter("is_last").select(key, "text_hash", "n_chars").distinct()
    cut = ask.join(ends, key).withColumn("__first", F.floor(F.least("__at", "n_chars") / block) * block)
    rows = counts.select(key, "text_hash", F.col("first").alias("__first"), "counts").dropDuplicates([key, "text_hash", "__first"])
    met = cut.join(rows, [key, "text_hash", "__first"])
    return met.select(key, "text_hash", F.col("__at").alias(place), F.get("counts", (F.least("__at", "n_chars") - F.col("__first")).cast("int")).cast("long").alias("n_tokens"))


def longest_prefixes(counts: DataFrame, budget: int, key: str = "doc_id") -> DataFrame:
    """(key, text_hash, n_chars, cut_chars): the most code points of each text that are `budget` tokens at most.

    A longer prefix can have fewer tokens than a shorter one, so the last that fits is taken, not the first that doesn't.
    """
    if budget < 0:
        raise ValueError("a budget is 0 at least")
    fits = F.array_max(F.transform("counts", lambda c, i: F.when(c <= budget, F.col("first") + i)))
    return counts.groupBy(key, "text_hash").agg(F.max("n_chars").alias("n_chars"), F.max(fits).alias("cut_chars"))
