"""Packing token sequences: descending pieces to the cheapest sequence with room."""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sievework.llm.work import column, text_bytes

#: Words, and parts of words, kept in a worker's memory before it starts afresh, and the longest ones kept, in bytes.
REMEMBERED, LONGEST = 500_000, 64
#: A word that is Latin letters and then, perhaps, ASCII punctuation without an apostrophe.
SIMPLE = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: itself if it is printable Latin-1, else one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)}


class _Words(dict):
    """Encoded words; a new one is encoded when it is first looked up."""

    def __init__(self, encoder: object):
        super().__init__()
        self.encoder, self.model = encoder, encoder.model
        self.letters = byte_letters()
        self.parts: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        if m := SIMPLE.fullmatch(word):
            letters, marks = m.groups()
            out = self._part(letters.lower() if letters.isascii() else letters.decode().lower().encode())
            if marks:
                out += self._part(marks)
        else:
            out = np.array(self.encoder.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= LONGEST:
            self[word] = out
        return out

    def _part(self, part: bytes) -> bytes:
        out = self.parts.get(part)
        if out is None:
            ids = [x.id for x in self.model.tokenize(part.decode("latin-1").translate(self.letters))]
            out = struct.pack(f"<{len(ids)}I", *ids)
            if len(part) <= LONGEST:
                self.parts[part] = out
        return out

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()
        if len(self.parts) > REMEMBERED:
            self.parts = {}


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space and encodes each word by itself.

    A text's ids are the ids of its words in turn, so each distinct word is
    encoded once and looked up afterwards. Words are split at ASCII white space
    only, which the tokenizer also splits at. Of a simple word, the letters and
    the punctuation are the tokenizer's own parts; each goes to its BPE model
    once. All other words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.known = _Words(Tokenizer.from_file(path))

    def encode(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        for text in texts:
            # The tokenizer lower-cases too, after composing letters with the marks U+0300 to
            # U+036F; without those, and special tokens' names, A to Z can go first.
            plain = b"\xcc" not in text and b"\xcd" not in text and b"<|" not in text
            yield b"".join(map(self.known.__getitem__, (text.lower() if plain else text).split()))
            self.known.trim()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker and vocabulary, so its memory outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one window.

    A document of at least `capacity` tokens fills whole sequences first. As
    many full sequences as the rest needs are opened; what does not fill one
    is spread over sequences whose capacities are powers of two, which need no
    padding. Pieces go in descending order to the sequence of lowest cost, of all
    that have room, cost being linear * n + quadratic * n ** 2 summed over pieces.
    Only a piece that no open sequence has room for is cut: the roomiest takes a
    part, and what is left goes on as a piece.
    """
    out, rest, opened = [], [], 0
    for d, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            out.append((d, k * capacity, capacity, opened, 0))
            opened += 1
        if n % capacity:
            rest.append((-(n % capacity), d, whole * capacity))
    total = -sum(r[0] for r in rest)
    size = np.array([capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if total % capacity >> b & 1], np.int64)
    room, cost = size.copy(), np.zeros(len(size))
    heapq.heapify(rest)
    while rest:
        n, d, start = heapq.heappop(rest)
        s = int(np.argmin(np.where(room >= -n, cost, np.inf)))
        if room[s] < -n:
            s = int(np.argmax(room))
        k = min(-n, int(room[s]))
        out.append((d, start, k, opened + s, int(size[s] - room[s])))
        room[s] -= k
        cost[s] += linear * k + quadratic * k * k
        if k < -n:
            heapq.heappush(rest, (n + k, d, start + k))
    return out


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 4096,
    end: int = 2,
    linear: float = 1.0,
    quadratic: float = 1.0 / 4096,
    window: int = 1 << 21,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The tokens of all documents in sequences of at most `capacity` tokens, as a row per piece.

    A document is its ids by `vocabulary`, without special tokens, then `end`;
    each id lies in one piece. Each task packs its rows in windows of about
    `window` tokens by assign(), so nothing is shuffled, memory is bounded by
    the window and the longest text, and a lost task is done again from its
    own input. The last window of a task is smaller; it needs no more padding.

    Columns: the key, start, length, ids (the piece's, little-endian unsigned
    32-bit), ids_crc32, doc_tokens, sequence_id (task << 32 | number), offset
    and cost (of the piece). A null or empty text is `end` alone. Rows are
    documents even where keys are null or repeat; other columns are not used.
    """
    field = docs.schema[key]
    schema = T.StructType(
        [T.StructField(key, field.dataType), *[T.StructField(n, T.LongType(), False) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], T.StructField("cost", T.DoubleType(), False), T.StructField("ids", T.BinaryType(), False)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, last = TaskContext.get().partitionId() << 32, np.array([end], "<u4").tobytes()
        keys, ids, held, kind = [], [], 0, None

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal base, keys, ids, held
            lengths = [len(x) // 4 for x in ids]
            rows = assign(lengths, capacity, linear, quadratic)
            for i in range(0, len(rows), 2000):
                part = rows[i : i + 2000]
                pieces = [ids[d][4 * start : 4 * (start + n)] for d, start, n, _, _ in part]
                of, start, n, seq, at = (np.array(x, dtype=np.int64) for x in zip(*part, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[d] for d in of], type=kind), pa.array(start), pa.array(n), pa.array([zlib.crc32(p) for p in pieces], pa.int64()), pa.array(np.array(lengths)[of]), pa.array(base + seq), pa.array(at),
                        pa.array(linear * n + quadratic * n.astype(float) ** 2), pa.array(pieces, pa.binary()),
                    ],
                    names=schema.fieldNames(),
                )
            base += 1 + max((r[3] for r in rows), default=-1)
            keys, ids, held = [], [], 0

        for batch in batches:
            kind = column(batch, key).type
            for k, x in zip(column(batch, key).to_pylist(), encoder(vocabulary).encode(text_bytes(column(batch, text))), strict=True):
                keys.append(k)
                ids.append(x + last)
                held += len(ids[-1]) // 4
                if held >= window:
                    yield from packed()
        if keys:
            yield from packed()

    return docs.select(key, text).mapInArrow(run, schema)
