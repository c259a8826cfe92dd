"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.words import blocks
from sievework.llm.work import text_bytes

#: A chunk is CHUNK bytes, and the next begins STRIDE bytes on. Filters span WIDTH bytes.
CHUNK, STRIDE, WIDTH, FILTERS = 256, 192, 6, 12
#: What pads a text that is shorter than a filter.
PAD = 0
#: Levels of the second input: how many of the last 24 bytes end a repeat of a nearby run of four.
LEVELS = 5
#: Places whose responses are computed together.
PLACES = 4096


def repeats(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each byte, how much of the last 24 repeats what stood 3 to 20 bytes before: 0 to LEVELS - 1.

    `begin` is where the text of each byte begins: nothing before it counts, so
    a byte's level depends on its own text alone.
    """
    n = len(data)
    if n < 8:
        return np.zeros(n, np.int64)
    four = data[3:].astype(np.uint32) | data[2:-1].astype(np.uint32) << 8 | data[1:-2].astype(np.uint32) << 16 | data[:-3].astype(np.uint32) << 24
    same = np.zeros(len(four), bool)
    for lag in range(3, min(21, len(four))):
        same[lag:] |= (four[lag:] == four[:-lag]) & (begin[lag + 3 :] == begin[: -lag - 3])
    sums = np.concatenate((np.zeros(4, np.int32), np.cumsum(same, dtype=np.int32)))
    recent = sums[1:] - sums[np.maximum(np.arange(n) - 23, begin)]
    return np.minimum(recent * LEVELS // 25, LEVELS - 1).astype(np.int64)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, each with WIDTH pad bytes after it; where each byte's text begins; where chunks begin and end; whose they are."""
    bounds, of, at, parts, starts = [], [], 0, [], []
    for i, t in enumerate(texts):
        n = max(1, len(t))
        first = np.arange(0, max(1, n - (CHUNK - STRIDE)), STRIDE)
        bounds.append(np.stack([at + first, at + np.minimum(first + CHUNK, n)], 1))
        of.append(np.full(len(first), i))
        parts += [t if t else bytes([PAD]), bytes([PAD]) * WIDTH]
        starts.append(at)
        at += n + WIDTH
    begin = np.repeat(starts, np.diff([*starts, at]))
    return np.frombuffer(b"".join(parts), np.uint8), begin, np.concatenate(bounds), np.concatenate(of)


@dataclass
class Network:
    """Filters over bytes and repeat levels; a chunk's strongest responses; the least good chunk decides."""

    bytes_: np.ndarray  # (WIDTH, 256, FILTERS)
    levels: np.ndarray  # (LEVELS, FILTERS)
    offset: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (FILTERS,)
    bias: float

    def responses(self, data: np.ndarray, level: np.ndarray) -> np.ndarray:
        """(place, filter): each filter at each byte, some places at a time, so that they stay in the cache."""
        n = len(data) - WIDTH + 1
        at, kind, base = data.astype(np.intp), level[WIDTH - 1 :], self.levels + self.offset
        out, one = np.empty((n, FILTERS), np.float32), np.empty((PLACES, FILTERS), np.float32)
        for i in range(0, n, PLACES):
            m = min(PLACES, n - i)
            part, buffer = out[i : i + m], one[:m]
            np.take(base, kind[i : i + m], axis=0, out=part, mode="clip")
            for j in range(WIDTH):
                np.take(self.bytes_[j], at[i + j : i + j + m], axis=0, out=buffer, mode="clip")
                part += buffer
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        """The logit that each chunk is junk; a sum in a fixed order, so it's the same in any batch."""
        out = np.full(len(pooled), self.bias)
        for f in range(FILTERS):
            out += np.maximum(pooled[:, f], 0).astype(np.float64) * float(self.out[f])
        return out

    def good(self, texts: list[bytes]) -> np.ndarray:
        """The probability that each whole text is of quality; of each text alone, whatever the others are."""
        out = np.empty(len(texts))
        for i, j in blocks(texts, 1 << 18):
            data, begin, bounds, of = joined(texts[i:j])
            pooled = np.maximum.reduceat(self.responses(data, repeats(data, begin)), bounds.ravel(), axis=0)[::2]
            logit = np.full(j - i, -np.inf)
            np.maximum.at(logit, of, self.logits(pooled))
            out[i:j] = 1 / (1 + np.exp(np.clip(logit, -40, 40)))
        return out


def fit(texts: list[bytes], labels: np.ndarray, steps: int = 500, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Network:
    """A network trained by Adam, so that a junk text's worst chunk is junk and a good text's is not.

    About `steps` batches are read, each text as often, and each time all its
    chunks. The gradient reaches the filters at their strongest places in the
    worst chunk. Junk and good texts weigh the same in all. Without texts of both
    kinds the network's answer is their share.
    """
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    net = Network(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), rng.normal(0, 0.1, (LEVELS, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.full(FILTERS, 0.5, np.float32), 0.0)
    if share in (0.0, 1.0) or len(labels) < 2:
        net.out[:] = 0
        net.bias = float(np.log((1 - share + 0.01) / (share + 0.01)))
        return net
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    params = {"bytes_": net.bytes_, "levels": net.levels, "offset": net.offset, "out": net.out, "bias": np.array([-1.0], np.float32)}
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in params.items()}
    step, rounds = 0, max(1, round(steps * batch / len(texts)))
    for turn in range(rounds):
        order = rng.permutation(len(texts))
        for b in range(0, len(order), batch):
            ids = order[b : b + batch]
            net.bias = float(params["bias"][0])
            grads = {k: np.zeros_like(v) for k, v in params.items()}
            picked = [texts[i] for i in ids]
            for i, j in blocks(picked, 1 << 18):
                data, begin, bounds, of = joined(picked[i:j])
                level = repeats(data, begin)
                found = net.responses(data, level)
                pooled = np.maximum.reduceat(found, bounds.ravel(), axis=0)[::2]
                logit = net.logits(pooled)
                worst = np.lexsort((-np.arange(len(of)), logit, of))[np.searchsorted(of, np.arange(j - i), side="right") - 1]
                mine = ids[i:j]
                p = 1 / (1 + np.exp(-logit[worst]))
                slope = ((p - (1 - labels[mine])) * weight[mine] / len(ids)).astype(np.float32)
                grads["bias"][0] += slope.sum()
                grads["out"] += np.maximum(pooled[worst], 0).T @ slope
                back = slope[:, None] * net.out * (pooled[worst] > 0)
                top = np.stack([lo + found[lo:hi].argmax(0) for lo, hi in bounds[worst]])
                filters = np.broadcast_to(np.arange(FILTERS), top.shape)
                for k in range(WIDTH):
                    np.add.at(grads["bytes_"][k], (data[top + k], filters), back)
                np.add.at(grads["levels"], (level[top + WIDTH - 1], filters), back)
                grads["offset"] += back.sum(0)
            grads["out"] += 1e-4 * net.out
            grads["bytes_"] += 1e-5 * params["bytes_"]
            step += 1
            fall = rate * (1 - turn / rounds)
            for k, v in params.items():
                m, s = moments[k]
                m += 0.1 * (grads[k] - m)
                s += 0.01 * (grads[k] ** 2 - s)
                v -= fall * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    net.bias = float(params["bias"][0])
    return net


def fold(key: str) -> Column:
    """The CRC-32 of the key as text, modulo 5; a null key's text is empty."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def trained(docs: DataFrame, labels: DataFrame, rows: int = 3000, most: int = 1 << 26, key: str = "doc_id", text: str = "text", label: str = "quality") -> Network:
    """A network fitted to at most `rows` labelled texts, of `most` bytes in all, outside the held-out fold.

    The sample is bounded by these parameters: for each label, the keys least by
    a hash, up to half of `rows` each; of their texts in that order, those that
    end within `most` bytes. The texts are read whole. Labels other than 0 and 1
    are not learned from; of several for one key, the least counts.
    """
    usable = labels.filter(F.col(label).isin(0, 1)).filter(fold(key) != 0).groupBy(key).agg(F.min(label).alias("__label"))
    order = F.xxhash64(F.col(key))
    some = usable.filter("__label = 0").orderBy(order).limit(rows // 2).unionByName(usable.filter("__label = 1").orderBy(order).limit(rows // 2))
    whole = F.coalesce(F.col(text), F.lit("")).alias(text)
    pairs = docs.select(key, whole).join(F.broadcast(some), key).withColumn("__order", order)
    so_far = Window.orderBy("__order", key, text).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = pairs.withColumn("__bytes", F.sum(F.octet_length(text) + 1).over(so_far)).filter(F.col("__bytes") <= most)
    pairs = within.orderBy("__bytes").select(text, "__label").toArrow()
    texts = [t or b"" for t in text_bytes(pairs.column(0).combine_chunks())] if pairs.num_rows else []
    return fit(texts, pairs.column(1).to_numpy().astype(np.int64) if pairs.num_rows else np.empty(0, np.int64))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = 3000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with held_out, score (that the text is of quality) and predicted (score >= threshold).

    The whole text counts: overlapping chunks cover it, and its worst chunk
    gives the score. Only the text enters it: equal texts have equal scores in any
    batch. A null or empty text is one pad
    byte. Without usable labels every score is the share of good ones, 0.5 if
    there are none. Columns of the added names are replaced.
    """
    own = ["held_out", "score", "predicted"]
    docs = docs.drop(*own)
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, rows, key=key, text=text))

    # Only texts go to Python and only scores come back. Not deterministic, to Spark: else a filter would score again.
    def good(texts: pa.Array) -> pa.Array:
        return pa.array(model.value.good(text_bytes(texts)))

    score = F.arrow_udf(good, T.DoubleType()).asNondeterministic()
    found = docs.select(*docs.columns, (fold(key) == 0).alias("held_out"), score(F.col(text)).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
