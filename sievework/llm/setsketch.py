"""Near-duplicate groups by SetSketch registers over word shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.components import components
from sievework.llm.words import SEED, blocks, hashed_words, shingles
from sievework.llm.work import column, hashed_joins, table, text_bytes

#: Registers are cut into BANDS bands of ROWS. A link shares no band with probability
#: (1 - 0.8 ** 6) ** 40 < 6e-6 at a similarity of 0.8, and below 6e-9 at 0.85.
ROWS, BANDS = 6, 40
#: Registers grow by one as the minimum shrinks by this factor.
FACTOR = 1.02
#: Parts in which a pivot's comparisons are dealt out.
SALTS = 64

_FACTORS = np.random.default_rng(SEED + 1).integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each register (row) and set (column), the least of the set's rehashed elements."""
    out = np.empty((len(_FACTORS), len(starts)), np.uint64)
    for i, factor in enumerate(_FACTORS):
        out[i] = np.minimum.reduceat(hashes * factor, starts)
    return out


def registers(least: np.ndarray) -> np.ndarray:
    """SetSketch registers: the minima as exponential variates, truncated to powers of FACTOR."""
    unit = (least.astype(np.float64) + 1.0) / 2.0**64
    with np.errstate(divide="ignore"):
        variate = np.where(unit < 1, -np.log1p(-np.minimum(unit, 1 - 1e-16)), 36.0)
    return np.clip(np.floor(1 - np.log(variate) / np.log(FACTOR)) + 256, 0, 65535).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def likelihood_estimates(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, steps: int = 128) -> np.ndarray:
    """For each pair of rows of registers, the Jaccard similarity under which their order is likeliest, sizes given.

    With shares u and v of the two sizes, a register of the first is greater
    with probability p(u - v J), smaller with p(v - u J), where
    p(x) = -log_FACTOR(1 - x (FACTOR - 1) / FACTOR).
    """
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    greater, smaller = (a > b).sum(1), (a < b).sum(1)
    j = np.linspace(0.0, 1.0, steps)[None, :] * np.minimum(u / v, v / u)[:, None]
    p = lambda x: -np.log(np.maximum(1 - x * (FACTOR - 1) / FACTOR, 1e-300)) / np.log(FACTOR)
    up, down = np.maximum(p(u[:, None] - v[:, None] * j), 1e-12), np.maximum(p(v[:, None] - u[:, None] * j), 1e-12)
    score = greater[:, None] * np.log(up) + smaller[:, None] * np.log(down) + (a.shape[1] - greater - smaller)[:, None] * np.log(np.maximum(1 - up - down, 1e-12))
    return j[np.arange(len(j)), np.argmax(score, 1)]


def margin(similarity: float) -> float:
    """Five standard errors of the estimate at a similarity: it is further off with a probability of about 3e-7 to either side."""
    return 5 * (similarity * (1 - similarity) / (ROWS * BANDS)) ** 0.5


def sketched(docs: DataFrame, size: int, text: str) -> DataFrame:
    """`docs` with __near_row (unique), __near_n (distinct shingles), __near_content (hash of the words) and __near_sketch."""
    own = [("__near_row", T.LongType()), ("__near_n", T.LongType()), ("__near_content", T.BinaryType()), ("__near_sketch", T.BinaryType())]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in own]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = text_bytes(column(batch, text))
            for i, j in blocks(texts):
                words, counts = hashed_words(texts[i:j])
                found, many = shingles(words, counts, size)
                ends = np.cumsum(many)
                n = [len(np.unique(found[e - m : e])) for e, m in zip(ends.tolist(), many.tolist(), strict=True)]
                full = np.flatnonzero(many)
                sketch = registers(minima(found, (ends - many)[full])).T if len(full) else []
                sketches: list = [None] * (j - i)
                for k, s in zip(full.tolist(), sketch, strict=True):
                    sketches[k] = np.ascontiguousarray(s).tobytes()
                content = [hashlib.sha256(b" ".join(t.lower().split())).digest()[:16] if m else None for t, m in zip(texts[i:j], many, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(i, j - i).columns, pa.array(row + np.arange(j - i)), pa.array(n, pa.int64()), pa.array(content, pa.binary()), pa.array(sketches, pa.binary())], names=schema.fieldNames()
                )
                row += j - i

    return docs.mapInArrow(run, schema)


def parts_of(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def with_pivot(pairs: DataFrame, pivots: DataFrame) -> DataFrame:
    """`pairs` (a, b, ...) with the columns of `pivots` (a, ...), a row for each of the SALTS parts that a pivot's pairs fall in, so that none meets all in one task."""
    salted = pairs.withColumn("__part", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    parts = salted.select("a", "__part").distinct().join(pivots, "a")
    return salted.join(parts, ["a", "__part"]).drop("__part")


def estimated(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b, likely): the joint likelihood estimate of each pair's similarity, from registers (row, n, sketch) alone."""
    left = sketches.select(F.col("row").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    met = with_pivot(pairs.join(sketches.withColumnRenamed("row", "b"), "b"), left)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                registers_ = [np.frombuffer(b"".join(column(batch, c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sketch_a", "sketch")]
                sizes = [column(batch, c).to_numpy().astype(float) for c in ("n_a", "n")]
                yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b"), pa.array(likelihood_estimates(*registers_, *sizes))], names=["a", "b", "likely"])

    return met.select("a", "b", "n_a", "n", "sketch_a", "sketch").mapInArrow(run, "a long, b long, likely double")


def pruned(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are to meet: those that the likelihood estimate doesn't rule out, and second pivots.

    Jaccard distance is a metric: with t the threshold, a row whose similarity
    to a pivot is under 2 t - 1 is linked with no row that is linked with the
    pivot. Rows estimated under that, less margin(), are far. The far rows of a
    pivot and those of its rows that may not be linked with it (estimated under t
    and margin()) get a second pivot, their least row, and all meet it. So of two
    rows that share a band both meet one pivot, or they aren't linked.
    """
    t = percent / 100
    found = table(estimated(pairs, sketches), "near-estimates")
    low, high = 2 * t - 1 - margin(max(2 * t - 1, 0.0)), t + margin(t)
    each = found.filter(F.col("likely") < high).groupBy("a").agg(F.min("likely").alias("far"), F.min("b").alias("second"))
    split = table(each.filter(F.col("far") < low).select("a", "second"), "near-far")
    if split.isEmpty():
        return pairs
    second = with_pivot(found.filter(F.col("likely") < high), split).filter("b <> second").select(F.col("second").alias("a"), "b")
    return found.filter(F.col("likely") >= low).select("a", "b").union(second).distinct()


def verified(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """For each of `pairs` (a, b): sizes, shared shingles, and b as it differs from a.

    `held` has a bit for each shingle of a, in order of their hashes, set if b
    has it; `more` has the hashes of b's other shingles. Rows of b, and one of a
    for each of the SALTS parts that its pairs fall in, meet sorted by (a, part),
    so a task holds one set of a at a time.
    """
    salted = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    right = salted.join(texts.withColumnRenamed("row", "b"), "b").select("a", "part", F.lit(1).alias("role"), "b", "text")
    left = salted.select("a", "part").distinct().join(texts.withColumnRenamed("row", "a"), "a").select("a", "part", F.lit(0).alias("role"), F.lit(None).cast("long").alias("b"), "text")
    met = left.unionByName(right).repartition(parts_of(pairs), "a", "part").sortWithinPartitions("a", "part", "role")
    schema = "a long, b long, size_a long, size_b long, shared long, held binary, more binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.empty(0, np.uint64)
        for batch in batches:
            texts = text_bytes(column(batch, "text"))
            a, role, b = (column(batch, x).to_pylist() for x in ("a", "role", "b"))
            out: list[tuple] = []
            for i, j in blocks(texts):
                found, many = shingles(*hashed_words(texts[i:j]), size)
                for k, (e, m) in enumerate(zip(np.cumsum(many).tolist(), many.tolist(), strict=True), i):
                    mine = np.unique(found[e - m : e])
                    if role[k] == 0:
                        first = mine
                        continue
                    at = np.minimum(np.searchsorted(first, mine), len(first) - 1)
                    there = first[at] == mine
                    bits = np.zeros(len(first), bool)
                    bits[at[there]] = True
                    out.append((a[k], b[k], len(first), len(mine), int(there.sum()), np.packbits(bits).tobytes(), mine[~there].tobytes()))
            if out:
                kinds = [pa.int64()] * 5 + [pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["a", "b", "size_a", "size_b", "shared", "held", "more"])

    return met.mapInArrow(run, schema)


class _Block:
    """Some rows of a bucket, each as it differs from the bucket's pivot."""

    def __init__(self, rows: list[tuple]):
        self.row, self.component, self.size = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        self.held = np.stack([np.frombuffer(r[3], np.uint8) for r in rows])
        extra = [np.frombuffer(r[4], np.uint64) for r in rows]
        owner = np.repeat(np.arange(len(rows)), [len(x) for x in extra])
        hashes = np.concatenate(extra)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], owner[order]

    def links(self, row: tuple, percent: int) -> list[int]:
        """Rows of the block linked to `row`, one of each other component."""
        n, component, size, held, more = row
        other = np.flatnonzero((self.component != component) & (100 * np.minimum(self.size, size) >= percent * np.maximum(self.size, size)))
        if not len(other):
            return []
        shared = np.bitwise_count(self.held[other] & np.frombuffer(held, np.uint8)).sum(1, dtype=np.int64)
        hashes = np.frombuffer(more, np.uint64)
        lo, hi = np.searchsorted(self.hashes, hashes), np.searchsorted(self.hashes, hashes, side="right")
        hits = [self.owner[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True) if y > x]
        if hits:
            shared += np.bincount(np.concatenate(hits), minlength=len(self.row))[other]
        linked = other[100 * shared >= percent * (self.size[other] + size - shared)]
        return self.row[linked[np.unique(self.component[linked], return_index=True)[1]]].tolist()


def remaining(seen: DataFrame, found: DataFrame, percent: int, block: int = 2000, most: int = 1 << 26) -> DataFrame:
    """Links (a, b) between rows compared with the same pivot, but not yet in one component.

    A row outside its pivot's component is an outer row; pivots without any are
    done with before the sets move. Blocks of at most about `block` outer rows,
    and `most` bytes, stay in memory while the pivot's rows stream by, once for
    each block; the shared shingles follow from how both differ from the pivot. So
    of a pivot with n rows and m outer ones, n * m / `block` rows are shuffled.
    Only links are returned, for each row one to each component.
    """
    named = found.withColumnRenamed("node", "b").withColumnRenamed("component", "__c")
    pivot = found.withColumnRenamed("node", "a").withColumnRenamed("component", "__p")
    light = seen.select("a", "b", (F.octet_length("held") + F.octet_length("more")).alias("bytes")).join(named, "b", "left")
    light = table(light.select("a", "b", F.coalesce("__c", "b").alias("component"), "bytes"), "near-outer")
    # A pivot's outer rows are counted by component, so that they need not meet its own one by one.
    counted = light.groupBy("a", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).join(pivot, "a", "left").withColumn("own", F.coalesce("__p", "a"))
    count = F.greatest(F.sum("n") / F.lit(block), F.sum("bytes") / F.lit(most))
    blocks_of = table(counted.filter("component <> own").groupBy("a", "own").agg(F.ceil(count).cast("int").alias("blocks")), "near-blocks")
    if blocks_of.isEmpty():
        return light.limit(0).select("a", "b")
    rows = with_pivot(light, blocks_of).withColumn("outer", F.col("component") != F.col("own")).join(seen.select("a", "b", F.col("size_b").alias("size"), "held", "more"), ["a", "b"])
    part = F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")
    outer = rows.filter("outer").select("a", part.alias("part"), F.lit(0).alias("role"), "b", "component", "size", "held", "more")
    every = rows.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.lit(1).alias("role"), "b", "component", "size", "held", "more")
    met = outer.unionByName(every).repartition(parts_of(seen), "a", "part").sortWithinPartitions("a", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, rows, held = None, [], None
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, part, role, *row in zip(*[column(batch, c).to_pylist() for c in ("a", "part", "role", "b", "component", "size", "held", "more")], strict=True):
                if (a, part) != where:
                    where, rows, held = (a, part), [], None
                if role == 0:
                    rows.append(tuple(row))
                    continue
                if not rows:  # no outer row fell in this block
                    continue
                held = held or _Block(rows)
                out += [(row[0], x) for x in held.links(tuple(row), percent)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def near_links(bands: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Components (node, component) of the linked ones among rows that share a band.

    `bands` has (band, row). The rows of a band, a bucket, are compared with one
    pivot, its least row, instead of pairwise. Two rows of a bucket that are in
    the pivot's component need no more comparison; all others of the same pivot
    are compared by remaining(). So every pair that shares a band is linked,
    found unlike, or in one component.

    Texts meet the rows to compare by a shuffle at every size: a broadcast would
    only fit small tables. The side that is hashed has only row numbers.
    """
    sizes = bands.groupBy("band").agg(F.min("row").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    pairs = table(bands.join(sizes, "band").filter("row <> a").select("a", F.col("row").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    texts = table(texts.join(wanted.hint("shuffle_hash"), "row"), "near-texts")
    pairs = table(pruned(pairs, texts.select("row", "n", "sketch"), percent), "near-pruned")
    seen = table(verified(pairs, texts.select("row", "text"), size), "near-pairs")
    found = components(seen.filter(100 * F.col("shared") >= percent * (F.col("size_a") + F.col("size_b") - F.col("shared"))).select("a", "b"))
    more = table(remaining(seen, found, percent), "near-links")
    return found if more.isEmpty() else components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with n_shingles, component_id and kept.

    Texts are linked if at least `percent` % of their united distinct shingles
    of `size` words are shared (A to Z lower-cased, words split at ASCII white
    space). Registers of a SetSketch are cut into bands; rows that share a band
    are candidates; those that the joint likelihood of their registers rules out
    are dropped (pruned()), and all others are confirmed on their full sets of
    shingles, hashed to 64 bits: two sets of m shingles show one too many shared
    with a probability of about m ** 2 / 2 ** 64. Rows with the same words are one row throughout, and join at the end.

    component_id is the least key that links reach, and `kept` holds for one row
    of each component: that of the least key, the first of them if it repeats. A
    text with fewer words than `size` has its sequence as its one shingle. A null
    or empty text has none and is linked with nothing: it keeps its own key. Null
    keys come last among keys. Columns of the added names are replaced.

    A link is missed with a probability under 6e-6 at a similarity of 0.8, under 6e-9 at 0.85.
    """
    own = ["n_shingles", "component_id", "kept"]
    docs = docs.drop(*own)
    rows = table(sketched(docs, size, text), "near-rows")
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("__near_row").alias("row"))
    classes = rows.filter("__near_n > 0").groupBy("__near_content").agg(F.min("__near_row").alias("__near_row"), F.min(order).alias("__near_first"))
    classes = table(classes, "near-classes")
    texts = rows.select(F.col("__near_row").alias("row"), F.col("__near_n").alias("n"), F.col("__near_sketch").alias("sketch"), F.col(text).alias("text"))
    width = 2 * ROWS
    cuts = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.col("__near_sketch").substr(i * width + 1, F.lit(width))))
    bands = rows.select("__near_row", "__near_sketch").join(classes.select("__near_row").hint("shuffle_hash"), "__near_row").select(F.explode(cuts).alias("band"), F.col("__near_row").alias("row"))
    with hashed_joins(docs.sparkSession):
        found = near_links(bands, texts, size, percent)
    linked = classes.join(found.withColumnRenamed("node", "__near_row"), "__near_row", "left").withColumn("component", F.coalesce("component", "__near_row"))
    least = linked.groupBy("component").agg(F.min("__near_first").alias("first"))
    named = linked.join(least, "component").select("__near_content", "first")
    return rows.join(named, "__near_content", "left").select(
        *docs.columns,
        F.col("__near_n").alias("n_shingles"),
        F.when(F.col("first").isNull(), F.col(key)).otherwise(F.col("first.key")).alias("component_id"),
        (F.col("first").isNull() | (F.col("first.row") == F.col("__near_row"))).alias("kept"),
    )
