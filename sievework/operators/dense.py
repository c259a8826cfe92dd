"""Exact dense retrieval: blocks of queries meet slices of vectors, and each pair of them leaves its best hits and its sums."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators.retrieval import ranked

#: Queries and vectors that meet in one group, at most; and how many of their scores are computed at once.
BLOCK, SLICE, ROWS, TILE = 512, 65_536, 16, 4096


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, padded with zeros, and their lengths: -1 for a null and for one with a null."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(lists)
    out = np.zeros((len(lists), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat.to_numpy(zero_copy_only=False)
    lengths = np.where(lists.is_null().to_numpy(zero_copy_only=False), -1, sizes)
    if flat.null_count:
        lengths[np.repeat(np.arange(len(lists)), sizes)[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return out, lengths


def nine_decimals(x: np.ndarray) -> np.ndarray:
    """As round(x, 9) of Spark: halves of the shortest decimal go away from zero."""
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.floor(np.abs(x))
        part = (np.abs(x) - whole) * 1e9
        out = np.where(np.isfinite(x), np.copysign(np.where(whole < 4e6, np.floor(np.abs(x) * 1e9 + 0.5) / 1e9, whole + np.floor(part + 0.5) / 1e9), x) + 0.0, x)
        near = np.abs(part - np.floor(part) - 0.5) <= 1e-8 + np.abs(x) * 1e-6
    for i in zip(*np.nonzero(near & (np.abs(x) < 4e6)), strict=True):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    return out


def products(q: np.ndarray, f: np.ndarray) -> np.ndarray:
    """All dot products of rows of q with columns of f, each summed in the order of the components."""
    out = np.zeros((len(q), f.shape[1]))
    with np.errstate(invalid="ignore", over="ignore"):
        for a in range(0, f.shape[1], TILE):
            tile, part = out[:, a : a + TILE], np.empty((len(q), min(TILE, f.shape[1] - a)))
            for j in range(f.shape[0]):
                np.multiply(q[:, j, None], f[j, a : a + TILE], out=part)
                tile += part
    return out


def dense_parts(queries: DataFrame, facets: DataFrame, query_id: str, record: str, top: int, lane: str | None = None, vector: str = "embedding", block: int = BLOCK, most: int = SLICE) -> DataFrame:
    """The `top` facets of each query and lane (or of all) within each slice of the facets, by their dot product rounded to nine decimals.

    Every query meets every facet: queries in blocks, facets in hashed slices of
    about `most` rows, one group for each pair of them, whatever the tables' size.
    `n`, `mean` and `m2` (squares about the mean) of all scores of the query and
    lane in the slice stand in the row of its first hit. A vector that is null,
    holds a null or has another length has a null score. Ties go to the lesser record.
    """
    n = facets.count()
    slices = max(1, -(-n // most))
    own = [c for c in facets.columns if c != vector]
    numbered = queries.select(query_id, F.col(vector).alias("__v"), F.floor(F.col(query_id) / block).alias("__block"))
    asked = numbered.crossJoin(facets.sparkSession.range(slices).withColumnRenamed("id", "__slice"))
    met = facets.withColumnRenamed(vector, "__v").withColumn("__slice", F.pmod(F.xxhash64(record), F.lit(slices)).cast("bigint")).crossJoin(numbered.select(F.col("__block").alias("__met")).distinct())
    numbers = [T.StructField("score", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("mean", T.DoubleType()), T.StructField("m2", T.DoubleType())]
    schema = T.StructType([queries.schema[query_id], *[facets.schema[c] for c in own], *numbers])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, [(c, "ascending") for c in ([lane] if lane else []) + [record]]))
        q, q_length = matrix(left["__v"])
        f, f_length = matrix(right["__v"])
        width = max(q.shape[1], f.shape[1])
        q, f = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, f))
        f = np.ascontiguousarray(f.T)
        codes = pc.rank(right[lane], tiebreaker="dense").to_numpy(zero_copy_only=False) if lane else np.zeros(right.num_rows, int)
        edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), right.num_rows] if right.num_rows else [0]
        found: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(q), ROWS):
            scores = nine_decimals(products(q[at : at + ROWS], f))
            known = (q_length[at : at + ROWS, None] == f_length) & (f_length >= 0)
            for a, b in zip(edges, edges[1:], strict=False):
                s, k = scores[:, a:b], known[:, a:b]
                size = k.sum(axis=1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    mean = np.where(k, s, 0.0).sum(axis=1) / size
                    m2 = np.where(k, (s - mean[:, None]) ** 2, 0.0).sum(axis=1)
                key = np.where(k, np.where(np.isnan(s), np.inf, s), -np.inf)
                row, col = np.nonzero(key >= -np.partition(-key, top - 1, axis=1)[:, top - 1 : top]) if b - a > top else (x.ravel() for x in np.indices(s.shape))
                order = np.lexsort((col, -key[row, col], ~np.isnan(s[row, col]), ~k[row, col], row))
                row, col = row[order], col[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                row, col, place = row[place < top], col[place < top], place[place < top]
                first = place == 0
                found.append((row + at, col + a, s[row, col], k[row, col], np.where(first, size[row], 0), np.where(first, mean[row], 0.0), np.where(first, m2[row], 0.0), first & (size[row] > 0)))
        if not found:
            none = [left[query_id][:0], *[right[c][:0] for c in own], *[pa.array([], t) for t in (pa.float64(), pa.int64(), pa.float64(), pa.float64())]]
            return pa.Table.from_arrays(none, names=schema.fieldNames())
        row, col, score, has, size, mean, m2, first = (np.concatenate(x) for x in zip(*found, strict=True))
        hits = [left[query_id].take(row), *[right[c].take(col) for c in own]]
        return pa.Table.from_arrays([*hits, pa.array(score, mask=~has), pa.array(size.astype(np.int64)), pa.array(mean, mask=~first), pa.array(m2, mask=~first)], names=schema.fieldNames())

    return asked.groupBy("__block", "__slice").cogroup(met.groupBy("__met", "__slice")).applyInArrow(best, schema)


def dense_top(queries: DataFrame, facets: DataFrame, query_id: str, record: str, top: int, vector: str = "embedding", block: int = BLOCK, most: int = SLICE) -> DataFrame:
    """The `top` facets of each query by their dot product, numbered from 1; see dense_parts()."""
    parts = dense_parts(queries, facets, query_id, record, top, None, vector, block, most).drop("n", "mean", "m2")
    return ranked(parts, [query_id], [F.desc("score"), F.asc(record)], top)


def lane_top(queries: DataFrame, facets: DataFrame, query_id: str, lane: str, record: str, top: int, vector: str = "embedding", block: int = BLOCK, most: int = SLICE) -> DataFrame:
    """The `top` records of each lane by their score's z value within the lane.

    Within a lane the z value rises with the score, so slices are pruned by score;
    their sums give the lane's mean and population deviation (at least 1e-6).
    Records without a lane have no place in one.
    """
    parts = dense_parts(queries, facets.filter(F.col(lane).isNotNull()), query_id, record, top, lane, vector, block, most)
    whole = Window.partitionBy(query_id, lane)
    size = F.nullif(F.sum("n").over(whole), F.lit(0))
    centred = parts.withColumn("__size", size).withColumn("__mean", F.sum(F.col("n") * F.col("mean")).over(whole) / F.col("__size"))
    spread = F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("__mean")) * (F.col("mean") - F.col("__mean"))).over(whole)
    stated = centred.withColumn("__std", F.greatest(F.sqrt(spread / F.col("__size")), F.lit(1e-6)))
    best = ranked(stated, [query_id, lane], [F.desc("score"), F.asc(record)], top, "lane_rank")
    return best.withColumn("z", F.round((F.col("score") - F.col("__mean")) / F.col("__std"), 9)).drop("n", "mean", "m2", "__size", "__mean", "__std")
