"""Queries of the subpackage against SQL, and the pipeline against its stages done by hand."""

import collections
import hashlib
import math
import os
import re
import zlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from sievework.llm import queries  # noqa: E402
from tests.compare import database, same  # noqa: E402
from tests.llm.test_operators import brute_components  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not there")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    same(queries.QUERIES[name](spark, FOLDER), database(FOLDER), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_covers_its_table(spark, name):
    table, key = ("pages", "page_id") if name in ("op7_wrappers", "op8_warc") else ("documents", "doc_id")
    found = {r[0] for r in queries.QUERIES[name](spark, FOLDER).select(key).distinct().collect()}
    every = {r[0] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect()}
    assert found <= every and (found == every or name == "op1_mixing")


def test_stages_keep_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumns({c: F.lit("own") for c in ("kept", "score", "predicted", "mix_copy", "component_id", "keep_id")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, FOLDER)
        assert found.columns == docs.columns
        assert {r[0] for r in found.select("kept").distinct().collect()} == {"own"}
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


def plain_mix(rows):
    """Poisson counts by inversion, sources weighing the square root of their number."""
    many = collections.Counter(s or "" for _, s in rows)
    weights = {s: math.sqrt(n) for s, n in many.items()}
    out = collections.Counter()
    for k, s in rows:
        s = s or ""
        rate = weights[s] / sum(weights.values()) * len(rows) / many[s]
        u = (int(hashlib.md5(f"mix|{k}|0".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        total, n = math.exp(-rate), 0
        while total <= u:
            n += 1
            total += math.exp(n * math.log(rate) - rate - math.lgamma(n + 1))
        if n:
            out[k] = n
    return out


def test_stages_take_nulls_and_odd_rows(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", None, "", 0), (10**9, "x " * 30_000, "en", "s", 1), (10**9, "x " * 30_000, "en", "s", 1)], docs.schema)
    rows = docs.limit(60).unionByName(odd).withColumns({c: F.lit("own") for c in ("text_sha256", "mix_order", "mix_rate", "n_shingles", "held_out", "group_size", "cost", "ids")})
    for name, stage in corpus_pipeline.STAGES:
        rows = spark.createDataFrame(stage(spark, rows, FOLDER).toArrow())
        assert name == "packing" or {r[0] for r in rows.select("mix_order").distinct().collect()} <= {"own"}
        assert rows.count() > 10
    assert rows.filter("offset < 0 or length <= 0").isEmpty()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, FOLDER).toArrow())
        assert at.columns == docs.columns
        kept[name] = [r["doc_id"] for r in at.collect()]
    good = kept["quality"]
    assert len(good) > 100 and len([k for k in good if label.get(k) == 1]) >= 0.97 * sum(label.values())
    assert len([k for k in good if label.get(k) == 0]) <= 0.1 * len([k for k in label.values() if k == 0])
    least = {}
    for k in sorted(good):
        least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text[k] or ""), k)
    assert sorted(kept["exact_dedup"]) == sorted(least.values())
    rows = [(k, text[k]) for k in sorted(kept["exact_dedup"])]
    sets, component = brute_components(rows, 5, 80)
    first = {c: k for (k, _), c, s in zip(reversed(rows), reversed(component), reversed(sets), strict=True) if s}
    assert sorted(kept["near_dedup"]) == sorted([*first.values(), *[k for (k, _), s in zip(rows, sets, strict=True) if not s]])
    copies = collections.Counter(kept["mixing"])
    assert copies == plain_mix([(k, source[k]) for k in kept["near_dedup"]])
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, FOLDER).collect()
    whole = collections.Counter(r["doc_id"] for r in pieces if r["start"] == 0)
    assert whole == copies and all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in pieces)
    whole_run = collections.Counter(r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).filter("start = 0").collect())
    assert whole_run == copies
