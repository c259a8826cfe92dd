"""Laws of the shards where rows are null, empty, repeated or one huge group."""

import zlib

import pytest
from pyspark.sql import functions as F

from sievework.llm import sharding


def check(found, rows, shards):
    want = sorted((str(k), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == want
    per = {s: [r for r in found if r["shard"] == s] for s in range(shards)}
    assert sum(map(len, per.values())) == len(found)
    for mine in per.values():
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
    bytes_ = [sum(r["size"] for r in mine) for mine in per.values()]
    total, most = sum(bytes_), max((r["size"] for r in found), default=0)
    assert max(bytes_) - min(bytes_) <= 2 * most + 2 * total / shards / 1000
    assert {r["law"] for r in found} <= {"bytes"} and {r["grown_shard"] for r in found} <= {None}
    return per


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_nulls_empty_and_repeated_rows(spark, shards):
    rows = [(None, None)] * 5 + [(None, "x")] * 4 + [(7, "same row")] * 60 + [(i, "" if i % 4 else None) for i in range(100)] + [(i, f"text {i} " * (i % 9)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    check(sharding.sharded(docs, shards).collect(), rows, shards)


def test_one_group_of_a_third(spark):
    rows = [(i, "a copy of one text " * 20 if i % 3 == 0 else f"text {i} " * (i % 50)) for i in range(3000)]
    check(sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect(), rows, 8)


def test_small_groups_stay_together(spark):
    rows = [(i, f"pair {i // 2} " * 8) for i in range(40_000)]
    per = check(sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect(), rows, 8)
    assert len({(r["doc_id"] // 2, s) for s, mine in per.items() for r in mine}) == 20_000
