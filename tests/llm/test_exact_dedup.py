"""The stream reads its state back over several micro-batches."""

import pathlib

from pyspark.sql import functions as F

from sievework.llm import queries


def test_several_batches_give_the_same(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 90).cast("string")).alias("text"))
    docs.repartition(8, "doc_id").write.parquet(f"file://{tmp_path}/documents.parquet")
    base = pathlib.Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(base.glob("dedup-state-*"))
    found = queries.op3_exact_dedup(spark, f"file://{tmp_path}").collect()
    (state,) = set(base.glob("dedup-state-*")) - before
    assert len(list((state / "changes").glob("batch=*"))) >= 3
    assert len(found) == 400
    for r in found:
        same = range(r["doc_id"] % 90, 400, 90)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (same[0], len(same), r["doc_id"] < 90)
