"""Where intermediate tables go, and when they go away."""

import os

import pytest

from sievework.llm import mixing, work


class Cluster:
    """A session on a cluster whose shared folder is unset."""

    class sparkContext:  # noqa: N801
        master = "spark://somewhere:7077"

        @staticmethod
        def getConf():  # noqa: N802
            return {}

    conf = {}  # noqa: RUF012


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work.folder(Cluster, "x")


def test_scratch_is_deleted(spark):
    with work.scratch(spark):
        inner = work.table(spark.range(3), "kept")
        path = inner.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)
    outer = work.table(spark.range(3), "kept")
    assert outer.count() == 3


def test_no_weights_is_nothing(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, source string")
    assert mixing.poisson_mix(docs, weights={}).count() == 0
    assert mixing.poisson_mix(docs, weights={"": 1.0}, size=50.0).filter("source is not null").count() == 0
