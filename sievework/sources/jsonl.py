"""JSON lines, JSON documents, text files and manifests."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, missing_ok: bool = False) -> DataFrame:
    """Rows of a JSON-lines file or folder under an explicit schema.

    A byte-order mark and blank lines are skipped; a line that is no such
    object raises an error when it is read. A missing path raises an error, or
    is an empty table with `missing_ok`.
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        if missing_ok:
            return spark.createDataFrame([], schema)
        raise
    text = F.regexp_replace("value", "^﻿", "")
    return lines.filter(F.trim(text) != "").select(F.from_json(text, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """`errorifexists` is an exclusive sink, `overwrite` replaces, `append` is a log; a failed job leaves no partial output."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_document(row: DataFrame, path: str) -> None:
    """The single row of a report as one indented JSON document."""
    row.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_texts(rows: DataFrame, path: str, key: str, text: str) -> DataFrame:
    """A text per key under key=..., and the manifest of their sizes and digests."""
    rows.select(key, F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)
    return manifest(rows, key, F.col(text))


def manifest(rows: DataFrame, key: str, text: Column) -> DataFrame:
    return rows.select(key, F.octet_length(text).alias("bytes"), F.sha2(text, 256).alias("sha256"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of each file under a path; its name is the path below that one, so files of one name stay apart."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    # What is read is a URI, whose path is escaped; the name is not.
    below = F.url_decode(F.replace(F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", ""), F.lit("+"), F.lit("%2B")))
    return files.select(F.substring(below, len(root) + 2, 1 << 30).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def integrity(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, fault): files that are missing, unexpected, of another size or digest, or named outside the folder.

    A name leaves the folder if it is absolute or has more ".." than folders before them.
    """
    steps = F.filter(F.split("name", "/"), lambda x: ~x.isin("", "."))
    depths = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.aggregate(F.slice(steps, 1, n), F.lit(0), lambda at, x: at + F.when(x == "..", -1).otherwise(1)))
    outside = F.col("name").startswith("/") | F.when(F.size(steps) > 0, F.exists(depths, lambda d: d < 0)).otherwise(True)
    met = expected.select("name", F.col("bytes").alias("b"), F.col("sha256").alias("s")).join(found, "name", "full_outer")
    fault = (
        F.when(outside, "outside")
        .when(F.col("sha256").isNull(), "missing")
        .when(F.col("s").isNull(), "unexpected")
        .when(F.col("b") != F.col("bytes"), "size")
        .when(F.col("s") != F.col("sha256"), "digest")
    )
    return met.select("name", fault.alias("fault")).filter("fault is not null")


def verified_scan(spark: SparkSession, path: str, schema: T.StructType, expected: dict, name: str | None = None) -> DataFrame:
    """Rows of a table whose manifest says READY, with the right schema name (`name`, if given), number of rows, and files.

    `expected["files"]` has the size and SHA-256 of each file, by its name below
    `path`; a manifest without them, a missing or another file, size or digest is an error.
    """
    if expected.get("status") != "READY" or not expected.get("schema") or (name and expected["schema"] != name):
        raise ValueError("the table is not ready, or of another schema")
    files = expected.get("files") or {}
    if not files or any(not f.get("sha256") for f in files.values()):
        raise ValueError("the manifest has no digests")
    listed = spark.createDataFrame([(k, f["bytes"], f["sha256"]) for k, f in files.items()], "name string, bytes long, sha256 string")
    found = file_digests(spark, path).filter(~F.element_at(F.split("name", "/"), -1).rlike(r"^[._]"))
    if faults := integrity(found, listed).take(5):
        raise ValueError(f"files differ from the manifest: {[tuple(f) for f in faults]}")
    rows = read_jsonl(spark, path, schema)
    if (n := rows.count()) != expected["rows"]:
        raise ValueError(f"{n} rows where the manifest has {expected['rows']}")
    return rows


def release_faults(tables: dict[str, DataFrame], rows: dict[str, int], key: str, total: int) -> DataFrame:
    """(name, fault): tables of another number of rows than stated, and whether all tables' keys are `total` and distinct."""
    spark = next(iter(tables.values())).sparkSession
    every = [t.select(F.lit(n).alias("name"), F.col(key).cast("string").alias("key")) for n, t in tables.items()]
    met = every[0]
    for t in every[1:]:
        met = met.unionByName(t)
    stated = spark.createDataFrame(list(rows.items()), "name string, stated long")
    counts = stated.join(met.groupBy("name").agg(F.count("*").alias("n")), "name", "left")
    wrong = counts.filter(F.coalesce("n", F.lit(0)) != F.col("stated")).select("name", F.lit("rows").alias("fault"))
    keys = met.agg(F.count("key").alias("n"), F.count_distinct("key").alias("d"))
    again = keys.filter((F.col("n") != F.col("d")) | (F.col("n") != total)).select(F.lit("all").alias("name"), F.lit("keys").alias("fault"))
    return wrong.unionByName(again)


def flags_of(options: dict) -> list[str]:
    """A configuration as command-line flags: names that begin with "_", nulls and false ones are left out; true is the flag alone."""
    out: list[str] = []
    for name, value in options.items():
        if name.startswith("_") or value is None or value is False:
            continue
        flag = "--" + name.replace("_", "-")
        out += [flag] if value is True else [flag, str(value)]
    return out


def read_config(spark: SparkSession, path: str) -> dict:
    """The object of one JSON document, as plain values."""
    whole = "".join(r["value"] for r in spark.read.option("wholetext", "true").text(path).collect()).lstrip("\ufeff")
    found = json.loads(whole)
    if not isinstance(found, dict):
        raise ValueError("a configuration is an object")
    return found


def answered(rows: DataFrame, schema: T.StructType, client: Callable[[list[dict]], list[dict]], size: int = 8, attempts: int = 2, pause: float = 5.0) -> DataFrame:
    """Rows answered by an injected client, in batches; a failing batch is split in halves, a failing row is tried again after `pause` seconds.

    The client is called on the executors. Nothing here reaches a network by itself.
    """

    def ask(batch: list[dict], left: int) -> list[dict]:
        try:
            return client(batch)
        except OSError:
            if len(batch) > 1:
                half = len(batch) // 2
                return ask(batch[:half], left) + ask(batch[half:], left)
            if left <= 1:
                raise
            time.sleep(pause)
            return ask(batch, left - 1)

    def run(parts):  # noqa: ANN001, ANN202
        import pandas as pd

        for part in parts:
            rows_ = part.to_dict("records")
            out = [x for i in range(0, len(rows_), size) for x in ask(rows_[i : i + size], attempts)]
            yield pd.DataFrame(out, columns=schema.fieldNames())

    return rows.mapInPandas(run, schema)


