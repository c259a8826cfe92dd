"""Several tables published together: a reader sees all of one version or all of the one before, never a mixture.

A run writes its tables into a folder of its own, beside what is published, reads
them back, and checks them there. What publishes them is the version's manifest,
one small file that Spark's writer commits last:

    path/runs/<run>/<table>/...          the tables of a run
    path/manifests/version=<n>/*.json    the run that is version n, its tables' rows and digests, and the run's facts

A run that fails, or whose checks find a fault, leaves no manifest, so nothing of
it is ever read. Tables of earlier versions stay for those who still read them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TABLE = T.StructType([T.StructField(n, T.LongType() if n == "rows" else T.StringType()) for n in ("name", "form", "schema", "rows", "digest")])
MANIFEST = T.StructType([T.StructField("version", T.LongType()), T.StructField("run", T.StringType()), T.StructField("tables", T.ArrayType(_TABLE)), T.StructField("facts", T.StringType())])


def _row_digest(df: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)


def content(df: DataFrame) -> DataFrame:
    """(rows, digest) of a table: equal for equal rows, in whatever order, files or columns' order they come.

    The digest is made of sums over the rows' own digests, so it needs no sort and a shuffle of one row a task.
    """
    part = lambda at: F.sum(F.conv(F.substring("d", at, 15), 16, 10).cast("decimal(38,0)"))
    sums = df.select(_row_digest(df).alias("d")).agg(F.count("*").alias("rows"), part(1).alias("a"), part(16).alias("b"))
    return sums.select("rows", F.sha2(F.concat_ws(":", "rows", F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))), 256).alias("digest"))


def versions(spark: SparkSession, path: str) -> DataFrame:
    """The manifests of what has been published under `path`; none yet is an empty table."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifests")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The manifest of a version, or of the newest; none if there is no such version."""
    found = versions(spark, path)
    row = (found.filter(F.col("version") == version) if version is not None else found.orderBy(F.desc("version"))).first()
    return None if row is None else row.asDict(recursive=True) | {"facts": json.loads(row["facts"])}


def _read(spark: SparkSession, place: str, form: str, schema: T.StructType) -> DataFrame:
    return spark.read.format(form).schema(schema).load(place).select(*schema.fieldNames())


def published(spark: SparkSession, path: str, name: str, version: int | None = None, verify: bool = False) -> DataFrame:
    """A published table, of the newest version if none is given; with `verify`, other rows or another digest than the manifest's are an error."""
    found = manifest(spark, path, version)
    entry = next((t for t in found["tables"] if t["name"] == name), None) if found else None
    if entry is None:
        raise ValueError(f"no table {name} is published there")
    table = _read(spark, f"{path}/runs/{found['run']}/{name}", entry["form"], T.StructType.fromJson(json.loads(entry["schema"])))
    if verify and tuple(content(table).first()) != (entry["rows"], entry["digest"]):
        raise ValueError(f"the table {name} isn't what was published")
    return table


def publish(
    spark: SparkSession,
    path: str,
    tables: dict[str, DataFrame],
    checks: Callable[[dict[str, DataFrame]], DataFrame] | None = None,
    facts: Callable[[dict[str, DataFrame]], dict] | None = None,
    partitions: dict[str, list[str]] | None = None,
    form: str = "parquet",
) -> int:
    """Writes and checks the tables, publishes them as the next version, and returns its number.

    `checks` gets the tables as they were written and returns rows of faults;
    any stops the run with an error. `facts` gets them too; what it returns stands
    in the manifest. `partitions` names the columns that divide a table's folders,
    `form` is parquet, json or orc. Of two runs at one time that would become the
    same version, the later one fails.
    """
    run, stored, entries = uuid.uuid4().hex, {}, []
    before = manifest(spark, path)
    version = before["version"] + 1 if before else 1
    for name, table in tables.items():
        place, by = f"{path}/runs/{run}/{name}", (partitions or {}).get(name, [])
        writer = table.write.format(form).partitionBy(*by)
        (writer.option("ignoreNullFields", "false") if form == "json" else writer).save(place)
        stored[name] = _read(spark, place, form, table.schema)
        entries.append({"name": name, "form": form, "schema": table.schema.json(), **content(stored[name]).first().asDict()})
    if checks and (faults := [tuple(r) for r in checks(stored).take(5)]):
        raise ValueError(f"nothing is published: {faults}")
    made = [(run, entries, json.dumps(facts(stored) if facts else {}, ensure_ascii=False, sort_keys=True))]
    columns = T.StructType(MANIFEST.fields[1:])
    spark.createDataFrame(made, columns).coalesce(1).write.mode("errorifexists").json(f"{path}/manifests/version={version}")
    return version


def append_entry(rows: DataFrame, path: str, run: str, entry: int) -> None:
    """Adds the rows to a log as one entry of a run; the same entry again replaces itself, so a repeated step logs once."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/run={run}/entry={entry}")


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All entries of a log: its columns, and run and entry."""
    kinds = T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("entry", T.LongType())])
    return spark.read.schema(kinds).json(path)
