"""Canonical records, checks and enumerations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.python import yaml_object

# Names under which a record may come, in order.
ID_NAMES = ("id", "benchmark_id", "query_id", "source_benchmark_id")
QUESTION_NAMES = ("question", "query", "prompt", "natural_language_query")
ANSWER_NAMES = ("candidate_answer", "prediction_text", "answer")
# Fields that a query must not have.
PRIVATE = ("core_id", "expected_core_ids", "reference_expected_answer", "gold_answer")


def first_of(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first non-blank value among the columns that there are, trimmed; else null."""
    there = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def canonical_questions(df: DataFrame, family: str = "task_family") -> DataFrame:
    """(id, question, family); a row without an id or question raises an error when it is read."""
    named = df.select(first_of(df, ID_NAMES).alias("id"), first_of(df, QUESTION_NAMES).alias("question"), (F.col(family) if family in df.columns else F.lit(None).cast("string")).alias("family"))
    whole = F.col("id").isNotNull() & F.col("question").isNotNull()
    return named.withColumn("id", F.when(whole, F.col("id")).otherwise(F.raise_error(F.lit("a question needs an id and a text"))))


def condition_code(condition: Column) -> Column:
    """E or S for the names of a condition; null stays; any other raises an error."""
    return F.when(condition.isNull(), F.lit(None).cast("string")).when(condition.isin("experimental_context", "E"), "E").when(condition.isin("limited_context", "S"), "S").otherwise(F.raise_error(F.concat(F.lit("unknown condition: "), condition)).cast("string"))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that come more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def misaligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def private_fields(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c in PRIVATE]


def private_text(text: Column) -> Column:
    """Whether a text names a private field as a JSON key."""
    return F.coalesce(text, F.lit("")).rlike(r'"(?:' + "|".join(sorted(PRIVATE)) + r')"\s*:')


def enumerated(value: Column, allowed: tuple[str, ...], fallback: str) -> Column:
    """The value trimmed and in capitals if it is allowed, else the fallback."""
    v = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    return F.when(v.isin(*allowed), v).otherwise(fallback)


def flags(values: Column, known: tuple[str, ...]) -> tuple[Column, Column]:
    """The known flags, sorted, and whether there were others."""
    said = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.upper(F.trim(v)))
    names = F.array(*[F.lit(k) for k in known])
    return F.array_sort(F.array_intersect(said, names)), F.size(F.array_except(said, names)) > 0


def json_object(text: Column) -> Column:
    """The JSON object in a model's text: without a code fence, else between the outermost braces; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(bare).isNotNull() & bare.startswith("{"), bare).when(F.try_parse_json(inner).isNotNull() & (inner != ""), inner)


def reviewed_object(text: Column) -> Column:
    """(payload, note) of a reviewer's text: its JSON object, or, with the note SERIALIZATION_FALLBACK_YAML, the object that it is as YAML.

    Neither has no payload and the note PARSE_FAILURE; so has YAML where there is no parser of it. Only texts without JSON go to Python.
    """
    found = json_object(text)
    other = yaml_object(F.when(found.isNull(), text))
    note = F.when(found.isNotNull(), "").when(other.isNotNull(), "SERIALIZATION_FALLBACK_YAML").otherwise("PARSE_FAILURE")
    return F.struct(F.coalesce(found, other).alias("payload"), note.alias("note"))


def first_per(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("__nth") <= n).drop("__nth")


def baseline(df: DataFrame, system: str, name: str, item: str, answer: str) -> DataFrame:
    """One system's answers; none, a blank one or a repeated item raises an error when they are read."""
    own = df.filter(F.col(system) == name)
    total = own.agg(F.count("*").alias("n"), F.count_distinct(item).alias("d"), F.count_if(F.coalesce(F.trim(answer), F.lit("")) == "").alias("blank"))
    fine = total.select((F.col("n") > 0) & (F.col("n") == F.col("d")) & (F.col("blank") == 0)).scalar()
    return own.filter(F.assert_true(fine, F.lit("a baseline needs one answer for each item")).isNull())


def routed(questions: DataFrame, routes: DataFrame, family: str, default: str) -> DataFrame:
    """Questions with the instruction of their family, or the default, and the chat messages for them."""
    met = questions.join(routes, family, "left").withColumn("route", F.when(F.col("instruction").isNull(), F.lit("general")).otherwise(F.col(family).cast("string")))
    text = F.coalesce("instruction", F.lit(default))
    return met.withColumn("messages", F.array(F.struct(F.lit("system").alias("role"), text.alias("content")), F.struct(F.lit("user").alias("role"), F.col("question").alias("content")))).drop("instruction")
