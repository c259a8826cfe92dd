"""Next-fit packing of one order of any length, without one task that walks it.

Whether a row begins a block depends on all rows before it, but on one number
only: how much of the open block is used. So a range of rows is a function from
the state before it to the state after it, a table over the capacity's numbers.
The order is cut into ranges; each range's function is computed by itself (the
row that begins the next block is found by search in prefix sums); functions are
composed in groups, and groups of groups; then the true states go down the same
tree, and each range places its rows. A group's end resets the state, wherever
it falls, so groups of any size are one order.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.sources.work import table

#: Rows of a range, about, and functions that are composed at once.
RANGE_ROWS, FAN = 200_000, 32


@dataclass
class Packing:
    """The rule: blocks of `capacity`; with `flush_full` a block that is exactly full is closed at once."""

    capacity: int
    flush_full: bool

    @property
    def new(self) -> int:
        """The state in which the next row begins a block; others are what the open block uses."""
        return self.capacity + 1

    def next_start(self, sums: np.ndarray, used_until: np.ndarray) -> np.ndarray:
        """The first row that isn't in a block any more, whose room ends where the prefix sums exceed `used_until`."""
        after = np.searchsorted(sums, used_until, side="right") - 1
        if self.flush_full:
            exact = np.searchsorted(sums, used_until, side="left")
            after = np.where((exact < len(sums)) & (sums[np.minimum(exact, len(sums) - 1)] == used_until), exact, after)
        return after

    def chain(self, sums: np.ndarray, start: int) -> list[int]:
        """The rows that begin blocks, from one of them on."""
        out, n = [], len(sums) - 1
        while start < n:
            out.append(start)
            start = int(self.next_start(sums, sums[start] + self.capacity))
        return out

    def final(self, used: Any) -> Any:
        return np.where(np.equal(used, self.capacity), self.new, used) if self.flush_full else used


@dataclass
class Step:
    """What a run of rows makes of each state before it.

    `state` after it, blocks begun in the last group (`since`) and rows in the
    open block (`placed`), both on top of those before unless the group changed
    or the open block began here (`fresh`).
    """

    first: Any
    last: Any
    changed: bool
    state: np.ndarray
    since: np.ndarray
    placed: np.ndarray
    fresh: np.ndarray

    def then(self, other: Step, new: int) -> Step:
        same = self.last == other.first
        at = self.state if same else np.full_like(self.state, new)
        keeps = same and not other.changed
        fresh = other.fresh[at] if keeps else np.ones(len(at), bool)
        return Step(
            self.first,
            other.last,
            self.changed or not keeps,
            other.state[at],
            other.since[at] + (self.since if keeps else 0),
            other.placed[at] + np.where(fresh, 0, self.placed),
            fresh | self.fresh,
        )


def step_of(first: Any, last: Any, parts: list[np.ndarray], rule: Packing) -> Step:
    """The function of a range; `parts` are the sizes of its groups' runs, in order."""
    new, states = rule.new, rule.capacity + 2
    sums = np.concatenate(([0], np.cumsum(parts[0])))
    n = len(parts[0])
    used = np.arange(rule.capacity + 1)
    begin = np.append(rule.next_start(sums, rule.capacity - used), 0)  # in the state `new` the first row begins a block
    if rule.flush_full:
        begin[rule.capacity] = 0  # a full block is never left open
    found = {int(b): rule.chain(sums, int(b)) for b in np.unique(begin)} if len(parts) == 1 else {}
    if len(parts) > 1:
        sums = np.concatenate(([0], np.cumsum(parts[-1])))
        starts, n = rule.chain(sums, 0), len(parts[-1])
        end = int(rule.final(sums[-1] - sums[starts[-1]]))
        return Step(first, last, True, np.full(states, end), np.full(states, len(starts)), np.full(states, n - starts[-1]), np.ones(states, bool))
    state, since, placed, fresh = np.empty(states, np.int64), np.zeros(states, np.int64), np.empty(states, np.int64), np.empty(states, bool)
    for b, starts in found.items():
        which = begin == b
        fresh[which] = bool(starts)
        since[which] = len(starts)
        placed[which] = n - starts[-1] if starts else n
        state[which] = rule.final(sums[-1] - sums[starts[-1]]) if starts else 0
    through = ~fresh
    state[through] = rule.final(np.append(used, 0)[through] + sums[-1])
    return Step(first, last, False, state, since, placed, fresh)


def placed_rows(parts: list[np.ndarray], rule: Packing, state: int, since: int, placed: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, place) of each row of a range, from the state before it."""
    blocks, places = [], []
    for k, sizes in enumerate(parts):
        if k:
            state, since, placed = rule.new, 0, 0
        sums = np.concatenate(([0], np.cumsum(sizes)))
        begin = 0 if state == rule.new else int(rule.next_start(sums, np.int64(rule.capacity - state)))
        starts = np.array(rule.chain(sums, begin), dtype=np.int64)
        row = np.arange(len(sizes))
        which = np.searchsorted(starts, row, side="right") - 1
        blocks.append(since + which)
        places.append(np.where(which < 0, placed + row, row - starts[which] if len(starts) else 0))
    return np.concatenate(blocks), np.concatenate(places)


def _runs(values: pd.Series) -> np.ndarray:
    """Where runs of equal values begin, and the end; nulls are equal."""
    codes = pd.factorize(values, use_na_sentinel=False)[0]
    return np.concatenate(([0], np.flatnonzero(np.diff(codes)) + 1, [len(values)]))


def next_fit(rows: DataFrame, group: str, key: str, size: str, capacity: int, order: list[str] | None = None, flush_full: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(group, key, block, place): rows put in order into blocks, a new one when the next does not fit.

    Rows are ordered by `order` (the key, if none is given) within their group,
    nulls first; null groups are one. Rows that are alike in all these columns
    are taken in any order and each has its own place. With `flush_full` a block
    that is exactly full is closed at once. A row larger than a block, or without
    a size, raises an error. Tasks hold `range_rows` rows' sizes, or `FAN` tables
    over the capacity; no group is held by one task.
    """
    spark, rule = rows.sparkSession, Packing(capacity, flush_full)
    names = list(dict.fromkeys([group, *(order or [key]), key]))
    light = table(rows.select(*dict.fromkeys([*names, size])), "nextfit-rows")
    many = max(1, -(-light.count() // range_rows))
    #: Equal rows are told apart by where they lie in the table, so that they can be dealt to several ranges.
    told = light.withColumn("__tie", F.monotonically_increasing_id())
    sizes = F.when(F.col(size).isNull(), F.raise_error(F.lit("a row without a size"))).when(F.col(size) > capacity, F.raise_error(F.concat(F.lit("a row of "), F.col(size).cast("string"), F.lit(f" exceeds the block length {capacity}")))).otherwise(F.col(size)).cast("long")
    kept = T.StructType([rows.schema[group], rows.schema[key]])
    # Written at once with the number of its range: the ranges' bounds are sampled anew in every run.
    ranged = told.repartitionByRange(many, *names, "__tie").sortWithinPartitions(*names, "__tie").select(F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().alias("__at"), group, key, sizes.alias("__size"))
    ranged = table(ranged, "nextfit-ranges")

    numbers = T.ArrayType(T.LongType())
    step = T.StructType([T.StructField("id", T.LongType()), T.StructField("first", kept[group].dataType), T.StructField("last", kept[group].dataType), T.StructField("changed", T.BooleanType()), T.StructField("state", numbers), T.StructField("since", numbers), T.StructField("placed", numbers), T.StructField("fresh", T.ArrayType(T.BooleanType()))])

    def none(x: Any) -> Any:
        return None if pd.isna(x) else x

    def parts_of(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray]]:
        pdf = pdf.sort_values("__at", kind="stable", ignore_index=True)
        cuts = _runs(pdf[group])
        values = pdf["__size"].to_numpy(np.int64)
        return pdf, [values[a:b] for a, b in zip(cuts, cuts[1:])]

    def row_of(at: int, s: Step) -> dict:
        return {"id": at, "first": s.first, "last": s.last, "changed": s.changed, "state": s.state, "since": s.since, "placed": s.placed, "fresh": s.fresh}

    def framed(found: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({name: pd.Series([r[name] for r in found], dtype=object if name in ("first", "last", "state", "since", "placed", "fresh") else None) for name in step.fieldNames()})

    def functions(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, parts = parts_of(pdf)
        return framed([row_of(int(pdf["__range"].iloc[0]), step_of(none(pdf[group].iloc[0]), none(pdf[group].iloc[-1]), parts, rule))])

    def steps_of(pdf: pd.DataFrame) -> list[tuple[int, Step]]:
        pdf = pdf.sort_values("id")
        return [(int(r["id"]), Step(none(r["first"]), none(r["last"]), bool(r["changed"]), *(np.asarray(r[c]) for c in ("state", "since", "placed", "fresh")))) for _, r in pdf.iterrows()]

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        (at, whole), *others = steps_of(pdf)
        for _, s in others:
            whole = whole.then(s, rule.new)
        return framed([row_of(at // FAN, whole)])

    levels = [table(ranged.groupBy("__range").applyInPandas(functions, step), "nextfit-steps")]
    width = many
    while width > FAN:
        levels.append(table(levels[-1].groupBy(F.floor(F.col("id") / FAN)).applyInPandas(composed, step), "nextfit-steps"))
        width = -(-width // FAN)

    before = T.StructType([T.StructField("of", T.LongType()), T.StructField("group", kept[group].dataType), T.StructField("known", T.BooleanType()), T.StructField("at", T.LongType()), T.StructField("blocks", T.LongType()), T.StructField("rows", T.LongType())])

    def descended(pdf: pd.DataFrame) -> pd.DataFrame:
        start = pdf.iloc[0]
        last, known, at, blocks, held = none(start["group"]), bool(start["known"]), int(start["at"]), int(start["blocks"]), int(start["rows"])
        out = []
        for i, s in steps_of(pdf):
            if not known or last != s.first:
                at, blocks, held = rule.new, 0, 0
            out.append((i, last, known, at, blocks, held))
            held = int(s.placed[at]) + (0 if s.fresh[at] else held)
            blocks = int(s.since[at]) + (0 if s.changed else blocks)
            last, known, at = s.last, True, int(s.state[at])
        return pd.DataFrame({name: pd.Series([r[k] for r in out], dtype=object if name == "group" else None) for k, name in enumerate(before.fieldNames())})

    states = spark.createDataFrame([(0, None, False, rule.new, 0, 0)], before)
    for n, level in enumerate(reversed(levels)):
        parent = F.lit(0).cast("long") if n == 0 else F.floor(F.col("id") / FAN)
        met = level.withColumn("__parent", parent).join(states, F.col("__parent") == F.col("of"))
        states = table(met.groupBy("__parent").applyInPandas(descended, before), "nextfit-states")

    schema = T.StructType([*kept, T.StructField("block", T.LongType()), T.StructField("place", T.LongType())])

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, parts = parts_of(pdf)
        start = pdf.iloc[0]
        # The state before a range is that of the group before it: of another group, it is none.
        same = bool(start["known"]) and none(start["__before"]) == none(start[group])
        blocks, places = placed_rows(parts, rule, int(start["at"]) if same else rule.new, int(start["blocks"]) if same else 0, int(start["rows"]) if same else 0)
        return pd.DataFrame({group: pdf[group], key: pdf[key], "block": blocks, "place": places})

    return ranged.join(states.withColumnRenamed("group", "__before"), F.col("__range") == F.col("of")).groupBy("__range").applyInPandas(put, schema)
