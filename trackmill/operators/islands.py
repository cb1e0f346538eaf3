"""Gaps and islands: runs of rows that belong together in an order.

All take the columns that tell sequences apart (keys) and an order that ends in a unique column, and are windows over those keys:
one shuffle, no Python. Interval merging is associative, so merge_intervals() first merges within time buckets of each key, where
a hot key is split over tasks, and then merges the few that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(keys: list[str], *order: str | Column):
    return Window.partitionBy(*keys).orderBy(*order)


def number_islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """df with the number (from 0) of each row's island; `starts` is true where one begins. A sequence's first row always does."""
    w = over(keys, *order)
    flag = F.when(F.row_number().over(w) == 1, 0).when(starts, 1).otherwise(0)
    return df.withColumn("__starts", flag).withColumn(name, F.sum("__starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__starts")


def gap_islands(df: DataFrame, keys: list[str], time: str, tie: str, gap: int) -> DataFrame:
    """Islands of rows whose time is at most `gap` after the row before; adds gap_before (null at a sequence's start)."""
    w = over(keys, time, tie)
    return number_islands(df.withColumn("gap_before", F.col(time) - F.lag(time).over(w)), keys, [time, tie], F.col("gap_before") > gap)


def equal_runs(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "island") -> DataFrame:
    """Islands of neighbouring rows with the same value; nulls are equal to each other."""
    w = over(keys, *order)
    marked = df.withColumn("__v", value).withColumn("__p", F.lag("__v").over(w))
    return number_islands(marked, keys, order, ~F.col("__v").eqNullSafe(F.col("__p")), name).drop("__v", "__p")


def reach_before(keys: list[str], start: str, end: str, tie: str) -> Column:
    """The largest end of the rows before this one."""
    return F.max(end).over(over(keys, start, end, tie).rowsBetween(Window.unboundedPreceding, -1))


def reach_islands(df: DataFrame, keys: list[str], start: str, end: str, tie: str, gap: int = 0, name: str = "island") -> DataFrame:
    """Islands of intervals: a new one begins where a start lies more than `gap` after the largest end so far (touching ones stay together)."""
    marked = df.withColumn("__reach", reach_before(keys, start, end, tie))
    return number_islands(marked, keys, [start, end, tie], F.col(start) > F.col("__reach") + gap, name).drop("__reach")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, bucket: int | None = None) -> DataFrame:
    """keys, start, end, n: the unions of intervals, with the number of their parts. bucket: width of the time buckets that are merged first."""
    rows = df.select(*keys, F.col(start).alias("start"), F.col(end).alias("end"), F.lit(1).cast("long").alias("n"))

    def once(x: DataFrame, by: list[str]) -> DataFrame:
        return reach_islands(x, by, "start", "end", "n", gap).groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("island")

    if bucket:
        rows = once(rows.withColumn("__bucket", F.floor(F.col("start") / bucket)), [*keys, "__bucket"]).drop("__bucket")
    return once(rows, keys)


def merged_duration(df: DataFrame, keys: list[str], start: str, end: str, bucket: int | None = None) -> DataFrame:
    """keys, covered, n_islands."""
    return merge_intervals(df, keys, start, end, 0, bucket).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.count("*").alias("n_islands"))


def hold(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Null values take the last known one, else the next known one, else the sequence's median (where none is known: null)."""
    w = over(keys, *order)
    last = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    following = F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(name, F.coalesce(last, following, F.percentile(value, 0.5).over(Window.partitionBy(*keys))))


def unwrap(df: DataFrame, keys: list[str], order: list[str], angle: str, turn: float, name: str) -> DataFrame:
    """Angles made continuous: whole turns are added where neighbours differ by more than half of one."""
    w = over(keys, *order)
    step = F.col(angle) - F.lag(angle).over(w)
    turns = F.coalesce(-F.when(step > turn / 2, 1).when(step < -turn / 2, -1).otherwise(0), F.lit(0))
    return df.withColumn("__turns", turns).withColumn(name, F.col(angle) + turn * F.sum("__turns").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__turns")


def alternate_pairs(df: DataFrame, keys: list[str], order: list[str], pairs_with_next: Column) -> DataFrame:
    """Greedy pairing of neighbours from the left: pair_role is 'first', 'second' or null.

    In a run of rows that could each pair with the next, every other one does so, counted from the run's start.
    """
    w = over(keys, *order)
    marked = equal_runs(df.withColumn("__can", F.coalesce(pairs_with_next, F.lit(False))), keys, order, F.col("__can"), "__run")
    nth = F.row_number().over(over([*keys, "__run"], *order))
    led = marked.withColumn("__leads", F.col("__can") & (nth % 2 == 1))
    role = F.when(F.col("__leads"), "first").when(F.lag("__leads").over(w), "second")
    return led.withColumn("pair_role", role).drop("__can", "__run", "__leads")
