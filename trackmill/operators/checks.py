"""Checks of inputs and of results: masks, budgets, comparable times, case and partition figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def motion_mask(dynamic: Column, x: Column, y: Column, z: Column, radius: float, height: float) -> Column:
    """DYNAMIC for points declared so (tested first), NEAR_EGO for those within a radius and a height of the sensor, else null."""
    near = (x * x + y * y <= radius * radius) & (F.abs(z) <= height)
    return F.when(F.coalesce(dynamic, F.lit(False)), "DYNAMIC").when(near, "NEAR_EGO")


def within_budget(rows: DataFrame, most_rows: int, ranges: dict[str, tuple[float, float]], groups: dict[str, int] | None = None) -> DataFrame:
    """One row: n, and of each column whose range is given `outside_<column>` (nulls and NaN count), of each whose number of values is bounded
    `values_<column>`, and ok: whether all keep within their bounds. One pass of partial aggregation."""
    groups = groups or {}
    inside = {c: F.coalesce((F.col(c) >= low) & (F.col(c) <= high) & ~F.isnan(F.col(c).cast("double")), F.lit(False)) for c, (low, high) in ranges.items()}
    got = rows.agg(F.count("*").alias("n"), *[F.count_if(~x).alias(f"outside_{c}") for c, x in inside.items()], *[F.count_distinct(c).alias(f"values_{c}") for c in groups])
    ok = F.col("n") <= most_rows
    for c in ranges:
        ok = ok & (F.col(f"outside_{c}") == 0)
    for c, most in groups.items():
        ok = ok & (F.col(f"values_{c}") <= most)
    return got.withColumn("ok", ok)


def require(report: DataFrame, what: str) -> DataFrame:
    """The report of within_budget(), which fails when it is read and something is out of bounds."""
    return report.withColumn("ok", F.when(F.col("ok"), True).otherwise(F.raise_error(F.concat(F.lit(f"{what} is out of bounds: "), F.to_json(F.struct(*[F.col(c) for c in report.columns])))).cast("boolean")))


def time_difference(a: Column, a_clock: Column, b: Column, b_clock: Column, otherwise: Column | None = None) -> Column:
    """a - b of times of one clock; an error, or `otherwise` if given, for times of different or unknown clocks and for differences beyond a long."""
    wide = a.cast("decimal(38,0)") - b.cast("decimal(38,0)")
    exact = wide.between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)"))
    other = F.raise_error(F.lit("times are not comparable")).cast("long") if otherwise is None else otherwise
    return F.when(F.coalesce(a_clock == b_clock, F.lit(False)) & exact, wide.cast("long")).otherwise(other)


def case_verdicts(cases: DataFrame, expected: str, primary: str, rules: str, clean: Column) -> DataFrame:
    """cases with `detected` (the expected rule is among the rules), `primary_absent` and `false_alarm` (a clean case with any rule)."""
    has = lambda rule: F.coalesce(F.array_contains(rules, F.col(rule)), F.lit(False))
    return cases.withColumns({"detected": ~clean & has(expected), "primary_absent": ~clean & ~has(primary), "false_alarm": clean & (F.size(rules) > 0)})


def boundary_error(first: Column, last: Column, found_first: Column, found_last: Column) -> Column:
    """How far an event's ends lie from the nearest end of the true one, the larger of both."""
    away = lambda x: F.least(F.abs(x - first), F.abs(x - last))
    return F.greatest(away(found_first), away(found_last))


def partition_figures(cases: DataFrame, keys: list[str], clean: Column, error: str) -> DataFrame:
    """keys, cases, detection_rate, false_alarm_rate (null without cases of the kind), max_error of the detected."""
    share = lambda hit, of: F.round(F.when(F.count_if(of) > 0, F.count_if(hit & of) / F.count_if(of)), 9)
    return cases.groupBy(*keys).agg(F.count("*").alias("cases"), share(F.col("detected"), ~clean).alias("detection_rate"), share(F.col("false_alarm"), clean).alias("false_alarm_rate"), F.max(F.when(F.col("detected"), F.col(error))).alias("max_error"))
