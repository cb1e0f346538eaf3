"""Masks, input budgets, clocks and figures of detector cases, on line items, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as C
from .registry import EVENTS, events, query, table


@query("""
SELECT l_suppkey % 20 AS frame, CASE WHEN l_returnflag = 'R' THEN 'DYNAMIC' WHEN (l_quantity - 25) * (l_quantity - 25) + (l_discount * 100) * (l_discount * 100) <= 100 AND abs(l_tax * 100 - 4) <= 2 THEN 'NEAR_EGO' ELSE 'KEPT' END AS mask, count(*) AS n FROM lineitem GROUP BY ALL
""")
def motion_masks(spark, sf_dir):
    """Points that are declared dynamic, or near the sensor, before frames are compared."""
    mask = C.motion_mask(F.col("l_returnflag") == "R", F.col("l_quantity") - 25, F.col("l_discount") * 100, F.col("l_tax") * 100 - 4, 10.0, 2.0)
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("frame"), F.coalesce(mask, F.lit("KEPT")).alias("mask")).agg(F.count("*").alias("n"))


@query("""
SELECT count(*) AS n, count(*) FILTER (NOT coalesce(l_quantity BETWEEN 1 AND 45, false)) AS outside_l_quantity, count(*) FILTER (NOT coalesce(l_discount BETWEEN 0 AND 1, false)) AS outside_l_discount,
  count(DISTINCT l_returnflag) AS values_l_returnflag, count(*) <= 100000000 AND count(*) FILTER (NOT coalesce(l_quantity BETWEEN 1 AND 45, false)) = 0 AND count(*) FILTER (NOT coalesce(l_discount BETWEEN 0 AND 1, false)) = 0 AND count(DISTINCT l_returnflag) <= 3 AS ok FROM lineitem
""")
def input_budget(spark, sf_dir):
    """Rows, ranges and numbers of values against their bounds, before anything is computed from them."""
    return C.within_budget(table(spark, sf_dir, "lineitem"), 100_000_000, {"l_quantity": (1, 45), "l_discount": (0, 1)}, {"l_returnflag": 3})


@query(f"""
WITH {EVENTS}, p AS (SELECT *, lag(us) OVER w AS before_us, lag(event_type) OVER w AS before_clock FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT event_id, CASE WHEN event_type = before_clock THEN us - before_us END AS since FROM p
""")
def clock_differences(spark, sf_dir):
    """Differences of neighbouring times only where both are of one clock."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    since = C.time_difference(F.col("us"), F.col("event_type"), F.lag("us").over(w), F.lag("event_type").over(w), F.lit(None).cast("long"))
    return events(spark, sf_dir).select("event_id", since.alias("since"))


@query("""
WITH c AS (SELECT o_orderkey % 8 AS part, o_orderstatus = 'O' AS clean, CASE o_orderkey % 3 WHEN 0 THEN 'gap' WHEN 1 THEN 'jump' ELSE 'freeze' END AS expected, 'jump' AS prim,
  list_filter([CASE WHEN o_custkey % 2 = 0 THEN 'gap' END, CASE WHEN o_custkey % 5 < 2 THEN 'jump' END, CASE WHEN o_custkey % 7 = 0 THEN 'freeze' END], lambda x: x IS NOT NULL) AS rules,
  greatest(least(o_custkey % 11, abs(o_custkey % 11 - 10)), least(abs(o_orderkey % 13 - 0), abs(o_orderkey % 13 - 10))) AS err FROM orders),
v AS (SELECT *, NOT clean AND list_contains(rules, expected) AS detected, NOT clean AND NOT list_contains(rules, prim) AS absent, clean AND len(rules) > 0 AS alarm FROM c)
SELECT part, count(*) AS cases, round(count(*) FILTER (detected) / CAST(nullif(count(*) FILTER (NOT clean), 0) AS DOUBLE), 9) AS detection_rate, round(count(*) FILTER (alarm) / CAST(nullif(count(*) FILTER (clean), 0) AS DOUBLE), 9) AS false_alarm_rate, max(err) FILTER (detected) AS max_error, count(*) FILTER (absent) AS without_primary FROM v GROUP BY part
""")
def case_figures(spark, sf_dir):
    """Verdicts of detector cases, the error of found ends, and figures of each partition of cases."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rules = F.array_compact(F.array(F.when(c % 2 == 0, "gap"), F.when(c % 5 < 2, "jump"), F.when(c % 7 == 0, "freeze")))
    cases = table(spark, sf_dir, "orders").select((o % 8).alias("part"), (F.col("o_orderstatus") == "O").alias("clean"), F.when(o % 3 == 0, "gap").when(o % 3 == 1, "jump").otherwise("freeze").alias("expected"), F.lit("jump").alias("primary"), rules.alias("rules"), C.boundary_error(F.lit(0), F.lit(10), c % 11, o % 13).alias("err"))
    judged = C.case_verdicts(cases, "expected", "primary", "rules", F.col("clean"))
    figures = C.partition_figures(judged, ["part"], F.col("clean"), "err")
    return figures.join(judged.groupBy("part").agg(F.count_if("primary_absent").alias("without_primary")), "part")
