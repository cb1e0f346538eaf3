"""Scoring of decoded routes by reviewers' decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Decisions that name no arc and must not be forced to one.
OPEN_LABELS = ["AMBIGUOUS", "OFF_MAP", "GRAPH_DATA_LIMITATION", "UNRESOLVED"]


def half_distances(points: DataFrame, keys: list[str], order: list[str], axes: list[str], speed: str, slow: float) -> DataFrame:
    """points with `weight`: half of the way to either neighbour, of ways between points that both move at `slow` or faster."""
    w = Window.partitionBy(*keys).orderBy(*order)

    def way(step):
        apart = F.sqrt(reduce(lambda x, y: x + y, [(step(a) - F.col(a)) * (step(a) - F.col(a)) for a in axes]))
        return F.coalesce(F.when((F.col(speed) >= slow) & (step(speed) >= slow), apart / 2), F.lit(0.0))

    return points.withColumn("weight", way(lambda c: F.lag(c).over(w)) + way(lambda c: F.lead(c).over(w)))


def adjudicated(points: DataFrame, decisions: DataFrame, keys: list[str], obs: str, least_share: float) -> DataFrame:
    """keys, distance, confident, manual, agreement, n_agree, n_off_map, open_distance, preserved, accepted, by route.

    points: keys, obs, weight, on_road, arc, confident, stationary; decisions: keys, obs, label, expected. Confident is the distance at which the decoder, sure of itself
    and moving, names the arc that the reviewer named; manual the distance at which the reviewer named any. Agreement is their ratio (0 where manual is 0).
    Points without a decision count for the distance only. A route is accepted if the confident share of its distance reaches least_share and no open decision names an arc.
    A null flag counts as false.
    """
    both = points.join(decisions, [*keys, obs], "left")
    sure = F.coalesce(F.col("confident") & ~F.col("stationary"), F.lit(False))
    named, open_ = F.coalesce(F.col("label") == "DIRECTED_ARC", F.lit(False)), F.coalesce(F.col("label").isin(*OPEN_LABELS), F.lit(False))
    agrees = named & sure & F.coalesce(F.col("on_road") & (F.col("arc") == F.col("expected")), F.lit(False))
    off = sure & F.coalesce((F.col("label") == "OFF_MAP") & ~F.col("on_road"), F.lit(False))
    total = lambda c: F.sum(F.when(c, F.col("weight")).otherwise(0.0))
    sums = both.groupBy(*keys).agg(F.sum("weight").alias("distance"), total(agrees).alias("confident"), total(named).alias("manual"), F.count_if(agrees).alias("n_agree"), F.count_if(off).alias("n_off_map"), total(open_).alias("open_distance"), (F.count_if(open_ & F.col("expected").isNotNull()) == 0).alias("preserved"))
    share = F.when(F.col("distance") > 0, F.col("confident") / F.col("distance")).otherwise(0.0)
    return sums.withColumn("agreement", F.when(F.col("manual") > 0, F.col("confident") / F.col("manual")).otherwise(0.0)).withColumn("accepted", F.col("preserved") & (share >= least_share))
