"""Histograms, grids and circles: aggregation over fixed cells, and joins that meet in cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import kept


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size)


def bin_index(value: Column, low: float, high: float, bins: int) -> Column:
    """The value's bin; -1 below the range, `bins` at its end or above."""
    inside = F.floor((value - low) / ((high - low) / bins))
    return F.when(value < low, -1).when(value >= high, bins).otherwise(F.least(inside, F.lit(bins - 1)))


def histogram(df: DataFrame, keys: list[str], value: Column, low: float, high: float, bins: int) -> DataFrame:
    return df.groupBy(*keys, bin_index(value, low, high, bins).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def histogram_quantiles(hist: DataFrame, keys: list[str], low: float, high: float, bins: int, shares: list[float]) -> DataFrame:
    """keys, share, quantile: the middle of the first bin at which the count reaches max(1, ceil(share * n)); values out of range count as none."""
    inside = hist.filter((F.col("bin") >= 0) & (F.col("bin") < bins))
    w = Window.partitionBy(*keys)
    running = inside.withColumn("cum", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    asked = running.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).filter(F.col("cum") >= F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("total"))))
    width = (high - low) / bins
    return asked.groupBy(*keys, "share").agg((F.lit(low) + (F.min("bin") + 0.5) * width).alias("quantile"))


def widest_empty_arc(df: DataFrame, keys: list[str], sector: str, sectors: int) -> DataFrame:
    """keys, empty: the longest run of sectors of a circle without rows (all of them if `sector` is always null)."""
    seen = df.groupBy(*keys, sector).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(sector)
    occupied = seen.filter(F.col(sector).isNotNull())
    first = F.first(sector).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    gaps = occupied.withColumn("gap", F.coalesce(F.lead(sector).over(w), first + sectors) - F.col(sector) - 1)
    return seen.select(*keys).distinct().join(gaps.groupBy(*keys).agg(F.max("gap").alias("empty")), keys, "left").withColumn("empty", F.coalesce("empty", F.lit(sectors)))


def voxels(df: DataFrame, frame: list[str], axes: list[str], size: float) -> DataFrame:
    """frame, i0, i1, ... and the mergeable sums of each cell: n, s<axis>, q<axis> (squares)."""
    cells = [cell(F.col(a), size).alias(f"i{k}") for k, a in enumerate(axes)]
    sums = [x for a in axes for x in (F.sum(a).alias(f"s_{a}"), F.sum(F.col(a) * F.col(a)).alias(f"q_{a}"))]
    return df.groupBy(*frame, *cells).agg(F.count("*").alias("n"), *sums)


def thickness(axes: list[str]) -> Column:
    """Root of the summed variances of a cell, each at least 0."""
    variance = [F.greatest(F.col(f"q_{a}") / F.col("n") - (F.col(f"s_{a}") / F.col("n")) * (F.col(f"s_{a}") / F.col("n")), F.lit(0.0)) for a in axes]
    return F.sqrt(reduce(lambda x, y: x + y, variance))


def frame_overlap(cells: DataFrame, frame: str, index: list[str]) -> DataFrame:
    """frame, n_before, n_now, shared: cells of each frame and of the frame before it (by number), and those in both."""
    now = cells.select(frame, *index)
    before = now.withColumn(frame, F.col(frame) + 1)
    shared = now.join(before, [frame, *index]).groupBy(frame).agg(F.count("*").alias("shared"))
    count = now.groupBy(frame).agg(F.count("*").alias("n_now"))
    previous = count.select((F.col(frame) + 1).alias(frame), F.col("n_now").alias("n_before"))
    return count.join(previous, frame).join(shared, frame, "left").withColumn("shared", F.coalesce("shared", F.lit(0)))


def around(index: list[str], reach: int = 1) -> Column:
    """An array of structs of the cells within `reach` of a row's own."""
    from itertools import product

    return F.array(*[F.struct(*[(F.col(c) + d).alias(c) for c, d in zip(index, step)]) for step in product(range(-reach, reach + 1), repeat=len(index))])


def radius_join(a: DataFrame, b: DataFrame, a_at: list[str], b_at: list[str], radius: float, alike: list[str] | None = None) -> DataFrame:
    """Pairs within the radius, with their squared distance d2, whose columns `alike` are equal. Both sides meet in cells as wide as the radius; other columns' names must differ."""
    index = [f"__i{k}" for k in range(len(a_at))]
    place = lambda df, at: df.withColumns({i: cell(F.col(c), radius) for i, c in zip(index, at)})
    left = place(a, a_at).withColumn("__c", F.explode(around(index))).drop(*index).select("*", "__c.*").drop("__c")
    d2 = reduce(lambda x, y: x + y, [(F.col(p) - F.col(q)) * (F.col(p) - F.col(q)) for p, q in zip(a_at, b_at)])
    return left.join(place(b, b_at), [*(alike or []), *index]).withColumn("d2", d2).filter(F.col("d2") <= radius * radius).drop(*index)


def frame_residuals(points: DataFrame, frame: str, key: str, axes: list[str], reach: float, rings: int = 3) -> DataFrame:
    """frame, forward, backward, residual, n: for each frame (by number) and the one before it, the mean distance of its points to their nearest in the one before, of those
    to their nearest in it, and the mean of both. A point with none within `reach` counts as that far. key must be unique.

    Points look in cells of their own width first; those that find none go on to cells twice as wide, so dense places are not joined at full reach.
    """
    frames = points.select(F.col(frame).alias("__other")).distinct()
    place = F.struct(*[F.col(a).cast("double").alias(a) for a in axes]).alias("__at")
    own = points.select(F.col(key).alias("__key"), F.col(frame).alias("__frame"), place)
    left = own.withColumn("__other", F.explode(F.array(F.col("__frame") - 1, F.col("__frame") + 1))).join(frames, "__other", "left_semi")
    asked, found = left, None
    index = [f"__i{i}" for i in range(len(axes))]
    for i in reversed(range(rings)):
        width = reach / 2**i
        cells = lambda df: df.withColumns({n: cell(F.col(f"__at.{a}"), width) for n, a in zip(index, axes)})  # noqa: B023, E731
        near = cells(left).withColumn("__c", F.explode(around(index))).drop(*index).select("*", "__c.*").drop("__c")
        there = cells(own).select(F.col("__frame").alias("__other"), F.col("__at").alias("__to"), *index)
        d2 = reduce(lambda x, y: x + y, [(F.col(f"__at.{a}") - F.col(f"__to.{a}")) * (F.col(f"__at.{a}") - F.col(f"__to.{a}")) for a in axes])
        best = near.join(there, ["__other", *index]).withColumn("__d2", d2).filter(F.col("__d2") <= width * width).groupBy("__key", "__other").agg(F.sqrt(F.min("__d2")).alias("__d"))
        best = kept(best)
        found = best if found is None else found.union(best)
        left = left.join(best, ["__key", "__other"], "left_anti")
    whole = asked.join(found, ["__key", "__other"], "left").select("__frame", "__other", F.coalesce("__d", F.lit(reach)).alias("__d"))
    ahead = F.col("__other") < F.col("__frame")
    sides = whole.groupBy(F.greatest("__frame", "__other").alias(frame)).agg(F.avg(F.when(ahead, F.col("__d"))).alias("forward"), F.avg(F.when(~ahead, F.col("__d"))).alias("backward"), F.count("*").alias("n"))
    return sides.withColumn("residual", (F.col("forward") + F.col("backward")) / 2)
