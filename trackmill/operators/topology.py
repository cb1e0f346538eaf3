"""Mining of road-graph faults from stretches that passes drove off the map: which are fit, how they cluster, and what the graph lacks there.

A chain of DataFrame steps: intervals are judged by the first rule they fail; the fit ones are resampled; those that run alike are clustered;
each cluster that enough independent traversals drove is a corridor, whose ends snap to the nearest graph nodes; a corridor between two nodes that no arc
joins is a missing connection, one whose best arc lies too far from it a disagreement of geometry.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import first_failing
from . import graphs, grids
from . import polylines as P
from .state import kept, spread, stored


@dataclass(frozen=True)
class Limits:
    """Least quality and length of an interval, points of a resampled one, what lets two run alike (headings in radians, distances of
    ends and of corresponding points in the mean), independent traversals, reach of snapping, and the distance at which geometry disagrees."""

    quality: float = 0.5
    length: float = 100.0
    samples: int = 21
    heading: float = 0.5
    ends: float = 40.0
    mean: float = 15.0
    traversals: int = 3
    snap: float = 50.0
    geometry: float = 25.0
    tolerance: float = 0.5


AXES = ["x", "y"]


def judged(intervals: DataFrame, parts: DataFrame, limits: Limits) -> DataFrame:
    """intervals with `reason`, the first rule that each fails (null: none).

    intervals: interval, off_map, observable, directed, stationary, quality; parts: the segments of their points by interval. A null flag counts
    as false (of stationary: too), a null quality as 0. Intervals of fewer than two points are short.
    """
    shape = parts.groupBy("interval").agg(F.sum("length").alias("length"), F.min_by(F.struct("x0", "y0"), "nth").alias("first"), F.max_by(F.struct("x1", "y1"), "nth").alias("last"))
    span = F.sqrt((F.col("last.x1") - F.col("first.x0")) * (F.col("last.x1") - F.col("first.x0")) + (F.col("last.y1") - F.col("first.y0")) * (F.col("last.y1") - F.col("first.y0")))
    false = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    rules = [
        ("not_off_map", false("off_map")),
        ("unobservable", false("observable")),
        ("direction", false("directed")),
        ("stationary", F.coalesce("stationary", F.lit(False))),
        ("quality", F.coalesce("quality", F.lit(0.0)) < limits.quality),
        ("short", F.coalesce("length", F.lit(0.0)) < limits.length),
        ("no_span", ~(F.coalesce(span, F.lit(0.0)) > limits.tolerance)),
    ]
    return intervals.join(shape, "interval", "left").withColumn("reason", first_failing(rules)).drop("first", "last", "length")


#: Intervals that Python clusters in one call, blocks of them as a whole.
TOGETHER = 4096


def lines(samples: DataFrame, limits: Limits) -> DataFrame:
    """interval, xs, ys (the points of a resampled interval in order of k) and the cells of its ends, i0 to i3, as a stored table."""
    made = samples.groupBy("interval").agg(F.sort_array(F.collect_list(F.struct("k", "x", "y"))).alias("p"))  # `samples` points each
    made = made.select("interval", F.transform("p", lambda q: q["x"]).alias("xs"), F.transform("p", lambda q: q["y"]).alias("ys"))
    ends = [F.element_at(c, i) for i in (1, -1) for c in ("xs", "ys")]
    return stored(made.withColumns({f"i{i}": grids.cell(e, limits.ends) for i, e in enumerate(ends)}))


def clustered(samples: DataFrame, limits: Limits) -> DataFrame:
    """interval, cluster: greedy complete-link clusters of resampled intervals (interval, k, x, y). Intervals are taken in ascending order and join
    the first cluster with all of whose members they run alike, else found one, which is named by them.

    Intervals that run alike have their starts, and their ends, in neighbouring cells as wide as `ends`. So the cells (start and end together)
    that hold intervals are linked with their neighbours, and each connected part of them is clustered by itself: cells are as many as the places,
    not as the passes, and no pairs of intervals are made. One part is one task, as its order decides; it holds `samples` points for each pass.
    """
    kind = samples.schema["interval"].dataType.simpleString()

    def named(rows: pd.DataFrame) -> pd.DataFrame:
        of, _, _ = _groups(rows, limits)
        names = rows["interval"].to_numpy()
        return pd.DataFrame({"interval": names, "cluster": names[of]})

    return _by_block(lines(samples, limits), limits, named, f"interval {kind}, cluster {kind}")


def clustered_corridors(samples: DataFrame, traversals: DataFrame, limits: Limits) -> DataFrame:
    """What corridors() gives for clustered() samples, where `traversals` different ones or more drove a cluster. traversals: interval, traversal, a row for each interval.

    A cluster's median is taken where it is made, so neither samples nor clusters are shuffled again.
    """
    kind, n = samples.schema["interval"].dataType.simpleString(), limits.samples

    def medians(rows: pd.DataFrame) -> pd.DataFrame:
        of, x, y = _groups(rows, limits)
        names, drove, made = rows["interval"].to_numpy(), rows["traversal"], []
        for first in np.unique(of):
            own = (of == first).nonzero()[0]
            different = drove.iloc[own].nunique()
            if different >= limits.traversals:
                made.append(pd.DataFrame({"cluster": names[first], "k": np.arange(n), "x": np.median(x[own], axis=0), "y": np.median(y[own], axis=0), "n_intervals": len(own), "n_traversals": different}))
        return pd.concat(made) if made else pd.DataFrame(columns=["cluster", "k", "x", "y", "n_intervals", "n_traversals"])

    made = lines(samples, limits).join(traversals, "interval")
    return _by_block(made, limits, medians, f"cluster {kind}, k int, x double, y double, n_intervals long, n_traversals long")


def _by_block(made: DataFrame, limits: Limits, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What run() gives for each connected part of the cells of lines(), its rows in order of their intervals. Python is called for some parts at a time, since most are small."""
    index = [f"i{i}" for i in range(4)]
    own = made.withColumn("cell", F.xxhash64(*index))
    cells = own.select(*index, "cell").distinct()
    near = cells.select(F.col("cell").alias("a"), F.explode(grids.around(index)).alias("c")).select("a", "c.*")
    links = kept(near.join(cells.withColumnRenamed("cell", "b"), index).filter("a < b").select("a", "b").distinct())
    calls = made.count() // TOGETHER + 1
    blocks = own.drop(*index).join(graphs.components(links).withColumnRenamed("node", "cell"), "cell", "left").withColumn("block", F.coalesce("component", "cell")).drop("cell", "component")

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "interval"], kind="stable").reset_index(drop=True)
        block = rows["block"].to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(rows)]
        made = [run(rows.iloc[a:b]) for a, b in zip(cuts, cuts[1:])]
        return pd.concat([m for m in made if len(m)] or made[:1])

    dealt = blocks.withColumn("call", F.pmod(F.xxhash64("block"), F.lit(calls)))
    # as many parts as there are calls, up to what keeps a part small
    return spread(dealt, calls * TOGETHER, "call").groupBy("call").applyInPandas(lambda rows: each(rows.drop(columns="call")), schema)


def _groups(rows: pd.DataFrame, limits: Limits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a block, in order of intervals: the row that founded its cluster, and its points."""
    x, y = np.stack(rows["xs"].to_list()), np.stack(rows["ys"].to_list())
    heading = np.arctan2(y[:, -1] - y[:, 0], x[:, -1] - x[:, 0])
    of = np.zeros(len(rows), int)
    founders: list[int] = []
    for i in range(len(rows)):
        turn = np.abs(np.remainder(heading[:i] - heading[i] + math.pi, 2 * math.pi) - math.pi)
        near = (turn <= limits.heading).nonzero()[0]
        apart = np.hypot(x[near] - x[i], y[near] - y[i])
        alike = np.zeros(i, bool)
        alike[near] = (apart[:, 0] <= limits.ends) & (apart[:, -1] <= limits.ends) & (apart.mean(axis=1) <= limits.mean)
        strange = np.bincount(of[:i][~alike], minlength=len(founders))
        home = (strange == 0).nonzero()[0]
        of[i] = home[0] if len(home) else len(founders)
        if not len(home):
            founders.append(i)
    return np.array(founders, int)[of], x, y


def nearest(points: DataFrame, key: str, at: list[str], nodes: DataFrame, node: str, node_at: list[str], radius: float, rings: int = 3) -> DataFrame:
    """points with `node` and `apart`: the nearest node within the radius, of equal ones the one of least id; both null if there is none.

    Cells grow: the nodes within the smallest ring are looked at first, and only points that have none go on to one of twice the width, so a
    crowd of nodes around a point is never joined with it at the full radius. key must be unique.
    """
    left, found = points, None
    for i in reversed(range(rings)):
        reach = radius / 2**i
        met = grids.radius_join(left.select(F.col(key).alias("__key"), *[F.col(a).alias(f"__p{j}") for j, a in enumerate(at)]), nodes.select(F.col(node).alias("__node"), *[F.col(a).alias(f"__n{j}") for j, a in enumerate(node_at)]), [f"__p{j}" for j in range(len(at))], [f"__n{j}" for j in range(len(at))], reach)
        best = kept(met.groupBy("__key").agg(F.min(F.struct(F.sqrt("d2").alias("apart"), F.col("__node").alias("node"))).alias("b")).select("__key", "b.node", "b.apart"))
        found = best if found is None else found.union(best)
        left = left.join(best, F.col(key) == F.col("__key"), "left_anti")
    return points.join(found, F.col(key) == F.col("__key"), "left").drop("__key")


def corridors(samples: DataFrame, clusters: DataFrame, traversals: DataFrame) -> DataFrame:
    """cluster, k, x, y, n_intervals, n_traversals: the coordinate-wise median of each cluster's intervals. traversals: interval, traversal."""
    members = clusters.join(traversals, "interval")
    count = members.groupBy("cluster").agg(F.count("*").alias("n_intervals"), F.count_distinct("traversal").alias("n_traversals"))
    return P.corridor(samples.join(clusters, "interval"), ["cluster"], AXES).drop("n").join(count, "cluster")


def hypotheses(lines: DataFrame, nodes: DataFrame, arcs: DataFrame, vertices: DataFrame, limits: Limits) -> DataFrame:
    """cluster, kind, from_node, to_node, arc, end_error, mean_error, n_intervals, n_traversals: what the graph lacks under the corridors.

    lines: as corridors() gives them; nodes: node, x, y; arcs: arc, from_node, to_node; vertices: arc, pos, x, y. Of several arcs between the nodes the
    nearest counts, of equally near ones that of least id. Only arcs between nodes that a corridor joins are resampled.
    """
    last, lines = limits.samples - 1, stored(lines)  # read by several steps
    ends = lines.filter((F.col("n_traversals") >= limits.traversals) & F.col("k").isin(0, last)).select("cluster", "n_intervals", "n_traversals", "k", F.struct("cluster", "k").alias("end"), *AXES)
    snapped = nearest(ends, "end", AXES, nodes, "node", AXES, limits.snap)
    is_first = F.col("k") == 0
    pick = lambda c, t: F.max(F.when(t, F.col(c)))
    asked = snapped.groupBy("cluster", "n_intervals", "n_traversals").agg(pick("node", is_first).alias("from_node"), pick("node", ~is_first).alias("to_node"), F.max("apart").alias("end_error"), F.count("node").alias("__n"))
    asked = kept(asked.filter("__n = 2 AND from_node != to_node").drop("__n"))
    direct = asked.select("cluster", "from_node", "to_node").join(arcs, ["from_node", "to_node"])
    shapes = P.resample(P.segments(vertices.join(direct.select("arc").distinct(), "arc"), ["arc"], "pos", AXES), ["arc"], AXES, limits.samples)
    own = shapes.select("arc", "k", F.col("x").alias("ax"), F.col("y").alias("ay")).join(direct.select("cluster", "arc"), "arc").join(lines.select("cluster", "k", *AXES), ["cluster", "k"])
    apart = F.sqrt((F.col("x") - F.col("ax")) * (F.col("x") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("y") - F.col("ay")))
    best = own.groupBy("cluster", "arc").agg(F.avg(apart).alias("mean_error")).groupBy("cluster").agg(F.min(F.struct("mean_error", "arc")).alias("b")).select("cluster", "b.arc", "b.mean_error")
    kind: Column = F.when(F.col("arc").isNull(), "missing_connection").when(F.col("mean_error") > limits.geometry, "geometry_disagreement")
    return asked.join(best, "cluster", "left").withColumn("kind", kind).filter("kind IS NOT NULL").select("cluster", "kind", "from_node", "to_node", "arc", "end_error", "mean_error", "n_intervals", "n_traversals")

