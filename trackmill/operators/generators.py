"""Made-up trajectories and faults, for drills of the detectors: everything is an expression over ids, so any size can be made."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The scenarios, by their number.
SCENARIOS = ["straight", "constant_radius_turn", "stop_start", "parallel_roads", "ramp", "overpass", "off_map_connection", "stationary"]
STEP_NS = 100_000_000
SPEED = 10.0


def trajectories(sequences: DataFrame, sequence: str, samples: int) -> DataFrame:
    """sequence, scenario, idx, time_ns, x, y, z and velocities of `samples` samples at 10 Hz for each sequence."""
    rows = sequences.select(sequence, F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("idx"))
    kind = F.element_at(F.array(*map(F.lit, SCENARIOS)), (F.pmod(F.col(sequence), F.lit(len(SCENARIOS))) + 1).cast("int"))
    t = F.col("idx") * (STEP_NS / 1e9)
    named = rows.select(sequence, kind.alias("scenario"), "idx", (F.col("idx").cast("long") * STEP_NS).alias("time_ns"), t.alias("__t"))
    is_ = lambda *names: F.col("scenario").isin(*names)
    s, zero = F.col("__t"), F.lit(0.0)
    turn = 0.1  # rad/s
    moving = F.least(s, F.lit(5.0)) + F.greatest(s - 10.0, F.lit(0.0))  # a stop from 5 s to 10 s
    x = F.when(is_("constant_radius_turn"), SPEED / turn * F.sin(turn * s)).when(is_("stop_start"), SPEED * moving).when(is_("stationary"), zero).otherwise(SPEED * s)
    y = F.when(is_("constant_radius_turn"), SPEED / turn * (1 - F.cos(turn * s))).when(is_("parallel_roads"), F.lit(4.0)).when(is_("off_map_connection"), 0.02 * s * s).otherwise(zero)
    z = F.when(is_("ramp"), 0.5 * s).when(is_("overpass"), F.lit(6.0)).otherwise(zero)
    going = F.when((s >= 5.0) & (s < 10.0), zero).otherwise(F.lit(SPEED))
    vx = F.when(is_("constant_radius_turn"), SPEED * F.cos(turn * s)).when(is_("stop_start"), going).when(is_("stationary"), zero).otherwise(F.lit(SPEED))
    vy = F.when(is_("constant_radius_turn"), SPEED * F.sin(turn * s)).when(is_("off_map_connection"), 0.04 * s).otherwise(zero)
    vz = F.when(is_("ramp"), F.lit(0.5)).otherwise(zero)
    return named.select(sequence, "scenario", "idx", "time_ns", x.alias("x"), y.alias("y"), z.alias("z"), vx.alias("vx"), vy.alias("vy"), vz.alias("vz"))


def _from(first: int, last: int | None = None) -> Column:
    return (F.col("idx") >= first) if last is None else F.col("idx").between(first, last - 1)


def time_shift(df: DataFrame, where: Column, first: int, ns: int) -> DataFrame:
    """Times from one sample on are shifted."""
    return df.withColumn("time_ns", F.when(where & _from(first), F.col("time_ns") + ns).otherwise(F.col("time_ns")))


def position_jump(df: DataFrame, where: Column, at: int, metres: float) -> DataFrame:
    """One sample lies aside."""
    return df.withColumn("y", F.when(where & (F.col("idx") == at), F.col("y") + metres).otherwise(F.col("y")))


def position_bias(df: DataFrame, where: Column, first: int, last: int, metres: float) -> DataFrame:
    return df.withColumn("y", F.when(where & _from(first, last), F.col("y") + metres).otherwise(F.col("y")))


def position_drift(df: DataFrame, where: Column, first: int, count: int, metres: float) -> DataFrame:
    """A ramp of `metres` over `count` samples, which goes on beyond them to the end."""
    ramp = (F.col("idx") - first + 1) / float(count) * metres
    return df.withColumn("y", F.when(where & _from(first), F.col("y") + ramp).otherwise(F.col("y")))


def position_freeze(df: DataFrame, sequence: str, where: Column, first: int, last: int) -> DataFrame:
    """Positions stay at the first one of a range, while velocities go on."""
    from pyspark.sql import Window

    w = Window.partitionBy(sequence).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    held = {a: F.when(where & _from(first, last), F.last(F.when(F.col("idx") <= first, F.col(a)), True).over(w)).otherwise(F.col(a)) for a in ("x", "y", "z")}
    return df.withColumns(held)


def ring_loss(points: DataFrame, ring: str, where: Column, seed: int, rings: list[int], n: int) -> DataFrame:
    """Points without those of n rings, chosen by hash of seed and ring; the model's rings are a short list."""
    order = sorted(rings, key=lambda r: hashlib.sha256(f"{seed}:{r}".encode()).hexdigest())
    return points.filter(~(where & F.col(ring).isin(*order[:n])))


def sector_loss(points: DataFrame, azimuth: Column, where: Column, start: float, width: float, turn: float) -> DataFrame:
    return points.filter(~(where & (F.pmod(azimuth - start, F.lit(turn)) < width)))


def density_loss(points: DataFrame, keys: list[str], row: str, where: Column, share: float, seed: int) -> DataFrame:
    """Of each group only the share of rows with the smallest hashes stays (the whole group where the fault doesn't apply)."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed).cast("string"), *[F.col(k).cast("string") for k in (*keys, row)]), 256), 1, 12), 16, 10).cast("long") % 1_000_000
    return points.filter(~where | (h < int(share * 1_000_000)))


def point_time_shift(points: DataFrame, where: Column, time: str, ns: int) -> DataFrame:
    return points.withColumn(time, F.when(where, F.col(time) + ns).otherwise(F.col(time)))


def yaw_perturbation(points: DataFrame, where: Column, x: str, y: str, radians: float) -> DataFrame:
    """Points as a sensor gives them whose mounting is turned about the vertical."""
    c, s = math.cos(radians), math.sin(radians)
    turned = {x: c * F.col(x) - s * F.col(y), y: s * F.col(x) + c * F.col(y)}
    return points.withColumns({n: F.when(where, v).otherwise(F.col(n)) for n, v in turned.items()})


def range_scale(points: DataFrame, where: Column, axes: list[str], factor: float) -> DataFrame:
    return points.withColumns({a: F.when(where, F.col(a) * factor).otherwise(F.col(a)) for a in axes})


def not_finite(points: DataFrame, where: Column, axis: str) -> DataFrame:
    return points.withColumn(axis, F.when(where, F.lit(float("nan"))).otherwise(F.col(axis)))


def ray_cast(rays: DataFrame, landmarks: DataFrame, keys: list[str], most: float, size: float) -> DataFrame:
    """keys, distance, landmark: the nearest hit of rays (ox, oy, dx, dy: a unit direction) on round landmarks (lx, ly, radius, landmark).

    Rays and landmarks meet in square cells: a landmark of a radius of at most half a cell that a ray hits lies in a cell next to one of
    the ray's points, which are a cell apart.
    """
    steps = F.sequence(F.lit(0), F.lit(math.ceil(most / size)))
    near = F.flatten(F.transform(steps, lambda k: F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.struct((F.floor((F.col("ox") + k * size * F.col("dx")) / size) + F.floor(i / 3) - 1).alias("i"), (F.floor((F.col("oy") + k * size * F.col("dy")) / size) + i % 3 - 1).alias("j")))))
    met = rays.select("*", F.inline(F.array_distinct(near))).join(landmarks.withColumns({"i": F.floor(F.col("lx") / size), "j": F.floor(F.col("ly") / size)}), ["i", "j"])
    fx, fy = F.col("ox") - F.col("lx"), F.col("oy") - F.col("ly")
    b = fx * F.col("dx") + fy * F.col("dy")
    inside = b * b - (fx * fx + fy * fy - F.col("radius") * F.col("radius"))
    hits = met.withColumn("distance", F.when(inside >= 0, -b - F.sqrt(F.greatest(inside, F.lit(0.0))))).filter((F.col("distance") > 0) & (F.col("distance") <= most))
    return hits.groupBy(*keys).agg(F.min(F.struct("distance", "landmark")).alias("h")).select(*keys, "h.distance", "h.landmark")


def differences(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, before, after, change (modified, removed, added) of every cell that differs; values as text."""
    fields = [c for c in before.columns if c not in keys]
    cells = lambda df, n: df.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(n)) for c in fields])))
    a, b = cells(before, "before").withColumn("__a", F.lit(True)), cells(after, "after").withColumn("__b", F.lit(True))
    both = a.join(b, [*keys, "field"], "full_outer")
    change = F.when(F.col("__b").isNull(), "removed").when(F.col("__a").isNull(), "added").when(~F.col("before").eqNullSafe(F.col("after")), "modified")
    return both.withColumn("change", change).filter("change IS NOT NULL").drop("__a", "__b")
