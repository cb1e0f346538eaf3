"""Whole detectors, built from the windows and islands of this package."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import number_islands, over, reach_islands
from .joins import as_of


@dataclass(frozen=True)
class TrajectoryLimits:
    """Fixed values of the trajectory profile (SI units, nanoseconds)."""

    gap_ns: int = 100_000_000
    jump: float = 1.0
    velocity: float = 0.75
    speed: float = 70.0
    acceleration: float = 15.0
    frozen_observed: float = 0.1
    frozen_source: float = 1.0
    frozen_ns: int = 500_000_000
    adjacency_ns: int = 500_000_000


#: From the most to the least important; the first six are structural.
RULES = ["duplicate", "regression", "gap", "position_jump", "position_freeze", "velocity_residual", "speed_limit", "acceleration_limit"]
CRITICAL = ("duplicate", "regression", "position_jump")


def norm(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def trajectory_failures(samples: DataFrame, sequence: str, limits: TrajectoryLimits = TrajectoryLimits()) -> DataFrame:
    """sequence, rule, start, end, value: every failure between neighbours in source order (idx).

    Content rules are silent in sequences with duplicates or regressions; a gap doesn't silence them, but pairs across one are skipped.
    """
    w = over([sequence], "idx")
    nxt = lambda c: F.lead(c).over(w)
    pairs = samples.select("*", *[nxt(c).alias(f"n_{c}") for c in ("time_ns", "x", "y", "z", "vx", "vy", "vz")]).filter("n_time_ns IS NOT NULL")
    dt = F.col("n_time_ns") - F.col("time_ns")
    broken = F.max(F.when(dt <= 0, 1).otherwise(0)).over(Window.partitionBy(sequence)) == 1
    s = dt / 1e9
    step = [F.col(f"n_{a}") - F.col(a) for a in "xyz"]
    mean = [(F.col(f"v{a}") + F.col(f"n_v{a}")) / 2 for a in "xyz"]
    jump = norm(*[d - m * s for d, m in zip(step, mean)])
    source = F.least(norm(F.col("vx"), F.col("vy"), F.col("vz")), norm(F.col("n_vx"), F.col("n_vy"), F.col("n_vz")))
    speed = norm(*step) / s
    sound = ~F.col("__broken") & (dt > 0) & (dt <= limits.gap_ns)
    rules = {
        "duplicate": (dt == 0, dt.cast("double")),
        "regression": (dt < 0, dt.cast("double")),
        "gap": (dt > limits.gap_ns, dt.cast("double")),
        "position_jump": (sound & (jump > limits.jump), jump),
        "position_freeze": (sound & (speed <= limits.frozen_observed) & (source >= limits.frozen_source), speed),
        "velocity_residual": (sound & (jump / s > limits.velocity * 10), jump / s),
        "speed_limit": (sound & (speed > limits.speed), speed),
        "acceleration_limit": (sound & (norm(*[F.col(f"n_v{a}") - F.col(f"v{a}") for a in "xyz"]) / s > limits.acceleration), norm(*[F.col(f"n_v{a}") - F.col(f"v{a}") for a in "xyz"]) / s),
    }
    found = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(name).alias("rule"), value.alias("value"))) for name, (hit, value) in rules.items()]))
    marked = pairs.withColumn("__broken", broken)
    return marked.select(sequence, "idx", F.least("time_ns", "n_time_ns").alias("start"), F.greatest("time_ns", "n_time_ns").alias("end"), F.inline(found))


def trajectory_events(failures: DataFrame, sequence: str, limits: TrajectoryLimits = TrajectoryLimits()) -> DataFrame:
    """sequence, event, start, end, primary_rule, severity, n, worst: freezes that last long enough, and all other failures, merged."""
    frozen = failures.filter("rule = 'position_freeze'")
    runs = reach_islands(frozen, [sequence], "start", "end", "idx", 0).groupBy(sequence, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("idx").alias("idx"), F.min("value").alias("value"))
    long = runs.filter(F.col("end") - F.col("start") >= limits.frozen_ns).select(sequence, "idx", "start", "end", F.lit("position_freeze").alias("rule"), "value")
    rank = F.array_position(F.array(*map(F.lit, RULES)), F.col("rule"))
    rows = failures.filter("rule != 'position_freeze'").unionByName(long).withColumn("rank", rank)
    merged = reach_islands(rows, [sequence], "start", "end", "rank", limits.adjacency_ns, "event")
    severity = F.when(F.bool_or(F.col("rule").isin(*CRITICAL)), "CRITICAL").otherwise("WARNING")
    return merged.groupBy(sequence, "event").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.element_at(F.array(*map(F.lit, RULES)), F.min("rank").cast("int")).alias("primary_rule"), severity.alias("severity"), F.count("*").alias("n"), F.max(F.abs("value")).alias("worst"))


def frame_metrics(points: DataFrame, keys: list[str], frame: str, valid: Column, ring: str, azimuth_bin: str, time: str) -> DataFrame:
    """keys, frame, n, valid, rings, sectors, span, density: the last is the count over the largest of earlier frames (1 for the first)."""
    per = points.groupBy(*keys, frame).agg(F.count("*").alias("n"), F.count_if(valid).alias("valid"), F.count_distinct(F.when(valid, F.col(ring))).alias("rings"), F.count_distinct(F.when(valid, F.col(azimuth_bin))).alias("sectors"), (F.max(time) - F.min(time)).alias("span"))
    before = F.max("n").over(over(keys, frame).rowsBetween(Window.unboundedPreceding, -1))
    return per.withColumn("density", F.coalesce(F.col("n") / before, F.lit(1.0)))


def frame_rule_events(metrics: DataFrame, keys: list[str], frame: str, rules: dict[str, Column], least_frames: int) -> DataFrame:
    """keys, rule, first_frame, last_frame, frames: runs of frames (in their own order) that fail a rule, of `least_frames` or more."""
    placed = metrics.withColumn("__i", F.row_number().over(over(keys, frame)))
    failed = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in rules.items()]))
    rows = placed.select(*keys, frame, "__i", F.explode(failed).alias("rule"))
    by = [*keys, "rule"]
    runs = number_islands(rows.withColumn("__p", F.lag("__i").over(over(by, "__i"))), by, ["__i"], F.col("__i") > F.col("__p") + 1)
    return runs.groupBy(*by, "island").agg(F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.count("*").alias("frames")).filter(F.col("frames") >= least_frames).drop("island")


def capped_findings(findings: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """The first `cap` findings of each group, and a marker with the number of the others where there are more; the marker's order is the first left out."""
    w = over(keys, *order)
    rows = findings.withColumn("__rn", F.row_number().over(w)).withColumn("left_out", F.greatest(F.count("*").over(Window.partitionBy(*keys)) - cap, F.lit(0)))
    marker = F.col("__rn") == cap + 1
    return rows.filter(F.col("__rn") <= cap + 1).withColumn("overflow", marker).withColumn("left_out", F.when(marker, F.col("left_out")).otherwise(0)).drop("__rn")


def compensated(points: DataFrame, poses: DataFrame, sequence: str, frame: str) -> DataFrame:
    """points with wx, wy: where they lie in the world, by the pose (px, py, heading) between the samples around each point's time.

    Points outside the poses' time get nulls, never a guess; headings turn the shorter way.
    """
    near = as_of(points, poses.select(sequence, "time_ns", "px", "py", "heading"), [sequence], "time_ns", ["px", "py", "heading"])
    t0, t1 = F.col("before_time_ns"), F.col("after_time_ns")
    share = F.when(t1 == t0, F.lit(0.0)).otherwise((F.col("time_ns") - t0) / (t1 - t0).cast("double"))
    mixed = lambda n: F.col(f"before_{n}") + share * (F.col(f"after_{n}") - F.col(f"before_{n}"))
    turn = F.pmod(F.col("after_heading") - F.col("before_heading") + math.pi, F.lit(2 * math.pi)) - math.pi
    posed = near.withColumns({"__x": mixed("px"), "__y": mixed("py"), "__h": F.col("before_heading") + share * turn})
    c, s = F.cos("__h"), F.sin("__h")
    placed = posed.withColumns({"wx": F.col("__x") + c * F.col("sx") - s * F.col("sy"), "wy": F.col("__y") + s * F.col("sx") + c * F.col("sy")})
    return placed.drop("__x", "__y", "__h", *[f"{w}_{n}" for w in ("before", "after") for n in ("time_ns", "px", "py", "heading")])


def alignment_verdicts(points: DataFrame, sequence: str, frame: str, size: float, least_cells: int, least_jaccard: float) -> DataFrame:
    """sequence, frame, jaccard, verdict of each frame against the one before; a frame with any unplaced point is unknown."""
    clear = points.groupBy(sequence, frame).agg(F.bool_and(F.col("wx").isNotNull() & F.col("wy").isNotNull()).alias("__clear"))
    cells = points.filter("wx IS NOT NULL AND wy IS NOT NULL").select(sequence, frame, F.floor(F.col("wx") / size).alias("i"), F.floor(F.col("wy") / size).alias("j")).distinct()
    count = cells.groupBy(sequence, frame).agg(F.count("*").alias("n"))
    before = count.select(sequence, (F.col(frame) + 1).alias(frame), F.col("n").alias("n_before"))
    shared = cells.join(cells.withColumn(frame, F.col(frame) + 1), [sequence, frame, "i", "j"]).groupBy(sequence, frame).agg(F.count("*").alias("shared"))
    known = clear.join(clear.select(sequence, (F.col(frame) + 1).alias(frame), F.col("__clear").alias("__before")), [sequence, frame])
    both = known.join(count, [sequence, frame], "left").join(before, [sequence, frame], "left").join(shared, [sequence, frame], "left")
    jaccard = F.coalesce("shared", F.lit(0)) / (F.col("n") + F.col("n_before") - F.coalesce("shared", F.lit(0))).cast("double")
    sure = F.col("__clear") & F.col("__before") & (F.least("n", "n_before") >= least_cells)
    verdict = F.when(~F.coalesce(sure, F.lit(False)), "UNKNOWN").when(jaccard >= least_jaccard, "PASS").otherwise("FAIL")
    return both.select(sequence, frame, F.round(jaccard, 6).alias("jaccard"), verdict.alias("verdict"))
