"""A trajectory between its samples: support at any time, a robust local fit with derivatives, and where it stands still.

Samples are rows of a sequence with a time in nanoseconds; gaps above a limit cut it into segments, within which alone is it known. At a supported time a cubic is
fitted to the WINDOW samples around it, all axes at once: weights follow from one norm of the residuals over all axes, whose scale is the median of their distances from
their median, and are renewed until they no longer change.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .state import spread

HALF_WINDOW, DEGREE, HUBER, ITERATIONS, TOLERANCE, MAD = 4, 3, 1.5, 12, 1e-12, 1.4826
WINDOW = 2 * HALF_WINDOW + 1
#: Samples that Python fits in one call.
TOGETHER = 1 << 15
#: A trajectory's support at a time.
SUPPORTED, OUTSIDE, GAP, INSUFFICIENT = "SUPPORTED", "OUTSIDE_SOURCE_SUPPORT", "UNSUPPORTED_GAP", "INSUFFICIENT_DERIVATIVE_SUPPORT"
EPSILON = np.finfo(float).eps


def robust_cubics(dt: np.ndarray, values: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """[fit, derivative 0 to 3, axis] of weighted cubics at dt = 0. dt: [fit, sample]; values: [fit, sample, axis]; inside: which samples count.

    Where the times of a window do not determine a cubic (fewer than four that differ, to numbers' precision), the least one that fits best is taken.
    """
    n, _, axes = values.shape
    scale = np.abs(np.where(inside, dt, 0)).max(axis=1)
    scale[scale == 0] = 1
    x = (np.where(inside, dt, 0) / scale[:, None])[:, :, None] ** np.arange(DEGREE + 1)
    turned = x.transpose(0, 2, 1) * inside[:, None, :]
    known = np.linalg.cond(turned @ x) < 1e12
    size = inside.sum(axis=1)

    def median(v: np.ndarray, m: np.ndarray) -> np.ndarray:
        v, row = np.sort(v, axis=1), np.arange(len(v))
        return (v[row, (m - 1) // 2] + v[row, m // 2]) / 2

    beta, weight, live = np.zeros((n, DEGREE + 1, axes)), inside.astype(float), np.arange(n)

    def solved(at: np.ndarray) -> None:
        turned = (x[at] * weight[at][:, :, None]).transpose(0, 2, 1)
        normal, right = turned @ x[at], turned @ values[at]
        ok = known[at] & (np.abs(np.linalg.det(normal)) > 0)
        if ok.any():
            beta[at[ok]] = np.linalg.solve(normal[ok], right[ok])
        if not ok.all():
            beta[at[~ok]] = np.linalg.pinv(normal[~ok], rcond=1e-12) @ right[~ok]

    for _ in range(ITERATIONS):
        solved(live)
        residual = np.where(inside[live], np.linalg.norm(values[live] - x[live] @ beta[live], axis=2), np.inf)
        centre = median(residual, size[live])
        spread = MAD * median(np.where(inside[live], np.abs(residual - centre[:, None]), np.inf), size[live])
        going = spread > EPSILON
        updated = np.where(inside[live], np.minimum(1.0, HUBER * spread[:, None] / np.maximum(residual, EPSILON)), 0.0)
        change = np.abs(updated - weight[live]).max(axis=1)
        weight[live[going]] = updated[going]
        ended = going & (change <= TOLERANCE)
        if ended.any():
            solved(live[ended])
        live = live[going & ~ended]
        if not len(live):
            break
    return beta * np.array([1, 1, 2, 6])[None, :, None] / scale[:, None, None] ** np.arange(DEGREE + 1)[None, :, None]


def numbered(samples: DataFrame, keys: list[str], time: str, gap: int | None) -> DataFrame:
    """samples with nth (from 0), segment (from 0), begins and ends (the segment's first and last nth)."""
    w = Window.partitionBy(*keys).orderBy(time)
    cut = F.lit(0) if gap is None else F.when(F.col(time) - F.lag(time).over(w) > gap, 1).otherwise(0)
    made = samples.withColumn("nth", F.row_number().over(w) - 1).withColumn("segment", F.sum(cut).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = Window.partitionBy(*keys, "segment")
    return made.withColumns({"begins": F.min("nth").over(s), "ends": F.max("nth").over(s)})


def located(known: DataFrame, queries: DataFrame, keys: list[str], time: str, query: str) -> DataFrame:
    """keys, query, time, state, at (the number of samples before), begins, ends, nearest neighbours' nth (left, right): where each query falls among numbered() samples.

    One window over samples and queries by time; a sample at just the query's time is its right neighbour.
    """
    place = F.struct("nth", "segment", "begins", "ends", F.col(time).alias("t"))
    rows = known.select(*keys, F.lit(None).cast(queries.schema[query].dataType).alias(query), F.col(time).alias("__t"), F.lit(1).alias("__kind"), place.alias("p"))
    asked = queries.select(*keys, F.col(query), F.col(time).alias("__t"), F.lit(0).alias("__kind"), F.lit(None).cast(rows.schema["p"].dataType).alias("p"))
    w = Window.partitionBy(*keys).orderBy("__t", "__kind", query)
    before = F.last("p", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("p", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    placed = rows.union(asked).withColumns({"l": before, "r": after}).filter("__kind = 0")
    exact = F.coalesce(F.col("r.t") == F.col("__t"), F.lit(False))
    own = F.when(exact, F.col("r")).when(F.col("l.segment") == F.col("r.segment"), F.col("l"))
    few = F.col("own.ends") - F.col("own.begins") < DEGREE
    state = F.when(~exact & (F.col("l").isNull() | F.col("r").isNull()), OUTSIDE).when(F.col("own").isNull(), GAP).when(few, INSUFFICIENT).otherwise(SUPPORTED)
    at = F.when(exact, F.col("r.nth")).otherwise(F.col("l.nth") + 1)
    return placed.withColumn("own", own).select(*keys, query, F.col("__t").alias(time), state.alias("state"), at.alias("at"), "own.begins", "own.ends", exact.alias("exact"))


def evaluated(samples: DataFrame, queries: DataFrame, keys: list[str], time: str, query: str, axes: list[str], gap: int | None = None, unit: float = 1e9, together: int = 4096) -> DataFrame:
    """keys, query, time, state, and at supported times <axis>, <axis>_d1 to _d3 (value and derivatives, by `unit` of time) and nearest (the nth of
    the nearest sample in the window, of equally near ones the first); null elsewhere.

    Samples of one sequence must differ in time for a full fit (equal times are allowed and fitted as they are). A sequence is dealt in
    stretches of `together` samples with a window's samples at either end, so a long one is many tasks.
    """
    known = numbered(samples, keys, time, gap)
    asked = located(known, queries, keys, time, query)
    first = F.greatest(F.col("begins"), F.col("at") - HALF_WINDOW)
    last = F.least(F.col("ends") + 1, first + WINDOW)
    fit = asked.filter(F.col("state") == SUPPORTED).withColumns({"__to": last, "__from": F.greatest(F.col("begins"), last - WINDOW), "__part": F.floor(F.col("at") / together)})
    own, place = F.floor(F.col("nth") / together), F.col("nth") % together
    shared = F.array_compact(F.array(own, F.when((place < WINDOW) & (own > 0), own - 1), F.when(place >= together - WINDOW, own + 1)))
    dealt = known.select(*keys, "nth", F.col(time).alias("__t"), *axes, F.explode(shared).alias("__part"))
    kinds = dict(queries.dtypes)
    names = [f"{a}{d}" for a in axes for d in ("", "_d1", "_d2", "_d3")]

    own_keys = [*keys, "__part"]

    def some(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = [*keys, query, *names, "nearest"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        # stretches one behind the other, each from its own first sample on
        left = left.sort_values([*own_keys, "nth"], kind="stable").reset_index(drop=True)
        left["__row"] = np.arange(len(left))
        begin = left.groupby(own_keys, sort=False, dropna=False)[["__row", "nth"]].first().rename(columns={"__row": "__at", "nth": "__base"}).reset_index()
        right = right.merge(begin, on=own_keys)
        if right.empty:
            return pd.DataFrame(columns=columns)
        t, y = left["__t"].to_numpy(np.int64), left[axes].to_numpy(float)
        base = (right["__base"] - right["__at"]).to_numpy(np.int64)
        start, stop = right["__from"].to_numpy(np.int64) - base, right["__to"].to_numpy(np.int64) - base
        index = start[:, None] + np.arange(WINDOW)
        inside = index < stop[:, None]
        index = np.minimum(index, stop[:, None] - 1)
        apart = t[index] - right["__qt"].to_numpy(np.int64)[:, None]
        found = robust_cubics(apart / unit, y[index], inside)
        near = np.where(inside, np.abs(apart), np.iinfo(np.int64).max).argmin(axis=1)
        out = {k: right[k] for k in keys} | {query: right["__q"]} | {n: found[:, i % 4, i // 4] for i, n in enumerate(names)}
        return pd.DataFrame(out | {"nearest": base + start + near})[columns]

    # Python is called for some stretches at a time, since most sequences are short
    rows = samples.count()
    call = lambda n: F.pmod(F.xxhash64(*own_keys), F.lit(rows // TOGETHER + 1)).alias(n)
    # names of their own, since both sides may come from one table
    renamed = {f"__{side}{i}": k for side in "lr" for i, k in enumerate(own_keys)}
    left = spread(dealt.select(*[F.col(k).alias(f"__l{i}") for i, k in enumerate(own_keys)], F.col("nth").alias("__nth"), F.col("__t").alias("__at"), *[F.col(a).alias(f"__a{i}") for i, a in enumerate(axes)], call("__l")), rows, "__l")
    renamed |= {"__nth": "nth", "__at": "__t"} | {f"__a{i}": a for i, a in enumerate(axes)}
    right = spread(fit.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(own_keys)], F.col(query).alias("__q"), F.col(time).alias("__qt"), "__from", "__to", call("__r")), rows, "__r")
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in [*keys, query]] + [f"`{n}` double" for n in names] + ["nearest long"])
    fits = left.groupBy("__l").cogroup(right.groupBy("__r")).applyInPandas(lambda a, b: some(a.drop(columns="__l").rename(columns=renamed), b.drop(columns="__r").rename(columns=renamed)), schema)
    return asked.select(*keys, query, time, "state").join(fits, [*keys, query], "left")


def stationary(samples: DataFrame, keys: list[str], time: str, axes: list[str], slow: float, least_ns: int, gap: int | None = None) -> DataFrame:
    """keys, nth, time, speed, stationary: samples whose speed (of the fit, the median of the samples around) stays at or below `slow` for `least_ns` or longer.

    Samples of segments too short for a fit move.
    """
    known = numbered(samples, keys, time, gap)
    fits = evaluated(samples, known.select(*keys, "nth", time), keys, time, "nth", axes, gap)
    speed = F.coalesce(F.sqrt(sum((F.col(f"{a}_d1") * F.col(f"{a}_d1") for a in axes), F.lit(0.0))), F.lit(float("inf")))
    rows = known.select(*keys, "nth", "segment").join(fits.select(*keys, "nth", time, speed.alias("speed")), [*keys, "nth"])
    w = Window.partitionBy(*keys, "segment").orderBy("nth")
    rows = rows.withColumn("__slow", F.percentile("speed", 0.5).over(w.rowsBetween(-HALF_WINDOW, HALF_WINDOW)) <= slow)
    rows = rows.withColumn("__run", F.sum(F.when(F.lag("__slow").over(w) == F.col("__slow"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy(*keys, "segment", "__run")
    return rows.select(*keys, "nth", time, "speed", (F.col("__slow") & (F.max(time).over(r) - F.min(time).over(r) >= least_ns)).alias("stationary"))


def errors(rows: DataFrame, jumps: DataFrame, keys: list[str], time: str, pairs: dict[str, tuple[str, str]], exclusion: int) -> DataFrame:
    """keys, rows, excluded, missing_<name>, worst_<name>, rms_<name>: how far estimates lie from the truth, by sequence.

    pairs: name to (estimate, truth). Rows within `exclusion` (inclusive) of a jump of their sequence (keys, time) are left out, since derivatives have no value
    there. A null estimate or truth is missing, and no error. The nearest jumps on either side are found in one window by time.
    """
    columns = sorted({c for pair in pairs.values() for c in pair})
    marked = rows.select(*keys, F.col(time).alias("__t"), *columns, F.lit(None).cast("long").alias("__jump"))
    at = jumps.select(*keys, F.col(time).alias("__t"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns], F.col(time).cast("long").alias("__jump"))
    w = Window.partitionBy(*keys).orderBy("__t")
    before = F.last("__jump", True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("__jump", True).over(w.rangeBetween(0, Window.unboundedFollowing))
    near = F.coalesce(F.col("__t") - F.col("__before") <= exclusion, F.lit(False)) | F.coalesce(F.col("__after") - F.col("__t") <= exclusion, F.lit(False))
    judged = marked.union(at).withColumns({"__before": before, "__after": after}).filter("__jump IS NULL").withColumn("__out", near)
    kept_ = ~F.col("__out")
    found = [F.count("*").alias("rows"), F.count_if("__out").alias("excluded")]
    for name, (estimate, truth) in pairs.items():
        error = F.when(kept_, F.abs(F.col(estimate) - F.col(truth)))
        found += [F.count_if(kept_ & error.isNull()).alias(f"missing_{name}"), F.max(error).alias(f"worst_{name}"), F.sqrt(F.avg(error * error)).alias(f"rms_{name}")]
    return judged.groupBy(*keys).agg(*found)
