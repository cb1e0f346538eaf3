"""Support, fits and standing still between samples, against plain versions."""

import bisect

import numpy as np
import pytest

from trackmill.operators import trajectory as J

S = 1_000_000_000


def plain_fit(dt, values):
    """One window, by numpy's least squares in each step."""
    design, weight, beta = dt[:, None] ** np.arange(4), np.ones(len(dt)), None
    for _ in range(12):
        root = np.sqrt(weight)[:, None]
        beta = np.linalg.lstsq(design * root, values * root, rcond=None)[0]
        residual = np.linalg.norm(values - design @ beta, axis=1)
        scale = 1.4826 * np.median(np.abs(residual - np.median(residual)))
        if scale <= np.finfo(float).eps:
            break
        new = np.minimum(1.0, 1.5 * scale / np.maximum(residual, np.finfo(float).eps))
        done, weight = np.abs(new - weight).max() <= 1e-12, new
        if done:
            root = np.sqrt(weight)[:, None]
            beta = np.linalg.lstsq(design * root, values * root, rcond=None)[0]
            break
    return beta * np.array([1, 1, 2, 6])[:, None]


def plain_support(times, gap, q):
    """State, and the window's samples."""
    cuts = [0] + [i for i in range(1, len(times)) if times[i] - times[i - 1] > gap] + [len(times)]
    if q < times[0] or q > times[-1]:
        return "OUTSIDE_SOURCE_SUPPORT", None
    for a, b in zip(cuts, cuts[1:]):
        if times[a] <= q <= times[b - 1]:
            if b - a < 4:
                return "INSUFFICIENT_DERIVATIVE_SUPPORT", None
            start = max(a, bisect.bisect_left(times, q, a, b) - 4)
            end = min(b, start + 9)
            return "SUPPORTED", range(max(a, end - 9), end)
    return "UNSUPPORTED_GAP", None


def made(seed):
    r = np.random.default_rng(seed)
    steps = np.where(r.random(80) < 0.08, 30 * S, r.integers(S // 2, 2 * S, 80))
    times = np.cumsum(steps).tolist()
    points = np.stack([np.cumsum(r.normal(3, 1, 80)), 5 * np.sin(np.arange(80) / 9)], axis=1)
    points[r.integers(0, 80, 6)] += 40
    return times, points


@pytest.mark.parametrize("together", [4096, 16])
def test_evaluation_at_any_time(spark, together):
    samples, queries, want = [], [], {}
    for k in range(3):
        times, points = made(k)
        samples += [(k, t, float(x), float(y)) for t, (x, y) in zip(times, points)]
        asked = [times[0] - 1, times[-1] + 5, *times[::7], times[-1], *[t + S // 3 for t in times], times[3]]
        for i, q in enumerate(asked):
            queries.append((k, i, q))
            state, window = plain_support(times, 5 * S, q)
            near = None if window is None else min(window, key=lambda j: abs(times[j] - q))
            want[k, i] = state, None if window is None else plain_fit((np.array([times[j] for j in window]) - q) / S, points[list(window)]), near
    df = spark.createDataFrame(samples, "k int, t long, x double, y double").repartition(3)
    got = J.evaluated(df, spark.createDataFrame(queries, "k int, q int, t long"), ["k"], "t", "q", ["x", "y"], 5 * S, together=together).collect()
    assert len(got) == len(want) and {s for s, *_ in want.values()} == {J.SUPPORTED, J.OUTSIDE, J.GAP, J.INSUFFICIENT}
    for r in got:
        state, fit, near = want[r["k"], r["q"]]
        assert r["state"] == state and r["nearest"] == near
        own = [[r[f"{a}{d}"] for a in "xy"] for d in ("", "_d1", "_d2", "_d3")]
        assert (own[0][0] is None) == (fit is None) and (fit is None or np.allclose(own, fit, rtol=1e-5, atol=1e-5))


def test_an_outlier_of_one_axis_weighs_less_on_all(spark):
    t = np.arange(9) - 4.0
    values = np.stack([t**3, 2 * t], axis=1)
    values[:, 1] += 0.5 * np.cos(5 * t)
    values[6, 0] += 50
    found = J.robust_cubics(t[None], values[None], np.ones((1, 9), bool))[0]
    assert np.allclose(found, plain_fit(t, values), atol=1e-6)
    alone = J.robust_cubics(t[None], values[None, :, 1:], np.ones((1, 9), bool))[0, :, 0]
    assert not np.allclose(alone, found[:, 1], atol=1e-3)


def test_equal_times_have_a_defined_fit():
    found = J.robust_cubics(np.zeros((1, 9)), np.full((1, 9, 1), 7.0), np.ones((1, 9), bool))[0, :, 0]
    assert found.tolist() == [pytest.approx(7.0), 0, 0, 0]
    assert J.robust_cubics(np.zeros((1, 9)), np.full((1, 9, 1), 7.0), np.arange(9)[None] < 1)[0, 0, 0] == pytest.approx(7.0)


def test_standing_still(spark):
    x = [2.0 * i for i in range(20)] + [38.0 + 0.001 * (i % 2) for i in range(25)] + [38 + 2.0 * i for i in range(1, 20)] + [76.0] * 6 + [76 + 2.0 * i for i in range(1, 12)]
    rows = [(0, i * S, v, 0.0) for i, v in enumerate(x)] + [(1, i * S, 0.0, 0.0) for i in range(3)]
    got = J.stationary(spark.createDataFrame(rows, "k int, t long, x double, y double"), ["k"], "t", ["x", "y"], 0.2, 10 * S, 5 * S)
    still = sorted(r["nth"] for r in got.filter("stationary").collect())
    assert got.count() == len(rows) and still == list(range(still[0], still[-1] + 1)) and 20 <= still[0] <= 25 and 38 <= still[-1] <= 44
    assert got.filter("k = 1 AND stationary").count() == 0
    assert J.stationary(spark.createDataFrame([], "k int, t long, x double, y double"), ["k"], "t", ["x", "y"], 0.2, 1).collect() == []


def test_errors_outside_of_jumps(spark):
    rows = [(0, t, float(t), 1.0 if t != 30 else None, float(t % 7)) for t in range(0, 100, 5)] + [(1, 5, 2.0, 1.0, 0.0), (0, 50, 9.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "k int, t long, a double, b double, c double")
    jumps = spark.createDataFrame([(0, 50), (0, 12), (0, 12), (2, 5)], "k int, t long")
    got = {r["k"]: r for r in J.errors(df, jumps, ["k"], "t", {"p": ("a", "b"), "v": ("c", "b")}, 7).collect()}
    for k, own in ((0, [r for r in rows if r[0] == 0]), (1, rows[-2:-1])):
        left = [r for r in own if all(abs(r[1] - j) > 7 for q, j in ((0, 50), (0, 12)) if q == k)]
        p = [abs(r[2] - r[3]) for r in left if r[3] is not None]
        r = got[k]
        assert (r["rows"], r["excluded"], r["missing_p"]) == (len(own), len(own) - len(left), len(left) - len(p))
        assert r["worst_p"] == max(p) and r["rms_p"] == pytest.approx(float(np.sqrt(np.mean(np.square(p)))))
    assert sorted(got) == [0, 1]
