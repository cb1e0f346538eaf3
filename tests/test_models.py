"""Operators against plain Python versions, hand-made cases, and the same rows in other partitions."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackmill.functions import geometry, scalars
from trackmill.operators import bins, checks, decoding, detectors, generators, graphs, grids, islands, joins, polylines, statistics


def merged(spans, gap=0):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("bucket", [None, 7, 1000])
@pytest.mark.parametrize("parts", [1, 5])
def test_merge_intervals(spark, bucket, parts):
    r = random.Random(5)
    rows = [(k, s, s + r.randint(1, 30)) for k in range(4) for s in r.sample(range(400), 40)]
    df = spark.createDataFrame(rows, "k int, s long, e long").repartition(parts)
    got = sorted(tuple(x) for x in islands.merge_intervals(df, ["k"], "s", "e", 0, bucket).select("k", "start", "end").collect())
    assert got == sorted((k, *x) for k in range(4) for x in merged([(s, e) for q, s, e in rows if q == k]))


def test_touching_and_overlap(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 10, 12), (1, 11, 15)], "k int, s long, e long")
    assert islands.merged_duration(df, ["k"], "s", "e").first()["covered"] == 13
    a = spark.createDataFrame([(1, 0, 5)], "k int, a long, b long")
    for span, n in (((5, 9), 0), ((4, 9), 1)):
        b = spark.createDataFrame([(1, *span)], "k int, c long, d long")
        assert joins.overlap_join(a, b, ["k"], ("a", "b"), ("c", "d"), 3).count() == n


def test_traversal_gap(spark):
    df = spark.createDataFrame([(1, 0, 10), (2, 310, 320), (3, 621, 630)], "id int, s long, e long").withColumn("k", F.lit(1))
    got = islands.reach_islands(df, ["k"], "s", "e", "id", 300, "o").orderBy("id").collect()
    assert [r["o"] for r in got] == [0, 0, 1]


@pytest.mark.parametrize("width", [5, 50])
def test_overlap_join_matches_all_pairs(spark, width):
    r = random.Random(9)
    make = lambda n, x: [(i, r.randint(0, 2), s, s + r.randint(1, 40)) for i, s in enumerate(r.choices(range(300), k=n))]
    a, b = make(60, "a"), make(60, "b")
    left, right = spark.createDataFrame(a, "a_id int, k int, s long, e long"), spark.createDataFrame(b, "b_id int, k int, t long, u long")
    got = sorted((x["a_id"], x["b_id"]) for x in joins.overlap_join(left, right, ["k"], ("s", "e"), ("t", "u"), width).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[2] < q[3] and q[2] < p[3])
    semi = sorted(x["a_id"] for x in joins.overlap_semi(left, right, ["k"], ("s", "e"), ("t", "u"), width, ["a_id"]).collect())
    assert semi == sorted({x for x, _ in got})


def test_as_of_takes_equal_times_on_both_sides(spark):
    q = spark.createDataFrame([(1, 5), (2, 7), (3, 1), (4, 99)], "id int, t long").withColumn("k", F.lit(0))
    s = spark.createDataFrame([(3, 1.0), (7, 2.0), (9, 3.0)], "t long, v double").withColumn("k", F.lit(0))
    got = {r["id"]: (r["before_t"], r["after_t"]) for r in joins.as_of(q, s, ["k"], "t", ["v"]).collect()}
    assert got == {1: (3, 7), 2: (7, 7), 3: (None, 3), 4: (9, None)}


def test_bins_hand_case(spark):
    moves = spark.createDataFrame([(1, 5.0, 45.0, 0, 40_000)], "arc int, a double, b double, s long, e long")
    got = bins.split(moves, "a", "b", "s", "e", 20.0).orderBy("bin").collect()
    assert [(r["bin"], r["entry"], r["exit"], r["piece_start"], r["piece_end"]) for r in got] == [(0, 5.0, 20.0, 0, 15_000), (1, 20.0, 40.0, 15_000, 35_000), (2, 40.0, 45.0, 35_000, 40_000)]
    whole = bins.arc_bins(spark.createDataFrame([(1, 45.0), (2, 40.0)], "arc int, length double"), "arc", "length", 20.0)
    assert sorted((r["arc"], r["bin"], r["bin_length"], r["partial"]) for r in whole.collect()) == [(1, 0, 20.0, False), (1, 1, 20.0, False), (1, 2, 5.0, True), (2, 0, 20.0, False), (2, 1, 20.0, False)]


def test_histogram_and_circle(spark):
    df = spark.createDataFrame([(0, v) for v in (1.0, 1.0, 3.0, 9.0, -5.0, 10.0)], "k int, v double")
    hist = grids.histogram(df, ["k"], F.col("v"), 0.0, 10.0, 5)
    got = {r["share"]: r["quantile"] for r in grids.histogram_quantiles(hist, ["k"], 0.0, 10.0, 5, [0.5, 0.95]).collect()}
    assert got == {0.5: 1.0, 0.95: 9.0}
    sectors = spark.createDataFrame([(0, 2), (0, 3), (0, 6), (1, None)], "k int, s int")
    assert {r["k"]: r["empty"] for r in grids.widest_empty_arc(sectors, ["k"], "s", 8).collect()} == {0: 3, 1: 8}


def test_radius_join_matches_all_pairs(spark):
    r = random.Random(3)
    p = [(i, r.uniform(-3, 3), r.uniform(-3, 3)) for i in range(80)]
    a, b = spark.createDataFrame(p, "a int, ax double, ay double"), spark.createDataFrame(p, "b int, bx double, by double")
    got = sorted((x["a"], x["b"]) for x in grids.radius_join(a, b, ["ax", "ay"], ["bx", "by"], 0.7).collect())
    assert got == sorted((i, j) for i, x, y in p for j, u, v in p if (x - u) ** 2 + (y - v) ** 2 <= 0.49)


@settings(max_examples=30, deadline=None)
@given(st.data())
def test_best_path_is_best(data):
    steps, states = data.draw(st.integers(1, 5)), range(data.draw(st.integers(1, 3)))
    score = st.integers(-20, 20).map(lambda x: x / 4)
    emissions = [{c: data.draw(score) for c in states} for _ in range(steps)]
    moves = [{}] + [{(p, c): data.draw(score) for p in states for c in states} for _ in range(steps - 1)]
    best = decoding.best_paths(emissions, moves)[0][0]
    assert math.isclose(best, max(sum(e[c] for e, c in zip(emissions, path)) + sum(moves[i + 1][path[i], path[i + 1]] for i in range(steps - 1)) for path in itertools.product(states, repeat=steps)))


def test_robust_fit():
    t = np.linspace(0, 2, 41)
    true = lambda x: np.array([1 + 2 * x - x**2 + 0.5 * x**3, 2 - 2 * x + 1.5 * x**2, -2 + 3 * x, 3 + 0 * x])
    exact = decoding.local_fits(t, true(t)[0])
    assert np.allclose(exact, true(t).T, atol=1e-6)
    y = true(t)[0].copy()
    y[20] += 30
    found = decoding.local_fits(t, y)
    far = np.abs(np.arange(41) - 20) > decoding.HALF_WINDOW
    assert np.allclose(found[far], true(t).T[far], atol=1e-6)
    # in the middle of its window an outlier weighs less than in plain least squares
    window = slice(16, 25)
    plain = np.polyval(np.polyfit(t[window] - t[20], y[window], 3), 0)
    assert abs(found[20, 0] - true(t[20])[0]) < 0.5 * abs(plain - true(t[20])[0])


def test_robust_fit_in_stretches(spark):
    r = random.Random(12)
    df = spark.createDataFrame([(k, i, float(i) + r.random() / 2, r.random() * 10) for k in range(2) for i in range(90)], "k int, i int, t double, v double")
    whole = {tuple(x[:2]): x[2:] for x in decoding.robust_fit(df, ["k"], "i", F.col("t"), "v").collect()}
    split = {tuple(x[:2]): x[2:] for x in decoding.robust_fit(df, ["k"], "i", F.col("t"), "v", together=11).collect()}
    assert len(whole) == len(split) == 180 and all(np.allclose(whole[x], split[x], rtol=1e-6, atol=1e-6) for x in whole)


def test_complete_link(spark):
    nodes = spark.createDataFrame([(0, i) for i in range(6)], "b int, n int")
    edges = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 0, 2), (0, 2, 3), (0, 4, 5)], "b int, a int, c int").withColumnRenamed("b", "b0").withColumnRenamed("c", "b").withColumnRenamed("b0", "blk")
    got = {r["n"]: r["cluster"] for r in polylines.complete_link(nodes.withColumnRenamed("b", "blk"), edges, "blk", "n").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}


def test_splitmix():
    from trackmill.functions import prng

    assert prng.draws(np.array([0, 0, 1234567]), np.array([0, 1, 0])).tolist() == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 6457827717110365317]


def test_alignment_verdicts(spark):
    rows = [(1, f, 1.5 * i + 0.1, 0.5 if f < 2 else 50.0) for f in range(4) for i in range(15)] + [(1, 3, None, None)]
    got = {r["frame"]: r["verdict"] for r in detectors.alignment_verdicts(spark.createDataFrame(rows, "seq int, frame int, wx double, wy double"), "seq", "frame", 1.0, 12, 0.75).collect()}
    assert got == {1: "PASS", 2: "FAIL", 3: "UNKNOWN"}


def test_poisson_bound():
    assert math.isclose(statistics.upper_mean(0, 0.95), -math.log(0.05), rel_tol=1e-9)
    for k in (10, 700, 2000, 40_000):  # beyond 700 the probability of no event underflows; sums in exact logarithms
        m = statistics.upper_mean(k, 0.95)
        assert k < m and math.isclose(math.fsum(math.exp(i * math.log(m) - m - math.lgamma(i + 1)) for i in range(k + 1)), 0.05, rel_tol=1e-5)
    for k in (1, 4, 30):
        m = statistics.upper_mean(k, 0.95)
        assert math.isclose(sum(math.exp(-m) * m**i / math.factorial(i) for i in range(k + 1)), 0.05, rel_tol=1e-6)


def test_decimal_seconds(spark):
    cases = {"1.5": 1_500_000_000, "-0.0000000005": -1, "0.0000000004": 0, "12": 12_000_000_000, "1607.123456789": 1_607_123_456_789, "1.": 1_000_000_000, "x": None, "": None, "1.2.3": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["n"] for r in df.withColumn("n", scalars.seconds_to_ns(F.col("t"))).collect()} == cases


def test_rotations(spark):
    df = spark.range(1).select(*[F.lit(x).alias(n) for n, x in (("r", 0.3), ("p", -0.2), ("h", 2.0))])
    q = geometry.from_roll_pitch_heading(F.col("r"), F.col("p"), F.col("h"))
    v = geometry.rotate(q, (F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    got = df.select(*[c.alias(f"c{i}") for i, c in enumerate((*q, *v))]).first()
    assert math.isclose(sum(x * x for x in got[:4]), 1) and got[0] > 0
    assert np.allclose(got[4:], [math.cos(2) * math.cos(-0.2), math.sin(2) * math.cos(-0.2), -math.sin(-0.2)])
    half = geometry.slerp((F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)), (F.lit(math.cos(0.5)), F.lit(0.0), F.lit(0.0), F.lit(math.sin(0.5))), F.lit(0.5))
    assert np.allclose(df.select(*[c.alias(f"c{i}") for i, c in enumerate(half)]).first(), [math.cos(0.25), 0, 0, math.sin(0.25)])


def test_clean_trajectories_are_silent_and_faults_are_found(spark):
    made = generators.trajectories(spark.range(16).withColumnRenamed("id", "seq"), "seq", 120).filter("scenario != 'stop_start'")
    assert detectors.trajectory_failures(made, "seq").count() == 0
    bad = generators.time_shift(made, F.col("seq") == 0, 60, -400_000_000)
    rules = {r["rule"] for r in detectors.trajectory_failures(bad, "seq").collect()}
    assert rules == {"regression"}
    frozen = generators.position_freeze(made, "seq", F.col("seq") == 0, 40, 60)
    events = detectors.trajectory_events(detectors.trajectory_failures(frozen, "seq"), "seq").collect()
    assert len(events) == 1 and events[0]["seq"] == 0 and events[0]["start"] == 4_000_000_000
    drift = generators.position_drift(made, F.col("seq") == 0, 100, 10, 5.0)
    assert drift.filter("seq = 0 and idx = 119").first()["y"] == 10.0  # it goes on beyond its end


def test_verdicts(spark):
    scopes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "s int")
    evidence = spark.createDataFrame([(1, "a", 1.0, 9), (1, "b", 1.0, 9), (2, "a", 1.0, 9), (2, "b", 9.0, 9), (3, "a", 1.0, 9)], "s int, key string, value double, support long")
    got = statistics.readiness(scopes, evidence, ["s"], [("a", "le", 2.0, 1), ("b", "le", 2.0, 1)])
    assert {r["s"]: r["verdict"] for r in got.collect()} == {1: "PASS", 2: "FAIL", 3: "UNKNOWN", 4: "UNKNOWN"}


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "k int, s long, e long, id int, v double")
    assert islands.merge_intervals(df, ["k"], "s", "e").collect() == []
    assert joins.overlap_join(df, df.toDF("k", "t", "u", "id2", "v2"), ["k"], ("s", "e"), ("t", "u"), 5).collect() == []
    assert decoding.robust_fit(df, ["k"], "id", F.col("s"), "v").collect() == []


def test_checks_fail_where_they_must(spark):
    df = spark.createDataFrame([(1, 2.0), (2, float("nan")), (3, None)], "k int, v double")
    assert checks.require(checks.within_budget(df, 3, {"k": (1, 3)}), "rows").first()["ok"]
    report = checks.within_budget(df, 2, {"v": (0, 9)}, {"k": 2})
    assert tuple(report.first()) == (3, 2, 3, False)
    with pytest.raises(Exception, match="out of bounds"):
        checks.require(report, "rows").collect()
    assert checks.within_budget(df.limit(0), 2, {"v": (0, 9)}).first()["ok"]
    times = spark.createDataFrame([(5, "a", 3, "a"), (2**63 - 1, "a", -1, "a"), (5, "a", 3, "b"), (5, None, 3, None)], "x long, p string, y long, q string")
    args = [F.col(c) for c in "xpyq"]
    assert [r[0] for r in times.select(checks.time_difference(*args, F.lit(None).cast("long"))).collect()] == [2, None, None, None]
    with pytest.raises(Exception, match="not comparable"):
        times.select(checks.time_difference(*args)).collect()


def test_routes_obey_turns(spark):
    arcs = spark.createDataFrame([(1, "a", "b", 1), (2, "b", "c", 1), (3, "b", "d", 1), (4, "d", "b", 1), (5, "a", "c", 9)], "arc long, src string, dst string, len long")
    sources = spark.createDataFrame([("a",), ("z",)], "src string")
    banned = spark.createDataFrame([(1, 2)], "from_arc long, to_arc long")
    got = {(r["source"], r["node"]): (r["dist"], r["turns"], r["path"]) for r in graphs.routes(arcs, sources, banned, 20).collect()}
    # the turn from a to c is closed at b, so the way goes on to d and comes back: b is passed twice
    assert got == {("a", "a"): (0, 0, []), ("z", "z"): (0, 0, []), ("a", "b"): (1, 1, [1]), ("a", "d"): (2, 2, [1, 3]), ("a", "c"): (4, 4, [1, 3, 4, 2])}
    assert {(r["a"], r["b"]) for r in graphs.closure(arcs).filter("a = 'a'").collect()} == {("a", "b"), ("a", "c"), ("a", "d")}
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 50), (50, 51)], "a long, b long")
    assert {r["node"]: r["component"] for r in graphs.components(links).collect()} == {**{i: 0 for i in range(31)}, 50: 50, 51: 50, 100: 50}
