"""The one-pass scan of frames, and bootstraps of whole clusters."""

import numpy as np
import pytest

from trackmill.operators import statistics
from trackmill.sources import readers, writers


def frames(folder, draw):
    for name, n in (("1000.bin", 5000), ("2000.bin", 1), ("3000.bin", 777), ("4000.bin", 64)):
        rows = np.empty((n, 6), "<f4")
        rows[:, :4], rows[:, 4], rows[:, 5] = draw.normal(0, 30, (n, 4)), np.arange(n) % 128, np.linspace(-0.01, 0.1, n)
        if name == "3000.bin":
            rows[5, 1], rows[6, 4], rows[7, 4], rows[9, 5], rows[500, 5] = np.nan, 1.5, 128, np.inf, -0.5
        if name == "4000.bin":
            rows[:, 2] = np.nan
        rows.tofile(folder / name)


@pytest.mark.parametrize("size", [1 << 20, 64, 7, 1])
def test_scan_is_that_of_single_records(spark, tmp_path, monkeypatch, size):
    frames(tmp_path, np.random.default_rng(2))
    monkeypatch.setattr(readers, "RANGE", size)
    got = {r["key"]: tuple(map(str, r)) for r in readers.frame_scan(spark, str(tmp_path)).collect()}
    want = {r["key"]: tuple(map(str, r)) for r in readers.frame_summary(readers.point_records(spark, str(tmp_path))).select(*readers.frame_scan(spark, str(tmp_path)).columns).collect()}
    assert got == want and len(got) == 4


def test_scan_of_a_frame_cut_within_a_record(spark, tmp_path):
    (tmp_path / "1000.bin").write_bytes(bytes(24 * 3 + 5))
    with pytest.raises(Exception, match="no whole records"):
        readers.frame_scan(spark, str(tmp_path)).collect()


def test_frames_are_written_in_order(spark, tmp_path):
    rows = [("a.bin", i, float(i), 0.5, -1.0, 2.0, 3.0, i / 8) for i in range(50)] + [("b.bin", 0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "key string, offset long, x float, y float, z float, intensity float, ring float, time float").repartition(7)
    assert {tuple(r) for r in writers.point_frames(df, str(tmp_path / "out")).collect()} == {("a.bin", 1200), ("b.bin", 24)}
    back = np.fromfile(tmp_path / "out" / "a.bin", "<f4").reshape(-1, 6)
    assert back[:, 0].tolist() == list(range(50)) and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.bin", "b.bin"]


@pytest.mark.parametrize("parts", [1, 9])
def test_cluster_bootstrap_is_that_of_one_place(spark, parts):
    rows = [(i, i % 7, 10 + i % 5) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, hit long, n long").repartition(parts)
    got = statistics.cluster_bootstrap(df, "k", "hit", "n", 400, 0.9, seed=3, together=25).first()
    buckets = {}
    for r in df.selectExpr("*", "pmod(xxhash64(k), 5) AS b").collect():
        buckets.setdefault(r["b"], []).append((r["k"], r["hit"], r["n"]))
    names = sorted(buckets)
    rates = []
    for rep in range(400):
        shared = np.random.default_rng([3, rep]).multinomial(120, np.array([len(buckets[b]) for b in names]) / 120)
        sums = np.zeros(2)
        for b, n in zip(names, shared):
            own = np.array(sorted(buckets[b]), float)
            sums += np.random.default_rng([3, rep, b]).multinomial(n, np.full(len(own), 1 / len(own))) @ own[:, 1:]
        rates.append(sums[0] / sums[1])
    assert (got["low"], got["high"], got["mean"], got["replicates"]) == (pytest.approx(np.quantile(rates, 0.05), abs=2e-9), pytest.approx(np.quantile(rates, 0.95), abs=2e-9), pytest.approx(np.mean(rates), abs=2e-9), 400)
    # as wide as resampling in one step makes it
    draw = np.random.default_rng(1)
    values = np.array(rows, float)[:, 1:]
    plain = [s[0] / s[1] for s in (values[draw.integers(0, 120, 120)].sum(axis=0) for _ in range(4000))]
    assert got["high"] - got["low"] == pytest.approx(np.quantile(plain, 0.95) - np.quantile(plain, 0.05), rel=0.15)


def test_cluster_bootstrap_of_little(spark):
    df = spark.createDataFrame([(1, 2, 4)], "k long, hit long, n long")
    assert tuple(statistics.cluster_bootstrap(df, "k", "hit", "n", 10, 0.9).first()) == (0.5, 0.5, 0.5, 10)
    assert tuple(statistics.cluster_bootstrap(df.limit(0), "k", "hit", "n", 10, 0.9).first()) == (None, None, None, 0)


def test_upper_means_at_low_levels():
    assert statistics.upper_mean(10, 0.1) == pytest.approx(7.0208, abs=1e-3) and statistics.upper_mean(0, 0.95) == pytest.approx(2.99573, abs=1e-4)
    assert statistics.upper_mean(700, 0.95) == pytest.approx(745.11, abs=0.01) and statistics.upper_mean(100_000, 0.5) == pytest.approx(100_000.667, abs=0.01)


@pytest.mark.parametrize("rings", [1, 4])
def test_residuals_between_frames(spark, rings):
    from trackmill.operators import grids

    draw = np.random.default_rng(7)
    rows = [(i, int(f), *map(float, draw.integers(0, 12, 2))) for i, f in enumerate(draw.choice([1, 2, 3, 5, 6], 120))] + [(900, 6, 500.0, 500.0)]
    got = {r["f"]: r for r in grids.frame_residuals(spark.createDataFrame(rows, "id long, f int, x double, y double"), "f", "id", ["x", "y"], 2.0, rings).collect()}
    assert sorted(got) == [2, 3, 6]
    near = lambda p, frame: min(2.0, *[float(np.hypot(p[2] - q[2], p[3] - q[3])) for q in rows if q[1] == frame])
    for f, r in got.items():
        forward, backward = ([near(p, b) for p in rows if p[1] == a] for a, b in ((f, f - 1), (f - 1, f)))
        assert (r["forward"], r["backward"], r["n"]) == (pytest.approx(np.mean(forward)), pytest.approx(np.mean(backward)), len(forward) + len(backward))
