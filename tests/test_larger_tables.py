"""What larger tables brought to light: cases that the small ones don't hold."""

import datetime
import math
import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import TABLES, assert_same

from trackmill.operators import bins, joins, polylines, road_import, state, statistics, topology, trajectory
from trackmill.plans import catalog

SMALL = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def with_events(folder, *files):
    """The smallest tables with other events: rows of (event_id, minute, user_id, event_type, value) for each file."""
    for t in TABLES:
        if t != "events":
            os.symlink(f"{SMALL}/{t}.parquet", folder / f"{t}.parquet")
    schema = pq.read_schema(f"{SMALL}/events.parquet")
    several = len(files) > 1
    if several:
        os.mkdir(folder / "events.parquet")
    for i, rows in enumerate(files):
        made = [{"event_id": n, "ts": datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=at), "user_id": u, "event_type": kind, "value": v, "props": "{}"} for n, at, u, kind, v in rows]
        pq.write_table(pa.Table.from_pylist(made, schema=schema), folder / "events.parquet" / f"part-{i:03}.parquet" if several else folder / "events.parquet")
    return str(folder)


@pytest.mark.parametrize("width", [5, 50])
def test_empty_intervals_meet_those_around_them(spark, width):
    r = random.Random(3)
    make = lambda n: [(i, r.randint(0, 2), s, s + r.choice([0, 0, 1, 7, 30])) for i, s in enumerate(r.choices(range(120), k=n))]
    a, b = make(60), make(60)
    left, right = spark.createDataFrame(a, "a_id int, k int, s long, e long"), spark.createDataFrame(b, "b_id int, k int, t long, u long")
    got = sorted((x["a_id"], x["b_id"]) for x in joins.overlap_join(left, right, ["k"], ("s", "e"), ("t", "u"), width).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[2] < q[3] and q[2] < p[3])
    assert any(a[p][2] == a[p][3] for p, _ in got) and any(b[q][2] == b[q][3] for _, q in got)
    semi = sorted(x["a_id"] for x in joins.overlap_semi(left, right, ["k"], ("s", "e"), ("t", "u"), width, ["a_id"]).collect())
    assert semi == sorted({x for x, _ in got})


@tables
@pytest.mark.parametrize("name", ["interval_overlap", "touched_traversals", "finding_bins", "modality_support", "truth_match"])
def test_events_without_length_within_others(spark, tmp_path, name):
    # a purchase without length within an error, one that begins with it, and an error without length within a purchase; ids of other users repeat
    rows = [(1, 0, 1, "error", 100.0), (2, 50, 1, "purchase", 0.0), (3, 0, 1, "purchase", 0.0), (4, 300, 2, "purchase", 60.0), (5, 330, 2, "error", 0.0), (6, 340, 2, "error", 90.0)]
    rows += [(7, 900, 3, "purchase", 5.0), (8, 901, 3, "error", 2.5), (2, 5000, 4, "purchase", 1.0), (9, 6000, 4, "error", 1.0)]
    assert_same(catalog.QUERIES[name](spark, with_events(tmp_path, rows)), str(tmp_path), catalog.ORACLE_SQL[name])


def plain_clusters(lines, most):
    """Greedy complete-link clusters of {line: points}, from all pairs."""
    near = lambda a, b: sum(math.dist(p, q) for p, q in zip(lines[a], lines[b])) / len(lines[a]) <= most
    groups = []
    for x in sorted(lines):
        home = next((g for g in groups if all(near(m, x) for m in g)), None)
        home.append(x) if home is not None else groups.append([x])
    return {x: g[0] for g in groups for x in g}, {(a, b) for a in lines for b in lines if a < b and near(a, b)}


def test_copies_of_polylines_are_compared_once(spark):
    r = random.Random(7)
    lines = {}
    for line in range(60):
        copied = [x for x in lines if x % 2 == line % 2]
        lines[line] = lines[r.choice(copied)] if copied and r.random() < 0.5 else [(k * 10 + r.uniform(-9, 9), r.choice([0, 8, 16, 200]) + r.uniform(-5, 5)) for k in range(4)]
    samples = spark.createDataFrame([(i % 2, i, k, x, y) for i, at in lines.items() for k, (x, y) in enumerate(at)], "family int, line int, k int, x double, y double").repartition(5)
    wanted = [plain_clusters({i: at for i, at in lines.items() if i % 2 == f}, 12.0) for f in (0, 1)]
    near = [tuple(x) for x in polylines.near_pairs(samples, ["family"], "line", ["x", "y"], 12.0).select("family", "a", "b").collect()]
    assert sorted(near) == sorted((f, *p) for f in (0, 1) for p in wanted[f][1])
    shapes = polylines.shapes(samples, ["family"], "line", ["x", "y"])
    assert shapes.select("shape").distinct().count() < 45
    # pairs of shapes, not of lines, are what is compared
    assert polylines.near_shapes(shapes, ["family"], "line", ["x", "y"], 12.0).count() < len(near) / 2
    got = {x["line"]: x["cluster"] for x in polylines.complete_clusters(shapes, ["family"], "line", ["x", "y"], 12.0).collect()}
    assert got == wanted[0][0] | wanted[1][0]


@pytest.mark.parametrize("block", [3, 1024])
def test_polylines_are_compared_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(polylines, "BLOCK", block)
    r = random.Random(17)
    lines = {i: [(k * 10 + r.uniform(-9, 9), r.choice([0, 8, 16, 200]) + r.uniform(-5, 5)) for k in range(4)] for i in range(50)}
    lines |= {50 + i: lines[i % 4] for i in range(14)} | {i: lines[0][:3] for i in (70, 71)}
    samples = spark.createDataFrame([(i % 2, i, k, x, y) for i, at in lines.items() for k, (x, y) in enumerate(at)], "family int, line int, k int, x double, y double").repartition(5)
    found = polylines.near_pairs(samples, ["family"], "line", ["x", "y"], 12.0, 3)
    # arrays are compared, and pairs are rounded before they are made of them
    plan = plan_of(found)
    assert "MapInArrow" in plan and "round(" not in plan and "zip_with" not in plan
    apart = lambda a, b: sum(math.dist(p, q) for p, q in zip(lines[a], lines[b])) / len(lines[a])
    wanted = {(a % 2, a, b): apart(a, b) for a in lines for b in lines if a < b and (b - a) % 2 == 0 and len(lines[a]) == len(lines[b]) and apart(a, b) <= 12}
    got = {tuple(x)[:3]: x["apart"] for x in found.collect()}
    assert found.count() == len(got) and set(got) == set(wanted) and len(got) > 100
    assert all(got[x] == pytest.approx(wanted[x], abs=5.001e-4) and got[x] == round(got[x], 3) for x in got)


def test_of_identical_pieces_the_first_counts(spark):
    rows = [(1, 0, i, 0.0, 50.0, 0, 1000, float(100 - i)) for i in range(40)] + [(2, 1, 90, 5.0, 45.0, 7, 40_007, 3.0)]
    moves = spark.createDataFrame(rows[::-1], "arc int, seq int, id long, a double, b double, s long, e long, speed double").coalesce(1)
    made = bins.traversals(bins.split(moves.repartition("arc", "seq"), "a", "b", "s", "e", 20.0), "arc", "seq", "id", "speed", 300)
    got = sorted((x["arc"], x["bin"], x["ordinal"], x["mean_speed"], x["pieces"], x["distance"]) for x in made.collect())
    assert got == [(1, 0, 0, 100.0, 1, 20.0), (1, 1, 0, 100.0, 1, 20.0), (1, 2, 0, 100.0, 1, 10.0), (2, 0, 0, 3.0, 1, 15.0), (2, 1, 0, 3.0, 1, 20.0), (2, 2, 0, 3.0, 1, 5.0)]


@tables
def test_reasons_of_excluded_ways_need_no_arcs(spark, monkeypatch):
    def no_arcs(*args, **kwargs):
        raise AssertionError("arcs are made")

    monkeypatch.setattr(road_import, "build_arcs", no_arcs)
    assert_same(catalog.QUERIES["excluded_ways"](spark, SMALL), SMALL, catalog.ORACLE_SQL["excluded_ways"])


@tables
def test_stream_checks_in_any_order_of_files(spark, tmp_path):
    r = random.Random(11)
    rows = [(i, at, i % 3, "view", 1.0) for i, at in enumerate(r.choices(range(0, 20_000, 50), k=240))]
    r.shuffle(rows)
    # more files than a batch takes
    folder = with_events(tmp_path, *[rows[i::12] for i in range(12)])
    got = catalog.QUERIES["stream_checks"](spark, folder).collect()
    wanted = []
    for user in range(3):
        times = [60_000_000 * at for i, at, u, _, _ in sorted(rows) if u == user]
        steps = [b - a for a, b in zip(times, times[1:])]
        wanted.append((user, len(times), sum(x == 0 for x in steps), sum(x < 0 for x in steps), sum(x > 86_400_000_000 for x in steps)))
    assert sorted((x["user_id"], x["n"], x["duplicates"], x["regressions"], x["gaps"]) for x in got) == wanted
    latest = {u: max(at for _, at, v, _, _ in rows if v == u) for u in range(3)}
    assert {x["user_id"]: x["last_us"] - 1_704_067_200_000_000 for x in got} == {u: 60_000_000 * at for u, at in latest.items()}


@tables
def test_pieces_of_movements_are_not_shuffled(spark):
    plan = catalog.QUERIES["traversals"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@tables
@pytest.mark.parametrize("name", ["road_arcs", "topology_rejections", "topology_clusters"])
def test_parts_are_as_many_as_the_rows_need(spark, monkeypatch, name):
    monkeypatch.setattr(state, "PART_ROWS", 400)
    found = catalog.QUERIES[name](spark, SMALL)
    if name != "topology_clusters":  # its sorts are behind it
        assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert_same(found, SMALL, catalog.ORACLE_SQL[name])


@tables
def test_corridors_are_made_once(spark):
    plan = catalog.QUERIES["topology_hypotheses"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "percentile" not in plan


@pytest.mark.parametrize("together", [7, 4096])
def test_corridors_of_clusters_are_their_medians(spark, monkeypatch, together):
    monkeypatch.setattr(topology, "TOGETHER", together)
    r, limits = random.Random(9), topology.Limits(samples=3, traversals=2)
    rows = [(i, k, r.choice([0, 30, 400, 900]) + 60.0 * k + r.uniform(-9, 9), r.choice([0, 20]) + r.uniform(-5, 5)) for i in range(90) for k in range(3)]
    samples = spark.createDataFrame(rows, "interval long, k int, x double, y double")
    traversals = spark.createDataFrame([(i, i % 4 if i % 9 else None) for i in range(90)], "interval long, traversal long")
    plain = topology.corridors(samples, topology.clustered(samples, limits), traversals).filter("n_traversals >= 2")
    columns = ["cluster", "k", "x", "y", "n_intervals", "n_traversals"]
    got = sorted(tuple(x) for x in topology.clustered_corridors(samples, traversals, limits).select(*columns).collect())
    assert got == sorted(tuple(x) for x in plain.select(*columns).collect()) and len(got) > 9
    assert topology.clustered_corridors(samples.limit(0), traversals, limits).collect() == []


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_percentiles_from_counted_values(spark):
    r = random.Random(2)
    rows = [(k, r.choice([None, 1.5, 2.0, 7.25, r.uniform(0, 9)])) for k in ("a", "b", None) for _ in range(r.randint(30, 90))] + [("c", None), ("d", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    found = statistics.percentiles(df, "k", "v", 0.95)
    assert "percentile" not in plan_of(found)
    got = {x["k"]: tuple(x)[1:] for x in found.collect()}
    assert set(got) == {"a", "b", "c", "d", None} and got["c"] == (None, None, None)
    for k in ("a", "b", "d", None):
        own = sorted(v for key, v in rows if key == k and v is not None)
        assert got[k] == (pytest.approx(np.quantile(own, 0.95)), own[math.ceil(0.95 * len(own)) - 1], own[-1])


def test_buckets_do_not_share_out_replicates_again(spark):
    df = spark.createDataFrame([(i, i % 7, 10) for i in range(60)], "k long, hit long, n long")
    assert "FlatMapCoGroupsIn" in plan_of(statistics.cluster_bootstrap(df, "k", "hit", "n", 20, 0.9, together=10))


@pytest.mark.parametrize("together", [7, 1 << 15])
def test_stretches_of_many_sequences_in_one_call(spark, monkeypatch, together):
    monkeypatch.setattr(trajectory, "TOGETHER", together)
    samples = spark.createDataFrame([(s, t * 10**9, float(s * t * t)) for s in range(30) for t in range(s % 12)], "seq long, t long, x double")
    queries = spark.createDataFrame([(s, s * 100 + t, t * 5 * 10**8) for s in range(31) for t in range(24)], "seq long, id long, t long")
    found = {x["id"]: x for x in trajectory.evaluated(samples, queries, ["seq"], "t", "id", ["x"]).collect()}
    supported = [x for x in found.values() if x["state"] == "SUPPORTED"]
    assert len(found) == 31 * 24 and len(supported) > 200
    for x in supported:
        assert x["x"] == pytest.approx(x["seq"] * (x["t"] / 1e9) ** 2, abs=1e-6) and x["x_d1"] == pytest.approx(2 * x["seq"] * x["t"] / 1e9, abs=1e-6)


@tables
def test_vectors_at_one_place_are_looked_at_once(spark, tmp_path, monkeypatch):
    from trackmill.plans import aggregates

    for t in TABLES:
        if t != "embeddings":
            os.symlink(f"{SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    one = pq.read_table(f"{SMALL}/embeddings.parquet")
    at = one.schema.get_field_index("vec_id")
    copies = [one.set_column(at, one.schema.field(at), pa.array([v + 10**6 * i for v in one["vec_id"].to_pylist()], one.schema.field(at).type)) for i in range(4)]
    pq.write_table(pa.concat_tables(copies), tmp_path / "embeddings.parquet")
    plain, seen = aggregates.G.radius_join, []
    monkeypatch.setattr(aggregates.G, "radius_join", lambda a, b, *more: seen.extend([a.count(), b.count()]) or plain(a, b, *more))
    assert_same(catalog.QUERIES["nearest_within"](spark, str(tmp_path)), str(tmp_path), catalog.ORACLE_SQL["nearest_within"])
    assert max(seen) <= one.num_rows


@tables
def test_an_import_keeps_no_digests_and_a_compressed_map(spark, monkeypatch):
    from trackmill.plans import road_maps

    monkeypatch.setattr(road_maps, "FILE_ELEMENTS", 50)
    files = [f for f in os.listdir(road_maps.written(spark, SMALL)) if f.startswith("part-")]
    assert len(files) > 20 and all(f.endswith(".gz") for f in files)
    kept, plain = [], road_import.stored
    monkeypatch.setattr(road_import, "stored", lambda df: kept.append(df.columns) or plain(df))
    found = catalog.QUERIES["imported_rules"](spark, SMALL)
    assert not any("arc_id" in c or "tags" in c for c in kept)
    # arcs are named by what rules show of them, so rules meet nothing again
    assert "Join" not in plan_of(found)
    assert_same(found, SMALL, catalog.ORACLE_SQL["imported_rules"])
