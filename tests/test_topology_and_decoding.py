"""Topology mining and decoding in blocks, against plain versions and hand-made cases."""

import itertools
import math
import random

import pytest

from trackmill.operators import decoding, graphs, topology

LIMITS = topology.Limits(samples=5)


def alike(a, b):
    turn = lambda p: math.atan2(p[-1][1] - p[0][1], p[-1][0] - p[0][0])
    apart = [math.dist(p, q) for p, q in zip(a, b)]
    return abs(math.remainder(turn(a) - turn(b), 2 * math.pi)) <= LIMITS.heading and max(apart[0], apart[-1]) <= LIMITS.ends and sum(apart) / len(apart) <= LIMITS.mean


def plain_clusters(lines):
    groups = []
    for i in sorted(lines):
        home = next((g for g in groups if all(alike(lines[i], lines[m]) for m in g)), None)
        home.append(i) if home else groups.append([i])
    return {i: g[0] for g in groups for i in g}


@pytest.mark.parametrize("parts", [1, 6])
def test_clusters_are_those_of_one_task(spark, parts):
    r = random.Random(4)
    lines = {}
    for i in r.sample(range(10_000), 140):
        x, y, turn = r.choice([0, 30, 60, 400]), r.choice([0, 10, 20, 300]), r.choice([1, 1, -1])
        noise = [r.uniform(-9, 9) for _ in range(5)]
        lines[i] = [(x + turn * 50 * k + noise[k], y + 8 * k + noise[-k]) for k in range(5)]
    rows = [(i, k, *p) for i, line in lines.items() for k, p in enumerate(line)]
    samples = spark.createDataFrame(rows, "interval long, k int, x double, y double").repartition(parts)
    got = {r["interval"]: r["cluster"] for r in topology.clustered(samples, LIMITS).collect()}
    assert got == plain_clusters(lines) and 5 < len(set(got.values())) < 100
    assert topology.clustered(samples.limit(0), LIMITS).collect() == []


def test_nearest_in_growing_rings(spark):
    r = random.Random(6)
    nodes = [(i, r.randint(0, 200), r.randint(0, 200)) for i in range(150)]
    points = [(i, r.randint(-40, 240), r.randint(-40, 240)) for i in range(300)]
    n, p = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in nodes], "node long, x double, y double"), spark.createDataFrame([(i, float(x), float(y)) for i, x, y in points], "id long, x double, y double")
    for rings in (1, 4):
        got = {q["id"]: (q["apart"], q["node"]) for q in topology.nearest(p, "id", ["x", "y"], n, "node", ["x", "y"], 25.0, rings).collect()}
        for i, x, y in points:
            best = min((math.sqrt((x - a) ** 2 + (y - b) ** 2), j) for j, a, b in nodes)
            assert got[i] == (best if best[0] <= 25 else (None, None))
        assert len(got) == 300
    assert topology.nearest(p, "id", ["x", "y"], n.limit(0), "node", ["x", "y"], 25.0).filter("node IS NULL").count() == 300


def test_reasons_in_order(spark):
    rows = [(1, True, True, True, False, 0.9), (2, False, False, True, False, 0.9), (3, True, None, True, False, 0.9), (4, True, True, False, True, 0.0), (5, True, True, True, True, 0.0), (6, True, True, True, False, None), (7, True, True, True, False, 0.5), (8, True, True, True, None, 0.9), (9, None, True, True, False, 0.9)]
    intervals = spark.createDataFrame(rows, "interval long, off_map boolean, observable boolean, directed boolean, stationary boolean, quality double")
    points = [(i, k, 60.0 * k, 0.0) for i in (1, 7) for k in range(3)] + [(8, 0, 0.0, 0.0), (8, 1, 100.0, 0.0), (8, 2, 0.0, 0.0)]
    from trackmill.operators import polylines

    parts = polylines.segments(spark.createDataFrame(points, "interval long, nth int, x double, y double"), ["interval"], "nth", ["x", "y"])
    got = {r["interval"]: r["reason"] for r in topology.judged(intervals, parts, LIMITS).collect()}
    assert got == {1: None, 2: "not_off_map", 3: "unobservable", 4: "direction", 5: "stationary", 6: "quality", 7: None, 8: "no_span", 9: "not_off_map"}


def test_hypotheses_by_hand(spark):
    """Corridors between snapped nodes: no arc, a far arc, a near one, the wrong direction, too few traversals, and no node."""
    lines, k = [], range(5)
    for c, (x, y, n) in {1: (0, 0, 3), 2: (0, 1000, 3), 3: (0, 2000, 4), 4: (0, 3000, 3), 5: (0, 4000, 2), 6: (0, 5000, 9)}.items():
        lines += [(c, i, x + 25.0 * i, float(y), n, n) for i in k]
    nodes = [(10 * c + e, 100.0 * e + 3, 1000.0 * (c - 1)) for c in range(1, 6) for e in (0, 1)] + [(9, 3.0, 0.0)]
    arcs = [(200, 20, 21), (201, 20, 21), (300, 30, 31), (400, 41, 40), (500, 50, 51)]
    bend = {200: 90.0, 201: 80.0, 300: 10.0, 400: 0.0, 500: 90.0}
    place = {n: (x, y) for n, x, y in nodes}
    vertices = [(a, p, place[f][0] + (place[t][0] - place[f][0]) * p / 2, place[f][1] + (bend[a] if p == 1 else 0)) for a, f, t in arcs for p in range(3)]
    make = spark.createDataFrame
    found = topology.hypotheses(make(lines, "cluster long, k int, x double, y double, n_intervals long, n_traversals long"), make(nodes, "node long, x double, y double"), make(arcs, "arc long, from_node long, to_node long"), make(vertices, "arc long, pos int, x double, y double"), LIMITS)
    got = {r["cluster"]: (r["kind"], r["from_node"], r["to_node"], r["arc"], r["end_error"]) for r in found.collect()}
    assert got == {1: ("missing_connection", 9, 11, None, 3.0), 2: ("geometry_disagreement", 20, 21, 201, 3.0), 4: ("missing_connection", 40, 41, None, 3.0)}


def lattice(r, n, states, gaps=0.2):
    """Scores in whole units, so that sums are exact; some moves are impossible."""
    emissions = [{c: -r.randint(0, 6) * 0.25 for c in r.sample(range(states), r.randint(1, states))} for _ in range(n)]
    moves = [{}] + [{(p, c): -r.randint(0, 4) * 0.25 for p in emissions[i] for c in emissions[i + 1] if r.random() > gaps} for i in range(n - 1)]
    return emissions, moves


def tables(spark, sequences):
    c = [(k, i + s, x, e) for k, (s, em, _) in sequences.items() for i, step in enumerate(em) for x, e in step.items()]
    t = [(k, i + s, p, x, m) for k, (s, _, mv) in sequences.items() for i, step in enumerate(mv) for (p, x), m in step.items()]
    return spark.createDataFrame(c, "seq int, obs int, candidate int, emission double"), spark.createDataFrame(t, "seq int, obs int, previous int, candidate int, score double")


def all_paths(emissions, moves):
    out = []
    for path in itertools.product(*(sorted(e) for e in emissions)):
        steps = [moves[i].get((path[i - 1], path[i])) for i in range(1, len(path))]
        if None not in steps:
            out.append((-sum(steps) - sum(e[c] for e, c in zip(emissions, path)), list(path)))
    return [(-s, p) for s, p in sorted(out)]


@pytest.mark.parametrize(("block", "fan"), [(512, 64), (1, 2), (3, 2), (4, 3)])
def test_decoding_in_blocks_of_any_size(spark, block, fan):
    r = random.Random(11)
    sequences = {k: (r.choice([0, 5, 1000, -7]), *lattice(r, r.randint(1, 7), 3, r.choice([0, 0.3]))) for k in range(25)}
    # longer ones, compared with the beam search that keeps everything it needs
    sequences |= {k: (3, *lattice(r, 40, 4, 0.1)) for k in (100, 101)}
    rows = {}
    for x in decoding.decode(*tables(spark, sequences), ["seq"], block, fan).collect():
        rows.setdefault(x["seq"], []).append(x)
    lost = 0
    for k, (start, emissions, moves) in sequences.items():
        own = sorted(rows[k], key=lambda x: x["obs"])
        assert [x["obs"] for x in own] == list(range(start, start + len(emissions)))
        paths = all_paths(emissions, moves)[:2] if k < 100 else decoding.best_paths(emissions, moves, beam=10**6, delta=1e9)[:2]
        if not paths:
            lost += 1
            assert {(x["state"], x["candidate"], x["score"], x["ambiguous"]) for x in own} == {("no_path", None, None, False)}
            continue
        assert [x["candidate"] for x in own] == paths[0][1] and own[0]["score"] == pytest.approx(paths[0][0], abs=1e-6)
        if len(paths) == 1:
            assert {(x["runner_up"], x["separation"], x["ambiguous"]) for x in own} == {(None, None, False)}
            continue
        assert [x["runner_up"] for x in own] == paths[1][1] and own[0]["separation"] == pytest.approx(paths[0][0] - paths[1][0], abs=1e-6)
        near = paths[0][0] - paths[1][0] <= decoding.AMBIGUOUS
        assert [x["point_ambiguous"] for x in own] == [near and a != b for a, b in zip(paths[0][1], paths[1][1])] and {x["ambiguous"] for x in own} == {near}
    assert lost
    scores = {x["seq"]: x["score"] for x in decoding.path_scores(*tables(spark, sequences), ["seq"], block, fan).collect()}
    assert scores == {k: own[0]["score"] for k, own in rows.items() if own[0]["state"] == "decoded"}


def test_decoding_of_nothing_and_of_names(spark):
    c, t = tables(spark, {1: (0, [{1: 0.0, 2: -1.0}, {1: -1.0}], [{}, {(2, 1): 0.0}])})
    assert decoding.decode(c.limit(0), t, ["seq"]).collect() == []
    named = c.selectExpr("cast(seq as string) as seq", "obs", "concat('arc', candidate) as candidate", "emission")
    moves = t.selectExpr("cast(seq as string) as seq", "obs", "concat('arc', previous) as previous", "concat('arc', candidate) as candidate", "score")
    assert [(x["candidate"], x["runner_up"], x["score"]) for x in decoding.decode(named, moves, ["seq"], 1, 2).orderBy("obs").collect()] == [("arc2", None, -2.0), ("arc1", None, -2.0)]


def test_required_route_may_have_any_number_of_arcs(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 30, 1) for i in range(30)], "src long, dst long, len long")
    got = graphs.required_route(ring, spark.createDataFrame([(0,), (7,)], "src long"), [5, 12, 20], 40)
    assert {r["source"]: r["dist"] for r in got.collect()} == {0: 20, 7: 28}
    assert {r["source"]: r["dist"] for r in graphs.required_route(ring, spark.createDataFrame([(0,)], "src long"), [5, 12, 20], 19).collect()} == {0: None}


def test_tables_of_few_and_of_many_candidates_agree(monkeypatch):
    import pandas as pd

    r = random.Random(21)
    for _ in range(60):
        emissions, moves = lattice(r, r.randint(1, 8), 4, r.choice([0.1, 0.6]))
        rows = [(0, None, c, int(e * 4), 0, None) for c, e in emissions[0].items()]
        for i in range(1, len(moves)):
            rows += [(i, p, c, int((m + emissions[i][c]) * 4), 0, None) for (p, c), m in moves[i].items()] or [(i, None, None, None, 0, None)]
        frame, found = pd.DataFrame(rows, columns=["pos", "entry", "exit", "score", "rank", "order"]), []
        for dense in (0, 1 << 19):
            monkeypatch.setattr(decoding, "DENSE", dense)
            _, names, ends, parts = decoding._through(frame)
            (score, order), _ = decoding._chain(parts)
            ways = [(names[0][a], ends[-1][b], c, int(score[a, b, c]), int(order[a, b, c])) for a in range(score.shape[0]) for b in range(score.shape[1]) for c in range(2) if score[a, b, c] != decoding.NONE]
            found.append(sorted(ways, key=lambda w: (str(w[0]), w[4])))
        assert [w[:4] for w in found[0]] == [w[:4] for w in found[1]]


def test_blocks_side_by_side_are_those_one_by_one(monkeypatch):
    import pandas as pd

    r, rows = random.Random(5), []
    for k in range(40):
        emissions, moves = lattice(r, r.randint(1, 9), 3, r.choice([0.1, 0.6]))
        rows += [(k % 7, k, 0, None if k % 2 else c, c, int(e * 4), 0, None) for c, e in emissions[0].items()]
        for i in range(1, len(moves)):
            rows += [(k % 7, k, i, p, c, int((m + emissions[i][c]) * 4), 0, None) for (p, c), m in moves[i].items()] or [(k % 7, k, i, None, None, None, 0, None)]
    frame, found = pd.DataFrame(rows, columns=["seq", "block", "pos", "entry", "exit", "score", "rank", "order"]).sample(frac=1, random_state=1), []
    blocks = decoding._Blocks(frame, ["seq"], True)
    assert not blocks.many and len(blocks.batches) < 10
    side = {}
    for numbers, within, width in blocks.batches:
        score, _, _ = blocks.chain((numbers, within, width))
        for s, b in enumerate(numbers):
            side[b] = sorted(score[s][score[s] != decoding.NONE].tolist())
    monkeypatch.setattr(decoding, "DENSE", 0)
    for b, (_, _, _, parts) in decoding._Blocks(frame, ["seq"], True).many:
        (score, _), _ = decoding._chain(parts)
        found.append((b, sorted(score[score != decoding.NONE].tolist())))
    assert len(found) == 40 and dict(found) == side and any(side.values())
