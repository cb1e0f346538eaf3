"""Scoring by reviewers' decisions, by hand."""

from trackmill.operators import review


def test_scores_by_hand(spark):
    # 0 -3- 1 -4- 2 -5- 3; the third stands still, so only the first way counts for the first two, and none for it
    points = [(1, 0, 0.0, 0.0, 5.0), (1, 1, 3.0, 0.0, 5.0), (1, 2, 3.0, 4.0, 0.0), (1, 3, 8.0, 4.0, 5.0), (1, 4, 8.0, 6.0, 5.0), (2, 0, 0.0, 0.0, 0.0)]
    flags = {(1, 0): (True, 7, True, False), (1, 1): (True, 7, False, False), (1, 3): (False, None, True, False), (1, 4): (True, 9, True, None), (1, 2): (None, None, None, None), (2, 0): (True, 1, True, False)}
    rows = [(*p, *flags[p[:2]]) for p in points]
    df = spark.createDataFrame(rows, "k int, obs int, x double, y double, speed double, on_road boolean, arc int, confident boolean, stationary boolean")
    weighed = review.half_distances(df, ["k"], ["obs"], ["x", "y"], "speed", 1.0)
    assert {(r["k"], r["obs"]): r["weight"] for r in weighed.collect()} == {(1, 0): 1.5, (1, 1): 1.5, (1, 2): 0.0, (1, 3): 1.0, (1, 4): 1.0, (2, 0): 0.0}
    decisions = spark.createDataFrame([(1, 0, "DIRECTED_ARC", 7), (1, 1, "DIRECTED_ARC", 7), (1, 3, "OFF_MAP", None), (2, 0, "UNRESOLVED", 1)], "k int, obs int, label string, expected int")
    got = {r["k"]: r.asDict() for r in review.adjudicated(weighed, decisions, ["k"], "obs", 0.3).collect()}
    assert got[1] == {"k": 1, "distance": 5.0, "confident": 1.5, "manual": 3.0, "n_agree": 1, "n_off_map": 1, "open_distance": 1.0, "preserved": True, "agreement": 0.5, "accepted": True}
    assert got[2] == {"k": 2, "distance": 0.0, "confident": 0.0, "manual": 0.0, "n_agree": 0, "n_off_map": 0, "open_distance": 0.0, "preserved": False, "agreement": 0.0, "accepted": False}
    assert review.adjudicated(weighed, decisions.limit(0), ["k"], "obs", 0.3).filter("NOT preserved OR manual > 0").count() == 0
    assert review.adjudicated(weighed.limit(0), decisions, ["k"], "obs", 0.3).collect() == []
