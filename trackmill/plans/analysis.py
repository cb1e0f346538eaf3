"""Detectors, decoders, generators and candidates, end to end."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as M
from ..operators import decoding as D
from ..operators import detectors as T
from ..operators import generators as N
from ..operators import grids as G
from ..operators import trajectory as J
from .registry import EVENTS, events, query, table
from .temporal import HOUR

STATES = 3


def lattice(spark, sf_dir):
    """Three states for each event of a user, and the moves between neighbours; the highest can't fall to the lowest."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    obs = events(spark, sf_dir).select("user_id", F.row_number().over(w).alias("obs"), "value")
    states = F.sequence(F.lit(0), F.lit(STATES - 1))
    near = F.col("value") / 50 - F.col("candidate")
    candidates = obs.select("user_id", "obs", "value", F.explode(states).alias("candidate")).select("user_id", "obs", "candidate", (-near * near).alias("emission"))
    moves = obs.filter("obs > 1").select("user_id", "obs", F.explode(states).alias("previous")).select("*", F.explode(states).alias("candidate")).filter("NOT (previous = 2 AND candidate = 0)")
    return candidates, moves.withColumn("score", -0.5 * F.abs(F.col("previous") - F.col("candidate")))


@query(f"""
WITH RECURSIVE {EVENTS}, o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i, value / 50 AS v FROM ev),
r AS (SELECT user_id, i, -v * v AS s0, -(v - 1) * (v - 1) AS s1, -(v - 2) * (v - 2) AS s2 FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.i, greatest(s0, s1 - 0.5) - v * v, greatest(s0 - 0.5, s1, s2 - 0.5) - (v - 1) * (v - 1), greatest(s0 - 1.0, s1 - 0.5, s2) - (v - 2) * (v - 2) FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT user_id, i AS n, round(greatest(s0, s1, s2), 5) AS score FROM r WHERE i = (SELECT max(i) FROM o WHERE o.user_id = r.user_id)
""")
def best_path_score(spark, sf_dir):
    """The score of each sequence's best path through its candidates."""
    candidates, moves = lattice(spark, sf_dir)
    return D.path_scores(candidates, moves, ["user_id"]).join(candidates.groupBy("user_id").agg(F.max("obs").alias("n")), "user_id").select("user_id", F.col("n").cast("long").alias("n"), F.round("score", 5).alias("score"))


@query(f"""
WITH RECURSIVE {EVENTS}, o AS MATERIALIZED (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i, value / 50 AS v FROM ev),
e AS MATERIALIZED (SELECT user_id, i, [CAST(round(-(v - c) * (v - c) / 1e-9) AS BIGINT) FOR c IN range(3)] AS e FROM o),
r AS (SELECT user_id, i, [{{'n': -e[c + 1], 'p': CAST(c AS VARCHAR)}} FOR c IN range(3)] AS h FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, flatten([list_sort([{{'n': x.n + CAST(500000000 * abs(CAST(x.p[-1:] AS BIGINT) - c) AS BIGINT) - e.e[c + 1], 'p': x.p || c}} FOR x IN list_filter(r.h, lambda y: NOT (y.p[-1:] = '2' AND c = 0))])[1:2] FOR c IN range(3)])
  FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1),
b AS (SELECT user_id, i AS n, list_sort(h) AS h FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1),
u AS (SELECT *, unnest(range(1, n + 1)) AS obs FROM b)
SELECT user_id, CAST(obs AS INTEGER) AS obs, CAST(h[1].p[obs:obs] AS INTEGER) AS candidate, CAST(h[2].p[obs:obs] AS INTEGER) AS runner_up, round(-h[1].n * 1e-9, 9) AS score, round((h[2].n - h[1].n) * 1e-9, 9) AS separation,
  coalesce(h[2].n - h[1].n <= 1000000000, false) AS ambiguous, coalesce(h[2].n - h[1].n <= 1000000000 AND h[1].p[obs:obs] <> h[2].p[obs:obs], false) AS point_ambiguous, 'decoded' AS state FROM u
""")
def decoded_path(spark, sf_dir):
    """The candidates along the best path and the runner-up, and where the two are too close to tell."""
    return D.decode(*lattice(spark, sf_dir), ["user_id"]).drop("runner_score").withColumns({c: F.round(c, 9) for c in ("score", "separation")})


@query()
def robust_fits(spark, sf_dir):
    """Robust local cubics and their derivatives; tested against exact cubics with outliers."""
    return D.robust_fit(events(spark, sf_dir), ["user_id"], "event_id", F.col("us") / float(HOUR), "value")


#: Above this a trajectory has a gap.
PAUSE = 12 * HOUR


def track(spark, sf_dir):
    """Each user's values as positions on one axis, equal times once; and a time asked for with each event, up to four hours behind it."""
    ev = events(spark, sf_dir)
    samples = ev.groupBy("user_id", "us").agg(F.avg("value").alias("x")).select("user_id", (F.col("us") * 1000).alias("t"), "x")
    return samples, ev.select("user_id", "event_id", ((F.col("us") + F.col("event_id") % 5 * HOUR) * 1000).alias("t"))


@query(f"""
WITH {EVENTS}, s AS (SELECT DISTINCT user_id, us AS t FROM ev), c AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > {PAUSE} THEN 1 ELSE 0 END AS cut FROM s),
g AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY t) AS seg FROM c), z AS (SELECT user_id, seg, count(*) AS n FROM g GROUP BY ALL),
q AS (SELECT user_id, event_id, us + event_id % 5 * {HOUR} AS t FROM ev),
j AS (SELECT q.user_id, event_id, max(CASE WHEN g.t = q.t THEN seg END) AS e, arg_max(seg, g.t) FILTER (g.t < q.t) AS l, arg_min(seg, g.t) FILTER (g.t > q.t) AS r FROM q JOIN g USING (user_id) GROUP BY ALL)
SELECT j.user_id, event_id, CASE WHEN e IS NULL AND (l IS NULL OR r IS NULL) THEN 'OUTSIDE_SOURCE_SUPPORT' WHEN e IS NULL AND l <> r THEN 'UNSUPPORTED_GAP' WHEN n < 4 THEN 'INSUFFICIENT_DERIVATIVE_SUPPORT' ELSE 'SUPPORTED' END AS state
FROM j LEFT JOIN z ON z.user_id = j.user_id AND z.seg = coalesce(e, l)
""")
def trajectory_support(spark, sf_dir):
    """D3: whether a trajectory is known at a time: between samples of one segment that has enough of them."""
    samples, queries = track(spark, sf_dir)
    return J.located(J.numbered(samples, ["user_id"], "t", PAUSE * 1000), queries, ["user_id"], "t", "event_id").select("user_id", "event_id", "state")


@query()
def trajectory_fits(spark, sf_dir):
    """M7, D3: value and derivatives at any supported time; tested against one window at a time."""
    samples, queries = track(spark, sf_dir)
    return J.evaluated(samples, queries, ["user_id"], "t", "event_id", ["x"], PAUSE * 1000, HOUR * 1000.0)


@query(f"""
WITH {EVENTS}, r AS (SELECT *, CASE WHEN event_id % 9 > 0 THEN avg(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS fit, value - lag(value) OVER (PARTITION BY user_id ORDER BY us, event_id) AS step,
  (lead(value) OVER (PARTITION BY user_id ORDER BY us, event_id) - lag(value) OVER (PARTITION BY user_id ORDER BY us, event_id)) / 2 AS slope FROM ev),
x AS (SELECT r.*, EXISTS (SELECT 1 FROM r j WHERE j.user_id = r.user_id AND j.value > 95 AND abs(j.us - r.us) <= {6 * HOUR}) AS out FROM r),
e AS (SELECT *, CASE WHEN NOT out THEN abs(fit - value) END AS p, CASE WHEN NOT out THEN abs(step - slope) END AS v FROM x)
SELECT user_id, count(*) AS rows, count(*) FILTER (out) AS excluded, count(*) FILTER (NOT out AND p IS NULL) AS missing_position, round(max(p), 6) AS worst_position, round(sqrt(avg(p * p)), 6) AS rms_position,
  count(*) FILTER (NOT out AND v IS NULL) AS missing_velocity, round(max(v), 6) AS worst_velocity, round(sqrt(avg(v * v)), 6) AS rms_velocity FROM e GROUP BY user_id
""")
def truth_errors(spark, sf_dir):
    """Errors of smoothed values and of steps against the truth, outside six hours around jumps."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    rows = events(spark, sf_dir).withColumns({
        "fit": F.when(F.col("event_id") % 9 > 0, F.avg("value").over(w.rowsBetween(-2, 2))), "step": F.col("value") - F.lag("value").over(w), "slope": (F.lead("value").over(w) - F.lag("value").over(w)) / 2,
    })
    found = J.errors(rows, rows.filter("value > 95"), ["user_id"], "us", {"position": ("fit", "value"), "velocity": ("step", "slope")}, 6 * HOUR)
    return found.withColumns({c: F.round(c, 6) for c in found.columns if c.startswith(("worst", "rms"))})


#: Arcs from each nation's place on a 5 x 5 grid to the next; observations are points of the embeddings, spread over the grid.
ARC_SQL = "arc AS (SELECT n_nationkey AS arc, CAST(n_nationkey % 5 * 20 AS DOUBLE) AS x0, CAST(n_nationkey // 5 * 20 AS DOUBLE) AS y0, CAST((n_nationkey + 1) % 5 * 20 AS DOUBLE) AS x1, CAST(n_nationkey // 5 * 20 + 20 AS DOUBLE) AS y1 FROM nation)"


@query(f"""
WITH {ARC_SQL}, o AS (SELECT vec_id AS obs, 50 + CAST(embedding[1] AS DOUBLE) * 120 AS px, 50 + CAST(embedding[2] AS DOUBLE) * 120 AS py FROM embeddings),
t AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS length, greatest(0, least(1, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / ((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)))) AS t FROM o CROSS JOIN arc),
d AS (SELECT obs, arc, t * length AS along, sqrt((px - x0 - t * (x1 - x0)) * (px - x0 - t * (x1 - x0)) + (py - y0 - t * (y1 - y0)) * (py - y0 - t * (y1 - y0))) AS "lateral" FROM t),
r AS (SELECT *, round(-0.5 * ("lateral" / 4) * ("lateral" / 4) - ln(4) - {0.9189385332046727}, 6) AS score FROM d WHERE "lateral" <= 15)
SELECT obs, CAST(row_number() OVER (PARTITION BY obs ORDER BY score DESC, round("lateral", 6), arc) AS INTEGER) AS rank, arc, round("lateral", 6) AS "lateral", round(along, 6) AS along, score FROM r
""")
def road_candidates(spark, sf_dir):
    """Arcs within reach of each observation, found through the grid cells that arcs touch, best first, at most 16."""
    n = F.col("n_nationkey")
    grid = table(spark, sf_dir, "nation").select(n.alias("arc"), *[x.cast("double").alias(c) for c, x in (("x0", n % 5 * 20), ("y0", F.floor(n / 5) * 20), ("x1", (n + 1) % 5 * 20), ("y1", F.floor(n / 5) * 20 + 20))])
    radius = 15.0
    reach = lambda a, b: F.sequence(F.floor((F.least(a, b) - radius) / radius), F.floor((F.greatest(a, b) + radius) / radius))
    placed = grid.withColumn("cx", F.explode(reach(F.col("x0"), F.col("x1")))).withColumn("cy", F.explode(reach(F.col("y0"), F.col("y1"))))
    obs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("obs"), *[(50 + F.col("embedding")[k].cast("double") * 120).alias(c) for k, c in ((0, "px"), (1, "py"))])
    near = obs.withColumns({"cx": G.cell(F.col("px"), radius), "cy": G.cell(F.col("py"), radius)}).join(placed, ["cx", "cy"])
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("px") - F.col("x0")) * dx + (F.col("py") - F.col("y0")) * dy) / (dx * dx + dy * dy)))
    foot = near.withColumn("t", share).withColumn("lateral", F.sqrt((F.col("px") - F.col("x0") - F.col("t") * dx) * (F.col("px") - F.col("x0") - F.col("t") * dx) + (F.col("py") - F.col("y0") - F.col("t") * dy) * (F.col("py") - F.col("y0") - F.col("t") * dy))).filter(F.col("lateral") <= radius)
    score = F.round(M.gauss(F.col("lateral"), F.lit(4.0)), 6)
    found = foot.select("obs", "arc", F.round("lateral", 6).alias("lateral"), F.round(F.col("t") * F.sqrt(dx * dx + dy * dy), 6).alias("along"), score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("obs").orderBy(F.desc("score"), "lateral", "arc"))
    return found.withColumn("rank", rank).filter("rank <= 16").select("obs", "rank", "arc", "lateral", "along", "score")


SAMPLES = 200


def trajectories(spark, sf_dir):
    return N.trajectories(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("seq")), "seq", SAMPLES)


@query("""
WITH r AS (SELECT CAST(n_nationkey AS BIGINT) AS seq, n_nationkey % 8 AS k, CAST(i AS INTEGER) AS idx, i * CAST(0.1 AS DOUBLE) AS t FROM nation CROSS JOIN range(200) g(i))
SELECT seq, ['straight', 'constant_radius_turn', 'stop_start', 'parallel_roads', 'ramp', 'overpass', 'off_map_connection', 'stationary'][k + 1] AS scenario, idx, idx * 100000000::BIGINT AS time_ns,
  round(CASE k WHEN 1 THEN 100 * sin(0.1 * t) WHEN 2 THEN 10 * (least(t, 5) + greatest(t - 10, 0)) WHEN 7 THEN 0 ELSE 10 * t END, 6) AS x,
  round(CASE k WHEN 1 THEN 100 * (1 - cos(0.1 * t)) WHEN 3 THEN 4 WHEN 6 THEN 0.02 * t * t ELSE 0 END, 6) AS y, round(CASE k WHEN 4 THEN 0.5 * t WHEN 5 THEN 6 ELSE 0 END, 6) AS z FROM r
""")
def synthetic_trajectories(spark, sf_dir):
    """Eight analytic scenarios at ten samples a second."""
    return trajectories(spark, sf_dir).select("seq", "scenario", "idx", "time_ns", *[F.round(c, 6).alias(c) for c in "xyz"])


def faulty(spark, sf_dir):
    seq = F.col("seq")
    made = trajectories(spark, sf_dir)
    made = N.position_jump(made, seq % 5 == 1, 80, 30.0)
    made = N.position_bias(made, seq % 5 == 2, 100, 120, 2.0)
    made = N.position_freeze(made, "seq", (seq % 5 == 3) & (F.col("scenario") != "stationary"), 60, 75)
    return N.time_shift(made, seq % 5 == 4, 150, 300_000_000)


@query("""
WITH s AS (SELECT CAST(n_nationkey AS BIGINT) AS seq, n_nationkey % 8 AS k FROM nation)
SELECT seq, 'time_ns' AS field, 50 AS changed FROM s WHERE seq % 5 = 4
UNION ALL SELECT seq, 'y', 1 FROM s WHERE seq % 5 = 1 UNION ALL SELECT seq, 'y', 20 FROM s WHERE seq % 5 = 2
UNION ALL SELECT seq, 'x', 14 FROM s WHERE seq % 5 = 3 AND k NOT IN (2, 7)
UNION ALL SELECT seq, 'y', 14 FROM s WHERE seq % 5 = 3 AND k IN (1, 6) UNION ALL SELECT seq, 'z', 14 FROM s WHERE seq % 5 = 3 AND k = 4
""")
def injected_changes(spark, sf_dir):
    """Cells that injected faults changed, found by comparing the derivative with its source."""
    return N.differences(trajectories(spark, sf_dir).drop("scenario"), faulty(spark, sf_dir).drop("scenario"), ["seq", "idx"]).groupBy("seq", "field").agg(F.count("*").cast("int").alias("changed"))


@query("""
WITH s AS (SELECT CAST(n_nationkey AS BIGINT) AS seq, n_nationkey % 8 AS k FROM nation)
SELECT seq, 'position_jump' AS primary_rule, 'CRITICAL' AS severity, 1 AS events FROM s WHERE seq % 5 = 1
UNION ALL SELECT seq, 'position_jump', 'CRITICAL', 2 FROM s WHERE seq % 5 = 2
UNION ALL SELECT seq, 'gap', 'WARNING', 1 FROM s WHERE seq % 5 = 4
UNION ALL SELECT seq, 'position_jump', 'CRITICAL', 1 FROM s WHERE seq % 5 = 3 AND k NOT IN (2, 7)
UNION ALL SELECT seq, 'acceleration_limit', 'WARNING', CASE WHEN seq % 5 = 2 THEN 1 ELSE 2 END FROM s WHERE k = 2
""")
def trajectory_events(spark, sf_dir):
    """Each injected fault is found where it was put, and clean sequences stay silent, but for two stops in no time.

    Eight of the twelve rules: jerk, yaw rate, reference positions and domains have queries of their own. A bias that begins as a
    sequence starts again is one event with it.
    """
    got = T.trajectory_events(T.trajectory_failures(faulty(spark, sf_dir), "seq"), "seq")
    return got.groupBy("seq", "primary_rule", "severity").agg(F.count("*").cast("int").alias("events"))


FRAMES = "fr AS (SELECT l_suppkey % 50 AS seq, CAST(l_orderkey % 40 AS BIGINT) AS frame, l_linenumber AS ring, CAST(l_partkey % 16 AS BIGINT) AS sector, l_quantity, l_extendedprice, l_tax, l_orderkey % 977 AS ms FROM lineitem)"
METRICS = f"""{FRAMES}, m AS (SELECT seq, frame, count(*) AS n, count(*) FILTER (l_quantity < 49 AND l_extendedprice > 2000) AS valid, count(DISTINCT ring) FILTER (l_quantity < 49 AND l_extendedprice > 2000) AS rings,
  count(DISTINCT sector) FILTER (l_quantity < 49 AND l_extendedprice > 2000) AS sectors, max(ms) - min(ms) AS span FROM fr GROUP BY seq, frame),
d AS (SELECT *, coalesce(n / CAST(max(n) OVER (PARTITION BY seq ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 1.0) AS density, row_number() OVER (PARTITION BY seq ORDER BY frame) AS i FROM m)"""


def metrics(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("seq"), (F.col("l_orderkey") % 40).alias("frame"), F.col("l_linenumber").alias("ring"), (F.col("l_partkey") % 16).alias("sector"), "l_quantity", "l_extendedprice", (F.col("l_orderkey") % 977).alias("ms"))
    return T.frame_metrics(points, ["seq"], "frame", (F.col("l_quantity") < 49) & (F.col("l_extendedprice") > 2000), "ring", "sector", "ms")


@query(f"WITH {METRICS} SELECT seq, frame, n, valid, rings, sectors, span, round(density, 9) AS density FROM d")
def frame_metrics(spark, sf_dir):
    """One row of figures for each frame of points."""
    return metrics(spark, sf_dir).withColumn("density", F.round("density", 9))


@query(f"""
WITH {METRICS}, f AS (SELECT seq, frame, i, unnest(list_filter([CASE WHEN n < 25 THEN 'too_few_points' END, CASE WHEN rings < 7 THEN 'ring_missing' END, CASE WHEN sectors < 14 THEN 'sector_blank' END, CASE WHEN density < 0.7 THEN 'density_drop' END], lambda x: x IS NOT NULL)) AS rule FROM d),
g AS (SELECT *, sum(CASE WHEN i > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY seq, rule ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY seq, rule ORDER BY i) AS p FROM f))
SELECT seq, rule, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS frames FROM g GROUP BY seq, rule, run HAVING count(*) >= 2
""")
def point_cloud_events(spark, sf_dir):
    """Frame rules that fail in two or more frames in a row."""
    rules = {"too_few_points": F.col("n") < 25, "ring_missing": F.col("rings") < 7, "sector_blank": F.col("sectors") < 14, "density_drop": F.col("density") < 0.7}
    return T.frame_rule_events(metrics(spark, sf_dir), ["seq"], "frame", rules, 2)


@query(f"""
WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM ev WHERE event_type = 'error')
SELECT user_id, event_id, rn = 11 AS overflow, CASE WHEN rn = 11 THEN n - 10 ELSE 0 END AS left_out FROM r WHERE rn <= 11
""")
def capped_findings(spark, sf_dir):
    """Ten findings for each stream, and one marker for the rest."""
    return T.capped_findings(events(spark, sf_dir).filter("event_type = 'error'"), ["user_id"], ["event_id"], 10).select("user_id", "event_id", "overflow", "left_out")


@query("""
WITH w AS (SELECT c_custkey, map_from_entries([('kind', c_mktsegment), ('access', CASE WHEN c_nationkey % 4 = 0 THEN 'private' ELSE 'yes' END), ('oneway', CASE c_nationkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' ELSE 'no' END)]) AS tags FROM customer)
SELECT c_custkey, CASE WHEN tags['kind'] NOT IN ('HOUSEHOLD', 'BUILDING', 'MACHINERY') THEN 'kind_excluded' WHEN tags['access'] = 'private' THEN 'access_private' END AS excluded, coalesce(tags['oneway'] <> '-1', true) AS forward, coalesce(tags['oneway'] <> 'yes', true) AS reverse FROM w
""")
def way_inclusion(spark, sf_dir):
    """The first rule by which tags exclude a way, and the directions that they leave open."""
    n = F.col("c_nationkey")
    tags = F.create_map(F.lit("kind"), F.col("c_mktsegment"), F.lit("access"), F.when(n % 4 == 0, "private").otherwise("yes"), F.lit("oneway"), F.when(n % 3 == 0, "yes").when(n % 3 == 1, "-1").otherwise("no"))
    ways = table(spark, sf_dir, "customer").select("c_custkey", tags.alias("tags"))
    excluded = F.when(~F.col("tags")["kind"].isin("HOUSEHOLD", "BUILDING", "MACHINERY"), "kind_excluded").when(F.col("tags")["access"] == "private", "access_private")
    return ways.select("c_custkey", excluded.alias("excluded"), F.coalesce(F.col("tags")["oneway"] != "-1", F.lit(True)).alias("forward"), F.coalesce(F.col("tags")["oneway"] != "yes", F.lit(True)).alias("reverse"))
