"""Checks and runs along time, on the event stream: users are sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import islands as I
from .registry import EVENTS, events, query

MINUTE, HOUR = 60_000_000, 3_600_000_000


@query(f"""
WITH {EVENTS}, g AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap FROM ev),
i AS (SELECT *, sum(CASE WHEN gap > {30 * MINUTE} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(us) AS start_us, max(us) AS end_us, arg_min_null(gap, us) AS gap_before FROM i GROUP BY user_id, island
""")
def gap_events(spark, sf_dir):
    """Islands of events without a gap of more than 30 minutes, with the gap before each."""
    marked = I.gap_islands(events(spark, sf_dir), ["user_id"], "us", "event_id", 30 * MINUTE)
    return marked.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.min_by("gap_before", F.struct("us", "event_id")).alias("gap_before"))


SOURCE = "(event_id * 37) % 1009"


@query(f"""
WITH {EVENTS}, s AS (SELECT user_id, us // {HOUR} AS t, {SOURCE} AS src, event_id FROM ev),
d AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY src, event_id) AS step FROM s)
SELECT user_id, count(*) FILTER (step = 0) AS duplicates, count(*) FILTER (step < 0) AS regressions, count(*) FILTER (step > 24) AS gaps, count(*) FILTER (step > 0) AS forward FROM d GROUP BY user_id
""")
def source_order_checks(spark, sf_dir):
    """Duplicates, regressions and gaps between neighbours in source order, not in time order."""
    rows = events(spark, sf_dir).select("user_id", "event_id", F.floor(F.col("us") / HOUR).alias("t"), F.expr(SOURCE).alias("src"))
    step = rows.select("user_id", (F.col("t") - F.lag("t").over(I.over(["user_id"], "src", "event_id"))).alias("step"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return step.groupBy("user_id").agg(count(F.col("step") == 0).alias("duplicates"), count(F.col("step") < 0).alias("regressions"), count(F.col("step") > 24).alias("gaps"), count(F.col("step") > 0).alias("forward"))


@query(f"""
WITH {EVENTS}, l AS (SELECT *, lag(us) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS p FROM ev)
SELECT user_id, event_type, count(*) AS n, min(us) AS first_us, max(us) AS last_us, coalesce(bool_and(us >= p), true) AS nondecreasing, count(*) - count(DISTINCT us // {HOUR}) AS duplicates FROM l GROUP BY user_id, event_type
""")
def range_summary(spark, sf_dir):
    """Count, range, order and duplicates of each stream."""
    rows = events(spark, sf_dir).withColumn("p", F.lag("us").over(I.over(["user_id", "event_type"], "event_id")))
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.coalesce(F.bool_and(F.col("us") >= F.col("p")), F.lit(True)).alias("nondecreasing"), (F.count("*") - F.count_distinct(F.floor(F.col("us") / HOUR))).alias("duplicates"))


@query(f"""
WITH {EVENTS} SELECT event_id, user_id, us // {HOUR} AS hour, nth FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id, event_type, us // {HOUR} ORDER BY event_id) AS INTEGER) AS nth FROM ev) WHERE nth > 1
""")
def duplicate_keys(spark, sf_dir):
    """A2: the second and later rows of each key."""
    rows = events(spark, sf_dir).withColumn("hour", F.floor(F.col("us") / HOUR))
    return rows.withColumn("nth", F.row_number().over(I.over(["user_id", "event_type", "hour"], "event_id"))).filter("nth > 1").select("event_id", "user_id", "hour", "nth")


INTERVALS = f"iv AS (SELECT event_id, user_id, event_type, value, us AS s, us + CAST(round(value * {MINUTE}) AS BIGINT) AS e FROM ev)"


def intervals(spark, sf_dir):
    """Each event as an interval of `value` minutes."""
    return events(spark, sf_dir).select("event_id", "user_id", "event_type", "value", F.col("us").alias("s"), (F.col("us") + F.round(F.col("value") * MINUTE).cast("long")).alias("e"))


@query(f"""
WITH {EVENTS}, {INTERVALS}, m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
i AS (SELECT *, sum(CASE WHEN s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m),
u AS (SELECT user_id, island, max(e) - min(s) AS d FROM i GROUP BY user_id, island)
SELECT user_id, CAST(sum(d) AS BIGINT) AS covered, count(*) AS n_islands FROM u GROUP BY user_id
""")
def merged_duration(spark, sf_dir):
    """A4: time covered by the union of each user's intervals; days are merged first, so that a hot user is split."""
    return I.merged_duration(intervals(spark, sf_dir), ["user_id"], "s", "e", 24 * HOUR)


@query(f"""
WITH {EVENTS}, {INTERVALS}, m AS (SELECT *, max(e) OVER (PARTITION BY user_id, event_type ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv)
SELECT event_id, user_id, event_type, CAST(sum(CASE WHEN s > reach + {300 * MINUTE} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY s, e, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ordinal FROM m
""")
def traversal_ordinal(spark, sf_dir):
    """The number of each pass; a new one begins more than 300 minutes after the largest end so far."""
    return I.reach_islands(intervals(spark, sf_dir), ["user_id", "event_type"], "s", "e", "event_id", 300 * MINUTE, "ordinal").select("event_id", "user_id", "event_type", "ordinal")


@query(f"""
WITH {EVENTS}, r AS (SELECT *, event_type IN ('view', 'click') AS on_road, value < 20 AS slow FROM ev),
f AS (SELECT *, CASE WHEN lag(user_id) OVER w IS NULL OR (on_road = lag(on_road) OVER w AND slow = lag(slow) OVER w) THEN 0 ELSE 1 END AS f FROM r WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY us, event_id)) AS moved FROM f)
SELECT user_id, CAST(island AS BIGINT) AS island, on_road, slow, count(*) AS n, min(us) AS start_us, max(us) AS end_us, round(sum(CASE WHEN on_road AND NOT slow THEN coalesce(moved, 0) ELSE 0 END), 6) AS usable FROM i GROUP BY user_id, island, on_road, slow
""")
def matched_runs(spark, sf_dir):
    """Maximal runs of equal state, with the distance that is usable in them."""
    rows = events(spark, sf_dir).withColumn("on_road", F.col("event_type").isin("view", "click")).withColumn("slow", F.col("value") < 20)
    rows = rows.withColumn("moved", F.abs(F.col("value") - F.lag("value").over(I.over(["user_id"], "us", "event_id"))))
    runs = I.equal_runs(rows, ["user_id"], ["us", "event_id"], F.struct("on_road", "slow"))
    usable = F.when(F.col("on_road") & ~F.col("slow"), F.coalesce("moved", F.lit(0.0))).otherwise(0.0)
    return runs.groupBy("user_id", "island", "on_road", "slow").agg(F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.round(F.sum(usable), 6).alias("usable"))


@query(f"""
WITH {EVENTS}, f AS (SELECT *, value <= 60 AS slow, CASE WHEN (value <= 60) = lag(value <= 60) OVER (PARTITION BY user_id ORDER BY us, event_id) THEN 0 ELSE 1 END AS f FROM ev),
i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f),
a AS (SELECT *, first_value(value) OVER (PARTITION BY user_id, run ORDER BY us, event_id) AS v0 FROM i),
g AS (SELECT user_id, run, min(us) AS start_us, max(us) AS end_us, count(*) AS n, max(abs(value - v0)) AS spread FROM a WHERE slow GROUP BY user_id, run)
SELECT user_id, start_us, end_us, n, round(spread, 6) AS spread FROM g WHERE n >= 2 AND end_us - start_us >= {30 * MINUTE} AND spread <= 40
""")
def stationary_runs(spark, sf_dir):
    """Runs of slow samples that last long enough and stay near their first."""
    runs = I.equal_runs(events(spark, sf_dir).withColumn("slow", F.col("value") <= 60), ["user_id"], ["us", "event_id"], F.col("slow"), "run").filter("slow")
    placed = runs.withColumn("v0", F.first("value").over(I.over(["user_id", "run"], "us", "event_id")))
    found = placed.groupBy("user_id", "run").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n"), F.max(F.abs(F.col("value") - F.col("v0"))).alias("spread"))
    return found.filter((F.col("n") >= 2) & (F.col("end_us") - F.col("start_us") >= 30 * MINUTE) & (F.col("spread") <= 40)).select("user_id", "start_us", "end_us", "n", F.round("spread", 6).alias("spread"))


@query(f"""
WITH {EVENTS}, n AS (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN value END AS v FROM ev)
SELECT event_id, user_id, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING),
  first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS held FROM n
""")
def held_value(spark, sf_dir):
    """An unknown value takes the last known one, else the next."""
    rows = events(spark, sf_dir).withColumn("v", F.when(F.col("event_type").isin("view", "click"), F.col("value")))
    return I.hold(rows, ["user_id"], ["us", "event_id"], "v", "held").select("event_id", "user_id", "held")


@query(f"""
WITH {EVENTS}, a AS (SELECT *, value - 360 * floor(value / 360) AS angle FROM ev),
d AS (SELECT *, angle - lag(angle) OVER (PARTITION BY user_id ORDER BY us, event_id) AS step FROM a)
SELECT event_id, round(angle + 360 * sum(CASE WHEN step > 180 THEN -1 WHEN step < -180 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING), 6) AS heading FROM d
""")
def unwrapped_heading(spark, sf_dir):
    """Angles made continuous."""
    rows = events(spark, sf_dir).withColumn("angle", F.col("value") - 360 * F.floor(F.col("value") / 360))
    return I.unwrap(rows, ["user_id"], ["us", "event_id"], "angle", 360.0, "heading").select("event_id", F.round("heading", 6).alias("heading"))


@query(f"""
WITH {EVENTS}, c AS (SELECT user_id, us // {24 * HOUR} AS day, count(*) AS n FROM ev GROUP BY ALL)
SELECT user_id, day, n, round(coalesce(n / CAST(max(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 1.0), 6) AS ratio FROM c
""")
def running_max_ratio(spark, sf_dir):
    """A frame's count against the largest of the frames before it; 1 for the first."""
    counts = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("us") / (24 * HOUR)).alias("day")).agg(F.count("*").alias("n"))
    before = F.max("n").over(I.over(["user_id"], "day").rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("user_id", "day", "n", F.round(F.coalesce(F.col("n") / before, F.lit(1.0)), 6).alias("ratio"))


@query(f"""
WITH {EVENTS}, d AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS step FROM ev)
SELECT user_id, coalesce(CAST(trunc(quantile_cont(step, 0.5) FILTER (step > 0)) AS BIGINT), 1) AS stride, count(*) FILTER (abs(step - {90 * MINUTE}) > {60 * MINUTE}) AS off_cadence FROM d GROUP BY user_id
""")
def median_stride(spark, sf_dir):
    """The median positive step, and the steps that miss the model's cadence."""
    step = events(spark, sf_dir).select("user_id", (F.col("us") - F.lag("us").over(I.over(["user_id"], "us", "event_id"))).alias("step"))
    return step.groupBy("user_id").agg(F.coalesce(F.percentile(F.when(F.col("step") > 0, F.col("step")), 0.5).cast("long"), F.lit(1)).alias("stride"), F.count_if(F.coalesce(F.abs(F.col("step") - 90 * MINUTE) > 60 * MINUTE, F.lit(False))).alias("off_cadence"))


@query(f"""
WITH {EVENTS}, f AS (SELECT *, first_value(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS e0 FROM ev)
SELECT user_id, count(*) FILTER (event_type <> e0) AS mismatches, bool_and(event_type = e0) AS continuous FROM f GROUP BY user_id
""")
def domain_continuity(spark, sf_dir):
    """Rows whose domain differs from the sequence's first."""
    rows = events(spark, sf_dir).withColumn("e0", F.first("event_type").over(I.over(["user_id"], "us", "event_id")))
    return rows.groupBy("user_id").agg(F.count_if(F.col("event_type") != F.col("e0")).alias("mismatches"), F.bool_and(F.col("event_type") == F.col("e0")).alias("continuous"))


@query(f"""
WITH RECURSIVE {EVENTS}, j AS (SELECT event_id, user_id, us, CASE WHEN event_id % 3 = 0 THEN -value ELSE value END AS jump, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM ev),
c AS (SELECT *, coalesce(jump * lead(jump) OVER w < 0 AND abs(jump + lead(jump) OVER w) <= greatest(10, 0.25 * greatest(abs(jump), abs(lead(jump) OVER w))), false) AS can FROM j WINDOW w AS (PARTITION BY user_id ORDER BY rn)),
r AS (SELECT event_id, user_id, rn, can, can AS leads, CAST(CASE WHEN can THEN 'first' END AS VARCHAR) AS pair_role FROM c WHERE rn = 1
  UNION ALL SELECT c.event_id, c.user_id, c.rn, c.can, c.can AND NOT r.leads, CASE WHEN r.leads THEN 'second' WHEN c.can THEN 'first' END FROM r JOIN c ON c.user_id = r.user_id AND c.rn = r.rn + 1)
SELECT event_id, pair_role FROM r
""")
def paired_jumps(spark, sf_dir):
    """Opposite neighbouring jumps that cancel are paired from the left, each used once."""
    w = I.over(["user_id"], "us", "event_id")
    rows = events(spark, sf_dir).withColumn("jump", F.when(F.col("event_id") % 3 == 0, -F.col("value")).otherwise(F.col("value"))).withColumn("after", F.lead("jump").over(w))
    cancels = (F.col("jump") * F.col("after") < 0) & (F.abs(F.col("jump") + F.col("after")) <= F.greatest(F.lit(10.0), 0.25 * F.greatest(F.abs("jump"), F.abs("after"))))
    return I.alternate_pairs(rows, ["user_id"], ["us", "event_id"], cancels).select("event_id", "pair_role")


@query(f"""
WITH {EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM ev), z AS (SELECT *, i + 1 + event_id % 3 AS stop FROM n WHERE value <= 40),
g AS (SELECT *, CASE WHEN i > lag(stop) OVER (PARTITION BY user_id ORDER BY i) THEN 1 ELSE 0 END AS f FROM z), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM g),
t AS (SELECT user_id, run, min(us) AS start_us, max(us) AS end_us, count(*) AS n, max(stop) AS stop FROM s GROUP BY user_id, run)
SELECT user_id, start_us, end_us, n, stop FROM t WHERE end_us - start_us >= {HOUR}
""")
def frozen_spans(spark, sf_dir):
    """Freezes that touch by index become one; those that last long enough stay."""
    rows = events(spark, sf_dir).withColumn("i", F.row_number().over(I.over(["user_id"], "us", "event_id"))).filter("value <= 40").withColumn("stop", F.col("i") + 1 + F.col("event_id") % 3)
    runs = I.number_islands(rows.withColumn("p", F.lag("stop").over(I.over(["user_id"], "i"))), ["user_id"], ["i"], F.col("i") > F.col("p"), "run")
    found = runs.groupBy("user_id", "run").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("n"), F.max("stop").alias("stop"))
    return found.filter(F.col("end_us") - F.col("start_us") >= HOUR).select("user_id", "start_us", "end_us", "n", "stop")


RANK = "CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 4 END"


@query(f"""
WITH {EVENTS}, {INTERVALS}, m AS (SELECT *, {RANK} AS rank, max(e) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
i AS (SELECT *, sum(CASE WHEN s > reach + {30 * MINUTE} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, CAST(island AS BIGINT) AS island, min(s) AS start_us, max(e) AS end_us, arg_min(event_type, [rank, event_id]) AS primary_rule, min(s) FILTER (rank <= 1) AS boundary_us, count(DISTINCT event_type) AS n_rules, max(value) AS worst FROM i GROUP BY user_id, island
""")
def consolidated_events(spark, sf_dir):
    """Failures within 30 minutes become one event, named by the rule of highest priority."""
    rows = I.reach_islands(intervals(spark, sf_dir).withColumn("rank", F.expr(RANK)), ["user_id"], "s", "e", "event_id", 30 * MINUTE)
    return rows.groupBy("user_id", "island").agg(F.min("s").alias("start_us"), F.max("e").alias("end_us"), F.min_by("event_type", F.struct("rank", "event_id")).alias("primary_rule"), F.min(F.when(F.col("rank") <= 1, F.col("s"))).alias("boundary_us"), F.count_distinct("event_type").alias("n_rules"), F.max("value").alias("worst"))


@query(f"""
WITH {EVENTS}, f AS (SELECT user_id, event_type, us // {24 * HOUR} AS frame, max(value) AS worst, count(*) AS n FROM ev GROUP BY ALL),
g AS (SELECT *, sum(CASE WHEN frame > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(frame) OVER (PARTITION BY user_id, event_type ORDER BY frame) AS p FROM f)),
a AS (SELECT user_id, event_type, run, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS frames, max(worst) AS worst, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY user_id, event_type, run)
SELECT user_id, event_type, first_frame, last_frame, frames, worst, n FROM a WHERE frames >= 2
""")
def frame_events(spark, sf_dir):
    """One rule's failures in adjoining frames become one event, if at least two frames have them."""
    frames = events(spark, sf_dir).groupBy("user_id", "event_type", F.floor(F.col("us") / (24 * HOUR)).alias("frame")).agg(F.max("value").alias("worst"), F.count("*").alias("n"))
    keys = ["user_id", "event_type"]
    runs = I.number_islands(frames.withColumn("p", F.lag("frame").over(I.over(keys, "frame"))), keys, ["frame"], F.col("frame") > F.col("p") + 1, "run")
    return runs.groupBy(*keys, "run").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("frames"), F.max("worst").alias("worst"), F.sum("n").alias("n")).filter("frames >= 2").drop("run")


@query(f"""
WITH {EVENTS}, c AS (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS dist, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM ev)
SELECT user_id, 'distance' AS policy, CAST(floor(dist / 500) AS BIGINT) AS slot, count(*) AS n, round(avg(value), 6) AS mean FROM c GROUP BY ALL
UNION ALL SELECT user_id, 'duration', us // {48 * HOUR}, count(*), round(avg(value), 6) FROM c GROUP BY ALL
UNION ALL SELECT user_id, 'sequence', 0, count(*), round(avg(value), 6) FROM c GROUP BY ALL
UNION ALL SELECT user_id, 'frames', i, count(*) OVER w, round(avg(value) OVER w, 6) FROM c WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)
""")
def window_policies(spark, sf_dir):
    """Windows by distance, by duration, of neighbouring frames, and of the whole sequence."""
    w = I.over(["user_id"], "us", "event_id")
    rows = events(spark, sf_dir).withColumn("dist", F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("i", F.row_number().over(w).cast("long"))
    around = w.rowsBetween(-2, 2)
    frames = rows.select("user_id", F.lit("frames").alias("policy"), F.col("i").alias("slot"), F.count("*").over(around).alias("n"), F.round(F.avg("value").over(around), 6).alias("mean"))
    slots = F.array(F.struct(F.lit("distance").alias("policy"), F.floor(F.col("dist") / 500).alias("slot")), F.struct(F.lit("duration").alias("policy"), F.floor(F.col("us") / (48 * HOUR)).alias("slot")), F.struct(F.lit("sequence").alias("policy"), F.lit(0).cast("long").alias("slot")))
    cut = rows.select("user_id", "value", F.inline(slots)).groupBy("user_id", "policy", "slot").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return cut.unionByName(frames)
