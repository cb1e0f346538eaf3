"""Scalar functions on whole tables: scores, geometry, time, text, identities."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalars as S
from ..functions import scores as M
from .registry import EVENTS, events, query, table

P = M.PROFILE
PI = math.pi
WRAP = lambda a, b: f"abs(({a} - ({b}) + {PI}) - 2 * {PI} * floor(({a} - ({b}) + {PI}) / (2 * {PI})) - {PI})"
GAUSS = lambda r, s: f"(-0.5 * ({r} / {s}) * ({r} / {s}) - ln({s}) - {0.5 * math.log(2 * PI)})"


@query(f"""
WITH o AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_quantity / 2 AS side, l_discount * 100 AS u, l_tax * 50 AS speed, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount * 60 END AS heading, l_tax * 40 AS tangent FROM lineitem),
s AS (SELECT *, least({P.sigma_most}, sqrt({P.sigma_least * P.sigma_least} + u * u)) AS sigma, CAST(least(1, greatest(0, (speed - {P.heading_from}) / {P.heading_full - P.heading_from})) AS DOUBLE) AS w FROM o)
SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, round(least(greatest(greatest({P.radius_usual}, {P.radius_sigmas} * u), {P.radius_least}), {P.radius_most}), 6) AS radius,
  round({GAUSS('side', 'sigma')} + CASE WHEN heading IS NULL THEN 0 ELSE w * {GAUSS(WRAP('heading', 'tangent'), P.heading_sigma)} END, 6) AS score FROM s
""")
def emission_score(spark, sf_dir):
    """Search radii and emission scores."""
    u, heading = F.col("l_discount") * 100, F.when(F.col("l_linenumber") != 7, F.col("l_discount") * 60)
    score = M.emission(F.col("l_quantity") / 2, u, heading, F.col("l_tax") * 40, F.col("l_tax") * 50)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", F.round(M.search_radius(u), 6).alias("radius"), F.round(score, 6).alias("score"))


@query(f"""
WITH {EVENTS}, n AS (SELECT *, lead(value) OVER w AS v1, lead(us) OVER w AS t1, lead(event_type) OVER w AS k1 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
q AS (SELECT event_id, value AS graph, v1 AS observed, (t1 - us) / CAST(60000000 AS DOUBLE) AS secs, event_id % 3 AS turns, event_id % 11 = 0 AS uturn, event_type = 'error' AS f, k1 = 'error' AS t FROM n WHERE t1 IS NOT NULL)
SELECT event_id, round(CASE WHEN f AND t THEN {P.off_map_stay} WHEN f OR t THEN {P.off_map_change} WHEN secs > 0 AND graph / secs <= {P.top_speed}
  THEN -abs(graph - observed) / {P.distance_scale} - {P.speed_cost} * greatest(0, graph / secs - observed / secs - {P.speed_allowance}) - {P.turn_cost} * turns - {P.u_turn_cost} * CASE WHEN uturn THEN 1 ELSE 0 END END, 6) AS score,
  CASE WHEN secs <= 0 THEN 'time_not_increasing' WHEN event_id % 17 = 0 THEN 'forbidden_turn' WHEN event_id % 19 = 0 THEN 'unknown_restriction' WHEN graph / secs > {P.top_speed} THEN 'too_fast' END AS rejected FROM q
""")
def transition_score(spark, sf_dir):
    """Transition scores of neighbouring samples, and the first reason for which one is impossible."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    n = events(spark, sf_dir).select("*", F.lead("value").over(w).alias("v1"), F.lead("us").over(w).alias("t1"), F.lead("event_type").over(w).alias("k1")).filter("t1 IS NOT NULL")
    secs = (F.col("t1") - F.col("us")) / 60_000_000.0
    u_turn = F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)
    score = M.transition(F.col("value"), F.col("v1"), secs, F.col("event_id") % 3, u_turn, F.col("event_type") == "error", F.col("k1") == "error")
    rule = F.when(F.col("event_id") % 17 == 0, "FORBIDDEN").when(F.col("event_id") % 19 == 0, "UNKNOWN_RESTRICTION")
    return n.select("event_id", F.round(score, 6).alias("score"), M.rejection(F.col("value"), secs, rule).alias("rejected"))


@query(f"""
WITH {EVENTS}, s AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '-' ELSE '' END || CAST(event_id * 977 AS VARCHAR) || CASE WHEN event_id % 7 = 0 THEN '' ELSE '.' || lpad(CAST(event_id * 7919 % 1000000007 AS VARCHAR), CAST(4 + event_id % 9 AS INTEGER), '0') END AS text FROM ev),
p AS (SELECT *, CASE WHEN starts_with(text, '-') THEN -1 ELSE 1 END AS sign, CAST(regexp_extract(text, '([0-9]+)', 1) AS BIGINT) AS whole, rpad(regexp_extract(text, '\\.([0-9]*)$', 1), 10, '0') AS d FROM s)
SELECT event_id, text, sign * (whole * 1000000000 + CAST(d[1:9] AS BIGINT) + CASE WHEN d[10:10] >= '5' THEN 1 ELSE 0 END) AS ns FROM p
""")
def decimal_seconds(spark, sf_dir):
    """Decimal seconds in text to whole nanoseconds without binary fractions."""
    e = F.col("event_id")
    digits = F.expr("lpad(CAST(event_id * 7919 % 1000000007 AS STRING), CAST(4 + event_id % 9 AS INT), '0')")
    text = F.concat(F.when(e % 5 == 0, "-").otherwise(""), (e * 977).cast("string"), F.when(e % 7 == 0, "").otherwise(F.concat(F.lit("."), digits)))
    return events(spark, sf_dir).select("event_id", text.alias("text")).withColumn("ns", S.seconds_to_ns(F.col("text")))


@query("SELECT n AS n, round(n / CAST(4 AS DOUBLE)) + 0.0 AS away, round_even(n / CAST(4 AS DOUBLE), 0) + 0.0 AS even, n / CAST(4 AS DOUBLE) > 2 AND abs(n / CAST(4 AS DOUBLE) - 2) > greatest(1e-12 * greatest(abs(n / CAST(4 AS DOUBLE)), 2), 1e-12) AS over FROM (SELECT n_nationkey * 2 - 25 AS n FROM nation)")
def rounding_modes(spark, sf_dir):
    """Halves away from zero and to even, and comparison that rounding can't tip."""
    x = F.col("n") / 4.0
    return table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 2 - 25).alias("n")).select("n", (S.half_away(x) + 0.0).alias("away"), S.half_even(x).alias("even"), S.exceeds(x, F.lit(2.0)).alias("over"))


@query("""
SELECT p_partkey, left(trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-'), 32) AS slug, 'part_' || sha256(coalesce(p_name, chr(0)) || '|' || coalesce(p_brand, chr(0)) || '|' || CAST(p_size AS VARCHAR)) AS id,
  regexp_matches(CASE WHEN p_partkey % 3 = 0 THEN '/' || p_name WHEN p_partkey % 3 = 1 THEN 'a/../' || p_name ELSE p_name END, '^(/|~|[A-Za-z]:[\\\\/]|file://)|(^|/)\\.\\.(/|$)') AS leaks FROM part
""")
def names_and_ids(spark, sf_dir):
    """Slugs, stable identities, and texts that name places on one machine."""
    path = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("/"), "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("a/../"), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", S.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"), S.stable_id("part_", F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("id"), S.leaks_path(path).alias("leaks"))


@query("""
WITH s AS (SELECT o_custkey, string_agg(o_orderpriority[1:1], '' ORDER BY o_orderdate, o_orderkey) AS a, string_agg(CAST(1 + o_orderkey % 5 AS VARCHAR), '' ORDER BY o_orderdate, o_orderkey) AS b FROM orders GROUP BY o_custkey)
SELECT o_custkey, CAST(levenshtein(a, b) AS INTEGER) AS edits, len(a) AS n FROM s
""")
def sequence_edits(spark, sf_dir):
    """M9: the edit distance of two sequences of names, each name one sign."""
    of = lambda c, n: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", c.alias("c")))), lambda x: x["c"]), "").alias(n)
    got = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(of(F.substring("o_orderpriority", 1, 1), "a"), of((1 + F.col("o_orderkey") % 5).cast("string"), "b"))
    return got.select("o_custkey", F.levenshtein("a", "b").alias("edits"), F.length("a").cast("long").alias("n"))


@query("SELECT p_partkey, CAST(CAST('0x' || substr(sha256('7:' || p_name || p_partkey), 1, 12) AS BIGINT) % 4 AS BIGINT) AS fold FROM part")
def hash_selection(spark, sf_dir):
    """A group's fold by hash of seed and label."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("7:"), "p_name", F.col("p_partkey").cast("string")), 256), 1, 12), 16, 10).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", (h % 4).alias("fold"))


@query(f"""
WITH c AS (SELECT c_custkey, 51 + c_acctbal / 100000 AS lat, -1 + c_nationkey / CAST(1000 AS DOUBLE) AS lon, c_acctbal / 100 AS alt FROM customer),
k AS (SELECT *, {G.A} / sqrt(1 - {G.E2} * sin(radians(lat)) * sin(radians(lat))) AS n, {G.A} / sqrt(1 - {G.E2} * sin(radians(51)) * sin(radians(51))) AS n0 FROM c),
e AS (SELECT *, (n + alt) * cos(radians(lat)) * cos(radians(lon)) - n0 * cos(radians(51)) * cos(radians(-1)) AS dx, (n + alt) * cos(radians(lat)) * sin(radians(lon)) - n0 * cos(radians(51)) * sin(radians(-1)) AS dy, (n * {1 - G.E2} + alt) * sin(radians(lat)) - n0 * {1 - G.E2} * sin(radians(51)) AS dz FROM k)
SELECT c_custkey, round(-sin(radians(-1)) * dx + cos(radians(-1)) * dy, 3) + 0.0 AS east, round(-sin(radians(51)) * cos(radians(-1)) * dx - sin(radians(51)) * sin(radians(-1)) * dy + cos(radians(51)) * dz, 3) + 0.0 AS north, round(cos(radians(51)) * cos(radians(-1)) * dx + cos(radians(51)) * sin(radians(-1)) * dy + sin(radians(51)) * dz, 3) + 0.0 AS up, true AS returns FROM e
""")
def local_coordinates(spark, sf_dir):
    """Degrees to east, north and up of an origin, and whether the way back meets within a millimetre."""
    lat, lon, alt = 51 + F.col("c_acctbal") / 100000, -1 + F.col("c_nationkey") / 1000.0, F.col("c_acctbal") / 100
    origin = (51.0, -1.0, 0.0)
    placed = table(spark, sf_dir, "customer").select("c_custkey", lat.alias("lat"), lon.alias("lon"), alt.alias("alt")).withColumns(dict(zip(("e", "n", "u"), G.to_enu(F.col("lat"), F.col("lon"), F.col("alt"), origin))))
    back = G.from_enu(F.col("e"), F.col("n"), F.col("u"), origin)
    near = (F.abs(back[0] - F.col("lat")) < 9e-9) & (F.abs(back[1] - F.col("lon")) < 9e-9) & (F.abs(back[2] - F.col("alt")) < 1e-3)
    return placed.select("c_custkey", (F.round("e", 3) + 0.0).alias("east"), (F.round("n", 3) + 0.0).alias("north"), (F.round("u", 3) + 0.0).alias("up"), near.alias("returns"))


@query(f"""
WITH {EVENTS}, h AS (SELECT event_id, radians(value) AS h, radians(event_id % 50) AS h1 FROM ev)
SELECT event_id, round(3 * cos(h) - 2 * sin(h) + 1, 6) + 0.0 AS x, round(3 * sin(h) + 2 * cos(h) - 4, 6) + 0.0 AS y, true AS returns, round({WRAP('h', 'h1')}, 5) AS turned FROM h
""")
def rigid_transforms(spark, sf_dir):
    """Points moved by a rotation and a translation, back by its inverse, and the angle between two rotations."""
    zero = F.lit(0.0)
    rows = events(spark, sf_dir).select("event_id", F.radians("value").alias("h"), F.radians(F.col("event_id") % 50).alias("h1"))
    named = lambda x, q: {f"{x}{i}": c for i, c in enumerate(q)}
    rows = rows.withColumns(named("p", G.from_roll_pitch_heading(zero, zero, F.col("h"))) | named("q", G.from_roll_pitch_heading(zero, zero, F.col("h1"))))
    p, q = (tuple(F.col(f"{x}{i}") for i in range(4)) for x in "pq")
    t, v = (F.lit(1.0), F.lit(-4.0), zero), (F.lit(3.0), F.lit(2.0), zero)
    rows = rows.withColumns(named("m", G.transform(p, t, v)))
    back = G.transform(*G.inverse(p, t), tuple(F.col(f"m{i}") for i in range(3)))
    returns = (F.abs(back[0] - 3) < 1e-9) & (F.abs(back[1] - 2) < 1e-9) & (F.abs(back[2]) < 1e-9)
    return rows.select("event_id", (F.round("m0", 6) + 0.0).alias("x"), (F.round("m1", 6) + 0.0).alias("y"), returns.alias("returns"), F.round(G.rotation_distance(p, q), 5).alias("turned"))


@query("SELECT l_suppkey, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem WHERE l_extendedprice BETWEEN 20000 AND 80000 AND l_quantity BETWEEN 10 AND 40 AND l_returnflag IN ('A', 'N') GROUP BY l_suppkey")
def region_filter(spark, sf_dir):
    """Rows inside a box and of certain classes; both filters reach the scan."""
    inside = F.col("l_extendedprice").between(20000, 80000) & F.col("l_quantity").between(10, 40) & F.col("l_returnflag").isin("A", "N")
    return table(spark, sf_dir, "lineitem").filter(inside).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))
