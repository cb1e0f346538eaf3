"""Joins of intervals, times, sequences and rules, on events, nations, orders and parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import islands as I
from ..operators import joins as J
from .registry import EVENTS, events, query, table
from .temporal import HOUR, INTERVALS, intervals


def sides(spark, sf_dir, a="purchase", b="error"):
    rows = intervals(spark, sf_dir)
    left = rows.filter(F.col("event_type") == a).select("user_id", F.col("event_id").alias("a_id"), F.col("s").alias("a_s"), F.col("e").alias("a_e"), F.col("value").alias("a_value"))
    right = rows.filter(F.col("event_type") == b).select("user_id", F.col("event_id").alias("b_id"), F.col("s").alias("b_s"), F.col("e").alias("b_e"), F.col("value").alias("b_value"))
    return left, right


SIDES = f"{EVENTS}, {INTERVALS}, a AS (SELECT user_id, event_id AS a_id, s AS a_s, e AS a_e, value AS a_value FROM iv WHERE event_type = 'purchase'), b AS (SELECT user_id, event_id AS b_id, s AS b_s, e AS b_e, value AS b_value FROM iv WHERE event_type = 'error')"
MEET = "a.user_id = b.user_id AND a_s < b_e AND b_s < a_e"


@query(f"WITH {SIDES} SELECT a.user_id, a_id, b_id, least(a_e, b_e) - greatest(a_s, b_s) AS shared FROM a JOIN b ON {MEET}")
def interval_overlap(spark, sf_dir):
    """Traversals and evidence that overlap, with the shared time."""
    a, b = sides(spark, sf_dir)
    found = J.overlap_join(a, b, ["user_id"], ("a_s", "a_e"), ("b_s", "b_e"), 2 * HOUR)
    return found.select("user_id", "a_id", "b_id", (F.least("a_e", "b_e") - F.greatest("a_s", "b_s")).alias("shared"))


@query(f"WITH {SIDES} SELECT user_id, a_id FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {MEET})")
def touched_traversals(spark, sf_dir):
    """Traversals that any finding touches."""
    a, b = sides(spark, sf_dir)
    return J.overlap_semi(a, b, ["user_id"], ("a_s", "a_e"), ("b_s", "b_e"), 2 * HOUR, ["a_id"]).select("user_id", "a_id")


@query(f"WITH {SIDES}, m AS (SELECT a_id, list(DISTINCT b_s // {24 * HOUR} ORDER BY b_s // {24 * HOUR}) AS bins FROM a JOIN b ON {MEET} GROUP BY a_id) SELECT a.a_id, len(coalesce(bins, [])) AS n_bins, array_to_string(coalesce(bins, []), ',') AS bins FROM a LEFT JOIN m USING (a_id)")
def finding_bins(spark, sf_dir):
    """The bins that each finding touches; findings without any stay."""
    a, b = sides(spark, sf_dir)
    met = J.overlap_join(a, b, ["user_id"], ("a_s", "a_e"), ("b_s", "b_e"), 2 * HOUR).groupBy("a_id").agg(F.sort_array(F.collect_set(F.floor(F.col("b_s") / (24 * HOUR)))).alias("bins"))
    bins = F.coalesce("bins", F.array().cast("array<bigint>"))
    return a.join(met, "a_id", "left").select("a_id", F.size(bins).cast("long").alias("n_bins"), F.array_join(bins.cast("array<string>"), ",").alias("bins"))


@query(f"""
WITH {SIDES}, p AS (SELECT a_id, b_id, b_s, (least(a_e, b_e) - greatest(a_s, b_s)) / CAST(greatest(a_e, b_e) - least(a_s, b_s) AS DOUBLE) AS iou FROM a JOIN b ON {MEET}),
r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY iou DESC, b_s, b_id DESC) AS rn FROM p WHERE iou >= 0.1)
SELECT a_id, b_id, round(iou, 9) AS iou FROM r WHERE rn = 1
""")
def truth_match(spark, sf_dir):
    """Each event's best injected truth by intersection over union; earlier starts, then larger ids win ties."""
    a, b = sides(spark, sf_dir)
    pairs = J.overlap_join(a, b, ["user_id"], ("a_s", "a_e"), ("b_s", "b_e"), 2 * HOUR).withColumn("iou", J.iou(F.col("a_s"), F.col("a_e"), F.col("b_s"), F.col("b_e"))).filter("iou >= 0.1")
    return pairs.groupBy("a_id").agg(F.max(F.struct("iou", -F.col("b_s"), "b_id")).alias("best")).select("a_id", "best.b_id", F.round("best.iou", 9).alias("iou"))


@query(f"""
WITH {EVENTS}, q AS (SELECT * FROM ev WHERE event_type = 'purchase'), r AS (SELECT * FROM ev WHERE event_type = 'view')
SELECT q.event_id, b.us AS before_us, b.value AS before_value, a.us AS after_us, a.value AS after_value,
  round(CASE WHEN a.us = b.us THEN b.value ELSE b.value + (a.value - b.value) * (q.us - b.us) / CAST(a.us - b.us AS DOUBLE) END, 6) AS interpolated
FROM q ASOF LEFT JOIN r b ON q.user_id = b.user_id AND q.us >= b.us ASOF LEFT JOIN r a ON q.user_id = a.user_id AND q.us <= a.us
""")
def asof_bracket(spark, sf_dir):
    """The samples around each query time, and the value between them; none is made up beyond the ends."""
    rows = events(spark, sf_dir)
    asks, samples = rows.filter("event_type = 'purchase'").select("event_id", "user_id", "us"), rows.filter("event_type = 'view'").select("user_id", "us", "value")
    found = J.as_of(asks, samples, ["user_id"], "us", ["value"])
    between = F.col("before_value") + (F.col("after_value") - F.col("before_value")) * (F.col("us") - F.col("before_us")) / (F.col("after_us") - F.col("before_us")).cast("double")
    value = F.when(F.col("after_us") == F.col("before_us"), F.col("before_value")).otherwise(between)
    return found.select("event_id", "before_us", "before_value", "after_us", "after_value", F.round(value, 6).alias("interpolated"))


@query(f"WITH {EVENTS}, f AS (SELECT DISTINCT us // {HOUR} AS t FROM ev WHERE event_type = 'click'), p AS (SELECT DISTINCT us // {HOUR} AS t FROM ev WHERE event_type = 'view') SELECT (SELECT count(*) FROM f) AS n_a, (SELECT count(*) FROM p) AS n_b, (SELECT count(*) FROM f JOIN p USING (t)) AS matched, (SELECT count(*) FROM f ANTI JOIN p USING (t)) AS only_a, (SELECT count(*) FROM p ANTI JOIN f USING (t)) AS only_b")
def exact_time_match(spark, sf_dir):
    """Frames and poses by exact time, with what either side lacks."""
    rows = events(spark, sf_dir).withColumn("t", F.floor(F.col("us") / HOUR))
    return J.completeness(rows.filter("event_type = 'click'"), rows.filter("event_type = 'view'"), ["t"])


@query(f"""
WITH {EVENTS}, a AS (SELECT user_id, us AS a_us, value AS a_value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM ev WHERE event_type = 'click'),
b AS (SELECT user_id, us AS b_us, value AS b_value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM ev WHERE event_type = 'view')
SELECT user_id, CAST(place AS INTEGER) AS place, b_us - a_us AS skew_us, round(abs(b_value - a_value), 6) AS residual FROM a FULL JOIN b USING (user_id, place)
""")
def reference_residual(spark, sf_dir):
    """Evidence beside samples by place, with the time and value between them."""
    rows = events(spark, sf_dir)
    one, two = (rows.filter(F.col("event_type") == k).select("user_id", "event_id", F.col("us").alias(f"{x}_us"), F.col("value").alias(f"{x}_value")) for k, x in (("click", "a"), ("view", "b")))
    both = J.positional(one.withColumnRenamed("event_id", "a_id"), two.withColumnRenamed("event_id", "b_id"), ["user_id"], ["a_id"], ["b_id"])
    return both.select("user_id", "place", (F.col("b_us") - F.col("a_us")).alias("skew_us"), F.round(F.abs(F.col("b_value") - F.col("a_value")), 6).alias("residual"))


NODES = "edge AS (SELECT n_nationkey AS src, (3 * n_nationkey + 1) % 25 AS dst, 1 + n_nationkey % 7 AS len FROM nation UNION ALL SELECT n_nationkey, (5 * n_nationkey + 2) % 25, 1 + (n_nationkey + 3) % 7 FROM nation)"


def edges(spark, sf_dir):
    """A small directed graph over nations: two arcs leave each."""
    n = table(spark, sf_dir, "nation")
    two = F.array(F.struct(((3 * F.col("n_nationkey") + 1) % 25).alias("dst"), (1 + F.col("n_nationkey") % 7).alias("len")), F.struct(((5 * F.col("n_nationkey") + 2) % 25).alias("dst"), (1 + (F.col("n_nationkey") + 3) % 7).alias("len")))
    return n.select(F.col("n_nationkey").alias("src"), F.inline(two))


@query(f"""
WITH {NODES}, rel AS (SELECT n_nationkey AS id, n_nationkey AS from_src, (3 * n_nationkey + 1) % 25 AS via, (5 * ((3 * n_nationkey + 1) % 25) + 2) % 25 AS to_dst, CASE n_nationkey % 3 WHEN 0 THEN 'NO' WHEN 1 THEN 'ONLY' ELSE 'UNKNOWN' END AS kind FROM nation),
o AS (SELECT r.*, e.dst FROM rel r JOIN edge e ON e.src = r.via)
SELECT DISTINCT id, from_src, via, dst, CASE WHEN kind = 'UNKNOWN' THEN 'UNKNOWN_RESTRICTION' ELSE 'FORBIDDEN' END AS state FROM o WHERE (kind = 'NO' AND dst = to_dst) OR (kind = 'ONLY' AND dst <> to_dst) OR kind = 'UNKNOWN'
""")
def restriction_rules(spark, sf_dir):
    """NO forbids the named turn, ONLY all others, an unknown kind marks all."""
    n = F.col("n_nationkey")
    via = (3 * n + 1) % 25
    kind = F.when(n % 3 == 0, "NO").when(n % 3 == 1, "ONLY").otherwise("UNKNOWN")
    rel = table(spark, sf_dir, "nation").select(n.alias("id"), n.alias("from_src"), via.alias("via"), ((5 * via + 2) % 25).alias("to_dst"), kind.alias("kind"))
    out = rel.join(edges(spark, sf_dir).select(F.col("src").alias("via"), "dst"), "via")
    named = F.col("dst") == F.col("to_dst")
    applies = F.when(F.col("kind") == "NO", named).when(F.col("kind") == "ONLY", ~named).otherwise(True)
    state = F.when(F.col("kind") == "UNKNOWN", "UNKNOWN_RESTRICTION").otherwise("FORBIDDEN")
    return out.filter(applies).select("id", "from_src", "via", "dst", state.alias("state")).dropDuplicates()


@query("""
WITH r AS (SELECT o_custkey % 50 AS a, o_orderkey % 20 AS b, CASE o_orderstatus WHEN 'F' THEN 'FORBIDDEN' WHEN 'P' THEN 'UNKNOWN_RESTRICTION' ELSE 'ALLOWED' END AS state FROM orders WHERE o_totalprice > 450000),
g AS (SELECT a, b, min(CASE state WHEN 'FORBIDDEN' THEN 0 WHEN 'UNKNOWN_RESTRICTION' THEN 1 ELSE 2 END) AS k FROM r GROUP BY a, b)
SELECT o_orderkey, CASE k WHEN 0 THEN 'FORBIDDEN' WHEN 1 THEN 'UNKNOWN_RESTRICTION' WHEN 2 THEN 'ALLOWED' ELSE 'NONE' END AS state FROM orders LEFT JOIN g ON o_custkey % 50 = a AND (o_orderkey * 3) % 20 = b
""")
def rule_lookup(spark, sf_dir):
    """A transition's strictest rule; none is none."""
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "FORBIDDEN").when(F.col("o_orderstatus") == "P", "UNKNOWN_RESTRICTION").otherwise("ALLOWED")
    rules = o.filter("o_totalprice > 450000").select((F.col("o_custkey") % 50).alias("a"), (F.col("o_orderkey") % 20).alias("b"), state.alias("state"))
    best = J.ranked_rules(rules, ["a", "b"], "state", ["FORBIDDEN", "UNKNOWN_RESTRICTION", "ALLOWED"])
    asks = o.select("o_orderkey", (F.col("o_custkey") % 50).alias("a"), (F.col("o_orderkey") * 3 % 20).alias("b"))
    return asks.join(best, ["a", "b"], "left").select("o_orderkey", F.coalesce("state", F.lit("NONE")).alias("state"))


@query("""
WITH m AS (SELECT l_orderkey AS way, l_linenumber AS pos, l_partkey AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem),
g AS (SELECT way, pos, rn, node, p_size AS x, p_retailprice AS y FROM m LEFT JOIN (SELECT * FROM part WHERE p_size <> 7) ON p_partkey = node)
SELECT way, count(*) AS n, count(*) FILTER (x IS NULL) AS missing, string_agg(CAST(node AS VARCHAR), ',' ORDER BY rn) AS nodes, round(sum(coalesce(y, 0)), 6) AS total FROM g GROUP BY way
""")
def way_nodes(spark, sf_dir):
    """Each way's nodes in order with their coordinates, and how many are not defined."""
    li = table(spark, sf_dir, "lineitem")
    rn = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    refs = li.select(F.col("l_orderkey").alias("way"), F.col("l_partkey").alias("node"), rn.alias("rn"))
    nodes = table(spark, sf_dir, "part").filter("p_size <> 7").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("y"))
    got = refs.join(nodes, "node", "left").groupBy("way").agg(F.count("*").alias("n"), F.count_if(F.col("y").isNull()).alias("missing"), F.sort_array(F.collect_list(F.struct("rn", "node"))).alias("nodes"), F.round(F.sum(F.coalesce("y", F.lit(0.0))), 6).alias("total"))
    return got.select("way", "n", "missing", F.array_join(F.transform("nodes", lambda x: x["node"].cast("string")), ",").alias("nodes"), "total")


@query(f"""
WITH {EVENTS}, d AS (SELECT *, abs(value - lag(value) OVER w) AS b, abs(lead(value) OVER w - value) AS a FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT user_id, round(sum((coalesce(b, 0) + coalesce(a, 0)) / 2), 6) AS distance, round(sum(CASE WHEN event_type <> 'error' THEN (coalesce(b, 0) + coalesce(a, 0)) / 2 ELSE 0 END) / sum((coalesce(b, 0) + coalesce(a, 0)) / 2), 9) AS confident FROM d GROUP BY user_id
""")
def half_distance(spark, sf_dir):
    """Each sample weighs half the way to either neighbour; the share of the way that is confident."""
    w = I.over(["user_id"], "us", "event_id")
    way = lambda c: F.coalesce(F.abs(c), F.lit(0.0))
    rows = events(spark, sf_dir).withColumn("w", (way(F.col("value") - F.lag("value").over(w)) + way(F.lead("value").over(w) - F.col("value"))) / 2)
    return rows.groupBy("user_id").agg(F.round(F.sum("w"), 6).alias("distance"), F.round(F.sum(F.when(F.col("event_type") != "error", F.col("w")).otherwise(0)) / F.sum("w"), 9).alias("confident"))


@query(f"""
WITH {EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev),
c AS (SELECT unnest(['start', 'middle', 'end']) AS clip)
SELECT user_id, clip, count(*) AS n, min(us) AS start_us, max(us) AS end_us FROM n CROSS JOIN c
WHERE CASE clip WHEN 'start' THEN i <= 10 WHEN 'end' THEN i > n - 10 ELSE i > n // 2 - 5 AND i <= n // 2 + 5 END GROUP BY user_id, clip
""")
def clips(spark, sf_dir):
    """Ten samples at the start, in the middle and at the end of each sequence."""
    rows = events(spark, sf_dir).withColumn("i", F.row_number().over(I.over(["user_id"], "us", "event_id"))).withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    half = F.floor(F.col("n") / 2)
    some = F.array_compact(F.array(F.when(F.col("i") <= 10, "start"), F.when((F.col("i") > half - 5) & (F.col("i") <= half + 5), "middle"), F.when(F.col("i") > F.col("n") - 10, "end")))
    return rows.select("user_id", "us", F.explode(some).alias("clip")).groupBy("user_id", "clip").agg(F.count("*").alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))


@query(f"""
WITH {EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev)
SELECT event_id, user_id FROM n WHERE (i - 1) % 8 = 0 OR i = n
""")
def stride_sample(spark, sf_dir):
    """P5: every eighth sample of a sequence, and its last."""
    w = I.over(["user_id"], "us", "event_id")
    rows = events(spark, sf_dir).withColumn("i", F.row_number().over(w)).withColumn("last", F.lead("event_id").over(w).isNull())
    return rows.filter(((F.col("i") - 1) % 8 == 0) | F.col("last")).select("event_id", "user_id")
