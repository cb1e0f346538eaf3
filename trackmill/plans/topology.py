"""Topology mining: orders as stretches that a customer's passes drove off the map, suppliers as nodes of a road grid."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import polylines as P
from ..operators import topology as T
from ..operators.state import spread
from .registry import query, table

LIMITS = T.Limits(quality=0.1)

#: An order runs from the node of its customer's number by 15 to the next one, or back: a point for each line, aside by its quantity, on one of three courses.
STRETCHES = """
nd AS (SELECT s_suppkey AS node, s_suppkey % 10 * 1000.0::DOUBLE AS x, s_suppkey // 10 * 1000.0::DOUBLE AS y FROM supplier),
iv AS (SELECT o_orderkey AS interval, o_custkey AS traversal, o_custkey // 15 AS home, o_orderstatus <> 'P' AS off_map, o_orderkey % 11 <> 0 AS observable, o_orderkey % 13 <> 0 AS directed, o_orderkey % 17 = 0 AS stationary, o_orderkey % 100 / 100.0::DOUBLE AS quality FROM orders),
ln AS (SELECT l_orderkey AS interval, row_number() OVER w AS nth, count(*) OVER (PARTITION BY l_orderkey) AS n, l_quantity FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice)),
fr AS (SELECT l.*, home, CASE WHEN n > 1 THEN (nth - 1) / CAST(n - 1 AS DOUBLE) ELSE 0 END AS f FROM ln l JOIN iv USING (interval)),
pt AS (SELECT interval, CASE WHEN interval % 5 = 0 THEN n + 1 - nth ELSE nth END AS nth, home % 10 * 1000.0::DOUBLE + 1000 * f AS x,
  home // 10 * 1000.0::DOUBLE + greatest(interval % 4 - 1, 0) * 18 * 4 * f * (1 - f) + (l_quantity % 7 - 3) AS y FROM fr),
sg AS (SELECT interval, nth, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM pt WINDOW w AS (PARTITION BY interval ORDER BY nth)),
sl AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS length FROM sg WHERE x1 IS NOT NULL),
sh AS (SELECT interval, sum(length) AS length, sqrt(pow(arg_max(x1, nth) - arg_min(x0, nth), 2) + pow(arg_max(y1, nth) - arg_min(y0, nth), 2)) AS span FROM sl GROUP BY interval),
jd AS MATERIALIZED (SELECT iv.*, CASE WHEN NOT off_map THEN 'not_off_map' WHEN NOT observable THEN 'unobservable' WHEN NOT directed THEN 'direction' WHEN stationary THEN 'stationary' WHEN quality < 0.1 THEN 'quality'
  WHEN coalesce(length, 0) < 100 THEN 'short' WHEN NOT coalesce(span, 0) > 0.5 THEN 'no_span' END AS reason FROM iv LEFT JOIN sh USING (interval))"""


def resampled_sql(name: str, source: str, key: str) -> str:
    """CTEs that end in `name`: key, k, x, y of 21 points along the segments of `source`."""
    return f"""
{name}_s AS (SELECT *, sum(length) OVER (PARTITION BY {key} ORDER BY nth ROWS UNBOUNDED PRECEDING) - length AS along, sum(length) OVER (PARTITION BY {key}) AS total, lag(nth) OVER (PARTITION BY {key} ORDER BY nth) IS NULL AS is_first FROM {source}),
{name}_n AS (SELECT *, lead(along) OVER (PARTITION BY {key} ORDER BY nth) AS next_along FROM {name}_s),
{name}_h AS (SELECT *, row_number() OVER (PARTITION BY {key}, k ORDER BY nth) AS rn, CASE WHEN length > 0 THEN greatest(0, least(1, (total * k / 20 - along) / length)) ELSE 0 END AS share FROM {name}_n CROSS JOIN range(21) r(k)
  WHERE total > 0 AND (total * k / 20 > along OR is_first) AND (total * k / 20 <= next_along OR next_along IS NULL)),
{name} AS MATERIALIZED (SELECT {key}, CAST(k AS INTEGER) AS k, x0 + share * (x1 - x0) AS x, y0 + share * (y1 - y0) AS y FROM {name}_h WHERE rn = 1)"""


#: Greedy clusters by recursion over the intervals of each home in ascending order; intervals of different homes never run alike.
CLUSTERS = f"""
fit AS MATERIALIZED (SELECT interval, home, row_number() OVER (PARTITION BY home ORDER BY interval) AS nth FROM jd WHERE reason IS NULL),
fs AS (SELECT sl.* FROM sl JOIN fit USING (interval)), {resampled_sql("rs", "fs", "interval").replace("FROM fs)", "FROM (SELECT interval, nth, x0, y0, x1, y1, length FROM fs))")},
hd AS (SELECT interval, atan2(arg_max(y, k) - arg_min(y, k), arg_max(x, k) - arg_min(x, k)) AS h FROM rs GROUP BY interval),
pr AS (SELECT a.home, a.interval AS i, b.interval AS j, avg(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))) AS mean, max(CASE WHEN p.k IN (0, 20) THEN sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) END) AS ends
  FROM fit a JOIN fit b ON a.home = b.home AND b.interval < a.interval JOIN rs p ON p.interval = a.interval JOIN rs q ON q.interval = b.interval AND q.k = p.k GROUP BY ALL),
lk AS MATERIALIZED (SELECT i, list(j) AS linked FROM pr JOIN hd u ON u.interval = i JOIN hd v ON v.interval = j WHERE mean <= 15 AND ends <= 40 AND abs((u.h - v.h) - 2 * pi() * round((u.h - v.h) / (2 * pi()))) <= 0.5 GROUP BY i),
st AS MATERIALIZED (SELECT home, nth, interval, coalesce(linked, []) AS linked FROM fit LEFT JOIN lk ON i = interval),
gr AS (SELECT DISTINCT home, CAST(0 AS BIGINT) AS nth, CAST([] AS BIGINT[][]) AS groups FROM fit
  UNION ALL SELECT home, nth, CASE WHEN pos IS NULL OR pos = 0 THEN list_append(groups, [interval]) ELSE [CASE WHEN z = pos THEN list_append(groups[z], interval) ELSE groups[z] END FOR z IN range(1, len(groups) + 1)] END
  FROM (SELECT gr.home, st.nth, st.interval, gr.groups, list_position([len(list_filter(c, lambda m: NOT list_contains(st.linked, m))) = 0 FOR c IN gr.groups], true) AS pos FROM gr JOIN st ON st.home = gr.home AND st.nth = gr.nth + 1)),
cl AS MATERIALIZED (SELECT unnest(c) AS interval, c[1] AS cluster FROM (SELECT unnest(groups) AS c FROM gr QUALIFY row_number() OVER (PARTITION BY home ORDER BY nth DESC) = 1))"""

#: Forward arcs but for every third node, bent where the remainder is one; backward ones but for every fourth.
GRAPH = """
ar AS (SELECT node * 2 AS arc, node AS from_node, node + 1 AS to_node, x, y, CASE WHEN node % 3 = 1 THEN 60 ELSE 0 END AS bend, 1 AS way FROM nd WHERE node % 10 < 9 AND node % 3 > 0
  UNION ALL SELECT node * 2 + 1, node + 1, node, x, y, 0, -1 FROM nd WHERE node % 10 < 9 AND node % 4 > 0),
av AS (SELECT arc, CASE WHEN way = 1 THEN p ELSE 2 - p END AS pos, x + 500 * p AS x, y + CASE WHEN p = 1 THEN bend ELSE 0 END AS y FROM ar CROSS JOIN range(3) r(p)),
ag AS MATERIALIZED (SELECT arc, pos AS nth, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM av WINDOW w AS (PARTITION BY arc ORDER BY pos)),
al AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS length FROM ag WHERE x1 IS NOT NULL)"""

HYPOTHESES = f"""{GRAPH}, {resampled_sql("ax", "al", "arc")},
co AS (SELECT cluster, k, median(x) AS x, median(y) AS y FROM rs JOIN cl USING (interval) GROUP BY ALL),
cn AS (SELECT cluster, count(*) AS n_intervals, count(DISTINCT traversal) AS n_traversals FROM cl JOIN iv USING (interval) GROUP BY cluster),
sn AS (SELECT cluster, k, node, sqrt((co.x - nd.x) * (co.x - nd.x) + (co.y - nd.y) * (co.y - nd.y)) AS apart FROM co JOIN nd ON abs(co.x - nd.x) <= 50 AND abs(co.y - nd.y) <= 50 WHERE k IN (0, 20)
  AND sqrt((co.x - nd.x) * (co.x - nd.x) + (co.y - nd.y) * (co.y - nd.y)) <= 50 QUALIFY row_number() OVER (PARTITION BY cluster, k ORDER BY apart, node) = 1),
ak AS (SELECT a.cluster, a.node AS from_node, b.node AS to_node, greatest(a.apart, b.apart) AS end_error FROM sn a JOIN sn b ON a.cluster = b.cluster AND a.k = 0 AND b.k = 20 AND a.node <> b.node),
er AS (SELECT cluster, arc, avg(sqrt((co.x - ax.x) * (co.x - ax.x) + (co.y - ax.y) * (co.y - ax.y))) AS mean_error FROM ak JOIN ar USING (from_node, to_node) JOIN ax USING (arc) JOIN co USING (cluster, k) GROUP BY ALL),
be AS (SELECT * FROM er QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY mean_error, arc) = 1)
SELECT cluster, CASE WHEN arc IS NULL THEN 'missing_connection' ELSE 'geometry_disagreement' END AS kind, from_node, to_node, arc, round(end_error, 6) AS end_error, round(mean_error, 6) AS mean_error, n_intervals, n_traversals
FROM ak JOIN cn USING (cluster) LEFT JOIN be USING (cluster) WHERE n_traversals >= 3 AND (arc IS NULL OR mean_error > 25)"""


def stretches(spark, sf_dir):
    """The intervals with their reasons, and the segments of their points."""
    key = F.col("o_orderkey")
    intervals = table(spark, sf_dir, "orders").select(
        key.alias("interval"), F.col("o_custkey").alias("traversal"), F.floor(F.col("o_custkey") / 15).alias("home"), (F.col("o_orderstatus") != "P").alias("off_map"), (key % 11 != 0).alias("observable"),
        (key % 13 != 0).alias("directed"), (key % 17 == 0).alias("stationary"), (key % 100 / 100.0).alias("quality"),
    )
    lines = Window.partitionBy("l_orderkey")
    lineitem = table(spark, sf_dir, "lineitem")
    points = spread(lineitem, lineitem.count(), "l_orderkey").select(F.col("l_orderkey").alias("interval"), F.row_number().over(lines.orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")).alias("nth"), F.count("*").over(lines).alias("n"), "l_quantity")
    points = points.join(intervals.select("interval", "home"), "interval").withColumn("f", F.when(F.col("n") > 1, (F.col("nth") - 1) / (F.col("n") - 1)).otherwise(0.0))
    i, f = F.col("interval"), F.col("f")
    aside = F.greatest(i % 4 - 1, F.lit(0)) * 18 * 4 * f * (1 - f) + (F.col("l_quantity") % 7 - 3)
    points = points.select("interval", F.when(i % 5 == 0, F.col("n") + 1 - F.col("nth")).otherwise(F.col("nth")).alias("nth"), (F.col("home") % 10 * 1000.0 + 1000 * f).alias("x"), (F.floor(F.col("home") / 10) * 1000.0 + aside).alias("y"))
    parts = P.segments(points, ["interval"], "nth", T.AXES)
    return T.judged(intervals, parts, LIMITS), parts


def fit_samples(spark, sf_dir):
    """The resampled fit intervals."""
    intervals, parts = stretches(spark, sf_dir)
    return P.resample(parts.join(intervals.filter("reason IS NULL").select("interval"), "interval"), ["interval"], T.AXES, LIMITS.samples)


def graph(spark, sf_dir):
    s = F.col("s_suppkey")
    nodes = table(spark, sf_dir, "supplier").select(s.alias("node"), (s % 10 * 1000.0).alias("x"), (F.floor(s / 10) * 1000.0).alias("y"))
    at = nodes.filter("node % 10 < 9")
    ahead = at.filter("node % 3 > 0").select((F.col("node") * 2).alias("arc"), F.col("node").alias("from_node"), (F.col("node") + 1).alias("to_node"), "x", "y", F.when(F.col("node") % 3 == 1, 60).otherwise(0).alias("bend"), F.lit(True).alias("ahead"))
    back = at.filter("node % 4 > 0").select(F.col("node") * 2 + 1, F.col("node") + 1, "node", "x", "y", F.lit(0), F.lit(False))
    arcs = ahead.union(back)
    p = F.col("p")
    vertices = arcs.withColumn("p", F.explode(F.array(*map(F.lit, range(3))))).select("arc", F.when(F.col("ahead"), p).otherwise(2 - p).alias("pos"), (F.col("x") + 500 * p).alias("x"), (F.col("y") + F.when(p == 1, F.col("bend")).otherwise(0)).alias("y"))
    return nodes, arcs.select("arc", "from_node", "to_node"), vertices


@query(f"WITH {STRETCHES} SELECT coalesce(reason, 'selected') AS reason, count(*) AS n FROM jd GROUP BY ALL")
def topology_rejections(spark, sf_dir):
    """How many off-map intervals fail at which rule."""
    return stretches(spark, sf_dir)[0].groupBy(F.coalesce("reason", F.lit("selected")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {STRETCHES}, {CLUSTERS} SELECT interval, cluster FROM cl")
def topology_clusters(spark, sf_dir):
    """Greedy complete-link clusters of the intervals that run alike."""
    return T.clustered(fit_samples(spark, sf_dir), LIMITS)


@query(f"WITH RECURSIVE {STRETCHES}, {CLUSTERS}, {HYPOTHESES}")
def topology_hypotheses(spark, sf_dir):
    """From off-map intervals to the connections that the graph lacks and the geometry that it has wrong."""
    samples = fit_samples(spark, sf_dir)
    # of fit intervals alone there are samples
    traversals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("interval"), F.col("o_custkey").alias("traversal"))
    found = T.hypotheses(T.clustered_corridors(samples, traversals, LIMITS), *graph(spark, sf_dir), LIMITS)
    return found.withColumns({c: F.round(c, 6) for c in ("end_error", "mean_error")})
