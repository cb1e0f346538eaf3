"""Bins on arcs, polylines and graphs, on parts and lineitem as arcs and movements, users as polylines, nations as a network."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bins as B
from ..operators import graphs as R
from ..operators import polylines as P
from ..operators.state import kept, spread
from .matching_joins import NODES, edges, restriction_rules
from .registry import EVENTS, events, query, table

SIZE = 20.0


def arcs(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("arc"), F.col("p_retailprice").alias("length"))


def moves(spark, sf_dir):
    """Forward movements on arcs: from l_quantity over l_extendedprice / 1000, during as many seconds as the line number."""
    li = table(spark, sf_dir, "lineitem")
    start = F.unix_micros(F.col("l_shipdate").cast("timestamp")) + F.col("l_orderkey") % 1000 * 1_000_000
    return li.select(F.col("l_partkey").alias("arc"), (F.col("l_suppkey") % 5).alias("seq"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity").alias("a"), (F.col("l_quantity") + F.col("l_extendedprice") / 1000).alias("b"), start.alias("s"), (start + F.col("l_linenumber") * 1_000_000).alias("e"), F.col("l_tax").alias("speed"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))


MOVES = "mv AS (SELECT l_partkey AS arc, l_suppkey % 5 AS seq, l_quantity AS a, l_quantity + l_extendedprice / 1000 AS b, epoch_us(l_shipdate) + l_orderkey % 1000 * 1000000 AS s, epoch_us(l_shipdate) + l_orderkey % 1000 * 1000000 + l_linenumber * 1000000 AS e, l_tax AS speed, l_orderkey * 8 + l_linenumber AS id FROM lineitem)"
PIECES = f"""{MOVES}, x AS (SELECT *, unnest(generate_series(CAST(floor(a / 20) AS BIGINT), CAST(ceil(b / 20) AS BIGINT) - 1)) AS bin FROM mv WHERE b > a),
pc AS (SELECT *, greatest(a, bin * CAST(20 AS DOUBLE)) AS entry, least(b, (bin + 1) * CAST(20 AS DOUBLE)) AS exit FROM x),
pieces AS (SELECT *, s + CAST(round((e - s) * ((entry - a) / (b - a))) AS BIGINT) AS piece_start, s + CAST(round((e - s) * ((exit - a) / (b - a))) AS BIGINT) AS piece_end FROM pc)"""


@query(f"WITH {PIECES} SELECT arc, id, bin, round(entry, 6) AS entry, round(exit, 6) AS exit, piece_start, piece_end FROM pieces")
def bin_split(spark, sf_dir):
    """Movements cut at bin edges, with their times there."""
    return B.split(moves(spark, sf_dir), "a", "b", "s", "e", SIZE).select("arc", "id", "bin", F.round("entry", 6).alias("entry"), F.round("exit", 6).alias("exit"), "piece_start", "piece_end")


@query("SELECT p_partkey AS arc, CAST(b AS BIGINT) AS bin, round(least(20.0::DOUBLE, p_retailprice - b * 20), 6) AS bin_length, least(20.0::DOUBLE, p_retailprice - b * 20) < 20 AS partial FROM (SELECT *, unnest(generate_series(0, CAST(ceil(p_retailprice / 20) AS BIGINT) - 1)) AS b FROM part)")
def bin_generation(spark, sf_dir):
    """The bins of every arc."""
    return B.arc_bins(arcs(spark, sf_dir), "arc", "length", SIZE)


GAP = 300_000_000
TRAVERSALS = f"""{PIECES}, one AS (SELECT DISTINCT ON (arc, bin, seq, piece_start, piece_end, entry, exit) * FROM pieces ORDER BY id),
m AS (SELECT *, max(piece_end) OVER (PARTITION BY arc, bin, seq ORDER BY piece_start, piece_end, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM one),
o AS (SELECT *, sum(CASE WHEN piece_start > reach + {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY arc, bin, seq ORDER BY piece_start, piece_end, id ROWS UNBOUNDED PRECEDING) AS ordinal FROM m),
tr AS (SELECT arc, bin, seq, CAST(ordinal AS BIGINT) AS ordinal, min(piece_start) AS first_time, max(piece_end) AS last_time, arg_min(entry, [piece_start, id]) AS entry, arg_max(exit, [piece_end, id]) AS exit, round(sum(exit - entry), 6) AS distance,
  min(speed) AS min_speed, round(avg(speed), 6) AS mean_speed, max(speed) AS max_speed, count(*) AS pieces FROM o GROUP BY arc, bin, seq, ordinal)"""


def passes(spark, sf_dir):
    """Movements are dealt by arc and sequence before they are cut, so that a movement is shuffled once and its pieces are not."""
    dealt = moves(spark, sf_dir).drop("l_orderkey", "l_linenumber").repartition("arc", "seq")
    return B.traversals(B.split(dealt, "a", "b", "s", "e", SIZE), "arc", "seq", "id", "speed", GAP)


@query(f"WITH {TRAVERSALS} SELECT arc, bin, seq, ordinal, first_time, last_time, round(entry, 6) AS entry, round(exit, 6) AS exit, distance, min_speed, mean_speed, max_speed, pieces FROM tr")
def traversals(spark, sf_dir):
    """The passes of each sequence over each bin."""
    return passes(spark, sf_dir).withColumns({"entry": F.round("entry", 6), "exit": F.round("exit", 6)})


@query(f"""
WITH {TRAVERSALS}, g AS (SELECT p_partkey AS arc, CAST(b AS BIGINT) AS bin, round(least(20.0::DOUBLE, p_retailprice - b * 20), 6) AS bin_length, least(20.0::DOUBLE, p_retailprice - b * 20) < 20 AS partial FROM (SELECT *, unnest(generate_series(0, CAST(ceil(p_retailprice / 20) AS BIGINT) - 1)) AS b FROM part)),
c AS (SELECT arc, bin, count(*) AS traversals, sum(distance) AS distance, min(min_speed) AS min_speed, round(round(sum(CAST(round(mean_speed * 1000000) AS BIGINT) * pieces) / CAST(sum(pieces) AS DOUBLE)) / 1000000, 6) AS mean_speed, max(max_speed) AS max_speed FROM tr GROUP BY arc, bin)
SELECT g.arc, g.bin, bin_length, partial, coalesce(traversals, 0) AS traversals, round(coalesce(distance, 0), 6) AS distance, min_speed, mean_speed, max_speed FROM g LEFT JOIN c ON g.arc = c.arc AND g.bin = c.bin
""")
def bin_coverage(spark, sf_dir):
    """Coverage of all bins, crossed or not."""
    return B.ledger(B.arc_bins(arcs(spark, sf_dir), "arc", "length", SIZE), passes(spark, sf_dir), "arc")


VERTICES = f"{EVENTS}, vx AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS nth, CAST(row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS DOUBLE) * 10 AS x, value AS y FROM ev)"
SEGMENTS = f"""{VERTICES}, sg AS (SELECT user_id, nth, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM vx WINDOW w AS (PARTITION BY user_id ORDER BY nth)),
sl AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS length FROM sg WHERE x1 IS NOT NULL),
st AS (SELECT *, sum(length) OVER (PARTITION BY user_id ORDER BY nth ROWS UNBOUNDED PRECEDING) - length AS along, sum(length) OVER (PARTITION BY user_id) AS total FROM sl)"""


def polylines(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    vertices = events(spark, sf_dir).select("user_id", nth.alias("nth"), F.col("value").alias("y")).withColumn("x", F.col("nth").cast("double") * 10)
    return P.segments(vertices, ["user_id"], "nth", ["x", "y"])


@query(f"WITH {SEGMENTS} SELECT user_id, count(*) AS n, round(sum(length), 6) AS length, round(max(length), 6) AS longest FROM st GROUP BY user_id")
def polyline_length(spark, sf_dir):
    """Lengths of polylines."""
    return polylines(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("length"), 6).alias("length"), F.round(F.max("length"), 6).alias("longest"))


RESAMPLED = f"""{SEGMENTS}, tg AS (SELECT st.*, k, total * k / 20 AS target, lead(along) OVER (PARTITION BY user_id, k ORDER BY nth) AS next_along, nth = min(nth) OVER (PARTITION BY user_id, k) AS is_first FROM st CROSS JOIN range(21) r(k)),
hits AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY nth) AS rn, CASE WHEN length > 0 THEN greatest(0, least(1, (target - along) / length)) ELSE 0 END AS share FROM tg WHERE (target > along OR is_first) AND (target <= next_along OR next_along IS NULL)),
rs AS (SELECT user_id, CAST(k AS INTEGER) AS k, x0 + share * (x1 - x0) AS x, y0 + share * (y1 - y0) AS y FROM hits WHERE rn = 1)"""


@query(f"WITH {RESAMPLED} SELECT user_id, k, round(x, 5) AS x, round(y, 5) AS y FROM rs")
def polyline_resample(spark, sf_dir):
    """21 points at equal distances along each polyline."""
    return P.resample(polylines(spark, sf_dir), ["user_id"], ["x", "y"], 21).select("user_id", "k", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query(f"WITH {RESAMPLED} SELECT user_id % 10 AS family, k, round(median(x), 5) AS x, round(median(y), 5) AS y, count(*) AS n FROM rs GROUP BY ALL")
def median_corridor(spark, sf_dir):
    """The coordinate-wise median of each family's polylines."""
    samples = P.resample(polylines(spark, sf_dir), ["user_id"], ["x", "y"], 21).withColumn("family", F.col("user_id") % 10)
    return P.corridor(samples, ["family"], ["x", "y"]).select("family", "k", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), "n")


@query(f"""
WITH {SEGMENTS}, p AS (SELECT *, 50 + user_id % 200 AS px, CAST(60 AS DOUBLE) AS py FROM st),
t AS (SELECT *, CASE WHEN length > 0 THEN greatest(0, least(1, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / (length * length))) ELSE 0 END AS t FROM p),
d AS (SELECT *, (px - x0 - t * (x1 - x0)) * (px - x0 - t * (x1 - x0)) + (py - y0 - t * (y1 - y0)) * (py - y0 - t * (y1 - y0)) AS d2 FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d2, nth) AS rn FROM d)
SELECT user_id, round(sqrt(d2), 5) AS lateral, round(along + t * length, 5) AS along, CAST(nth AS INTEGER) AS nth FROM r WHERE rn = 1
""")
def project_to_polyline(spark, sf_dir):
    """A point's distance to a polyline, and the place of its foot; the first of equal minima."""
    at = {"x": (50 + F.col("user_id") % 200).cast("double"), "y": F.lit(60.0)}
    best = P.projected(polylines(spark, sf_dir), ["x", "y"], at).groupBy("user_id").agg(F.min(F.struct("d2", "nth", "offset")).alias("b"))
    return best.select("user_id", F.round(F.sqrt("b.d2"), 5).alias("lateral"), F.round("b.offset", 5).alias("along"), "b.nth")


def corridors(spark, sf_dir):
    return P.resample(polylines(spark, sf_dir), ["user_id"], ["x", "y"], 21).withColumn("family", F.col("user_id") % 10)


@query(f"""
WITH {RESAMPLED}, f AS (SELECT *, user_id % 10 AS family FROM rs), d AS (SELECT a.family, a.user_id AS a, b.user_id AS b, avg(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS apart FROM f a JOIN f b ON a.family = b.family AND a.k = b.k AND a.user_id < b.user_id GROUP BY ALL)
SELECT family, a, b, round(apart, 4) AS apart FROM d WHERE apart <= 120
""")
def compatible_corridors(spark, sf_dir):
    """Pairs of a family's polylines whose samples lie near each other in the mean."""
    return P.near_pairs(corridors(spark, sf_dir), ["family"], "user_id", ["x", "y"], 120.0, 4)


@query()
def corridor_clusters(spark, sf_dir):
    """Greedy complete-link clusters of compatible polylines, one for all of a shape; tested against a plain version."""
    lines = kept(P.shapes(corridors(spark, sf_dir), ["family"], "user_id", ["x", "y"]))
    return P.complete_clusters(lines, ["family"], "user_id", ["x", "y"], 120.0)


@query(f"""
WITH RECURSIVE {NODES}, r AS (SELECT n_nationkey AS source, n_nationkey AS dst, CAST(0 AS BIGINT) AS dist FROM nation UNION SELECT source, e.dst, dist + len FROM r JOIN edge e ON e.src = r.dst WHERE dist + len <= 12)
SELECT source, dst, min(dist) AS dist FROM r GROUP BY source, dst
""")
def shortest_reach(spark, sf_dir):
    """M5: distances within a budget on a directed graph."""
    e = edges(spark, sf_dir)
    return R.reach(e, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src")), 12)


ARCS = f"{NODES}, arc AS (SELECT src * 2 + row_number() OVER (PARTITION BY src ORDER BY dst, len) - 1 AS arc, src, dst, len FROM edge)"


@query(f"""
WITH RECURSIVE {ARCS}, rel AS (SELECT n_nationkey AS from_src, (3 * n_nationkey + 1) % 25 AS via, (5 * ((3 * n_nationkey + 1) % 25) + 2) % 25 AS to_dst, n_nationkey % 3 = 0 AS no FROM nation WHERE n_nationkey % 3 < 2),
ban AS (SELECT DISTINCT a.arc AS from_arc, b.arc AS to_arc FROM rel JOIN arc a ON a.src = from_src AND a.dst = via JOIN arc b ON b.src = via WHERE (b.dst = to_dst) = no),
r AS (SELECT src AS source, arc, dst AS node, CAST(len AS BIGINT) AS dist, [arc] AS path FROM arc
  UNION ALL SELECT r.source, n.arc, n.dst, r.dist + n.len, list_append(r.path, n.arc) FROM r JOIN arc n ON n.src = r.node LEFT JOIN ban ON ban.from_arc = r.arc AND ban.to_arc = n.arc WHERE ban.from_arc IS NULL AND r.dist + n.len <= 12),
w AS (SELECT source, node, dist, CAST(len(path) AS INTEGER) AS turns, path FROM r UNION ALL SELECT n_nationkey, n_nationkey, 0, 0, [] FROM nation),
o AS (SELECT *, row_number() OVER (PARTITION BY source, node ORDER BY dist, turns, path) AS nth FROM w)
SELECT source, node, dist, turns, array_to_string(path, '-') AS path FROM o WHERE nth = 1
""")
def turn_restricted_routes(spark, sf_dir):
    """The best ways within a budget by which no forbidden turn is taken, with their arcs."""
    nth = F.row_number().over(Window.partitionBy("src").orderBy("dst", "len")) - 1
    arcs = edges(spark, sf_dir).select((F.col("src") * 2 + nth).alias("arc"), "src", "dst", "len")
    rules = restriction_rules(spark, sf_dir).filter("state = 'FORBIDDEN'").select("from_src", "via", F.col("dst").alias("to_dst"))
    into = arcs.select(F.col("arc").alias("from_arc"), F.col("src").alias("from_src"), F.col("dst").alias("via"))
    out = arcs.select(F.col("arc").alias("to_arc"), F.col("src").alias("via"), F.col("dst").alias("to_dst"))
    banned = rules.join(into, ["from_src", "via"]).join(out, ["via", "to_dst"])
    found = R.routes(arcs, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src")), banned, 12)
    return found.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "-"))


@query(f"WITH RECURSIVE {NODES}, f AS (SELECT src, dst FROM edge WHERE dst > src), r AS (SELECT src AS a, dst AS b FROM f UNION SELECT r.a, f.dst FROM r JOIN f ON f.src = r.b) SELECT a, b FROM r")
def stage_closure(spark, sf_dir):
    """Everything downstream of each stage of an acyclic graph."""
    return R.closure(edges(spark, sf_dir).filter("dst > src"))


WAYS = "wn AS (SELECT l_suppkey AS way, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS pos, l_orderkey AS node, CAST(l_orderkey % 100 AS DOUBLE) AS x, CAST(l_orderkey // 100 AS DOUBLE) AS y, l_suppkey % 2 = 0 AS two_way FROM lineitem)"


@query(f"""
WITH {WAYS}, s AS (SELECT node, count(DISTINCT way) AS ways FROM wn GROUP BY node),
m AS (SELECT wn.*, lag(node) OVER w IS NULL OR lead(node) OVER w IS NULL OR ways > 1 AS is_end FROM wn JOIN s USING (node) WINDOW w AS (PARTITION BY way ORDER BY pos)),
c AS (SELECT *, sum(CASE WHEN is_end THEN 1 ELSE 0 END) OVER (PARTITION BY way ORDER BY pos) AS n FROM m),
e AS (SELECT *, unnest(CASE WHEN is_end THEN [n - 1, n] ELSE [n] END) AS chain FROM c),
l AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS step FROM e WINDOW w AS (PARTITION BY way, chain ORDER BY pos)),
a AS (SELECT way, chain, arg_min(node, pos) AS a, arg_max(node, pos) AS b, count(*) AS n_vertices, round(sum(step), 6) AS length, bool_or(two_way) AS two_way FROM l GROUP BY way, chain HAVING count(*) > 1),
d AS (SELECT *, unnest(CASE WHEN two_way THEN ['forward', 'reverse'] ELSE ['forward'] END) AS direction FROM a)
SELECT way, CAST(chain AS BIGINT) AS chain, direction, CASE direction WHEN 'forward' THEN a ELSE b END AS from_node, CASE direction WHEN 'forward' THEN b ELSE a END AS to_node, n_vertices, length, sha256(way || '|' || CAST(chain AS BIGINT) || '|' || direction) AS arc_id FROM d
""")
def road_arcs(spark, sf_dir):
    """Ways cut into directed arcs where they meet."""
    pos = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    node = F.col("l_orderkey")
    lineitem = table(spark, sf_dir, "lineitem")
    rows = lineitem.count()
    refs = spread(lineitem, rows, "l_suppkey").select(F.col("l_suppkey").alias("way"), pos.alias("pos"), node.alias("node"), (node % 100).cast("double").alias("x"), F.floor(node / 100).cast("double").alias("y"), (F.col("l_suppkey") % 2 == 0).alias("both"))
    return R.build_arcs(refs, "way", "pos", "node", ["x", "y"], "both", rows=rows)


@query(f"WITH {NODES}, n AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey <> 13) SELECT 0 AS repeated, (SELECT count(*) FROM edge WHERE src NOT IN (SELECT k FROM n)) AS unknown_starts, (SELECT count(*) FROM edge WHERE dst NOT IN (SELECT k FROM n)) AS unknown_ends")
def graph_invariants(spark, sf_dir):
    """Repeated nodes, and arcs whose ends are unknown."""
    return R.graph_invariants(table(spark, sf_dir, "nation").filter("n_nationkey != 13"), edges(spark, sf_dir), "n_nationkey", "src", "dst")
