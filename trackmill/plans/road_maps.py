"""A road map from its file to arcs and rules: parts are nodes, orders are ways along their line items, and each part restricts turns between two of its orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import road_import as I
from ..sources import road_map as M
from .files import folder
from .registry import query, table


#: Elements of a file, since a compressed file is read by one task.
FILE_ELEMENTS = 100_000


def written(spark, sf_dir) -> str:
    """The map as XML in the shared folder, in compressed files: as many as the tables have parts, more where a part has more than FILE_ELEMENTS elements."""
    tag = lambda k, v: F.when(v.isNotNull(), F.struct(F.lit(k).alias("_k"), v.cast("string").alias("_v")))
    member = lambda kind, ref, role: F.struct(F.lit(kind).alias("_type"), ref.alias("_ref"), F.lit(role).alias("_role"))
    xml = lambda name, *columns: F.to_xml(F.struct(*columns), {"rowTag": name}).alias("value")
    part, li, key = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"), F.col("p_partkey")
    degrees = lambda whole, x: F.concat(F.lit(f"{whole}."), F.lpad((x * 5000).cast("string"), 7, "0"))
    nodes = part.select(xml("node", key.alias("_id"), degrees(48, key % 97).alias("_lat"), degrees(11, F.floor(key / 97) % 1900).alias("_lon")))
    along = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("along"))
    refs = F.transform(F.coalesce("along", F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint>>")), lambda a: F.struct(a["l_partkey"].alias("_ref")))
    cust, first = F.col("o_custkey"), F.substring("o_orderpriority", 1, 1)
    tags = F.array_compact(F.array(
        tag("highway", F.when(first == "1", "motorway").when(first == "2", "primary").when(first == "3", "residential").when(first == "4", "service").otherwise("footway")),
        tag("oneway", F.when(cust % 5 == 0, "yes").when(cust % 5 == 1, "-1").when(cust % 5 == 2, "no").when((cust % 5 == 4) & (F.col("o_orderkey") % 7 == 0), "reversible")),
        tag("access", F.when(F.col("o_orderstatus") == "O", "yes").when(F.col("o_orderstatus") == "P", "private")),
        tag("area", F.when(cust % 13 == 0, "yes")), tag("layer", F.when(cust % 11 == 0, "x").when(cust % 11 == 1, "-1")), tag("name", F.concat(F.lit("<&\"'> "), F.col("o_clerk") if "o_clerk" in table(spark, sf_dir, "orders").columns else cust.cast("string"))),
    ))
    ways = table(spark, sf_dir, "orders").join(along, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(xml("way", F.col("o_orderkey").alias("_id"), refs.alias("nd"), tags.alias("tag")))
    ends = li.groupBy(F.col("l_partkey").alias("k")).agg(F.min("l_orderkey").alias("a"), F.max("l_orderkey").alias("b"))
    k = F.col("k")
    value = F.when(k % 6 == 1, "only_straight_on").when(k % 6 == 2, "no_u_turn").when(k % 6 == 3, "maybe").otherwise("no_left_turn")
    members = F.array_compact(F.array(member("way", F.col("a"), "from"), member("node", k, "via"), F.when(k % 6 == 5, member("way", F.col("b"), "via")), member("way", F.col("b"), "to")))
    facts = F.array_compact(F.array(tag("type", F.when(k % 6 == 4, "multipolygon").otherwise("restriction")), tag("restriction", value), tag("except", F.when(k % 6 == 2, "bus"))))
    relations = ends.select(xml("relation", k.alias("_id"), members.alias("member"), facts.alias("tag")))
    at = folder(spark)
    nodes.union(ways).union(relations).write.option("maxRecordsPerFile", FILE_ELEMENTS).text(at, compression="gzip")
    return at


def elements(spark, sf_dir):
    return M.elements(spark, written(spark, sf_dir))


def graph(spark, sf_dir):
    return I.imported(elements(spark, sf_dir))


#: The map's arcs in SQL, from the tables that it was made of.
ARCS = f"""pt AS (SELECT p_partkey AS node, 48 + (p_partkey % 97) * 5000 / CAST(1e7 AS DOUBLE) AS lat, 11 + (p_partkey // 97 % 1900) * 5000 / CAST(1e7 AS DOUBLE) AS lon FROM part),
md AS (SELECT (min(lat) + max(lat)) / 2 AS la, (min(lon) + max(lon)) / 2 AS lo FROM pt),
kk AS (SELECT *, {G.A} / sqrt(1 - {G.E2} * sin(radians(lat)) * sin(radians(lat))) AS n, {G.A} / sqrt(1 - {G.E2} * sin(radians(la)) * sin(radians(la))) AS n0 FROM pt, md),
ec AS (SELECT *, n * cos(radians(lat)) * cos(radians(lon)) - n0 * cos(radians(la)) * cos(radians(lo)) AS dx, n * cos(radians(lat)) * sin(radians(lon)) - n0 * cos(radians(la)) * sin(radians(lo)) AS dy, n * {1 - G.E2} * sin(radians(lat)) - n0 * {1 - G.E2} * sin(radians(la)) AS dz FROM kk),
pl AS (SELECT node, round(-sin(radians(lo)) * dx + cos(radians(lo)) * dy, 6) AS x, round(-sin(radians(la)) * cos(radians(lo)) * dx - sin(radians(la)) * sin(radians(lo)) * dy + cos(radians(la)) * dz, 6) AS y FROM ec),
rf AS (SELECT l_orderkey AS way, l_partkey AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos FROM lineitem),
wy AS (SELECT o_orderkey AS way, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'motorway' WHEN '2' THEN 'primary' WHEN '3' THEN 'residential' WHEN '4' THEN 'service' ELSE 'footway' END AS highway,
  CASE WHEN o_custkey % 5 = 0 THEN 'yes' WHEN o_custkey % 5 = 1 THEN '-1' WHEN o_custkey % 5 = 2 THEN 'no' WHEN o_custkey % 5 = 4 AND o_orderkey % 7 = 0 THEN 'reversible' END AS oneway, o_custkey AS cust, o_orderstatus AS st FROM orders),
sz AS (SELECT way, count(*) AS c FROM rf GROUP BY way),
cl AS (SELECT way, CASE WHEN highway = 'footway' THEN 'unsupported_highway' WHEN cust % 13 = 0 THEN 'area' WHEN st = 'P' THEN 'denied_or_limited_access' WHEN coalesce(c, 0) < 2 THEN 'insufficient_geometry' WHEN oneway = 'reversible' THEN 'unknown_oneway' WHEN cust % 11 = 0 THEN 'unknown_layer' END AS excluded,
  coalesce(oneway <> '-1', true) AS ahead, CASE WHEN oneway IS NULL THEN highway <> 'motorway' ELSE oneway IN ('no', '-1') END AS back FROM wy LEFT JOIN sz USING (way)),
inc AS (SELECT * FROM cl WHERE excluded IS NULL),
u AS (SELECT rf.way, node, pos, ahead, back, lag(node) OVER w IS NULL OR lead(node) OVER w IS NULL AS tip FROM rf JOIN inc USING (way) WINDOW w AS (PARTITION BY rf.way ORDER BY pos)),
rl AS (SELECT l_partkey AS k, min(l_orderkey) AS a, max(l_orderkey) AS b FROM lineitem GROUP BY l_partkey),
tp AS (SELECT node FROM u GROUP BY node HAVING count(DISTINCT way) > 1 OR bool_or(tip) OR bool_or(node IN (SELECT k FROM rl WHERE k % 6 <> 4))),
m AS (SELECT u.*, x, y, tip OR tp.node IS NOT NULL AS is_end FROM u LEFT JOIN tp ON tp.node = u.node JOIN pl ON pl.node = u.node),
c AS (SELECT *, sum(CASE WHEN is_end THEN 1 ELSE 0 END) OVER (PARTITION BY way ORDER BY pos) AS n FROM m),
e AS (SELECT *, unnest(CASE WHEN is_end THEN [n - 1, n] ELSE [n] END) AS chain FROM c),
l AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) AS step FROM e WINDOW w AS (PARTITION BY way, chain ORDER BY pos)),
g AS (SELECT way, CAST(chain AS BIGINT) AS chain, arg_min(node, pos) AS p, arg_max(node, pos) AS q, count(*) AS n_vertices, sum(step) AS length, bool_or(ahead) AS ahead, bool_or(back) AS back FROM l GROUP BY way, chain HAVING count(*) > 1 AND sum(step) >= 0.01),
arc AS (SELECT way, chain, 'forward' AS direction, p AS from_node, q AS to_node, n_vertices, length FROM g WHERE ahead UNION ALL SELECT way, chain, 'reverse', q, p, n_vertices, length FROM g WHERE back)"""
RULES = f"""{ARCS}, rr AS (SELECT k AS relation, a, b, CASE k % 6 WHEN 2 THEN 'UNKNOWN_EXCEPT' WHEN 5 THEN 'UNKNOWN_VIA_WAY' WHEN 3 THEN 'UNKNOWN_VALUE' ELSE CASE WHEN a NOT IN (SELECT way FROM inc) OR b NOT IN (SELECT way FROM inc) THEN 'INACTIVE_SOURCE_EXCLUDED' WHEN k % 6 = 0 THEN 'APPLIED_NO' ELSE 'APPLIED_ONLY' END END AS reading FROM rl WHERE k % 6 <> 4),
tn AS (SELECT relation, reading, i.way AS from_way, i.chain AS from_chain, i.direction AS from_direction, o.way AS to_way, o.chain AS to_chain, o.direction AS to_direction, o.way = b AS named FROM rr JOIN arc i ON i.way = a AND i.to_node = relation JOIN arc o ON o.from_node = relation WHERE reading <> 'INACTIVE_SOURCE_EXCLUDED'),
nm AS (SELECT relation, count(*) FILTER (named) AS n, count(*) FILTER (NOT named) AS o FROM tn GROUP BY relation),
fin AS (SELECT rr.relation, CASE WHEN reading = 'APPLIED_NO' AND coalesce(n, 0) = 0 OR reading = 'APPLIED_ONLY' AND (coalesce(n, 0) = 0 OR coalesce(o, 0) = 0) THEN 'UNKNOWN_DISCONNECTED' ELSE reading END AS reading FROM rr LEFT JOIN nm USING (relation)),
ru AS (SELECT tn.relation, fin.reading, from_way, from_chain, from_direction, to_way, to_chain, to_direction, CASE WHEN fin.reading LIKE 'APPLIED%' THEN 'FORBIDDEN' ELSE 'UNKNOWN_RESTRICTION' END AS state FROM tn JOIN fin USING (relation) WHERE CASE fin.reading WHEN 'APPLIED_NO' THEN named WHEN 'APPLIED_ONLY' THEN NOT named ELSE true END)"""


@query(f"WITH {ARCS} SELECT way, chain, direction, from_node, to_node, n_vertices, round(round(length, 6) + 1e-7, 3) AS length FROM arc")
def imported_arcs(spark, sf_dir):
    """Directed arcs of the ways that a map in XML has, cut at ends, crossings and restricted nodes.

    Lengths of whole micrometres are moved off the half millimetre before they are rounded, as engines round halves of doubles differently.
    """
    read = elements(spark, sf_dir)
    arcs = I.directed(read, I.sound(read))[0]
    return arcs.select("way", "chain", "direction", "from_node", "to_node", "n_vertices", F.round(F.col("length") + 1e-7, 3).alias("length"))


@query(f"WITH {RULES} SELECT relation, reading, from_way, from_chain, from_direction, to_way, to_chain, to_direction, state FROM ru")
def imported_rules(spark, sf_dir):
    """The turns that a map's relations forbid or leave unknown, from its file to pairs of arcs."""
    sides = [F.col(f"{s}_arc.{c}").alias(f"{s}_{c}") for s in ("from", "to") for c in ("way", "chain", "direction")]
    return graph(spark, sf_dir)["rules"].select("relation", "reading", *sides, "state")


@query(f"""
WITH {RULES} SELECT (SELECT count(*) FROM part) AS nodes, (SELECT count(*) FROM orders) AS ways, (SELECT count(*) FROM rl) AS relations, (SELECT count(*) FROM inc) AS included_ways, (SELECT count(*) FROM cl) - (SELECT count(*) FROM inc) AS excluded_ways,
  (SELECT count(*) FROM tp) AS topology_nodes, (SELECT count(*) FROM arc) AS arcs, (SELECT count(*) FROM arc WHERE direction = 'forward') AS forward_arcs, (SELECT count(*) FROM arc WHERE direction = 'reverse') AS reverse_arcs, (SELECT count(*) FROM ru) AS transition_rules,
  (SELECT count(*) FROM fin WHERE reading LIKE 'APPLIED%') AS applied_restrictions, (SELECT count(*) FROM fin WHERE reading LIKE 'UNKNOWN%') AS unknown_restrictions
""")
def import_statistics(spark, sf_dir):
    """What was read, what was taken in, and what came of it."""
    return graph(spark, sf_dir)["statistics"]


@query(f"WITH {ARCS} SELECT excluded, count(*) AS ways FROM cl WHERE excluded IS NOT NULL GROUP BY excluded")
def excluded_ways(spark, sf_dir):
    """How many ways of a map each reason keeps out."""
    return I.excluded(I.sound(elements(spark, sf_dir)))
