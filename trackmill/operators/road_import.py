"""From a road map's elements to a directed graph with its rules of turning and the figures of what was taken in.

Ways are classified by their tags (P1), cut into directed arcs where they meet (I2, U3), and restrictions become rules between arcs (J3, U4). All joins are equal joins
on ways and nodes. What a tag leaves open is never guessed: such ways are left out with a reason, such restrictions mark every turn that they could mean.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .graphs import arc_id, build_arcs
from .state import stored


@dataclass(frozen=True)
class RoadProfile:
    """Classes of roads, keys of access in the order they count, and what their values mean."""

    highways: tuple[str, ...] = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service")
    access: tuple[str, ...] = ("motorcar", "motor_vehicle", "vehicle", "access")
    allowed: tuple[str, ...] = ("yes", "permissive", "designated", "official")
    denied: tuple[str, ...] = ("no", "private", "destination", "delivery", "customers", "permit")
    oneway: tuple[str, ...] = ("oneway:motor_vehicle", "oneway")
    forward: tuple[str, ...] = ("yes", "1", "true")
    reverse: tuple[str, ...] = ("-1",)
    both: tuple[str, ...] = ("no", "0", "false")
    round_junctions: tuple[str, ...] = ("roundabout", "circular")
    forward_highways: tuple[str, ...] = ("motorway", "motorway_link")
    restriction: tuple[str, ...] = ("restriction:motorcar", "restriction:motor_vehicle", "restriction")
    least_length: float = 0.01


def _tag(*keys: str) -> Column:
    return F.coalesce(*[F.col("tags")[k] for k in keys])


def _has(*keys: str) -> Column:
    return F.array_contains(F.map_keys("tags"), keys[0]) if len(keys) == 1 else F.arrays_overlap(F.map_keys("tags"), F.array(*map(F.lit, keys)))


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def classified(ways: DataFrame, profile: RoadProfile = RoadProfile()) -> DataFrame:
    """Ways (way, refs, tags) with excluded (the first reason that applies, else null), forward and reverse."""
    p, highway, access, oneway, layer = profile, _tag("highway"), _tag(*profile.access), _tag(*profile.oneway), _tag("layer")
    sides = {s: _tag(*[f"{k}:{s}" for k in p.access]) for s in ("forward", "backward")}
    unknown = [_sure(~v.isin(*p.allowed, *p.denied)) for v in sides.values()]
    opened = {s: ~_sure(v.isin(*p.denied)) for s, v in sides.items()}
    round_way = _sure(_tag("junction").isin(*p.round_junctions)) | _sure(highway.isin(*p.forward_highways))
    forward = F.when(oneway.isNull(), True).otherwise(oneway.isin(*p.forward, *p.both)) & opened["forward"]
    reverse = F.when(oneway.isNull(), ~round_way).otherwise(oneway.isin(*p.reverse, *p.both)) & opened["backward"]
    reason = (
        F.when(~_sure(highway.isin(*p.highways)), "unsupported_highway")
        .when(_sure(_tag("area") == "yes"), "area")
        .when(_sure(highway == "construction") | _has("construction", "proposed"), "construction")
        .when(_sure(_tag("route") == "ferry") | _has("ferry"), "ferry")
        .when(F.exists(F.map_keys("tags"), lambda k: k.endswith(":conditional")), "conditional_access")
        .when(_sure(access.isin(*p.denied)), "denied_or_limited_access")
        .when(_sure(~access.isin(*p.allowed)), "unknown_access")
        .when(F.size("refs") < 2, "insufficient_geometry")
        .when(_sure(~oneway.isin(*p.forward, *p.reverse, *p.both)), "unknown_oneway")
        .when(unknown[0] | unknown[1], "unknown_directional_access")
        .when(~forward & ~reverse, "no_allowed_direction")
        .when(_sure(~layer.rlike(r"^\s*[+-]?[0-9]+\s*$")), "unknown_layer")
    )
    return ways.withColumns({"excluded": reason, "forward": forward, "reverse": reverse})


def origin(elements: DataFrame) -> tuple[float, float, float]:
    """Degrees and height of the middle of the map's bounds, or of its nodes where it has none: two numbers, of one aggregation."""
    own, node = F.col("kind") == "bounds", F.col("kind") == "node"
    ends = []
    for name, low, high in (("lat_e7", "south", "north"), ("lon_e7", "west", "east")):
        ends += [F.coalesce(F.min(F.when(own, F.col(f"bounds.{low}"))), F.min(F.when(node, F.col(name)))), F.coalesce(F.max(F.when(own, F.col(f"bounds.{high}"))), F.max(F.when(node, F.col(name))))]
    south, north, west, east = elements.agg(*ends).first()
    if south is None or west is None:
        raise ValueError("the map has neither bounds nor nodes")
    if south > north or west > east:
        raise ValueError("the map's bounds are reversed")
    return (south + north) * 5 / 1e8, (west + east) * 5 / 1e8, 0.0


def faults(elements: DataFrame) -> DataFrame:
    """One row: ids that repeat within a kind or are missing, places that are no degrees, and references to nodes that are not there."""
    main = elements.filter("kind != 'bounds'")
    repeated = main.groupBy("kind", "id").count().filter("count > 1 OR id IS NULL").select(F.lit("repeated").alias("what"))
    misplaced = main.filter("kind = 'node' AND NOT (valid AND abs(lat_e7) <= 900000000 AND abs(lon_e7) <= 1800000000)").select(F.lit("misplaced").alias("what"))
    asked = main.filter("kind = 'way'").select(F.explode("refs").alias("node"))
    lost = asked.join(main.filter("kind = 'node'").select(F.col("id").alias("node")), "node", "left_anti").select(F.lit("unknown_nodes").alias("what"))
    return repeated.union(misplaced).union(lost).agg(*[F.count_if(F.col("what") == n).alias(n) for n in ("repeated", "misplaced", "unknown_nodes")])


def restrictions(relations: DataFrame, ways: DataFrame, profile: RoadProfile = RoadProfile()) -> DataFrame:
    """relation, value, from_ways, to_ways, via_nodes, reading: what each restriction (relations: relation, members, tags) says, before arcs are looked at.

    ways: those that are taken in. APPLIED_NO and APPLIED_ONLY can still turn out not to meet any arcs.
    """
    of = lambda kind, role: F.transform(F.filter("members", lambda m: (m["type"] == kind) & (m["role"] == role)), lambda m: m["ref"])
    named = relations.filter(_sure(_tag("type") == "restriction")).select(
        "relation", "tags", F.coalesce(_tag(*profile.restriction, "restriction:conditional"), F.lit("")).alias("value"), of("way", "from").alias("from_ways"), of("way", "to").alias("to_ways"), of("node", "via").alias("via_nodes"), of("way", "via").alias("via_ways")
    )
    for side in ("from", "to"):
        known = ways.select(F.col("way").alias("__way"), F.lit(True).alias(f"__{side}"))
        named = named.join(known, F.get(f"{side}_ways", F.lit(0)) == F.col("__way"), "left").drop("__way")
    simple = (F.size("from_ways") == 1) & (F.size("to_ways") == 1) & (F.size("via_nodes") == 1)
    reading = (
        F.when(_has("except"), "UNKNOWN_EXCEPT")
        .when(F.exists(F.map_keys("tags"), lambda k: k.endswith(":conditional")), "UNKNOWN_CONDITIONAL")
        .when(F.size("via_ways") > 0, "UNKNOWN_VIA_WAY")
        .when(~simple, "UNKNOWN_MALFORMED")
        .when(~F.col("value").rlike("^(no|only)_"), "UNKNOWN_VALUE")
        .when(F.col("__from").isNull() | F.col("__to").isNull(), "INACTIVE_SOURCE_EXCLUDED")
        .when(F.col("value").startswith("no_"), "APPLIED_NO")
        .otherwise("APPLIED_ONLY")
    )
    return named.select("relation", "value", "from_ways", "to_ways", "via_nodes", reading.alias("reading"))


def turn_rules(arcs: DataFrame, read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules (relation, reading, from_arc, to_arc, state) and restrictions with their final reading and number of rules.

    arcs: arc_id (of any type), way, from_node, to_node. A restriction's turns are those from the arcs of its from-ways that end at its one via-node (at any node, if it does
    not name just one). NO forbids the turns into its to-way, ONLY all others there; what meets no arcs is UNKNOWN_DISCONNECTED and, like all that is
    unknown, marks each of its turns. A turn that two members give is one rule. Turns are kept, so that arcs are joined once.
    """
    into = arcs.select(F.col("arc_id").alias("from_arc"), F.col("way").alias("__way"), F.col("to_node").alias("__at"))
    out = arcs.select(F.col("arc_id").alias("to_arc"), F.col("way").alias("__to_way"), F.col("from_node").alias("__at"))
    active = read.filter("reading != 'INACTIVE_SOURCE_EXCLUDED'").withColumn("__via", F.when(F.size("via_nodes") == 1, F.get("via_nodes", F.lit(0))))
    asked = active.select("relation", "reading", "to_ways", "__via", F.explode(F.array_distinct("from_ways")).alias("__way"))
    turns = stored(asked.join(into, "__way").filter("__via IS NULL OR __via = __at").join(out, "__at").select("relation", "reading", "from_arc", "to_arc", F.array_contains("to_ways", F.col("__to_way")).alias("named")))
    met = turns.groupBy("relation").agg(F.count_if("named").alias("named"), F.count_if(~F.col("named")).alias("others"))

    def judged(n: Column, o: Column) -> tuple[Column, Column]:
        """Whether a restriction meets nothing that it could apply to, and its final reading."""
        empty = ((F.col("reading") == "APPLIED_NO") & (n == 0)) | ((F.col("reading") == "APPLIED_ONLY") & ((n == 0) | (o == 0)))
        return empty, F.when(empty, "UNKNOWN_DISCONNECTED").otherwise(F.col("reading"))

    n, o = F.coalesce("named", F.lit(0)), F.coalesce("others", F.lit(0))
    empty, last = judged(n, o)
    made = F.when(F.col("reading") == "INACTIVE_SOURCE_EXCLUDED", F.lit(0)).when(empty, n + o).when(F.col("reading") == "APPLIED_NO", n).when(F.col("reading") == "APPLIED_ONLY", o).otherwise(n + o)
    final = read.join(met, "relation", "left").select("relation", "value", last.alias("reading"), made.cast("long").alias("rules"))
    own = Window.partitionBy("relation")
    counted = turns.withColumns({"__n": F.count_if("named").over(own), "__o": F.count_if(~F.col("named")).over(own)})
    read_so = counted.withColumn("reading", judged(F.col("__n"), F.col("__o"))[1])
    applies = F.when(F.col("reading") == "APPLIED_NO", F.col("named")).when(F.col("reading") == "APPLIED_ONLY", ~F.col("named")).otherwise(True)
    state = F.when(F.col("reading").startswith("APPLIED"), "FORBIDDEN").otherwise("UNKNOWN_RESTRICTION")
    return read_so.filter(applies).select("relation", "reading", "from_arc", "to_arc", state.alias("state")).distinct(), final


def sound(elements: DataFrame, profile: RoadProfile = RoadProfile()) -> DataFrame:
    """The classified ways of a map's elements, as sources.road_map gives them, without their tags.

    A map with repeated ids, misplaced nodes or references to nodes that it lacks is an error, as is one without nodes.
    """
    wrong = faults(elements).first().asDict()
    if any(wrong.values()):
        raise ValueError(f"the map is at fault: {wrong}")
    return stored(classified(elements.filter("kind = 'way'").select(F.col("id").alias("way"), "refs", "tags"), profile).drop("tags"))


def excluded(every: DataFrame) -> DataFrame:
    """excluded (the reason), ways: how many classified ways are left out."""
    return every.filter("excluded IS NOT NULL").groupBy("excluded").agg(F.count("*").alias("ways"))


def directed(elements: DataFrame, every: DataFrame, profile: RoadProfile = RoadProfile()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The arcs of the classified ways that are taken in, those ways' nodes in order, and the nodes that arcs end at.

    Lengths are in metres, on the plane through the middle of the map's bounds.
    """
    middle = origin(elements)
    ways = every.filter("excluded IS NULL")
    relations = elements.filter("kind = 'relation'")
    east, north, _ = G.to_enu(F.col("lat_e7") / 1e7, F.col("lon_e7") / 1e7, F.lit(0.0), middle)
    placed = elements.filter("kind = 'node'").select(F.col("id").alias("node"), F.round(east, 6).alias("x"), F.round(north, 6).alias("y"))
    on_ways = ways.select("way", "forward", "reverse", F.posexplode("refs").alias("pos", "node")).join(placed, "node")
    via = relations.filter(_sure(_tag("type") == "restriction")).select(F.explode("members").alias("m")).filter("m.type = 'node' AND m.role = 'via'").select(F.col("m.ref").alias("node"))
    ends = ways.select(F.explode(F.array(F.get("refs", F.lit(0)), F.get("refs", F.size("refs") - 1))).alias("node")).union(via)
    return build_arcs(on_ways, "way", "pos", "node", ["x", "y"], "reverse", ends=ends, ahead="forward", least=profile.least_length), on_ways, ends


def imported(elements: DataFrame, profile: RoadProfile = RoadProfile()) -> dict[str, DataFrame]:
    """nodes, arcs, rules, restrictions, excluded (reason, ways) and statistics (one row) of a map's elements, as sources.road_map gives them.

    Elements are kept by their reader, classified ways, arcs and turns here; everything else is lazy. Who needs ways or arcs alone takes sound() and directed(). Rules name
    arcs by structs of way, chain and direction, as digests are not compressed; an arc's own digest is made when it is asked for.
    """
    every = sound(elements, profile)
    arcs, on_ways, ends = directed(elements, every, profile)
    arcs = stored(arcs.drop("arc_id")).withColumn("arc_id", arc_id("way"))
    relations = elements.filter("kind = 'relation'").select(F.col("id").alias("relation"), "members", "tags")
    ways = every.filter("excluded IS NULL")
    rules, final = turn_rules(arcs.withColumn("arc_id", F.struct("way", "chain", "direction")), restrictions(relations, ways, profile))
    used = on_ways.groupBy("node").agg(F.count_distinct("way").alias("ways"), F.first("x").alias("x"), F.first("y").alias("y"))
    nodes = used.join(ends.select("node", F.lit(True).alias("__end")).distinct(), "node", "left").filter("ways > 1 OR __end").select("node", "x", "y")
    count = lambda df, name, what=F.lit(True): df.agg(F.count_if(what).alias(name))
    parts = [
        elements.agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("node", "way", "relation")]),
        every.agg(F.count_if(F.col("excluded").isNull()).alias("included_ways"), F.count_if(F.col("excluded").isNotNull()).alias("excluded_ways")),
        count(nodes, "topology_nodes"),
        arcs.agg(F.count("*").alias("arcs"), F.count_if(F.col("direction") == "forward").alias("forward_arcs"), F.count_if(F.col("direction") == "reverse").alias("reverse_arcs")),
        count(rules, "transition_rules"),
        final.agg(F.count_if(F.col("reading").startswith("APPLIED")).alias("applied_restrictions"), F.count_if(F.col("reading").startswith("UNKNOWN")).alias("unknown_restrictions")),
    ]
    # one row of each part, each with its own columns
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    statistics = rows.agg(*[F.max(c).alias(c) for c in rows.columns])
    return {"nodes": nodes, "arcs": arcs, "rules": rules, "restrictions": final, "excluded": excluded(every), "statistics": statistics}
