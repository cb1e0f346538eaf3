"""Directed graphs as tables: building of arcs, shortest paths within a budget, closures, invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import settled, spread


def build_arcs(way_nodes: DataFrame, way: str, pos: str, node: str, axes: list[str], both_ways: str, digits: int = 6, ends: DataFrame | None = None, ahead: str | None = None, least: float = 0.0, rows: int | None = None) -> DataFrame:
    """arc_id, way, chain, direction, from_node, to_node, n_vertices, length: ways cut where they end or meet.

    A node is an end of arcs if it is a way's end or belongs to several ways, or is among `ends` (a column `node`). Rows where `both_ways` is true also give
    the reverse; where `ahead` names a column, the forward arc is there only if that is true. Arcs shorter than `least` are left out. `rows` is how many
    way_nodes there are: if it is given, parts are as many as keep them small.
    """
    w = Window.partitionBy(way).orderBy(pos)
    at = Window.partitionBy(node)
    deal = (lambda df, key: df) if rows is None else (lambda df, key: spread(df, rows, key))
    met = deal(way_nodes.filter(F.col(node).isNotNull()), node).withColumn("__shared", F.coalesce(F.min(way).over(at) != F.max(way).over(at), F.lit(False)))
    if ends is not None:
        met = met.join(ends.select(F.col("node").alias(node), F.lit(True).alias("__named")).distinct(), node, "left").withColumn("__shared", F.col("__shared") | F.col("__named").isNotNull()).drop("__named")
    marked = deal(met, way).withColumn("__end", F.lag(node).over(w).isNull() | F.lead(node).over(w).isNull() | F.col("__shared"))
    chain = F.sum(F.when(F.col("__end"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # an inner end closes one chain and opens the next
    cut = marked.withColumn("__n", chain).withColumn("chain", F.explode(F.when(F.col("__end"), F.array(F.col("__n") - 1, F.col("__n"))).otherwise(F.array("__n"))))
    inside = Window.partitionBy(way, "chain").orderBy(pos)
    step = sum(((F.col(a) - F.lag(a).over(inside)) * (F.col(a) - F.lag(a).over(inside)) for a in axes[1:]), (F.col(axes[0]) - F.lag(axes[0]).over(inside)) * (F.col(axes[0]) - F.lag(axes[0]).over(inside)))
    arcs = cut.withColumn("__step", F.coalesce(F.sqrt(step), F.lit(0.0))).groupBy(way, "chain").agg(F.min_by(node, pos).alias("a"), F.max_by(node, pos).alias("b"), F.count("*").alias("n_vertices"), F.round(F.sum("__step"), digits).alias("length"), F.bool_or(both_ways).alias("__both"), (F.bool_or(ahead) if ahead else F.lit(True)).alias("__ahead")).filter((F.col("n_vertices") > 1) & (F.col("length") >= least))
    ways = F.array_compact(F.array(F.when(F.col("__ahead"), "forward"), F.when(F.col("__both"), "reverse")))
    made = arcs.withColumn("direction", F.explode(ways))
    forward = F.col("direction") == "forward"
    named = made.select(way, "chain", "direction", F.when(forward, F.col("a")).otherwise(F.col("b")).alias("from_node"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("to_node"), "n_vertices", "length")
    return named.withColumn("arc_id", arc_id(way))


def arc_id(way: str) -> Column:
    """What build_arcs() names an arc by."""
    return F.sha2(F.concat_ws("|", way, "chain", "direction"), 256)


def _with_stays(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """__from, __to, len: the arcs, and one of length 0 from each node to itself, so that a step also keeps what is reached."""
    arcs = edges.select(F.col("src").alias("__from"), F.col("dst").alias("__to"), F.col("len").cast("long").alias("len"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("n")).union(sources.select("src")).distinct()
    return arcs.unionByName(nodes.select(F.col("n").alias("__from"), F.col("n").alias("__to"), F.lit(0).cast("long").alias("len")))


def reach(edges: DataFrame, sources: DataFrame, budget: int) -> DataFrame:
    """source, dst, dist: shortest distances within the budget, by frontier expansion with a minimum at each step until nothing changes.

    Rows stay one for each (source, node); every round is a join on the node and an aggregation, and names the round before once.
    """
    arcs = _with_stays(edges, sources)
    first = sources.select(F.col("src").alias("source"), F.col("src").alias("dst"), F.lit(0).cast("long").alias("dist"))

    def step(best: DataFrame) -> DataFrame:
        made = best.join(arcs, best["dst"] == arcs["__from"]).select("source", F.col("__to").alias("dst"), (F.col("dist") + F.col("len")).alias("dist"))
        return made.filter(F.col("dist") <= budget).groupBy("source", "dst").agg(F.min("dist").alias("dist"))

    return settled(first, step)


def routes(arcs: DataFrame, sources: DataFrame, forbidden: DataFrame, budget: int) -> DataFrame:
    """source, node, dist, turns, path: the best way within the budget from each source to each node that obeys the forbidden turns.

    arcs: arc, src, dst, len; sources: src; forbidden: from_arc, to_arc. The state is the incoming arc, since what may follow depends on
    it, so a node can be passed twice. Best is least (dist, turns, path): the number of arcs and then their ids in order decide ties.
    A source reaches itself by no arcs. Rows stay one for each (source, arc).
    """
    own = arcs.select("arc", "src", "dst", F.col("len").cast("long").alias("len"))
    begin = sources.select(F.col("src").alias("source")).distinct().join(own, F.col("source") == own["src"]).filter(F.col("len") <= budget)
    first = begin.select("source", "arc", F.col("dst").alias("node"), F.struct(F.col("len").alias("dist"), F.lit(1).alias("turns"), F.array("arc").alias("path")).alias("best"))
    # turns that may be taken: from_arc, and the arc that follows
    after = own.select(F.col("arc").alias("from_arc"), F.col("dst").alias("at")).join(own.withColumnRenamed("arc", "to_arc"), F.col("at") == F.col("src"))
    turns = after.join(forbidden.select("from_arc", "to_arc").distinct(), ["from_arc", "to_arc"], "left_anti").select("from_arc", "to_arc", "dst", "len")

    def step(now: DataFrame) -> DataFrame:
        longer = F.struct((F.col("best.dist") + F.col("len")).alias("dist"), (F.col("best.turns") + 1).alias("turns"), F.concat("best.path", F.array("to_arc")).alias("path"))
        made = now.join(turns, now["arc"] == turns["from_arc"]).select("source", F.col("to_arc").alias("arc"), F.col("dst").alias("node"), longer.alias("best")).filter(F.col("best.dist") <= budget)
        return now.union(made).groupBy("source", "arc", "node").agg(F.min("best").alias("best"))

    ways = settled(first, step).select("source", "node", "best")
    stays = sources.select(F.col("src").alias("source"), F.col("src").alias("node")).distinct()
    none = F.struct(F.lit(0).cast("long").alias("dist"), F.lit(0).alias("turns"), F.expr("filter(array(0L), x -> false)").cast(dict(arcs.dtypes)["arc"].join(["array<", ">"])).alias("path"))
    return ways.union(stays.select("source", "node", none.alias("best"))).groupBy("source", "node").agg(F.min("best").alias("best")).select("source", "node", "best.*")


def closure(edges: DataFrame) -> DataFrame:
    """a, b: all nodes downstream of each node of edges (src, dst), by joining what is known with itself, so a path of n arcs takes log2(n) rounds."""
    first = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    return settled(first, lambda now: now.union(now.withColumnRenamed("b", "m").join(now.withColumnsRenamed({"a": "m", "b": "b"}), "m").select("a", "b")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that is reachable either way), for each node of edges (a, b)."""
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").distinct()
    first = both.groupBy("node").agg(F.min("other").alias("x")).select("node", F.least("node", "x").alias("component"))

    def step(now: DataFrame) -> DataFrame:
        near = both.join(now.select(F.col("node").alias("other"), F.col("component").alias("c")), "other").groupBy("node").agg(F.min("c").alias("c"))
        lower = now.join(near, "node").select("node", F.least("component", "c").alias("component"))
        # what the component's own node has found by now holds for all that point to it
        return lower.join(lower.select(F.col("node").alias("component"), F.col("component").alias("c")), "component").select("node", F.col("c").alias("component"))

    return settled(first, step)


def required_route(edges: DataFrame, sources: DataFrame, required: list[int], budget: int) -> DataFrame:
    """source, dist: the shortest way from each source that visits all required nodes; null where there is none within the budget.

    The state is (source, node, set of required nodes seen); a few required nodes, so that sets stay a few bits. Steps go on until nothing
    changes, so a way may have any number of arcs.
    """
    arcs = _with_stays(edges, sources)
    bit = F.lit(0)
    for i, node in enumerate(required):
        bit = F.when(F.col("node") == node, 1 << i).otherwise(bit)
    first = sources.select(F.col("src").alias("source"), F.col("src").alias("node")).distinct().select("source", "node", bit.alias("mask"), F.lit(0).cast("long").alias("dist"))

    def step(best: DataFrame) -> DataFrame:
        made = best.join(arcs, best["node"] == arcs["__from"]).select("source", F.col("__to").alias("node"), "mask", (F.col("dist") + F.col("len")).alias("dist"))
        return made.filter(F.col("dist") <= budget).withColumn("mask", F.col("mask").bitwiseOR(bit)).groupBy("source", "node", "mask").agg(F.min("dist").alias("dist"))

    done = settled(first, step).filter(F.col("mask") == (1 << len(required)) - 1).groupBy("source").agg(F.min("dist").alias("dist"))
    return sources.select(F.col("src").alias("source")).join(done, "source", "left")


def graph_invariants(nodes: DataFrame, arcs: DataFrame, node: str, start: str, end: str) -> DataFrame:
    """One row: repeated node ids, and arcs whose start or end is unknown."""
    ids = nodes.groupBy(node).count()
    known = ids.select(F.col(node).alias("__k"))
    lost = lambda c, n: arcs.select(c).join(known, F.col(c) == F.col("__k"), "left_anti").select(F.lit(n).alias("what"))
    found = ids.filter("count > 1").select(F.lit("repeated").alias("what")).union(lost(start, "unknown_starts")).union(lost(end, "unknown_ends"))
    return found.agg(*[F.count_if(F.col("what") == n).alias(n) for n in ("repeated", "unknown_starts", "unknown_ends")])
