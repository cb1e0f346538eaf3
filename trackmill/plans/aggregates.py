"""Aggregation over bins, cells, sectors and groups, on lineitem, events, embeddings, labels and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import grids as G
from ..operators import statistics as T
from .registry import EVENTS, events, query, table
from .temporal import HOUR

BINS, LOW, HIGH = 512, 0.0, 100_000.0


@query(f"""
WITH h AS (SELECT l_returnflag, least(CAST(floor((l_extendedprice - {LOW}) / {(HIGH - LOW) / BINS}) AS INTEGER), {BINS - 1}) AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice >= {LOW} AND l_extendedprice < {HIGH} GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM h), s AS (SELECT unnest([CAST(0.05 AS DOUBLE), 0.5, 0.95]) AS share)
SELECT l_returnflag, share, CAST({LOW} + (min(bin) + CAST(0.5 AS DOUBLE)) * {(HIGH - LOW) / BINS} AS DOUBLE) AS quantile FROM c, s WHERE cum >= greatest(1, ceil(share * total)) GROUP BY l_returnflag, share
""")
def fixed_histogram_quantiles(spark, sf_dir):
    """Quantiles from 512 fixed bins, with values out of range left out."""
    hist = G.histogram(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_extendedprice"), LOW, HIGH, BINS)
    return G.histogram_quantiles(hist, ["l_returnflag"], LOW, HIGH, BINS, [0.05, 0.5, 0.95])


@query(f"""
WITH {EVENTS}, s AS (SELECT user_id, event_type, CAST((us // {HOUR}) % 24 AS BIGINT) AS sector FROM ev GROUP BY ALL),
g AS (SELECT user_id, event_type, coalesce(lead(sector) OVER w, first_value(sector) OVER w + 24) - sector - 1 AS gap FROM s WINDOW w AS (PARTITION BY user_id, event_type ORDER BY sector))
SELECT user_id, event_type, max(gap) AS empty FROM g GROUP BY ALL
""")
def widest_empty_arc(spark, sf_dir):
    """The longest run of hours of the day without an event, across midnight."""
    rows = events(spark, sf_dir).withColumn("sector", F.floor(F.col("us") / HOUR) % 24)
    return G.widest_empty_arc(rows, ["user_id", "event_type"], "sector", 24)


@query(f"""
WITH {EVENTS}, f AS (SELECT DISTINCT user_id FROM ev), c AS (SELECT user_id, event_type AS ring, count(*) AS n FROM ev GROUP BY ALL), m AS (SELECT unnest(['view', 'click', 'signup', 'error', 'purchase', 'refund']) AS ring)
SELECT f.user_id, count(*) FILTER (coalesce(n, 0) < 12) AS missing FROM f CROSS JOIN m LEFT JOIN c ON c.user_id = f.user_id AND c.ring = m.ring GROUP BY f.user_id
""")
def missing_rings(spark, sf_dir):
    """A10: how many of the model's rings have too few rows in a frame; rings that never occur count too."""
    rings = ["view", "click", "signup", "error", "purchase", "refund"]
    return events(spark, sf_dir).groupBy("user_id").agg(sum((F.when(F.count_if(F.col("event_type") == r) < 12, 1).otherwise(0) for r in rings), F.lit(0)).cast("long").alias("missing"))


@query("""
WITH p AS (SELECT l_suppkey, l_extendedprice, l_quantity, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS x, l_partkey FROM lineitem)
SELECT l_suppkey, count(*) AS n, round(avg(CASE WHEN x IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) AS finite_share, count(*) FILTER (x IS NULL OR x < 2000 OR x > 99000 OR l_quantity >= 49) AS invalid FROM p GROUP BY l_suppkey
""")
def point_masks(spark, sf_dir):
    """Rows that fail any mask count once; rows that aren't finite fail before all else."""
    x = F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice"))
    fails = x.isNull() | (x < 2000) | (x > 99000) | (F.col("l_quantity") >= 49)
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.avg(F.when(x.isNotNull(), 1.0).otherwise(0.0)), 9).alias("finite_share"), F.count_if(F.coalesce(fails, F.lit(True))).alias("invalid"))


@query("""
WITH r AS (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem)
SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT l_partkey))[1:16], ',') AS offsets FROM r WHERE rn <= 16 GROUP BY l_suppkey
""")
def sample_offsets(spark, sf_dir):
    """The first 16 offsets of each frame; of those the 16 smallest distinct ones for each source."""
    w = Window.partitionBy("l_suppkey", "l_returnflag").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    first = table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(w)).filter("rn <= 16")
    return first.groupBy("l_suppkey").agg(F.array_join(F.slice(F.sort_array(F.collect_set("l_partkey")), 1, 16).cast("array<string>"), ",").alias("offsets"))


VECTORS = "v AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * 10 AS x, CAST(embedding[2] AS DOUBLE) * 10 AS y, CAST(embedding[3] AS DOUBLE) * 10 AS z FROM embeddings)"
AXES = ["x", "y", "z"]


def points(spark, sf_dir):
    """The first three components of each vector, in tens."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[(F.col("embedding")[k].cast("double") * 10).alias(a) for k, a in enumerate(AXES)])


VOXELS = f"{VECTORS}, c AS (SELECT label, floor(x) AS i0, floor(y) AS i1, floor(z) AS i2, count(*) AS n, {', '.join(f'sum({a}) AS s_{a}, sum({a} * {a}) AS q_{a}' for a in AXES)} FROM v GROUP BY ALL)"
THICK = "sqrt(" + " + ".join(f"greatest(q_{a} / n - (s_{a} / n) * (s_{a} / n), 0)" for a in AXES) + ")"


@query(f"WITH {VOXELS} SELECT label, CAST(i0 AS BIGINT) AS i0, CAST(i1 AS BIGINT) AS i1, CAST(i2 AS BIGINT) AS i2, n, round({THICK}, 5) AS thickness FROM c")
def voxel_grid(spark, sf_dir):
    """Counts and surface thickness of cells."""
    return G.voxels(points(spark, sf_dir), ["label"], AXES, 1.0).select("label", "i0", "i1", "i2", "n", F.round(G.thickness(AXES), 5).alias("thickness"))


@query(f"""
WITH {VOXELS}, s AS (SELECT a.label, count(*) AS shared FROM c a JOIN c b ON a.label = b.label + 1 AND a.i0 = b.i0 AND a.i1 = b.i1 AND a.i2 = b.i2 GROUP BY a.label), k AS (SELECT label, count(*) AS n FROM c GROUP BY label)
SELECT a.label, b.n AS n_before, a.n AS n_now, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / CAST(a.n + b.n - coalesce(shared, 0) AS DOUBLE), 9) AS jaccard,
  CASE WHEN coalesce(shared, 0) < 4 THEN 'UNKNOWN' WHEN coalesce(shared, 0) / CAST(a.n + b.n - coalesce(shared, 0) AS DOUBLE) >= 0.3 THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM k a JOIN k b ON a.label = b.label + 1 LEFT JOIN s ON s.label = a.label
""")
def voxel_jaccard(spark, sf_dir):
    """Occupancy of neighbouring frames, and a verdict that is unknown without enough shared cells."""
    found = G.frame_overlap(G.voxels(points(spark, sf_dir), ["label"], AXES, 1.0), "label", ["i0", "i1", "i2"])
    jaccard = F.col("shared") / (F.col("n_now") + F.col("n_before") - F.col("shared")).cast("double")
    verdict = F.when(F.col("shared") < 4, "UNKNOWN").when(jaccard >= 0.3, "PASS").otherwise("FAIL")
    return found.select("label", "n_before", "n_now", "shared", F.round(jaccard, 9).alias("jaccard"), verdict.alias("verdict"))


@query(f"WITH {VECTORS} SELECT a.vec_id AS a_id, b.vec_id AS b_id, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 9) AS d2 FROM v a JOIN v b ON a.vec_id <> b.vec_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.0625")
def radius_pairs(spark, sf_dir):
    """Pairs of points within a quarter of a unit."""
    p = points(spark, sf_dir)
    a, b = p.select(F.col("vec_id").alias("a_id"), F.col("x").alias("ax"), F.col("y").alias("ay")), p.select(F.col("vec_id").alias("b_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return G.radius_join(a, b, ["ax", "ay"], ["bx", "by"], 0.25).filter("a_id != b_id").select("a_id", "b_id", F.round("d2", 9).alias("d2"))


@query(f"""
WITH {VECTORS}, d AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM v a JOIN v b ON b.label = a.label + 1),
r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d2, b_id) AS rn FROM d WHERE d2 <= 1)
SELECT v.vec_id AS a_id, b_id, round(coalesce(d2, 9), 9) AS d2 FROM v LEFT JOIN r ON v.vec_id = r.a_id AND rn = 1
""")
def nearest_within(spark, sf_dir):
    """Each point's nearest one of the next frame within reach, ties to the smaller id; 9 where there is none."""
    p = points(spark, sf_dir)
    a, b = (p.select(F.col("vec_id").alias(f"{n}_id"), F.col("label").alias(f"{n}_label"), *[F.col(c).alias(f"{n}{c}") for c in AXES]) for n in "ab")
    # of vectors at one place the first is the nearest, so places of neighbouring frames are compared, not all vectors
    at, to = ([f"{n}_label", *[f"{n}{c}" for c in AXES]] for n in "ab")
    asked = a.select(*at).distinct().withColumn("frame", F.col("a_label") + 1)
    there = b.groupBy(*to).agg(F.min("b_id").alias("b_id")).withColumn("frame", F.col("b_label"))
    near = G.radius_join(asked, there, at[1:], to[1:], 1.0, ["frame"])
    best = near.groupBy(*at).agg(F.min(F.struct("d2", "b_id")).alias("best"))
    return a.join(best, at, "left").select("a_id", "best.b_id", F.round(F.coalesce("best.d2", F.lit(9.0)), 9).alias("d2"))


@query(f"""
WITH {VECTORS}, w AS (SELECT vec_id, label, x, y, z, 0 AS run FROM v UNION ALL SELECT vec_id, label, x + CASE WHEN label % 3 = 1 THEN 0.75 ELSE 0 END, y, z, 1 FROM v),
d AS (SELECT a.run, a.label AS f, b.label AS o, a.vec_id, least(1.0, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)))) AS d FROM w a JOIN w b ON a.run = b.run AND abs(a.label - b.label) = 1 GROUP BY ALL),
m AS (SELECT run, greatest(f, o) AS label, (avg(d) FILTER (o < f) + avg(d) FILTER (o > f)) / 2 AS residual, count(*) AS n FROM d GROUP BY ALL)
SELECT c.label, round(c.residual, 9) AS clean, round(i.residual, 9) AS injected, round(i.residual - c.residual, 9) AS effect, round(i.residual, 9) > 1.05 * round(c.residual, 9) AS moved, c.n FROM m c JOIN m i ON c.label = i.label AND c.run = 0 AND i.run = 1
""")
def adjacent_residuals(spark, sf_dir):
    """Distances between the points of neighbouring frames, both ways, as they are and with a shift put into every third frame."""
    p = points(spark, sf_dir)
    shifted = p.withColumn("x", F.col("x") + F.when(F.col("label") % 3 == 1, 0.75).otherwise(0.0))
    clean, injected = (G.frame_residuals(q, "label", "vec_id", AXES, 1.0).select("label", F.col("residual").alias(n), "n") for q, n in ((p, "clean"), (shifted, "injected")))
    both = clean.join(injected.drop("n"), "label")
    nine = {c: F.round(c, 9) for c in ("clean", "injected")}
    return both.select("label", *[v.alias(c) for c, v in nine.items()], F.round(F.col("injected") - F.col("clean"), 9).alias("effect"), (nine["injected"] > 1.05 * nine["clean"]).alias("moved"), "n")


@query("""
WITH r AS (SELECT CASE WHEN l_quantity < 5 THEN 'short' WHEN l_returnflag = 'R' THEN 'returned' WHEN l_discount > 0.08 THEN 'quality' WHEN l_tax = 0 THEN 'stationary' END AS reason FROM lineitem)
SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM r GROUP BY ALL
""")
def first_reason(spark, sf_dir):
    """The first rule that a row fails, and how often each is the first."""
    rules = [("short", F.col("l_quantity") < 5), ("returned", F.col("l_returnflag") == "R"), ("quality", F.col("l_discount") > 0.08), ("stationary", F.col("l_tax") == 0)]
    return table(spark, sf_dir, "lineitem").groupBy(S.first_failing(rules, "accepted").alias("reason")).agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
SELECT o_custkey, max(o_orderkey) FILTER (rn = 1) AS best, max(o_totalprice) FILTER (rn = 1) AS score, max(o_totalprice) FILTER (rn = 2) AS runner_up, coalesce(max(o_totalprice) FILTER (rn = 1) - max(o_totalprice) FILTER (rn = 2) <= 5000, false) AS ambiguous FROM r WHERE rn <= 2 GROUP BY o_custkey
""")
def best_and_runner_up(spark, sf_dir):
    """L2, L3: the best and the second best of each group, and whether they lie too close."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    two = table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    of = lambda c, n: F.max(F.when(F.col("rn") == n, F.col(c)))
    return two.groupBy("o_custkey").agg(of("o_orderkey", 1).alias("best"), of("o_totalprice", 1).alias("score"), of("o_totalprice", 2).alias("runner_up")).withColumn("ambiguous", F.coalesce(F.col("score") - F.col("runner_up") <= 5000, F.lit(False)))


@query("""
WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS rank FROM lineitem)
SELECT l_partkey, CAST(rank AS INTEGER) AS rank, l_orderkey, l_extendedprice AS score FROM r WHERE rank <= 16 UNION ALL SELECT p_partkey, 0, NULL, -5.0 FROM part
""")
def top_candidates(spark, sf_dir):
    """The 16 best candidates of each group, and one that always stands for none."""
    w = Window.partitionBy("l_partkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_suppkey")
    best = table(spark, sf_dir, "lineitem").select("l_partkey", F.row_number().over(w).alias("rank"), "l_orderkey", F.col("l_extendedprice").alias("score")).filter("rank <= 16")
    none = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lit(0).alias("rank"), F.lit(None).cast("long").alias("l_orderkey"), F.lit(-5.0).alias("score"))
    return best.unionByName(none)


@query("""
WITH m AS (SELECT d.source, l.quality AS truth, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS said FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT source, count(*) FILTER (truth = 1 AND said = 1) AS tp, count(*) FILTER (truth = 0 AND said = 1) AS fp, count(*) FILTER (truth = 1 AND said = 0) AS fn, count(*) AS n FROM m GROUP BY source)
SELECT source, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 9) AS precision, round(CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 9) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 1.0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END, 9) AS f1, round((n - fp - fn) / CAST(n AS DOUBLE), 9) AS accuracy FROM c
""")
def match_metrics(spark, sf_dir):
    """Precision, recall, F1 and accuracy; 1 where there is nothing to judge."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = docs.select("doc_id", "source", (F.col("n_chars") > 300).alias("said")).join(labels, "doc_id")
    return T.classification(rows, ["source"], F.col("quality") == 1, F.col("said"))


@query(f"WITH {EVENTS}, r AS (SELECT user_id, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS rank FROM ev) SELECT user_id, ['INFO', 'WARNING', 'ERROR', 'CRITICAL'][max(rank) + 1] AS severity, count(*) AS n FROM r GROUP BY user_id")
def severity_rollup(spark, sf_dir):
    """A group's worst severity."""
    level = F.when(F.col("event_type") == "error", "CRITICAL").when(F.col("event_type") == "purchase", "ERROR").when(F.col("event_type") == "signup", "WARNING").otherwise("INFO")
    return events(spark, sf_dir).groupBy("user_id").agg(S.worst(level, ["INFO", "WARNING", "ERROR", "CRITICAL"]).alias("severity"), F.count("*").alias("n"))


@query(f"""
WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY abs(value - 100) DESC, event_id) AS rn FROM ev)
SELECT user_id, event_type, event_id, round(value - 100, 6) AS measured FROM r WHERE rn = 1
""")
def largest_measurement(spark, sf_dir):
    """Of one rule's measurements the largest in absolute value, the first of equal ones."""
    m = F.col("value") - 100
    best = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max(F.struct(F.abs(m), -F.col("event_id"), F.col("event_id").alias("id"), m.alias("m"))).alias("b"))
    return best.select("user_id", "event_type", F.col("b.id").alias("event_id"), F.round("b.m", 6).alias("measured"))


@query("WITH l AS (SELECT unnest(['F', 'O', 'P', 'X']) AS label) SELECT label, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS distance FROM l LEFT JOIN orders ON o_orderstatus = label GROUP BY label")
def label_totals(spark, sf_dir):
    """Counts and distances of each label; labels that don't occur have zeros."""
    labels = spark.createDataFrame([(x,) for x in "FOPX"], "label string")
    got = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("label")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("distance"))
    return F.broadcast(labels).join(got, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("distance", F.lit(0.0)), 2).alias("distance"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.95), 6) AS linear, quantile_disc(l_extendedprice, 0.95) AS nearest, max(l_extendedprice) AS largest FROM lineitem GROUP BY l_returnflag")
def percentile_dialects(spark, sf_dir):
    """The 95th percentile by interpolation and by nearest rank."""
    return T.percentiles(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", 0.95).withColumn("linear", F.round("linear", 6))


@query("""
WITH c AS (SELECT o_custkey % 20 AS g, count(*) FILTER (o_orderstatus = 'F') AS hit, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS m FROM c),
d AS (SELECT rep, slot, CAST('0x' || substr(sha256(rep || ':' || slot), 1, 12) AS BIGINT) % (SELECT max(m) FROM k) AS pick FROM range(500) r(rep), range(20) s(slot) WHERE slot < (SELECT max(m) FROM k)),
e AS (SELECT rep, sum(hit) / CAST(sum(n) AS DOUBLE) AS rate FROM d JOIN k ON i = pick GROUP BY rep)
SELECT round(quantile_cont(rate, 0.025), 9) AS low, round(quantile_cont(rate, 0.975), 9) AS high, round(avg(rate), 9) AS mean, count(*) AS replicates FROM e
""")
def bootstrap_interval(spark, sf_dir):
    """An interval of a rate by 500 resamples of whole clusters; draws come from SHA-256, so they are the same anywhere."""
    clusters = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 20).alias("g")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("hit"), F.count("*").alias("n"))
    return T.bootstrap_rate(clusters, "g", "hit", "n", 500, 0.95)


@query()
def bootstrap_users(spark, sf_dir):
    """An interval of the share of large values by 10,000 resamples of whole users; tested against the same draws in one place."""
    clusters = events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("value") > 60).alias("hit"), F.count("*").alias("n"))
    return T.cluster_bootstrap(clusters, "user_id", "hit", "n", 10_000, 0.95)


@query(f"""
WITH {EVENTS}, x AS (SELECT user_id, (max(us) - min(us)) / CAST({HOUR} AS DOUBLE) AS hours, count(*) FILTER (value > 300) AS k FROM ev GROUP BY user_id)
SELECT user_id, round(hours, 6) AS hours, k, CASE WHEN k = 0 AND hours > 0 THEN round(-ln(0.05) / hours, 9) END AS zero_bound FROM x
""")
def zero_event_bound(spark, sf_dir):
    """The largest rate that zero events in an exposure leave open at 95 %."""
    x = events(spark, sf_dir).groupBy("user_id").agg(((F.max("us") - F.min("us")) / float(HOUR)).alias("hours"), F.count_if(F.col("value") > 300).alias("k"))
    return x.select("user_id", F.round("hours", 6).alias("hours"), "k", F.when((F.col("k") == 0) & (F.col("hours") > 0), F.round(T.zero_rate_bound(F.col("hours"), 0.95), 9)).alias("zero_bound"))


@query(f"""
WITH RECURSIVE {EVENTS}, x AS (SELECT user_id, (max(us) - min(us)) / CAST({HOUR} AS DOUBLE) AS hours, count(*) FILTER (value > 150) AS k, count(*) AS n FROM ev GROUP BY user_id),
y AS (SELECT user_id, hours, unnest([k, n, 40 * n]) AS k FROM x WHERE hours > 0),
b(k, lo, hi, nth) AS (SELECT DISTINCT k, CAST(k AS DOUBLE), CAST(greatest(10, 2 * k + 20) AS DOUBLE), 0 FROM y UNION ALL
  SELECT k, CASE WHEN tail > 0.05 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN tail > 0.05 THEN hi ELSE (lo + hi) / 2 END, nth + 1
  FROM (SELECT *, list_sum([exp(i * ln((lo + hi) / 2) - (lo + hi) / 2 - lgamma(i + 1)) FOR i IN range(k + 1)]) AS tail FROM b WHERE nth < 60))
SELECT user_id, k, round(hi, 5) AS upper_mean, round(hi / hours, 5) AS upper_rate FROM y JOIN b USING (k) WHERE nth = 60
""")
def rate_bounds(spark, sf_dir):
    """Exact one-sided Poisson bounds of any number of events: of those above a value, of all, and of forty times as many."""
    x = events(spark, sf_dir).groupBy("user_id").agg(((F.max("us") - F.min("us")) / float(HOUR)).alias("hours"), F.count_if(F.col("value") > 150).alias("k"), F.count("*").alias("n"))
    counts = x.filter("hours > 0").select("user_id", "hours", F.explode(F.array("k", "n", 40 * F.col("n"))).alias("k"))
    upper = counts.withColumn("upper", T.poisson_upper(F.col("k"), 0.95))
    return upper.select("user_id", "k", F.round("upper", 5).alias("upper_mean"), F.round(F.col("upper") / F.col("hours"), 5).alias("upper_rate"))


@query(f"""
WITH {EVENTS}, e AS (SELECT user_id, event_type AS k, avg(value) AS v, count(*) AS n FROM ev GROUP BY ALL), u AS (SELECT DISTINCT user_id FROM ev),
q(k, op, t, least) AS (VALUES ('view', 'lt', 52.0, 8), ('click', 'ge', 48.0, 8), ('error', 'abs_le', 51.0, 10), ('refund', 'le', 1.0, 1)),
s AS (SELECT u.user_id, CASE WHEN v IS NULL OR n < least THEN 1 WHEN CASE op WHEN 'lt' THEN v < t WHEN 'ge' THEN v >= t WHEN 'abs_le' THEN abs(v) <= t ELSE v <= t END THEN 0 ELSE 2 END AS rank, q.k FROM u CROSS JOIN q LEFT JOIN e ON e.user_id = u.user_id AND e.k = q.k)
SELECT user_id, CASE max(rank) WHEN 0 THEN 'PASS' WHEN 1 THEN 'UNKNOWN' ELSE 'FAIL' END AS verdict, count(*) FILTER (rank = 0) AS passed, count(*) FILTER (rank = 1) AS unknown, count(*) FILTER (rank = 2) AS failed FROM s GROUP BY user_id
""")
def readiness_verdict(spark, sf_dir):
    """Every requirement gets a state in every scope; without enough evidence it is unknown, never passed."""
    evidence = events(spark, sf_dir).groupBy("user_id", F.col("event_type").alias("key")).agg(F.avg("value").alias("value"), F.count("*").alias("support"))
    needs = [("view", "lt", 52.0, 8), ("click", "ge", 48.0, 8), ("error", "abs_le", 51.0, 10), ("refund", "le", 1.0, 1)]
    return T.readiness(events(spark, sf_dir).select("user_id").distinct(), evidence, ["user_id"], needs)
