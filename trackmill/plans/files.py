"""Sources and sinks: each query writes files of a format into the shared folder, and reads them as a user would."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.state import shared_dir
from ..sources import readers as R
from ..sources import writers as W
from .registry import query, table


def folder(spark) -> str:
    return os.path.join(shared_dir(spark), "files", uuid.uuid4().hex)


def lines(rows, path: str) -> None:
    """A text file for each key of rows (key, text): few keys, as files are read whole."""
    rows.repartition("key").write.partitionBy("key").text(path)


@query("""
SELECT l_orderkey * 1000000000 + l_linenumber AS time_ns, l_extendedprice AS x, l_quantity AS y, CASE WHEN l_linenumber < 7 THEN l_discount END AS z, CAST(l_suppkey AS DOUBLE) AS vx, l_tax AS vy,
  round(degrees(l_tax), 9) AS lat, round(degrees(l_discount), 9) AS lon, round(cos(l_tax / 2), 9) AS qw, l_linenumber < 7 AS valid FROM lineitem
""")
def trajectory_file(spark, sf_dir):
    """Line items as a trajectory's CSV, some heights of which are no numbers, read with exact times and flags."""
    zero = F.lit("0")
    made = {"GPSTime": F.concat("l_orderkey", F.lit("."), F.lpad(F.col("l_linenumber").cast("string"), 9, "0")), "easting": F.col("l_extendedprice"), "northing": F.col("l_quantity"), "altitude": F.when(F.col("l_linenumber") < 7, F.col("l_discount").cast("string")).otherwise("NaN"), "vel_east": F.col("l_suppkey"), "vel_north": F.col("l_tax"), "heading": F.col("l_tax"), "latitude": F.col("l_tax"), "longitude": F.col("l_discount")}
    at = folder(spark)
    table(spark, sf_dir, "lineitem").select(*[made.get(n, zero).cast("string").alias(n) for n in R.TRAJECTORY]).write.csv(at, header=True)
    got = R.trajectory_csv(spark, f"{at}/*.csv")
    return got.select("time_ns", "x", "y", "z", "vx", "vy", *[F.round(c, 9).alias(c) for c in ("lat", "lon")], F.round(F.abs("qw"), 9).alias("qw"), "valid")


@query("SELECT CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey * 1000 END AS time_ns, o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y FROM orders")
def pose_file(spark, sf_dir):
    """S3: orders as a pose file by microseconds, some of which aren't whole numbers."""
    made = {"GPSTime": F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey").cast("string")).otherwise("1.5"), "easting": F.col("o_totalprice"), "northing": F.col("o_custkey")}
    at = folder(spark)
    table(spark, sf_dir, "orders").select(*[made.get(n, F.lit("0")).cast("string").alias(n) for n in R.TRAJECTORY]).write.csv(at, header=True)
    return R.pose_csv(spark, f"{at}/*.csv").select("time_ns", "x", "y")


@query("SELECT n_nationkey AS k, CAST(16 - CASE WHEN n_nationkey % 4 = 3 THEN 1 ELSE 0 END AS INTEGER) AS numbers, CAST(n_nationkey AS DOUBLE) AS shift, n_nationkey % 4 = 0 AS proper FROM nation")
def calibration_files(spark, sf_dir):
    """A matrix for each nation; of four one is a rotation, one a reflection, one has a wrong last row, and one lacks a number."""
    n = F.col("n_nationkey")
    first = F.when(n % 4 == 1, "-1").otherwise("1")
    last = F.when(n % 4 == 2, "0 0 1 1").when(n % 4 == 3, "0 0 0").otherwise("0 0 0 1")
    at = folder(spark)
    lines(table(spark, sf_dir, "nation").select(n.alias("key"), F.concat(first, F.lit(" 0 0 "), n.cast("string"), F.lit("  0 1 0 0\t0 0 1 0 "), last).alias("value")), at)
    got = R.calibration_text(spark, f"{at}/*/*.txt")
    return got.select(F.regexp_extract("file", r"key=(\d+)/", 1).cast("long").alias("k"), F.size("m").alias("numbers"), F.get("m", F.lit(3)).alias("shift"), "proper")


@query("""
SELECT n_nationkey AS k, CAST(i AS INTEGER) AS pos, round(n_nationkey + i / 4.0, 2)::DOUBLE AS lat, round(-i - 0.5, 2)::DOUBLE AS lon FROM nation, range(3) t(i)
""")
def route_pages(spark, sf_dir):
    """The pairs of numbers of a page's line, in their order."""
    n = F.col("n_nationkey")
    pair = lambda i: F.concat(F.lit("["), F.format_string("%.2f", n + i / 4), F.lit(f", {-i - 0.5:.2f}]"))
    at = folder(spark)
    lines(table(spark, sf_dir, "nation").select(n.alias("key"), F.concat(F.lit("<script>var line = L.polyline(["), F.concat_ws(" ,\t", *map(pair, range(3))), F.lit("]);</script>")).alias("value")), at)
    return R.route_html(spark, f"{at}/*/*.txt").select(F.regexp_extract("file", r"key=(\d+)/", 1).cast("long").alias("k"), "pos", "lat", "lon")


@query("""
SELECT s_suppkey AS node, CAST(round(s_acctbal / 100 * 10000000) AS BIGINT) AS lat_e7, CAST(s_nationkey AS BIGINT) * 10000000 AS lon_e7 FROM supplier
""")
def road_map_nodes(spark, sf_dir):
    """Suppliers as the nodes of a road map in XML, with places in ten-millionths of a degree."""
    at = folder(spark)
    name = F.struct(F.lit("name").alias("_k"), F.col("s_nationkey").cast("string").alias("_v"))
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("_id"), F.format_string("%.7f", F.round(F.col("s_acctbal") / 100, 7)).alias("_lat"), F.format_string("%d.0000000", "s_nationkey").alias("_lon"), F.array(name).alias("tag"))
    nodes.write.format("xml").option("rootTag", "osm").option("rowTag", "node").save(at)
    return R.road_map_xml(spark, at)["nodes"].select("node", "lat_e7", "lon_e7")


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def index_file(spark, sf_dir):
    """Orders as JSON lines in order over four files, read with a declared schema."""
    at = folder(spark)
    W.index_lines(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), at, ["o_orderkey"], 4)
    return R.json_lines(spark, at, "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string")


@query("SELECT c_custkey, c_mktsegment, true AS whole FROM customer")
def published_table(spark, sf_dir):
    """A table that is published in one step, and the mark that says so."""
    at = f"{folder(spark)}/table"
    before = W.published(spark, at)
    W.publish(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), at)
    return spark.read.parquet(at).withColumn("whole", F.lit(W.published(spark, at) and not before))


@query("""SELECT '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || CASE WHEN c_nationkey % 3 = 0 THEN 'null' ELSE CAST(c_nationkey AS VARCHAR) END || '}' AS document FROM customer""")
def portable_documents(spark, sf_dir):
    """Customers as documents of a fixed order of fields, nulls included, private columns left out."""
    rows = table(spark, sf_dir, "customer").withColumn("c_nationkey", F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey"))).withColumn("place", F.lit("/home/someone"))
    return W.portable(rows, ["c_custkey", "c_mktsegment", "c_nationkey", "place"], ["place"])


@query("SELECT n_nationkey AS k, CAST(strlen(n_name) + 1 AS BIGINT) AS bytes, sha256(n_name || chr(10)) AS sha256 FROM nation")
def file_identities(spark, sf_dir):
    """Size and digest of each file."""
    at = folder(spark)
    lines(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value")), at)
    # files are told by their folder, as Spark names them
    digests = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{at}/*")
    return digests.select(F.regexp_extract("path", r"key=(\d+)/", 1).cast("long").alias("k"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


@query("""
WITH p AS (SELECT l_suppkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS n, CAST(l_quantity AS FLOAT) AS x, CAST(l_extendedprice AS FLOAT) AS y,
  CASE WHEN l_orderkey % 50 = 0 THEN CAST('nan' AS FLOAT) ELSE CAST(l_tax AS FLOAT) END AS z, l_linenumber + CASE WHEN l_orderkey % 40 = 1 THEN 0.5 ELSE 0 END AS ring, CASE WHEN l_suppkey % 3 = 0 THEN l_linenumber ELSE 0 END AS late FROM lineitem),
q AS (SELECT *, NOT isnan(z) AND ring = floor(ring) AS valid, CAST((n + 10 * late) / 1024.0 AS FLOAT) AS s FROM p),
t AS (SELECT *, CASE WHEN valid THEN CAST(floor(CAST(s AS DOUBLE) * 1e9 + 0.5) AS BIGINT) ELSE 0 END AS ns FROM q),
o AS (SELECT *, coalesce(ns >= lag(ns) OVER (PARTITION BY k ORDER BY n), true) AS ok FROM t)
SELECT k || '.bin' AS key, count(*) AS points, count(*) FILTER (NOT valid) AS invalid, min(ns) AS first_ns, max(ns) AS last_ns, bool_and(ok) AS ordered, CAST(min(x) AS DOUBLE) AS min_x, CAST(max(x) AS DOUBLE) AS max_x,
  CAST(min(y) AS DOUBLE) AS min_y, CAST(max(y) AS DOUBLE) AS max_y, CAST(min(z) AS DOUBLE) AS min_z, CASE WHEN bool_or(isnan(z)) THEN -1 ELSE CAST(max(z) AS DOUBLE) END AS max_z FROM o GROUP BY k
""")
def frame_files(spark, sf_dir):
    """Line items as a supplier's frame of binary records, some of them invalid or out of order, summarised in one pass."""
    n = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")) - 1
    late = F.when(F.col("l_suppkey") % 3 == 0, F.col("l_linenumber")).otherwise(0)
    made = {"x": F.col("l_quantity"), "y": F.col("l_extendedprice"), "z": F.when(F.col("l_orderkey") % 50 == 0, float("nan")).otherwise(F.col("l_tax")), "intensity": F.col("l_discount"), "ring": F.col("l_linenumber") + F.when(F.col("l_orderkey") % 40 == 1, 0.5).otherwise(0.0), "relative_time": (F.col("offset") + 10 * late) / 1024.0}
    points = table(spark, sf_dir, "lineitem").withColumn("offset", n).select(F.concat(F.col("l_suppkey").cast("string"), F.lit(".bin")).alias("key"), "offset", *[made[k].cast("float").alias(f) for k, f in zip(made, R.FIELDS)])
    at = folder(spark)
    W.point_frames(points, at).agg(F.sum("bytes")).collect()
    got = R.frame_scan(spark, at)
    return got.withColumns({c: F.col(c).cast("double") for c in got.columns if c[:4] in ("min_", "max_")}).withColumn("max_z", F.when(F.isnan("max_z"), -1.0).otherwise(F.col("max_z")))
