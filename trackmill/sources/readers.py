"""Readers of recordings, road maps and configuration: explicit schemas, malformed input fails or is flagged, nothing is inferred."""

from __future__ import annotations

import json
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions import scalars as S
from . import road_map

#: Fixed header of trajectory files.
TRAJECTORY = ["GPSTime", "easting", "northing", "altitude", "vel_east", "vel_north", "vel_up", "roll", "pitch", "heading", "angvel_z", "angvel_y", "angvel_x", "accelz", "accely", "accelx", "latitude", "longitude"]
#: Bytes of a point record: x, y, z, intensity, ring, time offset, as little-endian 32-bit floats.
RECORD, FIELDS = 24, ["x", "y", "z", "intensity", "ring", "time"]
MATRIX = 16


def strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def number(text: Column) -> Column:
    """A finite double, else null."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def trajectory_csv(spark: SparkSession, path: str) -> DataFrame:
    """File, time_ns, place, velocity, quaternion, degrees, valid. Numbers are parsed strictly, times exactly."""
    rows = spark.read.schema(strings(TRAJECTORY)).csv(path, header=True, enforceSchema=False, mode="FAILFAST").withColumn("file", F.input_file_name())
    values = {n: number(F.col(n)) for n in TRAJECTORY[1:]}
    q = G.from_roll_pitch_heading(values["roll"], values["pitch"], values["heading"])
    valid = S.seconds_to_ns(F.col("GPSTime")).isNotNull()
    for v in values.values():
        valid = valid & v.isNotNull()
    return rows.select(
        "file",
        S.seconds_to_ns(F.col("GPSTime")).alias("time_ns"),
        *[values[a].alias(b) for a, b in (("easting", "x"), ("northing", "y"), ("altitude", "z"), ("vel_east", "vx"), ("vel_north", "vy"), ("vel_up", "vz"))],
        *[c.alias(n) for c, n in zip(q, ("qw", "qx", "qy", "qz"))],
        F.degrees(values["latitude"]).alias("lat"),
        F.degrees(values["longitude"]).alias("lon"),
        valid.alias("valid"),
    )


def pose_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: the same columns by unsigned microseconds."""
    rows = spark.read.schema(strings(TRAJECTORY)).csv(path, header=True, enforceSchema=False, mode="FAILFAST")
    us = F.when(F.col("GPSTime").rlike("^[0-9]{1,15}$"), F.col("GPSTime").cast("long"))
    return rows.select((us * 1000).alias("time_ns"), *[number(F.col(a)).alias(b) for a, b in (("easting", "x"), ("northing", "y"), ("altitude", "z"))])


def nondecreasing(df: DataFrame, keys: list[str], order: list[str], time: str) -> DataFrame:
    """keys, n, first, last, ordered: whether times never fall in source order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__p", F.lag(time).over(w)).groupBy(*keys).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"), F.coalesce(F.bool_and(F.col(time) >= F.col("__p")), F.lit(True)).alias("ordered"))


def calibration_text(spark: SparkSession, path: str) -> DataFrame:
    """File, m (16 numbers), proper: whether the upper left 3 x 3 part is a rotation (determinant 1) and the last row is 0 0 0 1."""
    text = spark.read.text(path, wholetext=True)
    m = F.transform(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != ""), lambda x: number(x))
    rows = text.select(F.input_file_name().alias("file"), m.alias("m"))
    e = lambda i: F.get("m", F.lit(i))
    det = e(0) * (e(5) * e(10) - e(6) * e(9)) - e(1) * (e(4) * e(10) - e(6) * e(8)) + e(2) * (e(4) * e(9) - e(5) * e(8))
    foot = (e(12) == 0) & (e(13) == 0) & (e(14) == 0) & (e(15) == 1)
    return rows.withColumn("proper", F.coalesce((F.size("m") == MATRIX) & (F.abs(det - 1) < 1e-6) & foot, F.lit(False)))


def frame_listing(spark: SparkSession, path: str) -> DataFrame:
    """Key, time_ns, bytes, points, whole of files named by microseconds; contents are not read. Spark lists no files of 0 bytes."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    stem = F.regexp_extract("path", r"([0-9]+)\.bin$", 1)
    return files.filter(stem != "").select(F.regexp_extract("path", r"[^/]+$", 0).alias("key"), (stem.cast("long") * 1000).alias("time_ns"), F.col("length").alias("bytes"), F.floor(F.col("length") / RECORD).alias("points"), ((F.col("length") % RECORD == 0) & (F.col("length") > 0)).alias("whole"), "modificationTime")


def point_records(spark: SparkSession, path: str, rings: int = 128, bits: bool = False) -> DataFrame:
    """Key, offset, x, y, z, intensity, ring, relative_ns, valid, and with bits the record's bytes. A rest of fewer than 24 bytes fails."""
    kinds = [pa.string(), pa.int64(), *[pa.float32()] * 4, pa.int32(), pa.int64(), pa.bool_()]
    names = ["key", "offset", *FIELDS[:4], "ring", "relative_ns", "valid"]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(content) % RECORD:
                    raise ValueError(f"{name}: {len(content)} bytes are no whole records")
                values = np.frombuffer(content, "<f4").reshape(-1, len(FIELDS))
                for at in range(0, len(values), 65_536):
                    part = values[at : at + 65_536]
                    ring, offset = part[:, 4], part[:, 5].astype(np.float64) * 1e9
                    valid = np.isfinite(part).all(axis=1) & (ring == np.floor(ring)) & (ring >= 0) & (ring < rings)
                    ns = np.where(valid, np.where(offset >= 0, np.floor(offset + 0.5), np.ceil(offset - 0.5)), 0)
                    columns = [np.arange(at, at + len(part)), *[np.ascontiguousarray(part[:, i]) for i in range(4)], np.where(valid, ring, -1).astype(np.int32), ns.astype(np.int64), valid]
                    arrays = [pa.array([name]).take(pa.array(np.zeros(len(part), np.int32))), *[pa.array(c, k) for c, k in zip(columns, kinds[1:])]]
                    if bits:
                        arrays.append(pa.FixedSizeBinaryArray.from_buffers(pa.binary(RECORD), len(part), [None, pa.py_buffer(content[at * RECORD : (at + len(part)) * RECORD])]).cast(pa.binary()))
                    yield pa.RecordBatch.from_arrays(arrays, names=names + ["bits"] * bits)

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"[^/]+$", 0).alias("key"), "content")
    return files.mapInArrow(run, "key string, offset long, x float, y float, z float, intensity float, ring int, relative_ns long, valid boolean" + ", bits binary" * bits)


def frame_summary(points: DataFrame) -> DataFrame:
    """Key, points, first_ns, last_ns, ordered, and the bounds of each frame."""
    w = Window.partitionBy("key").orderBy("offset")
    rows = points.withColumn("__p", F.lag("relative_ns").over(w))
    return rows.groupBy("key").agg(F.count("*").alias("points"), F.count_if(~F.col("valid")).alias("invalid"), F.min("relative_ns").alias("first_ns"), F.max("relative_ns").alias("last_ns"), F.coalesce(F.bool_and(F.col("relative_ns") >= F.col("__p")), F.lit(True)).alias("ordered"), *[f(c).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))])


#: Records that are summarised together; a frame is a row for each of its ranges of so many, which merge.
RANGE = 1 << 20


def record_ranges(spark: SparkSession, path: str, rings: int = 128) -> DataFrame:
    """key, at, points, invalid, first, last, first_ns, last_ns, ordered and bounds of each range of a frame's records: what frames' summaries are made
    of, so no single record leaves the reader. The same rules as point_records()."""
    names = ["key", "at", "points", "invalid", "first", "last", "first_ns", "last_ns", "ordered", *[f"{n}_{c}" for c in "xyz" for n in ("min", "max")]]
    kinds = [pa.string(), *[pa.int64()] * 7, pa.bool_(), *[pa.float32()] * 6]

    def one(name: str, at: int, values: np.ndarray) -> list:
        ring, offset = values[:, 4], values[:, 5].astype(np.float64) * 1e9
        valid = np.isfinite(values).all(axis=1) & (ring == np.floor(ring)) & (ring >= 0) & (ring < rings)
        if not valid.all():
            offset[~valid] = 0
        ns = (np.sign(offset) * np.floor(np.abs(offset) + 0.5)).astype(np.int64)
        xyz = values[:, :3]
        # as in SQL, what is no number is greater than all numbers
        low, high = np.fmin.reduce(xyz, axis=0), xyz.max(axis=0)
        return [name, at, len(values), int(np.count_nonzero(~valid)), int(ns[0]), int(ns[-1]), int(ns.min()), int(ns.max()), bool((ns[1:] >= ns[:-1]).all()), *[float(b[i]) for i in range(3) for b in (low, high)]]

    def run(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = content.as_buffer()
                if held.size % RECORD:
                    raise ValueError(f"{name}: {held.size} bytes are no whole records")
                values = np.frombuffer(held, "<f4").reshape(-1, len(FIELDS))
                rows += [one(name, at, values[at : at + RANGE]) for at in range(0, len(values), RANGE)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"[^/]+$", 0).alias("key"), "content")
    schema = ["key string", *[f"{n} long" for n in names[1:8]], "ordered boolean", *[f"{n} float" for n in names[9:]]]
    return files.mapInArrow(run, ", ".join(schema))


def frame_scan(spark: SparkSession, path: str, rings: int = 128) -> DataFrame:
    """One pass over a recording's frames, as frame_summary() gives it: key, points, invalid, first_ns, last_ns, ordered, bounds."""
    before = F.lag("last").over(Window.partitionBy("key").orderBy("at"))
    parts = record_ranges(spark, path, rings).withColumn("ordered", F.col("ordered") & F.coalesce(F.col("first") >= before, F.lit(True)))
    bounds = [f(f"{n}_{c}").alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))]
    return parts.groupBy("key").agg(F.sum("points").alias("points"), F.sum("invalid").alias("invalid"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"), F.bool_and("ordered").alias("ordered"), *bounds)


def road_map_xml(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Nodes, ways and relations of a road map in XML, of one read of the files; files that declare a document type fail."""
    every = road_map.elements(spark, path)
    of = lambda kind, *columns: every.filter(F.col("kind") == kind).select(F.col("id").alias(kind), *columns)
    members = F.transform("members", lambda m: F.struct(m["type"].alias("_type"), m["ref"].alias("_ref"), m["role"].alias("_role")))
    return {"nodes": of("node", "lat_e7", "lon_e7", "valid"), "ways": of("way", "refs", "tags"), "relations": of("relation", members.alias("members"), "tags")}


def route_html(spark: SparkSession, path: str) -> DataFrame:
    """File, pos, lat, lon of the bracketed pairs of numbers in a page's polyline."""
    pair = r"\[\s*(-?[0-9]+\.[0-9]+)\s*,\s*(-?[0-9]+\.[0-9]+)\s*\]"
    found = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.arrays_zip(F.regexp_extract_all("value", F.lit(pair), F.lit(1)).alias("lat"), F.regexp_extract_all("value", F.lit(pair), F.lit(2)).alias("lon"))))
    return found.select("file", "pos", F.col("col.lat").cast("double").alias("lat"), F.col("col.lon").cast("double").alias("lon"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of one declared schema; a malformed line fails."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def json_document(text: str, depth: int = 32, size: int = 1 << 20) -> Any:
    """A small configuration document; repeated keys, numbers that aren't finite, deep nesting and oversize are errors."""
    if len(text.encode()) > size:
        raise ValueError("too large")

    def unique(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("repeated key")
        return out

    def refuse(name):
        raise ValueError(f"{name} is no number here")

    found = json.loads(text, object_pairs_hook=unique, parse_constant=refuse)

    def deep(x, left):
        if left < 0:
            raise ValueError("nested too deeply")
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            deep(y, left - 1)

    deep(found, depth)
    return found


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Key, bytes, sha256 of each file (files are read whole, one row each)."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"[^/]+$", 0).alias("key"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def combined_identity(digests: DataFrame) -> DataFrame:
    """One row, the SHA-256 over the files' digests in order of their keys (a recording's few files, not its points)."""
    listed = F.sort_array(F.collect_list(F.struct("key", "sha256")))
    return digests.agg(F.sha2(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["key"], x["sha256"])), "\n"), 256).alias("identity"), F.count("*").alias("files"))


def capabilities(listing: DataFrame, wanted: list[tuple[str, bool]]) -> DataFrame:
    """Stream, state (AVAILABLE, MISSING_OPTIONAL, MISSING_REQUIRED) of each wanted stream; listing has a column stream."""
    asked = listing.sparkSession.createDataFrame(wanted, "stream string, optional boolean")
    seen = listing.select("stream").distinct().withColumn("here", F.lit(True))
    state = F.when(F.col("here"), "AVAILABLE").when(F.col("optional"), "MISSING_OPTIONAL").otherwise("MISSING_REQUIRED")
    return F.broadcast(asked).join(seen, "stream", "left").select("stream", state.alias("state"))
