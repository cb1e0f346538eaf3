"""A recording as one object: lazy DataFrames of its streams, and an index of it.

Layout under the root: poses/*.csv (trajectory), lidar/*.bin (frames, named by microseconds), lidar_poses/*.csv, calib/*.txt. Any of them can
be missing; what a profile needs is told by capabilities().
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.detectors import capped_findings
from . import readers, writers

STREAMS = ["poses", "lidar", "lidar_poses", "calib"]
#: Findings of one kind in one stream that are listed; the rest is one marker.
FINDINGS = 100


@dataclass(frozen=True)
class Recording:
    """What adapters of recordings offer. Every method gives a lazy DataFrame; nothing is read before an action."""

    spark: SparkSession
    root: str
    name: str

    def files(self, stream: str) -> DataFrame:
        """stream, key, bytes, modified of a stream's files; empty if there are none. Contents are not read."""
        try:
            found = self.spark.read.format("binaryFile").load(f"{self.root}/{stream}/*")
        except AnalysisException:
            return self.spark.createDataFrame([], "stream string, key string, bytes long, modified timestamp")
        return found.select(F.lit(stream).alias("stream"), F.regexp_extract("path", r"[^/]+$", 0).alias("key"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))

    def all_files(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.files(s) for s in STREAMS])

    def capabilities(self, optional: tuple[str, ...] = ("lidar_poses",)) -> DataFrame:
        return readers.capabilities(self.all_files(), [(s, s in optional) for s in STREAMS])

    def poses(self) -> DataFrame:
        return readers.trajectory_csv(self.spark, f"{self.root}/poses/*.csv")

    def lidar_poses(self) -> DataFrame:
        return readers.pose_csv(self.spark, f"{self.root}/lidar_poses/*.csv")

    def frames(self) -> DataFrame:
        return readers.frame_listing(self.spark, f"{self.root}/lidar")

    def points(self) -> DataFrame:
        return readers.point_records(self.spark, f"{self.root}/lidar")

    def calibrations(self) -> DataFrame:
        return readers.calibration_text(self.spark, f"{self.root}/calib")


def anchored(poses: DataFrame, sequence: str, order: list[str], axes: list[str]) -> DataFrame:
    """Positions from the sequence's first."""
    w = Window.partitionBy(sequence).orderBy(*order)
    return poses.withColumns({a: F.col(a) - F.first(a).over(w) for a in axes})


def structural_findings(frames: DataFrame, cap: int = FINDINGS) -> DataFrame:
    """Kind, key, overflow, left_out: frames that are no whole records, are empty, or repeat another's time; at most `cap` of a kind are listed."""
    w = Window.partitionBy("time_ns").orderBy("key")
    marked = frames.withColumn("nth", F.row_number().over(w))
    kind = F.when(F.col("bytes") == 0, "EMPTY_FRAME").when(~F.col("whole"), "TRUNCATED_FRAME").when(F.col("nth") > 1, "DUPLICATE_TIME")
    found = marked.select(kind.alias("kind"), "key").filter("kind IS NOT NULL")
    return capped_findings(found, ["kind"], ["key"], cap)


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that came, went, or changed in size or time between two listings."""
    one, two = (x.select("stream", "key", "bytes", "modified") for x in (before, after))
    gone, new = one.exceptAll(two).withColumn("change", F.lit("before")), two.exceptAll(one).withColumn("change", F.lit("after"))
    return gone.unionByName(new)


def index_recording(recording: Recording, out: str, parts: int = 1) -> dict[str, DataFrame]:
    """Writes the frame index (JSON lines in time order), the streams' ranges, the findings and the identity under `out`,
    each as a table that is whole or absent, and returns them as read back. An existing index is an error."""
    frames = recording.frames()
    index = frames.select("key", "time_ns", "bytes", "points", "whole")
    writers.index_lines(index, f"{out}/index", ["time_ns", "key"], parts)
    poses = recording.poses().withColumn("stream", F.lit("poses"))
    ranges = poses.groupBy("stream").agg(F.count("*").alias("n"), F.min("time_ns").alias("first_ns"), F.max("time_ns").alias("last_ns"), F.count_if(~F.col("valid")).alias("invalid"))
    lidar = index.agg(F.lit("lidar").alias("stream"), F.count("*").alias("n"), F.min("time_ns").alias("first_ns"), F.max("time_ns").alias("last_ns"), F.count_if(~F.col("whole")).alias("invalid"))
    digests = reduce(DataFrame.unionByName, [readers.file_digests(recording.spark, f"{recording.root}/{s}").withColumn("key", F.concat(F.lit(f"{s}/"), "key")) for s in ("poses", "lidar")])
    tables = {"ranges": ranges.unionByName(lidar), "findings": structural_findings(frames), "identity": readers.combined_identity(digests)}
    for name, table in tables.items():
        writers.publish(table, f"{out}/{name}")
    read = {n: recording.spark.read.parquet(f"{out}/{n}") for n in tables}
    return read | {"index": readers.json_lines(recording.spark, f"{out}/index", "key string, time_ns long, bytes long, points long, whole boolean")}


def exact_matches(frames: DataFrame, poses: DataFrame) -> DataFrame:
    """Frames with the pose of exactly their time; frames without one have nulls."""
    named = poses.select(F.col("time_ns").alias("__t"), *[F.col(c).alias(f"pose_{c}") for c in poses.columns if c != "time_ns"])
    return frames.join(named, F.col("time_ns") == F.col("__t"), "left").drop("__t")
