"""Steps of iterations, kept in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a new temporary folder in local mode, and an error on a cluster."""
    path, current = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getCheckpointDir()
    if not path and current is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if current is None:
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp(prefix="trackmill-"))
    return path or spark.sparkContext.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df, computed once, so that a lost executor costs no recomputation of what led to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, computed once as a compressed table in the shared folder: for large steps of which later ones read some columns or rows."""
    at = os.path.join(shared_dir(df.sparkSession), "tables", uuid.uuid4().hex)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Rows of a part that sorts and windows hold at once.
PART_ROWS = 1 << 17


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by its keys into parts of about PART_ROWS of its `rows` rows, where the session's shuffle partitions would hold more: a task's memory doesn't grow with the table then."""
    parts = -(-rows // PART_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def settled(rows: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows after as many steps as it takes until one changes nothing (rows compared by their number and the sum of their hashes)."""
    now, mark = kept(rows), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64(*now.columns).cast("decimal(38,0)"))).first()
        if seen == mark:
            return now
        mark, now = seen, kept(step(now))
