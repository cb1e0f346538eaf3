"""Streaming queries: they run over all files that are there now, and give what the batch queries give."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators.state import shared_dir
from ..streaming import live as L
from .registry import query


def _folder(spark) -> str:
    """A new folder that driver and executors share."""
    return os.path.join(shared_dir(spark), "streams", uuid.uuid4().hex)


def _events(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return L.read_stream(spark, f"{sf_dir}/events.parque[t]", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _done(spark, frame, mode):
    at = _folder(spark)
    L.run_to_table(frame, f"{at}/table", f"{at}/state", mode)
    return spark.read.parquet(f"{at}/table")  # each append is a folder `batch=`


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 6 HOURS, ts)) AS start_us, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Tumbling windows of six hours for each kind of event."""
    got = _done(spark, L.windowed(_events(spark, sf_dir), "ts", ["event_type"], "value", "6 hours"), "complete")
    return got.select("event_type", F.unix_micros("window_start").alias("start_us"), "n", F.round("total", 4).alias("total"))


@query("""
WITH g AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800000000 THEN 1 ELSE 0 END AS f FROM events),
i AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM i GROUP BY user_id, s
""")
def stream_sessions(spark, sf_dir):
    """Sessions without a gap of more than 30 minutes; the same as the batch islands."""
    got = _done(spark, L.sessions(_events(spark, sf_dir), "ts", ["user_id"], "30 minutes"), "complete")
    return got.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("""
WITH d AS (SELECT user_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events)
SELECT user_id, count(*) AS n, count(*) FILTER (step = 0) AS duplicates, count(*) FILTER (step < 0) AS regressions, count(*) FILTER (step > 86400000000) AS gaps, max(us) AS last_us FROM d GROUP BY user_id
""")
def stream_checks(spark, sf_dir):
    """Duplicates, regressions and gaps of each user in order of ids, whatever order rows arrive in."""
    rows = _events(spark, sf_dir).select("user_id", "event_id", F.unix_micros("ts").alias("us"))
    got = _done(spark, L.running_checks(rows, "user_id", "event_id", "us", 86_400_000_000), "update")
    return got.groupBy("user_id").agg(*[F.max_by(c, "n").alias(c) for c in ("duplicates", "regressions", "gaps", "last_us")], F.max("n").alias("n"))


DAY = 86_400_000_000


@query(f"""
WITH r AS (SELECT user_id, event_id, epoch_us(ts) AS us, value, CAST(floor(value / 40) AS BIGINT) AS cell FROM events), m AS (SELECT epoch_ms(max(ts)) * 1000 - {DAY} AS mark FROM events),
p AS (SELECT *, lag(us) OVER w AS before, lag(cell) OVER w AS was FROM r, m WHERE us < mark WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
f AS (SELECT user_id, us, event_id, 'high' AS kind FROM p WHERE value > 90 UNION ALL SELECT user_id, us, event_id, 'cadence' FROM p WHERE us - before > {DAY} UNION ALL SELECT user_id, us, event_id, 'overlap' FROM p WHERE cell <> was),
g AS (SELECT *, CASE WHEN us - lag(us) OVER w > {DAY // 2} THEN 1 ELSE 0 END AS cut FROM f WINDOW w AS (PARTITION BY user_id, kind ORDER BY us, event_id)),
i AS (SELECT *, sum(cut) OVER (PARTITION BY user_id, kind ORDER BY us, event_id) AS nth FROM g)
SELECT user_id, kind, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM i, m GROUP BY user_id, kind, nth, mark HAVING max(us) + {DAY // 2} < mark
""")
def stream_events(spark, sf_dir):
    """Failures of frames, by themselves and beside the frame before, as events that timers close."""
    rows = _events(spark, sf_dir).select("user_id", "event_id", "ts", F.when(F.col("value") > 90, F.array(F.lit("high"))).alias("kinds"), F.array(F.floor(F.col("value") / 40)).alias("cells"))
    return _done(spark, L.frame_events(rows, "ts", "user_id", "event_id", "kinds", "cells", DAY, 0.5, DAY // 2), "append").select("user_id", "kind", "start_us", "end_us", "n")
