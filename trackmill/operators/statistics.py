"""Classification metrics, resampling, rate bounds and tri-state verdicts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .state import kept, stored


def ratio(a: Column, b: Column, empty: float | None = 1.0) -> Column:
    """a / b; `empty` where b is 0 (None: an error)."""
    other = F.raise_error(F.lit("nothing to judge")).cast("double") if empty is None else F.lit(empty)
    return F.when(b == 0, other).otherwise(a / b.cast("double"))


def classification(rows: DataFrame, keys: list[str], truth: Column, said: Column, empty: float | None = 1.0) -> DataFrame:
    """keys, tp, fp, fn, precision, recall, f1, accuracy."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    got = rows.groupBy(*keys).agg(count(truth & said).alias("tp"), count(~truth & said).alias("fp"), count(truth & ~said).alias("fn"), F.count("*").alias("__n"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    figures = {"precision": ratio(tp, tp + fp, empty), "recall": ratio(tp, tp + fn, empty), "f1": ratio(2 * tp, 2 * tp + fp + fn, empty), "accuracy": ratio(F.col("__n") - fp - fn, F.col("__n"), empty)}
    return got.withColumns({k: F.round(v, 9) for k, v in figures.items()}).drop("__n")


def bootstrap_rate(clusters: DataFrame, key: str, hit: str, n: str, replicates: int, level: float) -> DataFrame:
    """low, high, mean, replicates of sum(hit) / sum(n) over resamples of as many clusters as there are.

    Each draw's place follows from SHA-256 of "replicate:slot", so any engine and any partitioning draws the same clusters. Clusters are numbered in
    order of their keys: each range of keys counts its own, and the ranges' counts add up to where each begins.
    """
    ranges = kept(clusters.repartitionByRange(key).withColumn("__p", F.spark_partition_id()))
    begins = ranges.groupBy("__p").agg(F.count("*").alias("__c")).withColumn("__b", F.sum("__c").over(Window.orderBy("__p")) - F.col("__c"))  # a row a partition
    m = begins.agg(F.coalesce(F.sum("__c"), F.lit(0))).first()[0]
    own = F.row_number().over(Window.partitionBy("__p").orderBy(key)) - 1
    placed = ranges.withColumn("__n", own).join(F.broadcast(begins), "__p").withColumn("place", F.col("__b") + F.col("__n"))
    draws = clusters.sparkSession.range(replicates).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("slot")) if m else clusters.sparkSession.createDataFrame([], "rep long, slot int")
    pick = F.conv(F.substring(F.sha2(F.concat_ws(":", "rep", "slot"), 256), 1, 12), 16, 10).cast("long") % max(m, 1)
    rates = draws.select("rep", pick.alias("place")).join(placed.select("place", hit, n), "place").groupBy("rep").agg((F.sum(hit) / F.sum(n).cast("double")).alias("rate"))
    tail = round((1 - level) / 2, 12)
    return rates.agg(F.round(F.percentile("rate", tail), 9).alias("low"), F.round(F.percentile("rate", 1 - tail), 9).alias("high"), F.round(F.avg("rate"), 9).alias("mean"), F.count("*").alias("replicates"))


def cluster_bootstrap(clusters: DataFrame, key: str, hit: str, n: str, replicates: int, level: float, seed: int = 0, together: int = 1024) -> DataFrame:
    """low, high, mean, replicates of sum(hit) / sum(n) over resamples of as many clusters as there are, for many clusters and replicates.

    A resample is how often each cluster is drawn. Clusters are dealt to buckets of about `together` by a hash of their keys; a replicate first shares its draws
    among the buckets by their sizes, then among each bucket's clusters (both multinomial, so the whole is). Every draw follows from the seed, the
    replicate and the bucket, so results are the same for any partitioning, and only sums by replicate are shuffled.
    Clusters of no rows are drawn, and replicates that draw only such have no rate. Repeated and null keys are clusters of their own.
    """
    m = clusters.count()
    parts = max(1, -(-m // together))
    dealt = kept(clusters.select(F.col(key).alias("k"), F.col(hit).cast("double").alias("hit"), F.col(n).cast("double").alias("n")).withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int")))
    sizes = {r["bucket"]: r["count"] for r in dealt.groupBy("bucket").count().collect()}  # a number for each `together` clusters
    names = sorted(sizes)
    shares = np.array([sizes[b] for b in names], float) / max(m, 1)

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rep in batch["id"].tolist():
                yield pd.DataFrame({"shared": names, "rep": rep, "own": np.random.default_rng([seed, rep]).multinomial(m, shares)})

    def draw(key: tuple, rows: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["k", "hit", "n"], kind="stable")
        values, even = rows[["hit", "n"]].to_numpy(float), np.full(len(rows), 1 / len(rows))
        out = np.array([np.random.default_rng([seed, rep, key[0]]).multinomial(own, even) @ values for rep, own in zip(shared["rep"].tolist(), shared["own"].tolist())])
        return pd.DataFrame({"rep": shared["rep"], "hit": out[:, 0], "n": out[:, 1]})

    # each replicate is shared out once, not by every bucket
    spark = clusters.sparkSession
    counts = spark.range(replicates if m else 0).mapInPandas(share, "shared int, rep long, own long")
    sums = dealt.groupBy("bucket").cogroup(counts.groupBy("shared")).applyInPandas(draw, "rep long, hit double, n double").groupBy("rep").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"))
    rates = sums.filter("n > 0").select((F.col("hit") / F.col("n")).alias("rate"))
    tail = round((1 - level) / 2, 12)
    return rates.agg(F.round(F.percentile("rate", tail), 9).alias("low"), F.round(F.percentile("rate", 1 - tail), 9).alias("high"), F.round(F.avg("rate"), 9).alias("mean"), F.count("*").alias("replicates"))


def percentiles(rows: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """key, linear (by interpolation), nearest (the least value that `share` of all do not exceed), largest; nulls count as none.

    Equal values are counted first, and ranges of the counted values find their own ranks, so no task holds a whole key's values.
    """
    counted = stored(rows.groupBy(F.col(key).alias("__k"), F.col(value).alias("__v")).agg(F.count("*").alias("__c")).repartitionByRange("__k", "__v").withColumn("__p", F.spark_partition_id()))
    known = counted.filter("__v IS NOT NULL")
    parts = known.groupBy("__k", "__p").agg(F.sum("__c").alias("__s"))  # a row a key and range
    k = Window.partitionBy("__k")
    begins = parts.select(F.col("__k").alias("__bk"), F.col("__p").alias("__bp"), (F.sum("__s").over(k.orderBy("__p")) - F.col("__s")).alias("__b"), F.sum("__s").over(k).alias("__n"))
    placed = known.join(F.broadcast(begins), F.col("__k").eqNullSafe(F.col("__bk")) & (F.col("__p") == F.col("__bp")))
    upto = F.col("__b") + F.sum("__c").over(Window.partitionBy("__k", "__p").orderBy("__v"))
    at = (F.col("__n") - 1) * share
    ranks = {"__low": F.floor(at), "__high": F.ceil(at), "__nearest": F.greatest(F.ceil(F.col("__n") * share), F.lit(1)) - 1}
    marked = placed.withColumn("__to", upto)
    holds = {c: (F.col("__to") > r) & (F.col("__to") - F.col("__c") <= r) for c, r in ranks.items()}
    found = marked.groupBy("__k").agg(*[F.max(F.when(h, F.col("__v"))).alias(c) for c, h in holds.items()], F.max("__v").alias("__largest"), F.max("__n").alias("__n"))
    mixed = (F.ceil(at) - at) * F.col("__low") + (at - F.floor(at)) * F.col("__high")
    linear = F.when(F.col("__low") == F.col("__high"), F.col("__low")).otherwise(mixed)
    made = found.select(F.col("__k").alias("__f"), linear.alias("linear"), F.col("__nearest").alias("nearest"), F.col("__largest").alias("largest"))
    return counted.select("__k").distinct().join(made, F.col("__k").eqNullSafe(F.col("__f")), "left").select(F.col("__k").alias(key), "linear", "nearest", "largest")


def zero_rate_bound(exposure: Column, level: float) -> Column:
    return F.lit(-math.log(1 - level)) / exposure


def _tail(k: int, mean: float) -> float:
    """P(X <= k) of a Poisson variable; summed from the last term down, each by its logarithm."""
    if k > mean + 40 * math.sqrt(mean) + 40:
        return 1.0
    # terms more than forty deviations below the largest are under 1e-300 of it
    top = min(k, int(mean))
    i = np.arange(k, max(0, top - 40 * math.isqrt(top + 1) - 40), -1)
    logs = k * math.log(mean) - mean - math.lgamma(k + 1) + np.concatenate([[0.0], np.cumsum(np.log(i / mean))])
    return float(np.exp(logs).sum())


def upper_mean(k: int, level: float) -> float:
    """The mean at which k or fewer events have probability 1 - level."""
    low, high = 1e-9, max(10.0, 2.0 * k + 20)
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _tail(k, middle) > 1 - level else (low, middle)
    return high


def poisson_upper(k: Column, level: float) -> Column:
    @F.pandas_udf("double")
    def upper(values: pd.Series) -> pd.Series:
        known = {v: upper_mean(int(v), level) for v in values.dropna().unique()}
        return values.map(known).astype(float)

    return upper(k)


STATES = ["PASS", "UNKNOWN", "FAIL"]


def readiness(scopes: DataFrame, evidence: DataFrame, keys: list[str], needs: list[tuple[str, str, float, int]]) -> DataFrame:
    """keys, verdict, passed, unknown, failed. needs: (evidence key, operator, threshold, least support); evidence: keys, key, value, support.

    One failure fails a scope, whatever else passes; a requirement without evidence, or with too little, is unknown. The
    requirements are a profile's few, so they are part of the plan.
    """
    wanted = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(op).alias("op"), F.lit(t).alias("threshold"), F.lit(s).alias("least")) for k, op, t, s in needs])
    asked = scopes.select(*keys, F.inline(wanted)).join(evidence, [*keys, "key"], "left")
    holds = F.lit(False)
    for op in {n[1] for n in needs}:
        holds = F.when(F.col("op") == op, S.compare(F.col("value"), op, F.col("threshold"))).otherwise(holds)
    state = F.when(F.col("value").isNull() | (F.col("support") < F.col("least")), "UNKNOWN").when(holds, "PASS").otherwise("FAIL")
    each = asked.withColumn("state", state)
    return each.groupBy(*keys).agg(S.worst(F.col("state"), STATES).alias("verdict"), *[F.count_if(F.col("state") == s).alias(n) for s, n in zip(STATES, ("passed", "unknown", "failed"))])
