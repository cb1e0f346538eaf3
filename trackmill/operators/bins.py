"""Fixed-length bins along arcs: splitting of movements, and two levels of aggregation.

A movement runs forward on one arc, from offset a to b and from time s to e. It is cut at bin edges; pieces of one sequence on one
bin belong to one traversal until they part by more than `gap`. Means are rounded where traversals are made and again where bins
are, since bins weigh the rounded means. Every bin of every arc has a row, also those that nothing crossed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .islands import reach_islands

DIGITS = 6


def arc_bins(arcs: DataFrame, arc: str, length: str, size: float) -> DataFrame:
    """arc, bin, bin_length, partial: the bins of each arc; the last can be shorter."""
    n = F.ceil(F.col(length) / size)
    bins = arcs.filter(F.col(length) > 0).select(arc, length, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("bin"))
    held = F.least(F.lit(float(size)), F.col(length) - F.col("bin") * size)
    return bins.select(arc, "bin", F.round(held, DIGITS).alias("bin_length"), (held < size).alias("partial"))


def split(moves: DataFrame, a: str, b: str, s: str, e: str, size: float) -> DataFrame:
    """A row for each bin that a forward movement crosses: bin, entry, exit, piece_start, piece_end (times rounded half away)."""
    last = F.ceil(F.col(b) / size) - 1
    rows = moves.filter(F.col(b) > F.col(a)).withColumn("bin", F.explode(F.sequence(F.floor(F.col(a) / size), last)))
    entry, leave = F.greatest(F.col(a), F.col("bin") * float(size)), F.least(F.col(b), (F.col("bin") + 1) * float(size))

    def at(offset: Column) -> Column:
        return F.col(s) + F.round((F.col(e) - F.col(s)) * ((offset - F.col(a)) / (F.col(b) - F.col(a)))).cast("long")

    return rows.select("*", entry.alias("entry"), leave.alias("exit"), at(entry).alias("piece_start"), at(leave).alias("piece_end"))


def traversals(pieces: DataFrame, arc: str, sequence: str, tie: str, speed: str, gap: int) -> DataFrame:
    """One row for each pass over a bin: first and last time, entry and exit, distance, speeds, pieces. Identical pieces count once, as the first by `tie`.

    Nothing is shuffled if pieces are dealt by some of arc, bin and sequence already (as they are where the movements were, before split()).
    """
    keys = [arc, "bin", sequence]
    once = pieces.groupBy(*keys, "piece_start", "piece_end", "entry", "exit").agg(F.min(F.struct(tie, speed)).alias("__first")).select("*", "__first.*").drop("__first")
    numbered = reach_islands(once, keys, "piece_start", "piece_end", tie, gap, "ordinal")
    return numbered.groupBy(*keys, "ordinal").agg(
        F.min("piece_start").alias("first_time"),
        F.max("piece_end").alias("last_time"),
        F.min_by("entry", F.struct("piece_start", tie)).alias("entry"),
        F.max_by("exit", F.struct("piece_end", tie)).alias("exit"),
        F.round(F.sum(F.col("exit") - F.col("entry")), DIGITS).alias("distance"),
        F.min(speed).alias("min_speed"),
        F.round(F.avg(speed), DIGITS).alias("mean_speed"),
        F.max(speed).alias("max_speed"),
        F.count("*").alias("pieces"),
    )


def ledger(bins: DataFrame, passes: DataFrame, arc: str) -> DataFrame:
    """One row for each bin, crossed or not: traversals, sequences, distance, and speeds weighed by pieces (null where nothing passed)."""
    # in whole units of the last digit, so that the sum is exact in any order
    units = F.round(F.col("mean_speed") * 10**DIGITS).cast("long")
    mean = F.round(F.sum(units * F.col("pieces")) / F.sum("pieces").cast("double")) / 10**DIGITS
    crossed = passes.groupBy(arc, "bin").agg(F.count("*").alias("traversals"), F.sum("distance").alias("distance"), F.min("min_speed").alias("min_speed"), F.round(mean, DIGITS).alias("mean_speed"), F.max("max_speed").alias("max_speed"))
    full = bins.join(crossed, [arc, "bin"], "left")
    return full.withColumns({"traversals": F.coalesce("traversals", F.lit(0)), "distance": F.round(F.coalesce("distance", F.lit(0.0)), DIGITS)})
