"""Fixity audit of archived records (WARC) by Merkle trees.

A record's digest is SHA-256 over its serialised form. Records are ordered by their position (an offset or a sequence number).
The records of one position are hashed together as a multiset: their number and the sums of the limbs of their digests, so any
number of repeated records needs no gathering. FANOUT neighbouring positions form a range, FANOUT ranges the next level, up to
one root; a node's digest covers its children's numbers and digests in order, and a node has at most FANOUT children.

Two replicas are compared from their roots down: at each level only the children of mismatching nodes are joined, and the
mismatching positions tell which records were altered, are missing or are extra. Records with a null position are kept together
at a position of their own below all others. Null fields differ from empty ones. Equal replicas, and two empty ones, give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stored

#: Children of a node: 2**SHIFT.
SHIFT = 6
NO_POSITION = -(2**62)
#: Hex digits of a record's digest in each number that is added up for its position; all 64 count.
LIMB = 13


def warc_digest(url: Column, payload: Column) -> Column:
    """SHA-256 of a response record: header lines, then the payload."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    absent = F.lit("WARC-Truncated: unspecified\r\n")
    return F.sha2(
        F.concat(
            F.lit("WARC/1.0\r\nWARC-Type: response\r\n"),
            F.coalesce(line("WARC-Target-URI", url), F.lit("")),
            F.coalesce(line("Content-Length", F.octet_length(payload).cast("string")), absent),
            F.lit("\r\n"),
            F.coalesce(payload, F.lit("")),
            F.lit("\r\n\r\n"),
        ),
        256,
    )


def leaves(records: DataFrame, position: Column, digest: Column) -> DataFrame:
    """node, n, digest: one leaf for each position."""
    limb = lambda i: F.sum(F.conv(F.substring("d", 1 + LIMB * i, LIMB), 16, 10).cast("decimal(20,0)")).cast("string")
    found = records.select(F.coalesce(position.cast("long"), F.lit(NO_POSITION)).alias("node"), digest.alias("d"))
    return found.groupBy("node").agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *map(limb, range(-(-64 // LIMB)))), 256).alias("digest"))


def parents(nodes: DataFrame) -> DataFrame:
    """The next level: each node over its children, in order."""
    one = lambda x: F.concat_ws(":", x["node"].bitwiseAND((1 << SHIFT) - 1).cast("string"), x["digest"])
    children = F.sort_array(F.collect_list(F.struct("node", "digest")))  # at most FANOUT
    return nodes.groupBy(F.shiftright("node", SHIFT).alias("node")).agg(F.sha2(F.array_join(F.transform(children, one), ","), 256).alias("digest"))


def tree(records: DataFrame, position: Column, digest: Column) -> list[DataFrame]:
    """The levels, leaves first, as tables in the shared folder; the last has the nodes 0 and -1 at most."""
    levels = [stored(leaves(records, position, digest))]
    least, most = levels[0].agg(F.min("node"), F.max("node")).first()
    span = max(-(least or 0) - 1, most or 0, 0)
    while span > 0:
        levels.append(cut(parents(levels[-1])))
        span >>= SHIFT
    return levels


def taller(levels: list[DataFrame], height: int) -> list[DataFrame]:
    return levels + [cut(x) for x in _grown(levels[-1], height - len(levels))]


def _grown(top: DataFrame, times: int):
    for _ in range(times):
        top = parents(top)
        yield top


def audit(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """position, state (altered, missing, extra), n_a, n_b, digest_a, digest_b of the positions at which the replicas' trees differ."""
    height = max(len(a), len(b))
    a, b = taller(a, height), taller(b, height)
    suspects = None
    for x, y in zip(reversed(a), reversed(b)):
        if suspects is not None:
            x, y = (z.join(suspects, F.shiftright(z["node"], SHIFT) == suspects["parent"], "left_semi") for z in (x, y))
        both = x.withColumnsRenamed({"digest": "digest_a", "n": "n_a"}).join(y.withColumnsRenamed({"digest": "digest_b", "n": "n_b"}), "node", "full_outer").filter(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
        if "n" not in x.columns:  # all but the leaves
            suspects = cut(both.select(F.col("node").alias("parent")))
    state = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("altered")
    return both.select(F.nullif("node", F.lit(NO_POSITION)).alias("position"), state.alias("state"), F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"), "digest_a", "digest_b")


def damaged(records: DataFrame, digest: Column, payload: str) -> DataFrame:
    """A replica with faults for drills, by each record's digest: of 256 records one loses its first character, one is lost, one is stored twice."""
    mark = F.substring(digest, 1, 2)
    times = F.when(mark == "01", F.array().cast("array<int>")).when(mark == "02", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return records.select("*", mark.alias("__mark"), F.explode(times).alias("__copy")).withColumn(payload, F.when(F.col("__mark") == "00", F.expr(f"substring(`{payload}`, 2)")).otherwise(F.col(payload))).drop("__mark", "__copy")
