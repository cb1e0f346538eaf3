"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has bit i set if more than half of the hashes of a text's word shingles have it set. For a radius r each bit
position gets a nonzero vector of r+1 bits, and each nonzero vector v of r+1 bits is a table: its mask keeps the positions whose
vector has an odd product with v. Up to r differing positions leave some v to whose mask none of them belongs, so any two
fingerprints within the radius share a key in at least one of the 2^(r+1)-1 tables: no link is lost.

Fingerprints are made distinct first, so exact copies cost one row. Keys with few fingerprints are compared in pairs by a join.
Keys with many (more than SMALL) are not: each of their fingerprints names all values within r/2 flipped bits, and all that name
the same value hang on the smallest of them. Two that share such a value are within r, and any two within r share one (r even),
so the components are the same, with no pairs made.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts
from .components import components

BITS = 64
#: Fingerprints that share a key and are compared in pairs; keys with more go by flipped bits.
SMALL = 48


def shingle_hashes(data: bytes, size: int, seed: int) -> np.ndarray:
    """XXH64 of the space-joined shingles of `size` words of UTF-8 text, A-Z lower-cased; of the whole text if it has fewer words."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if size == 1:
        parts = words
    else:
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]])
        n = max(1, len(words) - size + 1)
        parts = [joined[a:b] for a, b in zip(starts[:n].tolist(), (ends[min(size, len(words)) - 1 :] - 1).tolist())]
    return np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), np.uint64, len(parts))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint, as a signed 64-bit number; zero without hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """key, fp. Null and empty texts have zero."""
    return map_texts(docs, key, text, lambda: lambda keys, texts: [[majority(shingle_hashes(t.encode(), size, seed)) for t in texts]], "fp long")


def masks(radius: int) -> list[int]:
    """The masks of the covering tables, as signed 64-bit numbers."""
    top = (1 << (radius + 1)) - 1
    own = [1 + i % top for i in range(BITS)]
    out = [sum(1 << i for i in range(BITS) if (own[i] & v).bit_count() % 2) for v in range(1, top + 1)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in out]


def table_keys(fp: Column, radius: int) -> Column:
    """One key for each table; the table's number is hashed in."""
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(m))) for i, m in enumerate(masks(radius))])


def flips(fp: Column, most: int) -> Column:
    """All values within `most` flipped bits."""
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    values = [sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(BITS), n)]
    return F.transform(F.array(*[F.lit(signed(v)) for v in values]), lambda x: x.bitwiseXOR(fp))


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """a, b: links of fingerprints (column fp, distinct) that differ in at most `radius` bits; their components are those of all such links."""
    if radius % 2:
        raise ValueError("the radius must be even")
    keys = fps.select("fp", F.explode(table_keys(F.col("fp"), radius)).alias("key"))
    shared = cut(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    met = cut(keys.join(shared, "key"))
    few = met.filter(F.col("n") <= SMALL).select("key", "fp")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), "key").filter((F.col("a") < F.col("b")) & near).select("a", "b")
    many = met.filter(F.col("n") > SMALL).select("fp").distinct()
    named = many.select("fp", F.explode(flips(F.col("fp"), radius // 2)).alias("value"))
    hub = named.groupBy("value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("value", "a")
    hung = named.join(hub, "value").filter("fp > a").select("a", F.col("fp").alias("b"))
    return pairs.union(hung).distinct()


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 2, size: int = 3, seed: int = 42) -> DataFrame:
    """key, fp, component: the smallest key that links of fingerprints reach from the row's, its own included.

    Null and empty texts have the fingerprint zero and are linked like any other; null keys take part but name no component
    unless nothing else does (then it is null). Repeated rows stay.
    """
    own = cut(fingerprints(docs, key, text, size, seed))
    classes = cut(own.groupBy("fp").agg(F.min(key).alias("least")))
    found = components(links(classes.select("fp"), radius))
    roots = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = roots.groupBy("root").agg(F.min("least").alias("component"))
    named = roots.join(least, "root").select("fp", "component")
    return own.join(named, "fp").select(key, "fp", "component")
