"""Near duplicates of whole texts: SimHash with covering tables, and keys of content-chosen shingles for what no radius covers.

Two texts are near copies if their sets of SHINGLE-word shingles have a Jaccard similarity of `least` or more; groups are
connected components. Texts that are equal are one class from the start. Classes are compared that share a key:

* of the covering tables of a SimHash over a text's distinct words (simhash.py): every class is compared with the key's head. That
  joins most copies early, but a fingerprint within the radius is no certainty: at 0.8 fingerprints of shingles differ in 9 bits;
* of content: each of KEYS orders of all shingles gives a key, the first CHOSEN shingles of the text in CHOSEN orders of their own.
  Two texts alike by s share a given key with the chance s ** CHOSEN, so they share none with (1 - 0.8 ** 3) ** 30 = 5e-10 at 0.8
  and less above. (A prefix filter would be certain, but its keys, a fifth of all shingles, took over nine times the input on disk.)

The classes of a content key are compared with a head in rounds, as long as a key holds more than SMALL classes that are not of its
largest group; what remains of keys with two or more groups is then compared in pairs, unless sizes or a bitmap of the shingles
show that a pair can't be alike. No key has a limit, and no pair of joined classes is made. Every link is verified on the whole sets,
which are made for pairs only that sizes and bitmaps admit. A crowd that shares a key and in which no two are alike is the one case of
work by the square of its size, within a join's condition.

Null texts count as empty; texts without words have no near copies but equal ones. A null key comes before all others. Of equal rows
(key and text) one stays, the one of least hash. Any type of key that can be ordered will do; only the two named columns matter.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_texts, pass_on, stored
from .components import components
from .simhash import majority, table_keys

#: Words in a shingle, and the least similarity of near copies.
SHINGLE, SIMILAR = 5, 0.8
#: Differing bits of two fingerprints that the covering tables are made for.
RADIUS = 4
#: Keys of content for each text, and the shingles that make one.
KEYS, CHOSEN = 30, 3
#: 64-bit words of a text's bitmap of shingles.
BITMAP = 32
#: Classes of a key outside its largest group that are left to pairs; the most rounds of heads before that.
SMALL, ROUNDS = 32, 3
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def word_hashes(text: str) -> np.ndarray:
    """XXH64 of each word, A-Z lower-cased."""
    words = text.encode().lower().split()
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes, ascending, of the shingles of `size` words (of all words, if there are fewer)."""
    size = min(size, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    h = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        h = (h + words[k : len(words) - size + 1 + k]) * _MIX[0]
        h ^= h >> np.uint64(31)
    h *= _MIX[1]
    return np.unique(h ^ (h >> np.uint64(29)))


def _odd(n: int) -> np.ndarray:
    """n fixed odd numbers: the orders."""
    z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * _MIX[0]
    return (z ^ (z >> np.uint64(27))) * _MIX[1] | np.uint64(1)


ORDERS = _odd(KEYS * CHOSEN)


def content_keys(grams: np.ndarray) -> list[int]:
    """A key for each of KEYS sets of orders, as signed 64-bit numbers; none without shingles."""
    if not len(grams):
        return []
    first = np.min([(grams[at : at + 4096, None] * ORDERS).min(axis=0) for at in range(0, len(grams), 4096)], axis=0).reshape(KEYS, CHOSEN)
    return [xxhash.xxh64_intdigest(one.astype("<u8").tobytes(), i) - (1 << 63) for i, one in enumerate(first)]


def signatures(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, fp (SimHash of the distinct words), size (distinct shingles), bits (each shingle flips one), keys (of content)."""

    def make():
        def work(_, texts):
            out = []
            for t in texts:
                words = word_hashes(t)
                grams = gram_hashes(words)
                odd = np.bincount((grams % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1
                bits = np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist()
                out.append([majority(np.unique(words)), len(grams), bits, content_keys(grams)])
            return [list(c) for c in zip(*out)]

        return work

    return map_texts(rows, key, text, make, "fp long, size int, bits array<long>, keys array<long>")


def beside(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """The pairs with x and y, the column's values of their nodes."""
    one = lambda side, name: table.select(F.col("node").alias(side), F.col(column).alias(name))
    return pairs.join(one("a", "x"), "a").join(one("b", "y"), "b")


def alike(pairs: DataFrame, signed: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of `least` or more, as a stored table."""

    @F.pandas_udf("double")
    def jaccard(x, y):
        def one(a, b):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            return both / max(1, len(a) + len(b) - both)

        return x.combine(y, one).astype(float)

    about = signed.select("node", F.struct("size", "bits").alias("about"))
    admitted = stored(beside(pairs, about, "about").filter(can_be_alike(F.col("x"), F.col("y"), least)).select("a", "b"))
    if admitted.isEmpty():
        return admitted
    # a table of its own, so that Spark knows its size: it is sent to the texts if it is small, else both are shuffled
    nodes = stored(admitted.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    grams = lambda _, found: [[gram_hashes(word_hashes(t)).tobytes() for t in found]]
    sets = stored(map_texts(texts.join(nodes, "node", "left_semi"), "node", "t", lambda: grams, "grams binary"))
    links = stored(beside(admitted, sets, "grams").filter(jaccard("x", "y") >= least - 1e-9).select("a", "b"))
    discard(admitted, nodes, sets)
    return links


def can_be_alike(x: Column, y: Column, least: float) -> Column:
    """False only for texts (structs of size and bits) that can't be alike by `least`: bits that differ are shingles that differ."""
    differ = sum((F.bit_count(x["bits"][i].bitwiseXOR(y["bits"][i])) for i in range(BITMAP)), F.lit(0))
    return sizes_fit(x["size"], y["size"], least) & (differ <= (1 - least) / (1 + least) * (x["size"] + y["size"]) + 1e-6)


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def sizes_fit(a: Column, b: Column, least: float) -> Column:
    return F.least(a, b) >= least * F.greatest(a, b) - 1e-6


def shared_keys(signed: DataFrame, radius: int) -> DataFrame:
    """key, node, size, content (whether the key is one of content), of keys that two or more classes have."""
    both = F.concat(F.transform(table_keys(F.col("fp"), radius), lambda k: F.struct(k.alias("key"), F.lit(False).alias("content"))), F.transform("keys", lambda k: F.struct(k.alias("key"), F.lit(True).alias("content"))))
    keys = signed.filter("size > 0").select("node", "size", F.inline(both))
    return keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "key")


def rooted(met: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows of met (key, node, size) whose keys still hold two or more groups, with each node's group (root), as a stored table."""
    # a table of its own, so that nodes meet their groups once, not for the keys and again for the rows
    now = stored(met.select("key", "node", "size").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")))
    live = now.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("key")
    held = stored(now.join(live, "key"))
    discard(now)
    return held


def largest_groups(now: DataFrame) -> DataFrame:
    """key, top (the root of most classes of it), rest (how many classes are of others)."""
    each = now.groupBy("key", "root").agg(F.count("*").alias("n"))
    return each.groupBy("key").agg(F.max(F.struct("n", "root")).alias("x"), F.sum("n").alias("all")).select("key", F.col("x.root").alias("top"), (F.col("all") - F.col("x.n")).alias("rest"))


def beside_heads(now: DataFrame, nth: int, least: float) -> DataFrame:
    """a, b: of each key of now (key, node, root, size), one node that the hash and nth choose, beside all that it isn't joined with."""
    head = F.min(F.struct(F.xxhash64("node", F.lit(nth)).alias("h"), F.col("node").alias("head"), F.col("root").alias("head_root"), F.col("size").alias("head_size")))
    heads = now.groupBy("key").agg(head.alias("x")).select("key", "x.head", "x.head_root", "x.head_size")
    met = now.join(heads, "key").filter((F.col("root") != F.col("head_root")) & sizes_fit(F.col("size"), F.col("head_size"), least))
    return met.select(*ordered(F.col("node"), F.col("head"))).distinct()


def apart(now: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    """a, b: all pairs of a key of now that aren't joined, whatever the key's size; nodes of a key's largest group meet only others."""
    told = now.join(signed.select("node", F.struct("size", "bits").alias("about")), "node")
    sided = lambda rows, side, *more: rows.select("key", *more, *[F.col(c).alias(f"{c}_{side}") for c in ("node", "root", "about")])
    few = sided(told.join(largest_groups(now).select("key", "top"), "key").filter("root != top"), "a", "top")
    once = (F.col("root_b") == F.col("top")) | (F.col("node_a") < F.col("node_b"))
    met = few.join(sided(told, "b"), "key").filter((F.col("root_a") != F.col("root_b")) & once & can_be_alike(F.col("about_a"), F.col("about_b"), least))
    return met.select(*ordered(F.col("node_a"), F.col("node_b"))).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, least: float = SIMILAR) -> DataFrame:
    """docs (all columns) without the rows that a copy or near copy of smaller key stands for: one of each group stays."""
    string = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    k, t = F.col(f"`{key}`"), string(F.col(f"`{text}`"))
    # a row stands aside in one column, so that its names can't clash with those used here; h deals the copies of a text apart
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = docs.select(row, k.alias("d"), F.xxhash64(k).alias("h"), F.unhex(F.substring(F.sha2(t, 256), 1, 32)).alias("digest"))
    classes = own.groupBy("digest").agg(F.min(F.struct("d")).alias("x"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("x.d").alias("least"), F.xxhash64("x.d").alias("h")))
    # the one row of each class that stands for it; neither side has a bound, so they are joined by sorting
    plain = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    met = own.join(classes.hint("merge"), ["digest", "h"]).filter(F.col("d").eqNullSafe(F.col("least")))
    rows = stored(met.groupBy("digest", "h").agg(F.first("node").alias("node"), F.min_by("row", F.xxhash64(*plain)).alias("row")).select("node", "row"))
    texts = rows.select("node", string(F.col(f"row.`{text}`")).alias("t"))
    signed = stored(signatures(texts, "node", "t"))
    met = stored(shared_keys(signed, radius))
    # every key's classes beside a head; then only keys of content, where many are left, and at last in pairs
    links = alike(beside_heads(met.withColumn("root", F.col("node")), 0, least), signed, texts, least)
    joined = stored(components(links))
    discard(links)
    now = rooted(met.filter("content"), joined)
    crowds = now
    for nth in range(1, ROUNDS):
        # groups only grow, so a key that holds one group or no crowd never gets another: a round reads what the last one left
        crowded = stored(largest_groups(crowds).filter(F.col("rest") > SMALL).select("key"))
        links = None if crowded.isEmpty() else alike(beside_heads(crowds.join(crowded, "key"), nth, least), signed, texts, least)
        if links is None or links.isEmpty():
            break
        before, joined = joined, stored(components(pass_on(joined, links)))
        left, crowds = crowds, rooted(crowds.join(crowded, "key"), joined)
        discard(links, crowded, before, *[left] * (left is not now))
    if crowds is not now:
        left, now = now, rooted(now, joined)
        discard(left, crowds)
    links = alike(apart(now, signed, least), signed, texts, least)
    found = stored(components(pass_on(joined, links)))
    discard(links, now)
    first = found.join(classes, "node").groupBy("root").agg(F.min(F.struct("least", "digest", "node")).alias("x")).select(F.col("x.node").alias("node"))
    # a table of its own, so that Spark knows its size and sends it to the rows if it is small
    copies = stored(found.select("node").join(first, "node", "left_anti"))
    return rows.join(copies, "node", "left_anti").select("row.*")
