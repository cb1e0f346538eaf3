"""Removal of repeated passages: every byte that a string of LENGTH bytes covers which also starts elsewhere in the corpus.

Of the LENGTH - GRAM + 1 GRAM-byte strings in a window of LENGTH bytes, the one of least hash (the leftmost of equal ones) is the
window's anchor. The choice depends on the window's bytes alone, so equal windows have equal anchors at equal places, and about
one position in 70 is an anchor. An anchor's context is what its windows cover.

1. An anchor whose string occurs once has no repeated windows. If all contexts of a string are equal, all of them are repeated.
2. Of other strings' contexts, those that occur twice are repeated; the rest can be so in part.
3. One copy of each context of such a string is fetched. The contexts are sorted by what follows the anchor and by what precedes
   it, read backwards: multikey quicksort to a shallow depth, then blind tries (suffixes.py). Two windows at the same distance from
   their anchors are equal if their contexts lie in one run of long enough common prefixes in both orders.
4. Strings with more than GROUP different contexts are cut into parts first, by multikey ranges: the distances of the anchor from a
   window's start are halved, and of a half only contexts that agree in all bytes which its windows have in common can share one
   (what precedes the anchor at the least distance, what follows at the largest). Parts of at most GROUP contexts are sorted as
   above, larger ones are halved again; of a single distance those bytes are the window, so all contexts of a part are repeated.

Hashes of 64 bits decide only which contexts are looked at together, and (by a second hash of 64 bits) which are equal; windows of
one distance are equal by 128 bits. Null texts count as empty; texts of fewer than LENGTH bytes have no windows. Repeated rows are
copies of each other. Only the two named columns are read. Rows are told apart by key and 64 bits of a hash of the text, rows without
a key by 128 bits, so keys can repeat or be null, and be of any type. A text is one row in one task, however long it is.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, stored
from .suffixes import WORD, deep_shallow

LENGTH, GRAM = 200, 32
REACH = LENGTH - GRAM
#: Contexts of one string that are sorted in one task, of at most 2 * LENGTH bytes each; contexts that are sorted together.
GROUP, TOGETHER = 8192, 2048
SLICE = 1 << 20
#: Shares in which the anchors of a frequent string are dealt.
SALTS = 64


def gram_hashes(data: np.ndarray) -> np.ndarray:
    h, width, base = data.astype(np.uint64) + np.uint64(1), 1, 0x100000001B3
    while width < GRAM:
        h = h[:-width] * np.uint64(base) + h[width:]
        width, base = 2 * width, base * base % (1 << 64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, place, first window, last window, hash) of each anchor; data: texts one after the other, each ending at its entry of ends."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none.astype(np.uint64)
    h = gram_hashes(data)
    bits = int(len(h)).bit_length()
    low, width = h >> np.uint64(bits) << np.uint64(bits) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * width <= REACH + 1:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    rest = REACH + 1 - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    window = np.arange(len(low))
    text = np.searchsorted(ends, window, side="right")
    whole = window + LENGTH <= ends[np.minimum(text, len(ends) - 1)]
    window, text, place = window[whole], text[whole], (low[whole] & np.uint64((1 << bits) - 1)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])]) if len(place) else none
    last = np.r_[new[1:] - 1, len(place) - 1] if len(place) else none
    return text[new], place[new], window[new], window[last], h[place[new]]


def pieces(data: bytes) -> list[tuple[int, bytes]]:
    """A long text in parts of SLICE windows, so that no window is lost or seen twice."""
    return [(at, data[at : at + SLICE + LENGTH - 1]) for at in range(0, max(1, len(data) - LENGTH + 1), SLICE)]


def packed(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return place << 16 | (place - first) << 8 | (last - first)


def covered(at: Column) -> list[Column]:
    """The bytes that the windows of a packed anchor cover."""
    start = F.shiftright(at, 16) - F.shiftright(at, 8).bitwiseAND(255)
    return [start.alias("start"), (start + at.bitwiseAND(255) + LENGTH).alias("end")]


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """d, v: what tells rows apart; k: the key; t: the text."""
    t, k = F.coalesce(F.col(text).cast("string"), F.lit("")), F.col(key)
    number = k.cast("long") if docs.schema[key].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else F.when(k.isNotNull(), F.xxhash64(k))
    return small_batches(docs).select(F.coalesce(number, F.xxhash64(F.lit("no key"), t)).alias("d"), F.xxhash64(t).alias("v"), k.alias("k"), t.cast("binary").alias("t"))


def scan(rows: DataFrame) -> DataFrame:
    """g (hash of the anchor's string), c (hash of its context and place in it), d, v, at (packed)."""

    def run(batches):
        for batch in slices(batches, 2, SLICE):
            texts = batch.column(2).to_pylist()
            parts = [(i, at, part) for i, t in enumerate(texts) if len(t) >= LENGTH for at, part in pieces(t)]
            d, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            size, some = 0, []
            for n, part in enumerate(parts):
                some.append(part)
                size += len(part[2])
                if size >= SLICE or n == len(parts) - 1:
                    joined = b"".join(p[2] for p in some)
                    ends = np.cumsum([len(p[2]) for p in some])
                    row, offset = np.array([p[0] for p in some]), np.array([p[1] for p in some]) - np.r_[0, ends[:-1]]
                    text, place, first, last, g = anchors(np.frombuffer(joined, np.uint8), ends)
                    c = np.fromiter((xxhash.xxh3_64_intdigest(joined[a : b + LENGTH], p - a) for a, b, p in zip(first.tolist(), last.tolist(), place.tolist())), np.uint64, len(place))
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(c.view(np.int64)), pa.array(d[row[text]] if len(text) else np.zeros(0, np.int64)), pa.array(v[row[text]] if len(text) else np.zeros(0, np.int64)), pa.array(packed(place + offset[text], first + offset[text], last + offset[text]))], names=["g", "c", "d", "v", "at"])
                    size, some = 0, []

    return rows.select("d", "v", "t").mapInArrow(run, "g long, c long, d long, v long, at long")


def small(rows: DataFrame) -> DataFrame:
    """The rows with compressed texts, for a shuffle."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for batch in slices(batches, 3, SLICE):
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([press.compress(t) for t in batch.column(3).to_pylist()], pa.binary())], names=["d", "v", "k", "z"])

    return rows.select("d", "v", "k", "t").mapInArrow(run, f"d long, v long, k {rows.schema['k'].dataType.simpleString()}, z binary")


def contexts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """g, d, v, at, once, hot, left, right: the bytes before and from each wanted anchor that its windows cover."""

    def run(batches):
        press = zstandard.ZstdDecompressor()
        for batch in slices(batches, 2, SLICE):
            out = []
            for d, v, z, found in zip(*[c.to_pylist() for c in batch.columns]):
                data = press.decompress(z)
                for x in found:
                    place, before, more = x["at"] >> 16, x["at"] >> 8 & 255, x["at"] & 255
                    out.append((x["g"], d, v, x["at"], x["once"], x["hot"], data[place - before : place], data[place : place - before + more + LENGTH]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 8, kinds)], names=["g", "d", "v", "at", "once", "hot", "left", "right"])

    asked = wanted.groupBy("d", "v").agg(F.collect_list(F.struct("g", "at", "once", "hot")).alias("found"))  # at most a text's own anchors
    return small(rows).join(asked, ["d", "v"]).select("d", "v", "z", "found").mapInArrow(run, "g long, d long, v long, at long, once boolean, hot boolean, left binary, right binary")


def repeated(group: np.ndarray, left: list[bytes], right: list[bytes], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each context and distance (low to high) of the anchor from a window's start, whether the window is another context's too (groups ascending)."""
    n = len(group)
    out = np.zeros((n, REACH + 1), bool)
    before, after = np.fromiter(map(len, left), np.int64, n), np.fromiter(map(len, right), np.int64, n)
    wide = lambda x: -(-x // WORD) * WORD
    order_r, lcp_r = deep_shallow(right, group, wide(LENGTH), 8)
    order_l, lcp_l = deep_shallow([x[::-1] for x in left], group, wide(REACH), 4)
    run_r, run_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for r in range(int(low.min(initial=REACH)), int(high.max(initial=0)) + 1):
        own = np.flatnonzero((before >= r) & (after >= LENGTH - r) & (low <= r) & (r <= high))
        if len(own) < 2:
            continue
        run_r[order_r] = np.cumsum(lcp_r < LENGTH - r)
        run_l[order_l] = np.cumsum(lcp_l < r)
        key = run_r[own] * (n + 1) + run_l[own]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        out[own[order], r] = np.r_[same, False] | np.r_[False, same]
    return out


def resolve(found: DataFrame) -> DataFrame:
    """d, v, start, end: what repeated windows cover of contexts that occur once, in groups g and of distances low to high."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def work(table: pa.Table):
            g = table["g"].to_numpy()
            hit = repeated(np.cumsum(np.r_[0, g[1:] != g[:-1]]), table["left"].to_pylist(), table["right"].to_pylist(), table["low"].to_numpy(), table["high"].to_numpy())
            hit &= table["once"].to_numpy(zero_copy_only=False)[:, None]
            edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, first = np.nonzero(edge == 1)
            last = np.nonzero(edge == -1)[1] - 1
            place = table["at"].to_numpy()[row] >> 16
            return pa.RecordBatch.from_arrays([pa.array(table["d"].to_numpy()[row]), pa.array(table["v"].to_numpy()[row]), pa.array(place - last), pa.array(place - first + LENGTH)], names=["d", "v", "start", "end"])

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= TOGETHER:
                table = pa.Table.from_batches(held).combine_chunks()
                g = table["g"].to_numpy()
                whole = int(np.searchsorted(g, g[-1]))  # the last string may go on
                if whole:
                    yield work(table.slice(0, whole))
                    held = table.slice(whole).to_batches()
                    rows -= whole
        if rows:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return found.select("g", "d", "v", "at", "once", "left", "right", "low", "high").repartition("g").sortWithinPartitions("g", "d", "v", "at").mapInArrow(run, "d long, v long, start long, end long")


def parted(found: DataFrame, group: int) -> DataFrame:
    """d, v, start, end: the same for strings with more than `group` contexts, which are cut into parts until these are small enough."""
    out, hot = [], found.withColumns({"low": F.lit(0), "high": F.lit(REACH)})
    while True:
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct("low", middle.alias("high")), F.struct((middle + 1).alias("low"), "high"))
        cut = hot.select("g", "d", "v", "at", "once", "left", "right", F.inline(F.filter(halves, lambda x: x["low"] <= x["high"])))
        # those with a window in the range
        cut = cut.filter((F.greatest("low", LENGTH - F.length("right")) <= F.least("high", F.length("left"))))
        shared = F.concat(F.expr("substring(left, length(left) - low + 1, low)"), F.expr(f"substring(right, 1, {LENGTH} - high)"))
        cut = cut.withColumn("same", F.md5(shared))
        by = ["g", "low", "high", "same"]
        # stored, so that a part with very many contexts can be split among tasks
        cut = stored(cut)
        counts = stored(cut.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1"))
        single = F.col("low") == F.col("high")
        met = cut.join(counts, by)
        start = F.shiftright("at", 16) - F.col("low")
        out.append(met.filter(single & F.col("once")).select("d", "v", start.alias("start"), (start + LENGTH).alias("end")))
        out.append(resolve(met.filter(~single & (F.col("n") <= group)).withColumn("g", F.xxhash64(*by))))
        if counts.filter(~single & (F.col("n") > group)).isEmpty():
            break
        hot = met.filter(~single & (F.col("n") > group))
    return reduce(DataFrame.union, out)


def spans(rows: DataFrame, group: int = GROUP) -> DataFrame:
    """d, v, start, end: bytes to remove, as intervals that can overlap."""
    # stored, so that both sides of the join are dealt for it alone and a string with very many anchors can be split
    strings = stored(scan(rows).groupBy("g").agg(F.count("*").alias("n"), (F.min("c") == F.max("c")).alias("alike")).filter("n > 1"))
    met = scan(rows).join(strings, "g")
    # the hashes are needed no more where all contexts are alike
    shared = stored(met.select(F.when(~F.col("alike"), F.col("g")).alias("g"), F.when(~F.col("alike"), F.col("c")).alias("c"), "d", "v", "at", (F.col("n") > group).alias("large")))
    alike = shared.filter("g IS NULL").select("d", "v", *covered(F.col("at")))
    mixed = shared.filter("g IS NOT NULL")
    kinds = stored(mixed.groupBy("g", "c", "large").agg(F.count("*").alias("n"), F.min(F.struct("d", "v", "at")).alias("one")))
    # strings with very many anchors are salted, so that the copies of one context are not one task's
    salt = F.when(F.col("large"), F.pmod(F.xxhash64("d", "v", "at"), F.lit(SALTS))).otherwise(0).cast("int")
    salts = F.when(F.col("large"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = kinds.filter("n > 1").select("g", "c", F.explode(salts).alias("salt"))
    twice = mixed.withColumn("salt", salt).join(copied, ["g", "c", "salt"]).select("d", "v", *covered(F.col("at")))
    hot = kinds.filter("large").groupBy("g").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > group).select("g", F.lit(True).alias("hot"))
    marked = kinds.filter("large").join(hot, "g", "left").select("g", "one", "n", F.coalesce("hot", F.lit(False)).alias("hot")).union(kinds.filter("NOT large").select("g", "one", "n", F.lit(False)))
    wanted = marked.select("g", "one.d", "one.v", "one.at", (F.col("n") == 1).alias("once"), "hot")
    found = stored(contexts(rows, wanted))
    whole = {"low": F.lit(0), "high": F.lit(REACH)}
    out = alike.union(twice).union(resolve(found.filter("NOT hot").withColumns(whole)))
    crowded = found.filter("hot")
    return out if crowded.isEmpty() else out.union(parted(crowded, group))


def strip(docs: DataFrame, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """key, kept (binary), n_bytes, n_removed, n_spans (maximal removed runs), spans (array of start and end)."""
    rows = keyed(docs, key, text)
    own = spans(rows, group).groupBy("d", "v").agg(F.collect_list(F.struct("start", "end")).alias("found"))  # at most a text's own
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        press = zstandard.ZstdDecompressor()
        for batch in slices(batches, 1, SLICE):
            out = []
            for z, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, merged = press.decompress(z), []
                for a, b in sorted((x["start"], x["end"]) for x in found or []):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                edges = [0, *[x for m in merged for x in m], len(data)]
                out.append((b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])), len(data), sum(b - a for a, b in merged), len(merged), [{"start": a, "end": b} for a, b in merged]))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 5, kinds)]], names=[key, "kept", "n_bytes", "n_removed", "n_spans", "spans"])

    return small(rows).join(own, ["d", "v"], "left").select("k", "z", "found").mapInArrow(run, f"`{key}` {kind}, kept binary, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>")
