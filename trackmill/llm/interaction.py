"""How filters of a corpus interact: what each removes in every order in which they can be applied.

Five filters give each document a mask of 32 values. A table of 32 masks by 120 orders states the step at which an order removes a mask first.
`mapInArrow` looks the masks up in that table and counts, with `np.bincount`, the removals by part, order, step and label; the partial arrays of all
tasks are summed. From the sums follow, for each part, order and step, what is kept, what is removed, what was redundant, and each filter's share over all orders.

Filters, over the whole text (null: empty; words: maximal runs of all but space and \\x09-\\x0D, case-sensitive):
A under 200 words; B fewer than half of the words distinct; C over 3 % of the code points A-Z; D any of #$%&*|; E the same text as a document of smaller id.

Copies are counted before they are shuffled: rows of one text in one part with one label are one row with its count, so a text that is a third of the table
is a few rows a task. Documents with a null id have no label, are identical to none of smaller id, and are dealt by their text. A null part is "".
An id that repeats counts each of its rows; labels that repeat an id count as 1 if any of them does. Labels are 1 or not: null and other values count as not.
An empty table gives no rows: parts are those that occur.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

FILTERS = "ABCDE"
STEPS = len(FILTERS)
ORDERS = ["".join(o) for o in itertools.permutations(FILTERS)]
#: Label classes: bit 0 good, bit 1 toxic.
CLASSES = 4
#: Parts whose arrays a task holds at once.
PARTS = 256
SPACE = r"[\x20\x09-\x0D]+"


def first_failures() -> np.ndarray:
    """For each mask (bit i: fails filter i) and order, the step from 0 at which it is removed; STEPS if never."""
    table = np.full((1 << STEPS, len(ORDERS)), STEPS, np.int64)
    for column, order in enumerate(ORDERS):
        for step in reversed(range(STEPS)):
            failing = (np.arange(1 << STEPS) >> FILTERS.index(order[step])) & 1 == 1
            table[failing, column] = step
    return table


def text_failures(text: Column) -> Column:
    """The bits of A to D."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    tests = [F.size(words) < 200, 100 * F.size(F.array_distinct(words)) < 50 * F.size(words), 100 * capitals.cast("long") > 3 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask, label, n: how many documents of each part have the mask and the label class."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    facts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_failures(whole).alias("mask"), F.sha2(whole, 256).alias("digest"))
    # null ids meet no label, and would all be one key
    facts = facts.withColumn("salt", F.when(F.col("k").isNull(), F.xxhash64("digest", "part")).otherwise(F.lit(0).cast("long")))
    one = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0))
    known = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg((one("quality") + 2 * one("toxic")).alias("label")).withColumn("salt", F.lit(0).cast("long"))
    joined = facts.join(known, ["k", "salt"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    # dealt by (k, salt) already, so this needs no shuffle; a repeated id is one row with its count
    rows = joined.groupBy("k", "salt", "digest", "mask", "part", "label").agg(F.count("*").alias("n"))
    groups = rows.groupBy("digest", "mask", "part", "label").agg(F.sum("n").alias("n"), F.min("k").alias("least"), F.min_by("n", "k").alias("at_least"), F.sum(F.when(F.col("k").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    # at most parts by labels rows a text
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    groups = groups.withColumn("original", F.col("nameless") + F.when(first, F.col("at_least")).otherwise(0))
    kinds = F.array(F.struct(F.col("mask"), F.col("original").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("original")).alias("n")))
    return groups.select("part", "label", F.explode(kinds).alias("kind")).select("part", "kind.mask", "label", "kind.n").filter("n > 0")


def removals(counts: DataFrame) -> DataFrame:
    """part, cells: partial arrays of removals by order, step and label (in this order), and behind them the documents by mask."""
    width = len(ORDERS) * STEPS * CLASSES + (1 << STEPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = first_failures()
        place = np.arange(len(ORDERS)) * (STEPS + 1)
        held: dict[str, np.ndarray] = {}

        def emitted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([c.tolist() for c in held.values()], pa.list_(pa.int64()))], names=["part", "cells"])
            held.clear()
            return out

        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            own, names = parts.indices.to_numpy(), parts.dictionary.to_pylist()
            mask, label, n = (batch.column(i).to_numpy() for i in (1, 2, 3))
            for number, name in enumerate(names):
                some = own == number
                if name not in held and len(held) >= PARTS:
                    yield emitted()
                # a row for each document class, a column for each order
                cells = (table[mask[some]] + place) * CLASSES + label[some, None]
                removed = np.bincount(cells.ravel(), np.repeat(n[some], len(ORDERS)), len(ORDERS) * (STEPS + 1) * CLASSES)
                removed = removed.reshape(len(ORDERS), STEPS + 1, CLASSES)[:, :STEPS].ravel()
                found = np.concatenate([removed, np.bincount(mask[some], n[some], 1 << STEPS)]).astype(np.int64)
                held[name] = held[name] + found if name in held else found
        if held:
            yield emitted()

    partial = small_batches(counts).select("part", F.col("mask").cast("int"), F.col("label").cast("int"), F.col("n").cast("long")).mapInArrow(run, "part string, cells array<long>")
    return partial.select("part", F.posexplode("cells").alias("cell", "n")).filter(F.col("cell") < width).groupBy("part", "cell").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each part."""
    sums = cut(removals(judged(docs, labels, key, text, part)))  # read twice; 2,432 rows a part
    steps = len(ORDERS) * STEPS * CLASSES
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    label = F.col("cell") % CLASSES
    removed = sums.filter(F.col("cell") < steps).groupBy("part", F.floor(F.col("cell") / (STEPS * CLASSES)).cast("int").alias("o"), (F.floor(F.col("cell") / CLASSES) % STEPS + 1).cast("int").alias("step"))
    removed = removed.agg(F.sum("n").alias("removed"), count(label.bitwiseAND(1) == 1).alias("good_lost"), count(label.bitwiseAND(2) == 2).alias("toxic_lost"))
    mask = F.col("cell") - steps
    bits = lambda test: F.array(*[count(test(1 << i)) for i in range(STEPS)])
    masks = sums.filter(mask >= 0).groupBy("part").agg(F.sum("n").alias("total"), bits(lambda b: mask.bitwiseAND(b) == b).alias("fails"), bits(lambda b: mask == b).alias("alone"))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    out = removed.withColumn("filter_order", F.element_at(F.array(*map(F.lit, ORDERS)), F.col("o") + 1)).withColumn("f", F.instr(F.lit(FILTERS), letter)).join(masks, "part")
    so_far = F.sum("removed").over(Window.partitionBy("part", "o").orderBy("step"))
    return out.select(
        "part", "filter_order", "step", (F.col("total") - so_far).alias("kept"), "removed", (F.element_at("fails", F.col("f")) - F.col("removed")).alias("redundant"),
        F.element_at("alone", F.col("f")).alias("unique_fails"), "good_lost", "toxic_lost", F.sum("removed").over(Window.partitionBy("part", "f")).alias("shapley"),
    )
