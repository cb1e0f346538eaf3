"""Road maps in XML, read once: nodes, ways, relations and bounds come from one scan of the files, in splits of any size.

The text source splits a file at `<`, which occurs in neither values nor text, so each row is one tag. A tag's place is its split and its row there. A task sees a split's tags
in their order, so it gathers those of each element as it reads; what begins in one split and ends in another is put together from its few pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.state import stored

KINDS, INNER = ("node", "way", "relation", "bounds"), ("nd", "tag", "member")
NAMES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}
VALUE = r"""("[^"]*+"|'[^']*+')"""
#: A tag from its name to its end, and one of its attributes.
TAG, ATTRIBUTE = rf"^/?[A-Za-z]+(\s+[\w:.-]+\s*=\s*{VALUE})*+\s*/?>\s*$", rf"\s([\w:.-]+)\s*=\s*{VALUE}"
DEGREES = r"^-?[0-9]+(\.[0-9]{1,7})?$"
#: What `\s` of these patterns stands for.
BLANK = " \t\n\x0b\f\r"
HEAD = -1
#: What a tag is to the element around it: within it, its open or only tag, its end; SPENT is the last tag of what is handed on, OTHER a tag that does not matter.
INSIDE, OPEN, WHOLE, END, SPENT, OTHER = range(6)


def _refused(tag: Column, known: Column) -> Column:
    """Why a file with this tag isn't read, else null: what could hide or add markup, other versions of the format, and tags that are none."""
    upper = F.upper(F.substring(tag, 1, 9))
    version = F.regexp_extract(tag, r"""\sversion\s*=\s*["']([^"']*)["']""", 1)
    marked = (
        F.when(upper.startswith("!DOCTYPE") | upper.startswith("!ENTITY"), "document types and entities are not read")
        .when(upper.startswith("![CDATA["), "sections of raw text are not read")
        .when(upper.startswith("!--") & ~tag.contains("-->"), "comments that hold markup are not read")
    )
    return (
        F.when(tag.startswith("!"), marked)
        .when(tag.startswith("osm") & tag.rlike(r"^osm[\s/>]") & ~version.isin("", "0.6"), "only version 0.6 is read")
        .when(known & ~tag.rlike(TAG), F.concat(F.lit("not a whole tag: "), F.substring(tag, 1, 80)))
    )


def unescaped(value: Column) -> Column:
    """An attribute's value with its entities and character numbers as characters; line breaks and tabs are spaces, other entities fail."""

    def one(part: Column) -> Column:
        name = F.substring_index(part, ";", 1)
        of = lambda digits: F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
        found = F.lit(None).cast("string")
        for n, c in NAMES.items():
            found = F.when(name == n, F.lit(c)).otherwise(found)
        found = F.when(name.rlike("^#[0-9]{1,7}$"), of(F.hex(F.substr(name, F.lit(2)).try_cast("long")))).when(name.rlike("^#x[0-9A-Fa-f]{1,6}$"), of(F.substr(name, F.lit(3)))).otherwise(found)
        return F.concat(F.when(found.isNotNull() & part.contains(";"), found).otherwise(F.raise_error(F.concat(F.lit("unknown entity: "), F.substring(part, 1, 80))).cast("string")), F.substr(part, F.length(name) + 2))

    parts = F.split(F.translate(value, "\n\r\t", "   "), "&")
    return F.when(value.contains("&"), F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), ""))).otherwise(F.translate(value, "\n\r\t", "   "))


def _tags(spark: SparkSession, path: str) -> DataFrame:
    """file, block, nth, state, value: tags in the order in which each split has them."""
    rows = spark.read.option("lineSep", "<").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), F.col("value")
    )
    name = F.regexp_extract("value", "^/?([A-Za-z]+)", 0)
    known = name.isin(*KINDS, *[f"/{k}" for k in KINDS], *INNER)
    reason = _refused(F.col("value"), known)
    begins = F.when(F.col("value").rlike(r"/>\s*$"), WHOLE).otherwise(OPEN)
    state = F.when(~known, OTHER).when(name.startswith("/"), END).when(name.isin(*KINDS), begins).otherwise(INSIDE)
    # the error is part of the state, and tags of other elements are passed over by _cuts(), so that each tag is looked at once
    return rows.select("file", "block", "nth", F.when(reason.isNotNull(), F.raise_error(reason).cast("int")).otherwise(state).cast("byte").alias("state"), "value")


def _cut(rows: pa.RecordBatch, more: bool) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
    """The pieces that rows of tags hold, and the rows that what comes next may go on; of an element that is over, its last tag as SPENT."""
    file, block, nth, state = *(rows.column(c) for c in ("file", "block")), *(rows.column(c).to_numpy() for c in ("nth", "state"))
    at, n = np.arange(len(state)), len(state)
    other = pc.or_(pc.not_equal(file.slice(1), file.slice(0, n - 1)), pc.not_equal(block.slice(1), block.slice(0, n - 1))).to_numpy(zero_copy_only=False)
    split = np.maximum.accumulate(np.where(np.append(True, other), at, 0))
    last = np.maximum.accumulate(np.where(state != INSIDE, at, -1))
    before = np.append(-1, last[:-1])
    before[before < split] = -1
    begins = (state == OPEN) | (state == WHOLE)
    # a tag after an element's end and before the next belongs to none; those before the first are the head of the split
    owner = np.where(begins, at, np.where(before < 0, split, np.where(state[before] == OPEN, before, -1)))
    owner[state == SPENT] = -1
    stop, held = n, None
    if more:
        end = last[-1] if last[-1] >= split[-1] else -1
        if end < 0 or state[end] == OPEN:
            stop = split[-1] if end < 0 else end
            held = rows.slice(stop)
        else:
            held = pa.RecordBatch.from_arrays([file.slice(end, 1), block.slice(end, 1), pa.array(nth[end : end + 1]), pa.array([SPENT], pa.int8()), rows.column("value").slice(end, 1)], names=["file", "block", "nth", "state", "value"])
    own = np.flatnonzero((owner >= 0) & (at < stop))
    starts = np.flatnonzero(np.append(True, owner[own][1:] != owner[own][:-1])) if len(own) else own
    lead, tag = owner[own][starts], state[own] != END
    sums = lambda x: np.add.reduceat(x.astype(np.int64), starts) if len(own) else np.zeros(0, np.int64)
    tags = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sums(tag))), pa.int32()), rows.column("value").take(pa.array(own[tag])))
    closed = sums((state[own] == WHOLE) | (state[own] == END)) > 0
    return pa.RecordBatch.from_arrays([file.take(pa.array(lead)), block.take(pa.array(lead)), pa.array(np.where(begins[lead], nth[lead], HEAD)), pa.array(closed), tags], names=["file", "block", "nth", "closed", "tags"]), held


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of a task's splits, whose tags come in their order; an element that goes on is held until its end."""
    held = None
    for every in batches:
        batch = every.filter(pc.not_equal(every.column("state"), OTHER))
        if batch.num_rows:
            rows = batch if held is None else pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, names=batch.schema.names) for b in (held, batch)]).combine_chunks().to_batches()[0]
            made, held = _cut(rows, True)
            yield made
    if held is not None:
        yield _cut(held, False)[0]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block, nth, closed, tags (name, values as entries): elements, and of those that a split cuts the pieces; nth is HEAD for a piece that an earlier split began."""
    found = _tags(spark, path).mapInArrow(_cuts, "file string, block long, nth long, closed boolean, tags array<string>")

    def taken(tag: Column) -> Column:
        value = lambda e: F.ltrim(F.substr(e, F.instr(e, "=") + 1), F.lit(BLANK))
        one = lambda e: F.struct(F.trim(F.substring_index(e, "=", 1), F.lit(BLANK)).alias("key"), unescaped(F.substr(value(e), F.lit(2), F.length(value(e)) - 2)).alias("value"))
        return F.struct(F.regexp_extract(tag, "^([A-Za-z]+)", 1).alias("name"), F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), one).alias("values"))

    return found.withColumn("tags", F.transform("tags", taken))


def _joined(pieces: DataFrame) -> DataFrame:
    """closed and tags of the elements that splits cut: one that a split leaves open and the heads of splits after it, up to its end."""
    w = Window.partitionBy("file").orderBy("block", "nth")
    cut = pieces.filter((F.col("nth") == HEAD) | ~F.col("closed"))
    named = cut.withColumn("element", F.last(F.when(F.col("nth") != HEAD, F.struct("block", "nth")), True).over(w)).filter("element IS NOT NULL")
    inside = Window.partitionBy("file", "element").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, -1)
    own = named.withColumn("over", F.coalesce(F.max("closed").over(inside), F.lit(False))).filter("NOT over")
    tags = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "nth", "tags"))), lambda p: p["tags"]))
    return own.groupBy("file", "element").agg(F.bool_or("closed").alias("closed"), tags.alias("tags")).select("closed", "tags")


def _columns(whole: Column) -> list[Column]:
    """What is kept of elements (closed, tags, first: the attributes of their first tag), where `whole` is true."""
    kind = F.when(F.col("closed"), F.get("tags", F.lit(0))["name"]).otherwise(F.raise_error(F.lit("an element has no end")).cast("string"))
    inner = lambda name, one: F.transform(F.filter("tags", lambda t: t["name"] == name), lambda t: one(F.map_from_entries(t["values"])))
    v = F.col("first")
    e7 = lambda c: (v[c].try_cast("decimal(20,7)") * 10_000_000).cast("long")
    place = v["lat"].rlike(DEGREES) & v["lon"].rlike(DEGREES)
    bounds = F.when(kind == "bounds", F.struct(*[e7(c).alias(n) for c, n in (("minlat", "south"), ("minlon", "west"), ("maxlat", "north"), ("maxlon", "east"))]))
    made = {
        "kind": kind, "id": v["id"].cast("long"), "lat_e7": e7("lat"), "lon_e7": e7("lon"), "valid": F.coalesce(place, F.lit(False)), "refs": inner("nd", lambda x: x["ref"].cast("long")),
        "members": inner("member", lambda x: F.struct(x["type"].alias("type"), x["ref"].cast("long").alias("ref"), x["role"].alias("role"))), "tags": F.map_from_entries(inner("tag", lambda x: F.struct(x["k"], x["v"]))), "bounds": bounds,
    }
    return [F.when(whole, c).alias(n) for n, c in made.items()]


def elements(spark: SparkSession, path: str) -> DataFrame:
    """kind, id, lat_e7, lon_e7, valid, refs, members (type, ref, role), tags (a map), bounds (south, west, north, east in ten-millionths of a degree).

    One scan, kept in the shared folder; tags are neither shuffled nor sorted. What is no tag, an entity that XML does not name, document types, raw text and comments that hold markup are a
    ValueError; an element that has no end, a number that is none and a repeated key fail as Spark does. `valid` is false for a place that is not written in
    degrees with at most seven decimals. Files are UTF-8. Tags of other elements are passed over; an empty file has no rows.
    """
    whole, attributes = (F.col("nth") != HEAD) & F.col("closed"), F.map_from_entries(F.get("tags", F.lit(0))["values"])
    cut = F.when(~whole, F.struct("file", "block", "nth", "closed", "tags")).alias("cut")
    try:
        read = stored(_pieces(spark, path).withColumn("first", F.when(whole, attributes)).select(*_columns(whole), cut))
    except PySparkException as error:
        if "USER_RAISED_EXCEPTION" in str(error):
            raise ValueError(str(error).split("\n")[0]) from error
        raise
    joined = stored(_joined(read.filter("cut IS NOT NULL").select("cut.*")).withColumn("first", attributes).select(*_columns(F.lit(True))))
    return read.filter("cut IS NULL").drop("cut").union(joined)
