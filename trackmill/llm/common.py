"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Python code sees at most about so many bytes of text at once (one longer text is seen alone).
SLICE_BYTES = 2 << 20
#: Rows in an Arrow batch.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a new one in local mode, and an error on a cluster."""
    path, current = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getCheckpointDir()
    if path:
        if current is None:
            spark.sparkContext.setCheckpointDir(path)
        return path
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trackmill-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no recomputation of what led to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like cut(), for large tables: compressed Parquet in the shared folder, read with column pruning."""
    path = os.path.join(shared_dir(df.sparkSession), "tables", uuid.uuid4().hex)
    df.write.option("compression", "zstd").parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._stored_at = path
    if _scratch:
        _scratch[-1].append(made)
    return made


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """The tables that are stored within are deleted at its end, so results must have been written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        discard(*_scratch.pop())


def discard(*tables: DataFrame) -> None:
    """Deletes stored() tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def pass_on(joined: DataFrame, edges: DataFrame) -> DataFrame:
    """edges (a, b) and those of the stars that joined (node, root) holds."""
    return joined.select(F.col("node").alias("a"), F.col("root").alias("b")).union(edges)


def small_batches(df: DataFrame) -> DataFrame:
    """df, after lowering the session's rows for each Arrow batch: 10,000 long texts at once would fill a worker."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the column numbered `text` holds at most `limit` bytes in each (or one row)."""
    for batch in batches:
        start, size = 0, 0
        lengths = pc.binary_length(batch.column(text)).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if batch.num_rows > start:
            yield batch.slice(start)


def map_texts(df: DataFrame, key: str, text: str, make: Callable[[], Callable[[list, list], list]], schema: str) -> DataFrame:
    """Rows (key, ...) that `make()(keys, texts)` returns as columns, after the key, for each slice of df; a null text arrives as "".

    Only the two columns are read from df, so its other columns can have any names.
    """
    kind = df.schema[key].dataType.simpleString()
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    names = [key, *kinds.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in slices(batches):
            columns = work(batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds.types)]], names=names)

    return small_batches(df).select(F.col(key), F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, {schema}")


def pass_rows(df: DataFrame, text: str, make: Callable[[], Callable[[list], list]], filters: bool) -> DataFrame:
    """df with all its columns: only the rows for whose texts `make()(texts)` says true, or all rows with the texts that it returns.

    Filters get "" for null texts; otherwise nulls arrive as None.
    """
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in slices(batches, at):
            texts = batch.column(at).to_pylist()
            if filters:
                yield batch.filter(pa.array(work([t or "" for t in texts]), pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([pa.array(work(texts), batch.schema.field(i).type) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return small_batches(df).mapInArrow(run, df.schema)


def sampled(rows: DataFrame, group: str, key: str, per_group: int) -> DataFrame:
    """group, key: the `per_group` keys of least hash in each group, repeated ones once. The number of groups must be bounded.

    From the groups' numbers of keys (estimated within some per cent) follows a hash below which about three times as many keys lie,
    so only those are put in order; the chance that they hold fewer than asked for is negligible (under 1e-80 for 256).
    """
    counts = rows.groupBy(F.col(group).alias("__g")).agg(F.approx_count_distinct(key, 0.02).alias("__n"))
    h = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    low = rows.select(group, key, h.alias("__h")).join(F.broadcast(counts), F.col(group) == F.col("__g")).filter(F.col("__h").cast("double") * F.col("__n") <= float(3 * per_group * (1 << 40)))
    order = Window.partitionBy(group).orderBy("__h", key)
    return low.select(group, key, "__h").distinct().withColumn("__nth", F.row_number().over(order)).filter(F.col("__nth") <= per_group).select(group, key)


def one_text(rows: DataFrame, by: list[str], text: str) -> DataFrame:
    """by, text: of rows that repeat a key, the text of least hash."""
    return rows.groupBy(*by).agg(F.min_by(text, F.struct(F.xxhash64(text), F.col(text))).alias(text))
