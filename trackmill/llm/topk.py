"""Exact top-k search by distributed histogram selection.

Vectors are packed into blocks of bounded size; each pair of a block of queries and a block of candidates is one cell, dealt by
its two numbers, so no task holds more than two blocks and the scores of a few queries. A pass scores every cell and counts
scores in bins; the global counts of a query tell the bin that holds its kth value, which the next pass divides, until bins are
one score wide. A cell reports a query's bins from the top only as far as it alone reaches k, since the kth value can't lie
below. The last pass keeps scores that reach the kth value; of equal ones a cell keeps those of its k smallest ids, and the
final order (score down, id up) cuts at k.

Vectors that are null or hold null or non-finite components take no part. Shorter vectors count as if they were padded with
zeros. A row is no candidate for queries of its own id; every query row has a list of its own, and repeated candidates are
listed as often as they occur, except those of a null id, which are neither queries nor candidates. With fewer than k candidates all
are listed. Scores are exact: where the vectors' lengths allow one beyond 62 bits, or a scaled component has more, that is an error.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

QUERY_BLOCK, CANDIDATE_BLOCK, BINS, QUERY_ROWS = 1024, 8192, 1024, 128
MOST_SCORE = 2**62 - 1


def quantise(vectors: list, scale: float) -> tuple[list[int], np.ndarray]:
    """Positions of the vectors that take part, and their floored, scaled components as rows of one array."""
    kept, rows = [], []
    for i, v in enumerate(vectors):
        if v is None or any(x is None for x in v):
            continue
        row = np.asarray(v, dtype=np.float64)
        if np.isfinite(row).all():
            kept.append(i)
            rows.append(np.floor(scale * row))
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    if np.abs(out).max(initial=0) > MOST_SCORE:
        raise OverflowError("a scaled component exceeds 62 bits")
    return kept, out.astype(np.int64)


def pack(df: DataFrame, key: str, vector: str, scale: float, rows: int, parts: int) -> DataFrame:
    """Blocks (block, ids, data, width) of at most `rows` vectors."""

    def run(batches):
        ids, data, n = [], [], 0
        part = TaskContext.get().partitionId()

        def block():
            nonlocal n
            width = max(d.shape[1] for d in data)
            whole = np.concatenate([np.pad(d, ((0, 0), (0, width - d.shape[1]))) for d in data])
            own = np.concatenate(ids)
            for start in range(0, len(own), rows):
                piece = whole[start : start + rows]
                small = np.abs(piece).max(initial=0) < 2**31
                yield pa.RecordBatch.from_pydict({"block": pa.array([part * (1 << 24) + n], pa.int64()), "ids": [own[start : start + rows].tobytes()], "data": [piece.astype(np.int32 if small else np.int64).tobytes()], "width": pa.array([width if small else -width], pa.int32())})
                n += 1
            ids.clear(), data.clear()

        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(0)))
            kept, values = quantise(batch.column(1).to_pylist(), scale)
            if kept:
                ids.append(np.asarray(batch.column(0).to_pylist(), dtype=np.int64)[kept])
                data.append(values)
            if sum(map(len, ids)) >= rows:
                yield from block()
        if ids:
            yield from block()

    return df.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).repartition(parts).mapInArrow(run, "block long, ids binary, data binary, width int")


def unpack(ids: bytes, data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, dtype=np.int64)
    return own, np.frombuffer(data, dtype=np.int32 if width >= 0 else np.int64).reshape(len(own), abs(width))


def scores(queries: np.ndarray, candidates: np.ndarray):
    """Blocks (first query, int64 scores) of a few queries each, by the narrowest arithmetic that is exact."""
    width = max(queries.shape[1], candidates.shape[1])
    queries, candidates = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries, candidates))
    most = width * int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0))
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else object
    turned = np.ascontiguousarray(candidates.T.astype(kind))
    for at in range(0, len(queries), QUERY_ROWS):
        made = queries[at : at + QUERY_ROWS].astype(kind) @ turned
        yield at, made.astype(np.int64 if most >= 2**31 else np.int32)


def numbered(blocks: DataFrame) -> DataFrame:
    """The blocks with numbers from 0 on; one row stands for thousands of vectors, and only block numbers are put in order."""
    order = blocks.select("block").withColumn("nth", F.row_number().over(Window.orderBy("block")) - 1)
    return cut(blocks.join(order, "block").drop("block").withColumnRenamed("nth", "block"))


def paired(queries: DataFrame, candidates: DataFrame, n_queries: int, n_candidates: int) -> DataFrame:
    """Each block of queries beside each block of candidates: both are sent to the cells that need them, by the cell's numbers."""
    parts = max(1, min(n_queries * n_candidates, 20_000))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns], spread(n_candidates).alias("c_block"))
    c = candidates.select(*[F.col(x).alias(f"c_{x}") for x in candidates.columns], spread(n_queries).alias("q_block"))
    return q.repartition(parts, "q_block", "c_block").join(c.repartition(parts, "q_block", "c_block"), ["q_block", "c_block"])


def count_bins(span: int, width: int):
    """A task: bins of `width` over the span from each query's lo; for each cell (q_block, query, bin, n) from the top bin down to where the cell alone has the scores still needed."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q = unpack(row["q_ids"], row["q_data"], row["q_width"])
                c_ids, c = unpack(row["c_ids"], row["c_data"], row["c_width"])
                lows, needs = (np.asarray(row[x], dtype=np.int64) for x in ("q_lo", "q_need"))
                parts = []
                for at, made in scores(q, c):
                    n = len(made)
                    over = made - lows[at : at + n, None]
                    bins = over // width
                    bins[(over < 0) | (over >= span) | (q_ids[at : at + n, None] == c_ids)] = BINS
                    counts = np.bincount((bins + np.arange(n)[:, None] * (BINS + 1)).ravel(), minlength=n * (BINS + 1)).reshape(n, BINS + 1)[:, BINS - 1 :: -1]
                    above = np.cumsum(counts, axis=1) - counts
                    qi, b = np.nonzero((counts > 0) & (above < needs[at : at + n, None]))
                    parts.append((qi + at, BINS - 1 - b, counts[qi, b]))
                qi, b, count = map(np.concatenate, zip(*parts))
                yield pa.RecordBatch.from_pydict({"q_block": pa.array(np.full(len(qi), row["q_block"]), pa.int32()), "query": pa.array(qi, pa.int32()), "bin": pa.array(b, pa.int32()), "n": pa.array(count, pa.int64())})

    return run


def keep_best(k: int):
    """A task: for each cell the scores that reach the kth value, at most k for a query, best first."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q = unpack(row["q_ids"], row["q_data"], row["q_width"])
                c_ids, c = unpack(row["c_ids"], row["c_data"], row["c_width"])
                lows = np.asarray(row["q_lo"], dtype=np.int64)
                for at, made in scores(q, c):
                    n = len(made)
                    qi, ci = np.nonzero((made >= lows[at : at + n, None]) & (q_ids[at : at + n, None] != c_ids))
                    value, ids = made[qi, ci].astype(np.int64), c_ids[ci]
                    order = np.lexsort((ids, -value, qi))
                    qi, value, ids = qi[order], value[order], ids[order]
                    nth = np.arange(len(qi)) - np.searchsorted(qi, qi)
                    qi, value, ids = (x[nth < k] for x in (qi, value, ids))
                    yield pa.RecordBatch.from_pydict({"q_block": pa.array(np.full(len(qi), row["q_block"]), pa.int32()), "query": pa.array(qi + at, pa.int32()), "query_id": pa.array(q_ids[at:][qi], pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(value, pa.int64())})

    return run


def top_k(df: DataFrame, is_query: str, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row that meets the SQL condition `is_query`."""
    columns = df.select(F.col(key), F.col(vector), F.expr(is_query).alias("__asks"))
    rows, asking = columns.agg(F.count("*"), F.count_if("__asks")).first()
    candidates = numbered(pack(columns, key, vector, scale, CANDIDATE_BLOCK, max(1, math.ceil(rows / CANDIDATE_BLOCK))))
    queries = numbered(pack(columns.filter("__asks"), key, vector, scale, QUERY_BLOCK, max(1, math.ceil(asking / QUERY_BLOCK))))
    n_candidates, n_queries = (x.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0] + 1 for x in (candidates, queries))
    if not n_candidates or not n_queries:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    @F.pandas_udf("double")
    def most(ids: pd.Series, data: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([float((unpack(*x)[1].astype(float) ** 2).sum(axis=1).max(initial=0)) for x in zip(ids, data, width)])

    norms = [x.agg(F.max(most("ids", "data", "width"))).first()[0] for x in (queries, candidates)]
    bound = math.isqrt(math.ceil(norms[0] * norms[1] * (1 + 1e-9))) + 1  # no score is larger, by Cauchy and Schwarz
    if bound > MOST_SCORE:
        raise OverflowError("scores may exceed 62 bits")
    size = F.length("ids") / 8
    state = queries.select("*", F.array_repeat(F.lit(-bound), size.cast("int")).alias("lo"), F.array_repeat(F.lit(k).cast("long"), size.cast("int")).alias("need"))
    width = 2 * bound + 1
    while width > 1:
        span, width = width, -(-width // BINS)
        counted = paired(state, candidates, n_queries, n_candidates).mapInArrow(count_bins(span, width), "q_block int, query int, bin int, n long")
        # a query's bins: at most k from each cell
        total = counted.groupBy("q_block", "query", "bin").agg(F.sum("n").alias("n")).withColumnRenamed("q_block", "block")
        found = total.groupBy("block", "query").agg(F.sort_array(F.collect_list(F.struct(-F.col("bin"), "n"))).alias("bins"))
        found = found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("query", "bins"))).alias("found"))
        state = cut(narrowed(state.join(found, "block", "left"), width))
    best = paired(state, candidates, n_queries, n_candidates).mapInArrow(keep_best(k), "q_block int, query int, query_id long, vec_id long, score long")
    order = Window.partitionBy("q_block", "query").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def narrowed(state: DataFrame, width: int) -> DataFrame:
    """The blocks with each query's lo at the bin that holds its kth value (the lowest one, if there are fewer), and what is needed within it."""

    def run(batches):
        for batch in batches:
            found = batch.column("found").to_pylist()
            los, needs = batch.column("lo").to_pylist(), batch.column("need").to_pylist()
            for lo, need, of in zip(los, needs, found):
                for query, bins in ((x["query"], x["bins"]) for x in of or []):
                    base = lo[query]
                    for b in bins:
                        lo[query] = base + -b["col1"] * width
                        if b["n"] >= need[query]:
                            break
                        need[query] -= b["n"]
            keep = [n for n in batch.schema.names if n not in ("found", "lo", "need")]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(los, pa.list_(pa.int64())), pa.array(needs, pa.list_(pa.int64()))], names=[*keep, "lo", "need"])

    kept = [f"{n} {t}" for n, t in state.dtypes if n not in ("found", "lo", "need")]
    return state.mapInArrow(run, ", ".join([*kept, "lo array<bigint>", "need array<bigint>"]))
