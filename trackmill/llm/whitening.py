"""Whitening of embeddings by the covariance of their distinct vectors, with Chan's merging of partial moments.

Each component c becomes the integer x = floor(64 c) + 1,000,000. The fit list is every distinct x-vector once. Each partition of it
gives its count, its exact sums and its centred scatter; `treeReduce` merges these in pairs by Chan's formula, so nothing but one d by d
table reaches the driver, which takes its eigenvectors. A second pass over the fit list gathers the moments of the whitened vectors the
same way: their covariance must be the identity.

Sums are integers without bounds, and a partition's rows are taken relative to its first row before they are centred, so the
covariance has double precision however far from zero the vectors lie.

Rows with a null vector, or a null or non-finite component, take no part and have no result. Repeated rows each have their rows of the result, but
count once in the fit. Components whose eigenvalue is not above NEGLIGIBLE of the trace have no whitened values and are left out: a
table with fewer than two distinct vectors, an empty one and vectors of length zero give no rows. Vectors of different lengths, components
that 64 bits cannot hold, and deviations beyond 64 bits are errors, since no result is defined for them. Rows with a null key have results
with a null key.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import discard, small_batches, stored

SCALE, OFFSET = 64, 1_000_000
#: Components that are returned.
COMPONENTS = 16
#: The share of the trace that an eigenvalue must exceed.
NEGLIGIBLE = 1e-12
LARGEST = float(1 << 62)


class Moments:
    """Count, exact sums and centred scatter of vectors."""

    def __init__(self, n: int, sums: np.ndarray, scatter: np.ndarray):
        self.n, self.sums, self.scatter = n, sums, scatter

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """Those of the rows of x, integers or doubles; x is taken relative to its first row."""
        near, whole = x - x[0], x.dtype.kind == "i"
        if whole and int(np.abs(near).max(initial=0)) * len(x) >= 1 << 62:
            sums = near.sum(axis=0, dtype=object)
        else:
            sums = near.sum(axis=0).astype(object if whole else float)
        centred = near - (sums / len(x)).astype(float)
        drift = centred.sum(axis=0)  # what rounding of the mean leaves
        return cls(len(x), sums + x[0].astype(sums.dtype) * len(x), centred.T @ centred - np.outer(drift, drift) / len(x))

    def merged(self, other: Moments) -> Moments:
        """Chan's formula: the scatters, and that of the two means."""
        n = self.n + other.n
        apart = ((other.sums * self.n - self.sums * other.n) / (self.n * other.n)).astype(float)
        return Moments(n, self.sums + other.sums, self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n))


def integers(df: DataFrame, key: str | None, vector: str) -> DataFrame:
    """key, x: the rows that take part, as integers."""
    entries = F.col(vector).cast("array<double>")
    whole = df.filter(F.col(vector).isNotNull() & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    scaled = F.transform(entries, lambda c: F.when(F.abs(c * SCALE) < LARGEST, F.floor(c * SCALE) + OFFSET).otherwise(F.raise_error(F.lit("a component exceeds 64 bits")).cast("long")))
    return whole.select(*([] if key is None else [F.col(key).alias("__key")]), scaled.alias("x"))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """The rows of a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    if width is None:
        width = int(sizes[0])
    if (sizes != width).any():
        raise ValueError("vectors of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def moments(rows: DataFrame, then: Callable[[np.ndarray], np.ndarray]) -> Moments | None:
    """The moments of then(x) over all rows of the fit list; None where there is no row."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            if batch.num_rows and len(batch.column(0).flatten()):
                some = Moments.of(then(matrix(batch.column(0))))
                if own is not None and len(own.sums) != len(some.sums):
                    raise ValueError("vectors of different lengths")
                own = some if own is None else own.merged(some)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([own.n]), pa.array([[str(s) if isinstance(s, int) else float(s).hex() for s in own.sums]]), pa.array([own.scatter.ravel().tolist()])], names=["n", "sums", "scatter"])

    def read(row) -> Moments:
        sums = [float.fromhex(s) if "x" in s else int(s) for s in row["sums"]]
        return Moments(row["n"], np.array(sums, dtype=object if isinstance(sums[0], int) else float), np.array(row["scatter"]).reshape(len(sums), -1))

    def merge(a: Moments | None, b: Moments | None) -> Moments | None:
        if a is None or b is None:
            return b if a is None else a
        if len(a.sums) != len(b.sums):
            raise ValueError("vectors of different lengths")
        return a.merged(b)

    # one value for each partition, so that no tree is empty
    parts = small_batches(rows).mapInArrow(partial, "n long, sums array<string>, scatter array<double>").rdd.mapPartitions(lambda found: [functools.reduce(merge, map(read, found), None)])
    size = parts.getNumPartitions()
    return parts.treeReduce(merge, depth=max(2, math.ceil(math.log(size, 100)))) if size else None


class Whitening:
    """n, exact sums, the components' eigenvectors (columns, signed so that the entry of most weight is positive), eigenvalues and shares."""

    def __init__(self, fit: Moments, components: int):
        cov = fit.scatter / fit.n
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        trace = float(np.trace(cov))
        order = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > NEGLIGIBLE * trace]
        vectors = vectors[:, order]
        top = np.abs(vectors).argmax(axis=0)
        self.n, self.sums, self.values, self.shares = fit.n, [int(s) for s in fit.sums], values[order], values[order] / trace if order else values[order]
        self.vectors = vectors * np.sign(vectors[top, np.arange(len(order))])
        # S/n in two parts: an integer, and what is left
        self.whole = np.array([s // fit.n for s in self.sums], dtype=np.int64)
        self.rest = np.array([(s % fit.n) / fit.n for s in self.sums])

    def apply(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.whole) - self.rest) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums of (n x - S)**2, exactly."""
        apart = x - self.whole
        over = np.array([s % self.n for s in self.sums], dtype=object)
        most = (int(np.abs(apart).max(initial=0)) + 1) * self.n
        exact = apart if most**2 * max(1, x.shape[1]) < 1 << 62 else apart.astype(object)
        out = ((exact * self.n - (over.astype(np.int64) if exact is apart else over)) ** 2).sum(axis=1).tolist()
        if max(out, default=0) >= 1 << 63:
            raise OverflowError("a deviation exceeds 64 bits")
        return out


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    kind = df.schema[key].dataType.simpleString()
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    distinct = stored(integers(df, None, vector).distinct())
    fit = moments(distinct, lambda x: x)
    model = None if fit is None else Whitening(fit, components)
    if model is None or len(model.values) == 0:
        discard(distinct)
        return df.sparkSession.createDataFrame([], f"`{key}` {kind}, {schema}")
    seen = moments(distinct, model.apply)
    discard(distinct)
    error = float(np.abs(seen.scatter / seen.n - np.eye(len(model.values))).max())
    held = df.sparkSession.sparkContext.broadcast(model)  # at most `components` vectors
    form = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        k = len(own.values)
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = matrix(batch.column(1), len(own.sums))
            columns = [np.tile(np.arange(1, k + 1), m), np.full(m * k, own.n), np.repeat(own.deviations(x), k), own.apply(x).ravel(), np.tile(own.shares, m), np.full(m * k, error)]
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(c).cast(t) for c, t in zip(columns, form.types)]], names=[key, *form.names])

    return small_batches(integers(df, key, vector)).mapInArrow(run, f"`{key}` {kind}, {schema}")
