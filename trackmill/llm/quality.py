"""Quality by votes of the nearest labelled texts in a latent semantic space.

Texts are counted as hashed character n-grams (as they are: case, signs and white space count), with a term for the step in which
their share of repeated neighbouring words, of capitals and of signs lies; the counts are damped, weighted by rarity in the
sample and brought to length one. The singular vectors of the sample span the latent space. The labelled sample's latent
vectors, at most PER_LABEL of either label, are broadcast; each text's cosine with all of them is computed exactly, in blocks,
and the NEAREST ones vote for their labels with their similarity (to the power SHARPNESS).

Rows with a null text, key or label are not learnt from, nor labels other than 0 and 1 and keys that have both; of rows that repeat a
key the text of least hash is. An empty or null text is near nothing
and gets the share of label 1 among the labelled rows, as does every text if nothing can be learnt (then 0.5).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import map_texts, one_text, pass_rows, sampled

BITS = 12
#: The bound of the sample, for each label; dimensions of the latent space; voters.
PER_LABEL, DIMENSIONS, NEAREST = 512, 48, 5
SHARPNESS = 8
THRESHOLD = 0.7


#: STEPS, SHAPE, FEW and NEAREST were chosen by fivefold cross-validation within rows that may be learnt from (41 settings on sf0.1).
#: Upper ends of the steps of each share; a step's term counts as SHAPE times the n-grams.
STEPS = (0.15, 1.0)
SHAPE = 0.05
#: Bytes that a text has besides its own when shares are counted.
FEW = 32


def terms(texts: list[str]) -> np.ndarray:
    """A row for each text: n-gram counts, then the terms of its shares."""
    grams = ngrams.counts(texts, BITS, False)
    shares = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        words = text.split()
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        capital = np.count_nonzero((data >= 65) & (data <= 90))
        small = np.count_nonzero(((data >= 97) & (data <= 122)) | (data >= 128))
        space = np.count_nonzero(data <= 32)
        # short texts have few capitals and signs, though often a large share
        shares[i] = sum(a == b for a, b in zip(words, words[1:])) / (len(words) + FEW / 8), capital / (capital + small + FEW), (len(data) - capital - small - space) / (len(data) + FEW)
    step = np.searchsorted(STEPS, shares) + np.arange(3) * (len(STEPS) + 1)
    shape = np.zeros((len(texts), 3 * (len(STEPS) + 1)), np.float32)
    np.put_along_axis(shape, step, (SHAPE * grams.sum(axis=1, keepdims=True)).repeat(3, axis=1), axis=1)
    some = np.array([len(t) > 0 for t in texts])[:, None]
    return np.concatenate([grams * some, shape * some], axis=1)


class Model:
    """Rarity weights, the projection to the latent space, and the labelled vectors (rows of length one)."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, prior: float):
        self.prior, self.labels = prior, labels.astype(np.float32)
        seen = (x > 0).sum(axis=0)
        self.rarity = np.log((1 + len(x)) / (1 + seen)).astype(np.float32) + 0.1
        made = self.scaled(x)
        values, vectors = np.linalg.eigh((made @ made.T).astype(np.float64))
        keep = [i for i in np.argsort(-values)[:DIMENSIONS] if values[i] > 1e-6]
        self.basis = (made.T @ (vectors[:, keep] / np.sqrt(values[keep]))).astype(np.float32)
        self.vectors = self.latent(x)

    def scaled(self, counts: np.ndarray) -> np.ndarray:
        share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        made = np.sqrt(share) * self.rarity
        return (made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def latent(self, counts: np.ndarray) -> np.ndarray:
        made = self.scaled(counts) @ self.basis
        return made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12)

    def score(self, counts: np.ndarray) -> np.ndarray:
        near = self.latent(counts) @ self.vectors.T
        k = min(NEAREST, near.shape[1])
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) ** SHARPNESS
        total = vote.sum(axis=1)
        found = (vote * self.labels[best]).sum(axis=1) / np.maximum(total, 1e-300)
        return np.where(total > 1e-12, np.clip(found, 0, 1), self.prior)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """The model from a bounded sample of the labelled rows that meet `learn`."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("k").isNotNull()).filter(learn)
    # keys that have both labels tell nothing
    known = known.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("k", "y")
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = sampled(known, "y", "k", PER_LABEL)
    # at most PER_LABEL keys of either label
    sample = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")
    sample = one_text(sample, ["k", "y"], "t").withColumn("row", F.struct("k", "y"))
    rows = map_texts(sample, "row", "t", lambda: lambda keys, texts: [[np.minimum(c, 65504).astype("<f2").tobytes() for c in terms(texts)]], "x binary").orderBy("row").collect()
    if not rows:
        return None
    x = np.array([np.frombuffer(r["x"], "<f2") for r in rows], dtype=np.float32)
    return Model(x, np.array([r["row"]["y"] for r in rows]), totals.get(1, 0) / max(1, sum(totals.values())))


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 4096 weights and at most 1024 vectors of 48

    def make():
        own = held.value

        def work(keys, texts):
            out = [0.5] * len(texts) if own is None else []
            for at in range(0, len(texts) if own else 0, 256):
                out += own.score(terms(texts[at : at + 256])).tolist()
            return [out, [int(s >= threshold) for s in out]]

        return work

    return map_texts(docs, key, text, make, "score double, predicted int")


def keep(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs (all columns): the rows whose score reaches the threshold; all of them if nothing could be learnt."""
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = held.value
        return lambda texts: [bool(s >= threshold) for at in range(0, len(texts), 256) for s in own.score(terms(texts[at : at + 256]))]

    return pass_rows(docs, text, make, True)
