"""Toxicity of texts whose words may be written in disguise: a noisy channel restores them, then the restored text is scored.

A character model of order three is counted over all texts (letters a-z, 37 classes of other letters, and the edge of a word), so it grows with
the corpus; it is one table of 64 cubed numbers, summed over the tasks' partial arrays. Stretches that may be disguised are looked for in every text: tokens that mix
letters with signs read as letters (LEET), tokens with a letter three times in a row, and three or more single characters set apart by one character each.
Each is a lattice: a sign is itself or a letter it stands for, a run is shortened or kept, a gap is kept or closed. Viterbi's path of least cost (the channel's costs
and the model's surprise) is the restored text. All else stays as it is.

Restored texts are scored by logistic regression on the presence of words and of their beginnings, chosen by their likelihood ratio among labelled texts and fitted, weighted to the labels' shares, on a
sample of at most PER_LABEL of either label.

Rows with a null text, key or label are not learnt from, nor labels other than 0 and 1 and keys that have both; of rows that repeat a key the
text of least hash is. Null texts are empty; an empty text holds no word and has the score of a text without any. If nothing can be learnt, or only one label, every score is 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import discard, map_texts, one_text, sampled, slices, small_batches, stored

#: The letters that a sign can stand for (fixed values of common usage).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¥": "y", "*": "aeiou"}
#: The channel's costs in nats: a sign for a letter, a star for a vowel, a sign that stays beside letters (with no letter behind it: LAST), one letter for
#: two, a run of three or more shortened, a gap closed, a gap kept (for each single character beyond three, at most KEPT).
SIGN, STAR, STAYS, LAST, DOUBLE, RUN, GAP, KEPT = 1.0, 1.5, 6.0, 0.5, 8.0, 0.5, 0.5, 3.0
#: Symbols of the character model (0 is the edge of a word), and the weight of the shorter context.
SYMBOLS, BACK_OFF = 64, 4.0
#: The bounds of the sample for each label, and of the terms.
PER_LABEL, TERMS = 2048, 512
#: TERMS, DOCUMENTS and RIDGE were chosen by fivefold cross-validation within rows that may be learnt from (36 settings on sf0.1).
#: Beginnings of words that are terms, by length; documents that must hold a term.
SHORTEST, LONGEST, DOCUMENTS = 3, 8, 3
RIDGE = 0.03
THRESHOLD = 0.7
#: Characters that are looked at together (longer stretches only where they cannot be cut), and stretches that a worker remembers.
CHARS, MEMORY = 1 << 18, 100_000

WORD = re.compile(r"[^\W\d_]+")
CUT = re.compile(r"\S\S\s")
_tables: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, its symbol, and its kind: 1 a letter, 2 a sign that can stand for one, 0 other."""
    if not _tables:
        letters = ngrams.letters()
        symbol = np.where(letters, 27 + (np.arange(len(letters), dtype=np.uint64) * 0x9E3779B1 >> 12) % (SYMBOLS - 27), 0).astype(np.uint8)
        symbol[97:123] = np.arange(1, 27)
        kind = letters.astype(np.uint8)
        kind[[ord(c) for c in LEET]] = 2
        _tables.extend([symbol, kind])
    return _tables[0], _tables[1]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def chunks(text: str) -> Iterator[str]:
    """The text in parts, cut behind a token of two or more characters, so that no stretch is cut."""
    at = 0
    while at < len(text):
        found = CUT.search(text, min(len(text), at + CHARS))
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end


def triples(text: str) -> np.ndarray:
    """The numbers of all contexts of two symbols with the next symbol; a text begins and ends at an edge."""
    symbol = np.concatenate([[0, 0], tables()[0][code_points(text.lower())], [0]]).astype(np.int64)
    symbol = symbol[np.concatenate([[True, True], (symbol[2:] > 0) | (symbol[1:-1] > 0)])]
    return (symbol[:-2] * SYMBOLS + symbol[1:-1]) * SYMBOLS + symbol[2:]


def counted(docs: DataFrame, text: str) -> np.ndarray:
    """How often each triple occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in slices(batches, 0):
            for t in batch.column(0).to_pylist():
                for part in chunks(t or ""):
                    total += np.bincount(triples(part), minlength=len(total)) if len(part) > 1 << 16 else 0
                    if len(part) <= 1 << 16:
                        np.add.at(total, triples(part), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["triple", "n"])

    partial = small_batches(docs).select(F.col(text).cast("string").alias("__text")).mapInArrow(run, "triple long, n long")
    out = np.zeros(SYMBOLS**3, np.int64)
    for r in partial.groupBy("triple").agg(F.sum("n").alias("n")).toLocalIterator():  # at most 64 cubed
        out[r["triple"]] = r["n"]
    return out


def surprise(counts: np.ndarray) -> np.ndarray:
    """The cost of each symbol behind two others: minus logarithms, the longer contexts smoothed by the shorter ones."""
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    share = np.full(SYMBOLS, 1 / SYMBOLS)
    for table in (three.sum(axis=(0, 1)), three.sum(axis=0), three):
        share = (table + BACK_OFF * share) / (table.sum(axis=-1, keepdims=True) + BACK_OFF)
    return -np.log(share).astype(np.float32)


def stretches(text: str) -> list[tuple[int, int]]:
    """Where the lower-cased text may be disguised, in order."""
    codes = code_points(text)
    kind = tables()[1][codes]
    edge = np.diff(np.concatenate([[0], (kind > 0).astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    signs = np.concatenate([[0], np.cumsum(kind == 2)])
    thrice = np.zeros(len(codes) + 1, np.int64)
    if len(codes) > 2:
        np.cumsum((codes[2:] == codes[1:-1]) & (codes[2:] == codes[:-2]) & (kind[2:] == 1), out=thrice[3:])
    n_signs = signs[ends] - signs[starts]
    noisy = ((n_signs > 0) & (n_signs < ends - starts)) | (thrice[ends] > thrice[np.minimum(starts + 2, ends)])
    out = list(zip(starts[noisy].tolist(), ends[noisy].tolist()))
    single = ends - starts == 1
    joined = single[1:] & single[:-1] & (starts[1:] - ends[:-1] == 1)
    turn = np.diff(np.concatenate([[0], joined.astype(np.int8), [0]]))
    first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    long = last - first >= 2
    return sorted(out + list(zip(starts[first[long]].tolist(), ends[last[long]].tolist())))


class Channel:
    """Restores disguised texts by the costs of a character model."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs
        self.known: dict[str, str] = {}

    def __getstate__(self):
        return self.costs

    def __setstate__(self, costs):
        self.__init__(costs)

    def choices(self, sign: str, n: int, singles: int, last: bool) -> list[tuple[str, float]]:
        """What n times the sign can be, with the channel's cost."""
        same = [(sign * n, 0.0)]
        if sign in LEET:
            cost = STAR if sign == "*" else SIGN
            return [(sign * n, LAST if last else STAYS),  *((c, cost + (RUN if n > 1 else 0)) for c in LEET[sign]), *((c * 2, 2 * cost) for c in LEET[sign] if n > 1)]
        if sign.isalpha():
            return same if n == 1 else [*same, (sign, DOUBLE)] if n == 2 else [*same, (sign, RUN), (sign * 2, RUN)]
        return [(sign * n, min(KEPT, 0.5 * (singles - 3))), ("", GAP)] if singles else same

    def restored(self, stretch: str) -> str:
        """The path of least cost; of equal ones the one that keeps more signs as they are."""
        if (found := self.known.get(stretch)) is not None:
            return found
        symbol, costs = tables()[0], self.costs
        singles = len(stretch) // 2 + 1 if len(stretch) > 4 and tables()[1][code_points(stretch[1::2])].max() == 0 else 0
        tail = max((i + 1 for i, c in enumerate(stretch) if c.isalpha()), default=0)
        # by the last two symbols: the cost, and what was written, as a chain
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        at = 0
        while at <= len(stretch):
            n = 1
            if at == len(stretch):
                options = [(" ", 0.0)]
            else:
                while at + n < len(stretch) and stretch[at + n] == stretch[at]:
                    n += 1
                options = self.choices(stretch[at], n, singles, at >= tail)
            options = [([int(symbol[ord(c)]) for c in out], out, cost) for out, cost in options]
            then: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (total, chain) in best.items():
                for symbols, out, cost in options:
                    x, y, sum_ = a, b, total + cost
                    for s in symbols:
                        if s or y:  # an edge behind an edge says nothing
                            sum_ += float(costs[x, y, s])
                            x, y = y, s
                    if (x, y) not in then or sum_ < then[x, y][0]:
                        then[x, y] = (sum_, (chain, out))
            best = then
            at += n
        chain, parts = min(best.values(), key=lambda v: v[0])[1][0], []
        while chain:
            chain, out = chain
            parts.append(out)
        made = "".join(reversed(parts))
        if singles and made != stretch and len(made) > 2 and " " not in made:
            made = self.restored(made)  # runs that gaps had set apart
        if len(self.known) >= MEMORY:
            self.known.clear()
        if len(stretch) < 100:
            self.known[stretch] = made
        return made

    def clear(self, text: str) -> tuple[str, int]:
        """The lower-cased, restored text, and how many stretches were changed."""
        out, changed = [], 0
        for part in chunks(text.lower()):
            at = 0
            for start, end in stretches(part):
                made = self.restored(part[start:end])
                if made != part[start:end]:
                    out += [part[at:start], made]
                    at, changed = end, changed + 1
            out.append(part[at:])
        return "".join(out), changed


def terms(text: str) -> set[str]:
    """The words of a restored text (with a dot behind them) and their beginnings."""
    words = set(WORD.findall(text))
    return {f"{w}." for w in words} | {w[:k] for w in words for k in range(SHORTEST, min(LONGEST, len(w)) + 1)}


class Model:
    """The channel, and the weights of the terms."""

    def __init__(self, channel: Channel, names: list[str], weights: np.ndarray, bias: float):
        self.channel, self.bias = channel, bias
        self.weights = dict(zip(names, weights.tolist()))
        self.heads = {n[:SHORTEST].rstrip(".") for n in names}

    def score(self, text: str) -> tuple[float, int]:
        made, changed = self.channel.clear(text)
        live = [w for w in set(WORD.findall(made)) if w[:SHORTEST] in self.heads]
        found = {f"{w}." for w in live} | {w[:k] for w in live for k in range(SHORTEST, min(LONGEST, len(w)) + 1)}
        logit = self.bias + sum(sorted(self.weights[t] for t in found if t in self.weights))
        return 1 / (1 + float(np.exp(-np.clip(logit, -500, 500)))), changed


def regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression, by Newton's steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    penalty = np.full(x.shape[1], RIDGE)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    loss = lambda w: (weight * np.logaddexp(0, -(2 * y - 1) * (x @ w))).sum() + (penalty * w * w).sum() / 2
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * w)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """The model: its channel from all texts, its weights from a bounded sample of the labelled rows that meet `learn` (on k and y)."""
    channel = Channel(surprise(counted(docs, text)))
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("k").isNotNull()).filter(learn)
    # keys that have both labels tell nothing
    known = known.groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("k", "y")
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = sampled(known, "y", "k", PER_LABEL)
    # at most PER_LABEL keys of either label
    sample = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")
    sample = one_text(sample, ["k", "y"], "t").withColumn("row", F.struct("k", "y"))
    held = docs.sparkSession.sparkContext.broadcast(channel)
    found = stored(map_texts(sample, "row", "t", lambda: lambda keys, texts: [[list(terms(held.value.clear(t)[0])) for t in texts]], "terms array<string>"))
    try:
        sizes = {r["y"]: r["count"] for r in found.groupBy(F.col("row.y").alias("y")).count().collect()}
        if len(sizes) < 2:
            return None
        size = sizes[0] + sizes[1]
        one = found.select(F.col("row.y").alias("y"), F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("a"), F.count("*").alias("n"))
        part = lambda n, of, share: F.when(n > 0, n * F.log(n / (of * share))).otherwise(0.0)
        a, n = F.col("a"), F.col("n")
        ratio = sum((part(x, of, F.lit(k / size)) for x, of, k in ((a, n, sizes[1]), (n - a, n, sizes[0]), (sizes[1] - a, size - n, sizes[1]), (sizes[0] - n + a, size - n, sizes[0]))), F.lit(0.0))
        names = [r["term"] for r in one.filter((n >= DOCUMENTS) & (a * size > n * sizes[1])).orderBy(ratio.desc(), "term").limit(TERMS).select("term").collect()]
        own = F.array_intersect("terms", F.array(*map(F.lit, names))) if names else F.array().cast("array<string>")
        rows = found.select("row", own.alias("own")).orderBy("row").collect()  # at most TERMS of each text
    finally:
        discard(found)
    place = {n: i for i, n in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [place[t] for t in r["own"]]] = 1
    y = np.array([r["row"]["y"] for r in rows], float)
    share = np.array([totals[0] / sizes[0], totals[1] / sizes[1]])[y.astype(int)]
    return Model(channel, names, *regression(x, y, share / share.mean()))


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, score, predicted, n_restored (stretches whose restored form differs)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 64 cubed costs and at most TERMS weights

    def make():
        own = held.value

        def work(keys, texts):
            out = [own.score(t) if own else (0.5, 0) for t in texts]
            return [[s for s, _ in out], [int(s >= threshold) for s, _ in out], [n for _, n in out]]

        return work

    return map_texts(docs, key, text, make, "score double, predicted int, n_restored long")


def restore(docs: DataFrame, channel: Channel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, restored, n_restored."""
    held = docs.sparkSession.sparkContext.broadcast(channel)
    return map_texts(docs, key, text, lambda: lambda keys, texts: list(map(list, zip(*[held.value.clear(t) for t in texts]))), "restored string, n_restored long")
