"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier over hashed character n-grams predicts each bit. A text's margins are
compared with every codeword by exponential loss, weighted by how well each classifier does on that language in the sample; the
codeword of least loss wins, the score is its softmax share, and texts whose two best losses lie close are flagged.

The classifiers are fitted on a bounded sample: PER_LANGUAGE keys of each language, by least hash, or fewer of each where more than
SAMPLE rows would come of it, so the fit takes the same memory for any number of languages. Rows with a null language, text or key
are not learnt from; of rows that repeat a key the text of least hash is. A text that is null or has no letter is `und` with score 0; so is every text if
nothing can be learnt. With one language, every text with a letter has it. Tokens of mixed texts count whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ngrams
from .common import map_texts, one_text, sampled

BITS = 12
#: Bounds of the sample, for each language and in all, and of the number of languages.
PER_LANGUAGE, SAMPLE, LANGUAGES = 256, 4096, 512
RIDGE = 1e-3
#: Texts whose losses differ by less are ambiguous.
AMBIGUOUS = 0.15


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo by."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(by))


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each language: all splits for few languages, else pseudo-random ones that keep rows apart."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 5:
        return np.array([[1 if not i or (b >> (i - 1)) & 1 == 0 else -1 for b in range(1, 1 << (n - 1))] for i in range(n)], dtype=float)
    draw = np.random.default_rng(n)
    while True:
        code = draw.choice([-1.0, 1.0], size=(n, int(np.ceil(10 * np.log2(n)))))
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * code.shape[1]
        if (np.abs(code.sum(axis=0)) < n).all() and apart.min() >= code.shape[1] / 4:
            return code


def features(texts: list[str]) -> np.ndarray:
    """Square roots of the shares of each n-gram bucket: rows of length one; zero for texts without letters."""
    found = ngrams.counts(texts, BITS, True)
    return np.sqrt(found / np.maximum(found.sum(axis=1, keepdims=True), 1)).astype(np.float32)


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.weights, self.bias, self.trust = languages, weights, bias, trust
        self.code = codewords(len(languages))

    @classmethod
    def fit(cls, x: np.ndarray, names: list[str]) -> Model:
        """Ridge regression of each code bit in the dual form, languages weighing the same."""
        languages = sorted(set(names))
        code = codewords(len(languages))
        own = np.array([languages.index(n) for n in names], dtype=int)
        if code.shape[1] == 0:
            return cls(languages, np.zeros((1 << BITS, 0), np.float32), np.zeros(0), np.ones(code.shape))
        weight = 1 / np.bincount(own, minlength=len(languages))[own]
        weight = np.sqrt(weight / weight.mean())[:, None]
        y = code[own]
        mean = (x * weight**2).sum(axis=0) / (weight**2).sum()
        center = (x - mean) * weight
        bias = (y * weight**2).sum(axis=0) / (weight**2).sum()
        gram = (center @ center.T).astype(np.float64)  # SAMPLE squared at most
        gram.flat[:: len(x) + 1] += RIDGE * np.trace(gram)
        solved = np.linalg.solve(gram, (y - bias) * weight)
        weights = (center.T @ solved).astype(np.float32)
        bias = bias - mean @ weights
        right = np.sign(x @ weights + bias) == y
        trust = np.array([right[own == c].mean(axis=0) for c in range(len(languages))]) + 1e-6
        return cls(languages, weights, bias, trust / trust.sum(axis=1, keepdims=True))

    def losses(self, x: np.ndarray) -> np.ndarray:
        """For each text and language, the weighted mean exponential loss of the margins against the codeword."""
        margins = 2 * np.clip(x @ self.weights + self.bias, -2, 2)
        return np.einsum("cb,tcb->tc", self.trust, np.exp(-margins[:, None, :] * self.code[None]))


def fit(docs: DataFrame, learn: Column, key: str, text: str, lang: str) -> Model | None:
    """The model from a bounded sample of the rows that meet `learn`."""
    known = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("t"))
    names = known.select("lang").distinct().limit(LANGUAGES + 1).count()
    if names > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    chosen = sampled(known.filter("k IS NOT NULL").select("k", "lang"), "lang", "k", min(PER_LANGUAGE, SAMPLE // max(1, names)))
    # at most SAMPLE keys
    sample = one_text(known.join(F.broadcast(chosen), ["k", "lang"]), ["k", "lang"], "t").withColumn("row", F.struct("lang", "k"))
    rows = map_texts(sample, "row", "t", lambda: lambda keys, texts: [[f.astype("<f2").tobytes() for f in features(texts)]], "x binary").orderBy("row").collect()
    if not rows:
        return None
    return Model.fit(np.array([np.frombuffer(r["x"], "<f2") for r in rows], dtype=np.float32), [r["row"]["lang"] for r in rows])


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, ambiguous, second (the next best language, null if there is none)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 4096 weights for each bit of the codewords

    def make():
        own = held.value

        def work(keys, texts):
            n = len(texts)
            named, score, doubt, second = ["und"] * n, [0.0] * n, [False] * n, [None] * n
            live = [i for i, t in enumerate(texts) if own and any(map(str.isalpha, t))]
            for at in range(0, len(live), 256):
                some = live[at : at + 256]
                loss = own.losses(features([texts[i] for i in some]))
                order = np.argsort(loss, axis=1, kind="stable")
                share = np.exp(4 * (loss.min(axis=1, keepdims=True) - loss))
                share /= share.sum(axis=1, keepdims=True)
                for j, i in enumerate(some):
                    best = order[j, 0]
                    named[i], score[i] = own.languages[best], float(share[j, best])
                    if len(own.languages) > 1:
                        second[i] = own.languages[order[j, 1]]
                        doubt[i] = bool(loss[j, order[j, 1]] - loss[j, best] < AMBIGUOUS)
            return [named, score, doubt, second]

        return work

    return map_texts(docs, key, text, make, "lang_pred string, score double, ambiguous boolean, second string")
