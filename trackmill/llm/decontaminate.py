"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared by their letters and digits, lower-cased, runs of anything else being one space. A benchmark item is cut into
windows of WINDOW characters, one every STRIDE characters (shorter items are one window). An occurrence of a window of m characters
with at most e edits shares at least m - q + 1 - q * e of the window's q-grams, all on diagonals that differ by at most e; so hits
of q-grams are counted in diagonal bands of twice that width, each half over the one before, and bands that reach the bound are
verified by an alignment in the band, with free ends in the document. No occurrence of a window within the budget is lost, so every
fragment of WINDOW + STRIDE - 1 characters of an item is found, wherever it begins; shorter ones only if they hold a whole window.

Items of fewer than LEAST characters allow no edits: they match as they are, between spaces or the text's ends (Aho-Corasick). Items
without a letter or digit, null items, and null and empty documents match nothing. Long documents are searched in segments of the
compared characters that overlap by more than an occurrence. Hits are looked at HITS at a time, so a q-gram that very many windows
share takes time but no memory. The result has one row for each document row and item that match.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import pass_rows, slices, small_batches

Q, WINDOW, STRIDE, LEAST = 8, 120, 20, 24
#: Edits allowed for each character of a window.
RATE = 0.08
#: Characters of benchmark text that are broadcast at once; a larger benchmark is searched in as many passes as that takes.
ITEM_CHARS = 2_000_000
SEGMENT, BATCH_CHARS = 1 << 20, 1 << 20
#: Hits of q-grams (a place in a document and one in a window) that are held at once.
HITS = 1 << 22
FILTER_BITS = 22
MIX = np.uint64(0x9E3779B97F4A7C15)
COST = 1 << 20
_tables: list[np.ndarray] = []


def _plain() -> np.ndarray:
    """For each code point: its lower case if it is a letter or digit, else a space."""
    if not _tables:
        out = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            t = chr(c)
            if t.isalnum():
                low = t.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _tables.append(out)
    return _tables[0]


def plain(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The text's characters as compared, and the position of each in the text."""
    codes = _plain()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    space = codes == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    at = np.flatnonzero(keep)
    return codes[at], at


def as_text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of the q characters from each position; empty if there are fewer."""
    if len(codes) < Q:
        return np.zeros(0, np.uint64)
    h, width, base = codes.astype(np.uint64), 1, 0x100000001B3
    while width < Q:
        h = h[:-width] * np.uint64(base) + h[width:]
        width, base = 2 * width, base * base % (1 << 64)
    return h * MIX


class Index:
    """The windows of some items and their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, self.windows, self.of, short = [i for i, _ in items], [], [], {}
        for n, (_, text) in enumerate(items):
            codes = plain(text)[0]
            if len(codes) < LEAST:
                if word := as_text(codes).strip():
                    short.setdefault(f" {word} ", []).append(n)
                continue
            last = max(0, len(codes) - WINDOW)
            for at in sorted({*range(0, last, STRIDE), last}):
                self.windows.append(codes[at : at + WINDOW])
                self.of.append(n)
        self.sizes = np.array([len(w) for w in self.windows], np.int64)
        self.edits = np.minimum((RATE * self.sizes).astype(np.int64), (self.sizes - Q) // Q)
        self.least = self.sizes - Q + 1 - Q * self.edits
        self.band = int(self.edits.max(initial=0)) + 1
        made = [gram_hashes(w) for w in self.windows]
        grams = np.concatenate([*made, np.zeros(0, np.uint64)])
        order = np.argsort(grams, kind="stable")
        self.grams, first = np.unique(grams[order], return_index=True)
        self.ends = np.append(first, len(grams)).astype(np.int64)
        self.window = np.repeat(np.arange(len(made)), [len(m) for m in made])[order]
        self.place = np.concatenate([*[np.arange(len(m)) for m in made], np.zeros(0, np.int64)]).astype(np.int64)[order]
        self.known = np.zeros(1 << FILTER_BITS, bool)
        self.known[self.grams >> np.uint64(64 - FILTER_BITS)] = True
        self.short = None
        if short:
            self.short = ahocorasick.Automaton()
            for word, numbers in short.items():
                self.short.add_word(word, (len(word) - 2, numbers))
            self.short.make_automaton()

    def short_matches(self, codes: np.ndarray):
        """(item, start, end) of items of fewer than LEAST characters; start and end count compared characters."""
        if self.short is None or not len(codes):
            return
        before = int(codes[0] != 32)
        for last, (size, numbers) in self.short.iter(" " * before + as_text(codes) + " " * int(codes[-1] != 32)):
            end = last - before
            yield from ((n, end - size, end) for n in numbers)

    def bands(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, window, band) whose hits reach the bound; codes: texts one after the other, each ending at its entry of ends."""
        none = np.zeros(0, np.int64)
        h = gram_hashes(codes)
        at = np.flatnonzero(self.known[h >> np.uint64(64 - FILTER_BITS)])
        if not len(at) or not len(self.grams):
            return none, none, none
        n = np.searchsorted(self.grams, h[at])
        real = self.grams[np.minimum(n, len(self.grams) - 1)] == h[at]
        at, n = at[real], n[real]
        text = np.searchsorted(ends, at, side="right")
        inside = at + Q <= ends[text]
        at, n, text = at[inside], n[inside], text[inside]
        total = np.cumsum(self.ends[n + 1] - self.ends[n])
        found, start = [(none, none, none)], 0
        while start < len(at):
            stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + HITS, side="right")))
            # a part begins before its own hits, so that it has all those of an occurrence that ends in it
            own = slice(int(np.searchsorted(at, at[start] - 3 * WINDOW)), stop)
            found += self.full_bands(at[own], n[own], text[own], ends)
            start = stop
        made = [np.concatenate(x) for x in zip(*found)]
        return tuple(np.unique(np.stack(made), axis=1)) if len(found) > 2 else tuple(made)

    def full_bands(self, at, n, text, ends):
        """bands() of some hits, for parts of the windows where all of them together would make too many."""
        times = self.ends[n + 1] - self.ends[n]
        parts = min(len(self.windows), -(-int(times.sum()) // (4 * HITS)))
        if parts <= 1:
            yield self.bands_of(at, n, text, ends, self.ends[n], times)
            return
        for low, high in zip(cuts := np.linspace(0, len(self.windows), parts + 1).astype(int), cuts[1:]):
            # a q-gram's places are in the order of their windows
            below = [np.r_[0, np.cumsum(self.window < w)] for w in (low, high)]
            first, last = (self.ends[n] + x[self.ends[n + 1]] - x[self.ends[n]] for x in below)
            some = last > first
            yield self.bands_of(at[some], n[some], text[some], ends, first[some], (last - first)[some])

    def bands_of(self, at, n, text, ends, first, times):
        none = np.zeros(0, np.int64)
        if not len(at):
            return none, none, none
        post = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
        at, text, window = np.repeat(at, times), np.repeat(text, times), self.window[post]
        pair = text * len(self.windows) + window
        if len(ends) * len(self.windows) <= 1 << 22:
            total = np.bincount(pair)[pair]
        else:
            _, inverse, times = np.unique(pair, return_inverse=True, return_counts=True)
            total = times[inverse]
        enough = total >= self.least[window]
        at, text, window, post, pair = at[enough], text[enough], window[enough], post[enough], pair[enough]
        starts = np.concatenate([[0], ends[:-1]])
        diagonal = at - starts[text] - self.place[post] + WINDOW
        span = int((np.diff(ends, prepend=0).max(initial=0) + 2 * WINDOW) // self.band + 3)
        key = pair * span + diagonal // self.band
        found, count = np.unique(np.concatenate([key, key + 1]), return_counts=True)
        pair, band = found // span, found % span
        text, window = pair // len(self.windows), pair % len(self.windows)
        good = count >= self.least[window]
        return text[good], window[good], (band[good] - 1) * self.band - WINDOW

    def align(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each candidate: the least edits of the window in the band of 2 * band diagonals from low on (and as many edits to either side), start and end."""
        pad = self.band
        low = low - pad
        width = 4 * pad
        m = int(self.sizes[window].max())
        patterns = np.zeros((len(window), m), np.uint32)
        for i, w in enumerate(window):
            patterns[i, : self.sizes[w]] = self.windows[w]
        where = starts[:, None] + low[:, None] + np.arange(m + width)
        outside = (where < starts[:, None]) | (where >= ends[:, None])
        texts = np.where(outside, np.uint32(0x110000), codes[np.clip(where, 0, len(codes) - 1)])
        step = np.arange(width) * COST
        cost = np.tile(np.arange(width), (len(window), 1)).astype(np.int64)
        best = np.zeros(len(window), np.int64)
        over = np.full((len(window), 1), COST * COST, np.int64)
        for i in range(m):
            made = np.minimum(cost + COST * (texts[:, i : i + width] != patterns[:, i, None]), np.concatenate([cost[:, 1:], over], axis=1) + COST)
            cost = np.minimum.accumulate(made - step, axis=1) + step
            done = self.sizes[window] == i + 1
            if done.any():
                best[done] = np.min(cost[done] * 1024 + np.arange(width), axis=1)
        edits, first, last = best // 1024 // COST, best // 1024 % COST, best % 1024
        return edits, low + first, low + self.sizes[window] + last

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, windows that match, least edits, start, end) for texts of bounded length together."""
        own, codes, at, out = [], [], [], {}
        for n, text in enumerate(texts):
            made, place = plain(text)
            for item, a, b in self.short_matches(made):
                seen = out.setdefault((n, item), [{-1}, 0, int(place[a]), int(place[b - 1]) + 1])
                seen[2:] = [min(seen[2], int(place[a])), max(seen[3], int(place[b - 1]) + 1)]
            for start in range(0, max(1, len(made)), SEGMENT):
                part = slice(max(0, start - 3 * WINDOW), start + SEGMENT)
                own.append(n)
                codes.append(made[part])
                at.append(place[part])
        ends = np.cumsum([len(c) for c in codes])
        joined = np.concatenate([*codes, np.zeros(0, np.uint32)])
        text, window, low = self.bands(joined, ends)
        for i in range(0, len(text), 4096):
            t, w = text[i : i + 4096], window[i : i + 4096]
            edits, first, last = self.align(joined, (ends - np.diff(ends, prepend=0))[t], ends[t], w, low[i : i + 4096])
            for j in np.flatnonzero(edits <= self.edits[w]):
                place = at[t[j]]
                a, b = int(place[min(max(first[j], 0), len(place) - 1)]), int(place[min(max(last[j] - 1, 0), len(place) - 1)]) + 1
                seen = out.setdefault((own[t[j]], self.of[w[j]]), [set(), 1 << 30, a, b])
                seen[0].add(int(w[j]))
                seen[1:] = [min(seen[1], int(edits[j])), min(seen[2], a), max(seen[3], b)]
        return [(t, n, len(v[0]), *v[1:]) for (t, n), v in sorted(out.items())]


def item_parts(docs: DataFrame, benchmark: DataFrame, item: str, item_text: str) -> list:
    """The benchmark's (item, text) rows as broadcasts of about ITEM_CHARS characters each."""
    items = benchmark.filter(F.col(item_text).isNotNull()).select(F.col(item).alias("i"), F.col(item_text).alias("t")).distinct()
    passes = max(1, math.ceil((items.agg(F.sum(F.length("t"))).first()[0] or 0) / ITEM_CHARS))
    parts = (items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == n) for n in range(passes))
    return [docs.sparkSession.sparkContext.broadcast([tuple(r) for r in p.collect()]) for p in parts]


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs (all columns) without the rows in which a benchmark item matches. Null texts stay."""
    for held in item_parts(docs, benchmark, item, item_text):
        docs = pass_rows(docs, text, _clear(held), True)
    return docs


def _clear(held):
    def make():
        index = Index(held.value)

        def work(texts):
            out, at = [True] * len(texts), 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH_CHARS):
                    size += len(texts[end])
                    end += 1
                for found in index.matches(texts[at:end]):
                    out[at + found[0]] = False
                at = end
            return out

        return work

    return make


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item, n_windows (that match), edits (the least), start, end (code points of the document from the first to the last match)."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    key_type, item_type = to_arrow_type(docs.schema[key].dataType), to_arrow_type(benchmark.schema[item].dataType)
    parts = []
    for held in item_parts(docs, benchmark, item, item_text):

        def run(batches, held=held):
            index = Index(held.value)
            schema = pa.schema([("k", key_type), ("i", item_type), ("n", pa.int32()), ("e", pa.int32()), ("s", pa.int32()), ("z", pa.int32())])
            for batch in slices(batches, limit=BATCH_CHARS):
                found = index.matches([t or "" for t in batch.column(1).to_pylist()])
                keys = batch.column(0).to_pylist()
                rows = [(keys[t], index.items[n], *rest) for t, n, *rest in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 6, schema)], names=[key, item, "n_windows", "edits", "start", "end"])

        parts.append(small_batches(docs).select(F.col(key), F.col(text).cast("string").alias("__text")).mapInArrow(run, f"`{key}` {kind}, `{item}` {item_kind}, n_windows int, edits int, start int, end int"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
