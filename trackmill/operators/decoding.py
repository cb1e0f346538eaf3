"""Sequences: best paths over candidates, by products of blocks, and robust local polynomial fits, in stretches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .state import kept, spread, stored
from .trajectory import HALF_WINDOW, WINDOW, robust_cubics

#: Entries of all tables of a group up to which they are one array; observations of a block, tables that are multiplied together, the unit of scores, and how large a path's score may be in it.
DENSE = 1 << 19
BLOCK, FAN, UNIT, MOST, NONE = 512, 64, 1e-9, 1 << 59, -(1 << 61)
#: Rows of blocks that Python multiplies in one call, blocks as a whole; kinds of candidates that are whole numbers.
TOGETHER, WHOLE = 1 << 16, ("tinyint", "smallint", "int", "bigint")
BEAM, PER_TERMINAL, DELTA, AMBIGUOUS = 64, 2, 50.0, 1.0


def best_paths(emissions: list[dict], moves: list[dict], beam: int = BEAM, per_terminal: int = PER_TERMINAL, delta: float = DELTA) -> list[tuple[float, list]]:
    """The final beam: (score, candidates in order), best first.

    emissions: for each observation, candidate to score; moves: for each, (previous, candidate) to score (absent: impossible).
    Hypotheses are kept by score, then by the order of their paths; at most per_terminal end in one candidate, and those more than
    delta below the best go. Where no move is possible, paths begin anew.
    """
    live = [(s, (c, None)) for c, s in sorted(emissions[0].items())] if emissions else []

    def ordered(hypotheses):
        return sorted(hypotheses, key=lambda h: (-h[0], h[2], h[1][0]))

    live = [(s, p, i) for i, (s, p) in enumerate(live)]
    for step in range(len(emissions)):
        if step:
            grown = []
            for s, path, r in live:
                for c, e in emissions[step].items():
                    m = moves[step].get((path[0], c))
                    if m is not None:
                        grown.append((s + m + e, (c, path), r))
            if not grown:
                top = live[0]
                grown = [(top[0] + e, (c, top[1]), top[2]) for c, e in emissions[step].items()]
            live = grown
        kept, used = [], {}
        for h in ordered(live):
            if used.get(h[1][0], 0) < per_terminal and len(kept) < beam and (not kept or h[0] >= kept[0][0] - delta):
                used[h[1][0]] = used.get(h[1][0], 0) + 1
                kept.append(h)
        # the rank of a path among those kept follows the order of paths, not of scores
        places = {id(h): i for i, h in enumerate(sorted(kept, key=lambda h: (h[2], h[1][0])))}
        live = [(s, p, places[id(h)]) for h in kept for s, p, _ in [h]]
    out = []
    for s, path, _ in live:
        nodes = []
        while path is not None:
            nodes.append(path[0])
            path = path[1]
        out.append((s, nodes[::-1]))
    return out


def _product(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two best ways through two tables in a row: scores and orders [entry, exit, rank], and the flat (middle, rank left, rank right) of each."""
    (p, p_order), (q, q_order) = left, right
    i, m, _ = p.shape
    j = q.shape[1]
    width = int(q_order.max(initial=0)) + 1
    # [entry, exit, (middle, rank left, rank right)]
    wide = lambda a, b: (a[:, None, :, :, None] + b.transpose(1, 0, 2)[None, :, :, None, :]).reshape(i, j, m * PER_TERMINAL**2)
    total = wide(p, q)
    total[total < -2 * MOST] = NONE  # at least one of the two is no path
    # paths of one entry and exit differ in the left one first, then in the right one
    order = wide(p_order * width, q_order)
    if m * PER_TERMINAL**2 < PER_TERMINAL or not total.size:
        total, order = (np.concatenate([x, np.full((i, j, PER_TERMINAL), fill)], axis=-1) for x, fill in ((total, NONE), (order, 0)))
    chosen = np.lexsort((order, -total), axis=-1)[..., :PER_TERMINAL]
    at = chosen + (np.arange(i * j) * total.shape[-1]).reshape(i, j, 1)
    score, order = total.reshape(-1)[at], order.reshape(-1)[at]
    # orders are small numbers again: the place among the paths of one entry
    none = score == NONE
    order[none] = np.iinfo(np.int64).max
    if (np.abs(score[~none]) > MOST).any():
        raise OverflowError("a path's score exceeds what 64 bits hold")
    return score, order.reshape(i, j * PER_TERMINAL).argsort(axis=1, kind="stable").argsort(axis=1).reshape(score.shape), chosen


def _through(rows: pd.DataFrame) -> tuple[list, list, list, list]:
    """The elements of a group in order: their positions, entries and exits, and tables: scores [entry, exit, rank] (NONE: no path) and the
    places of the paths among those of one entry. What cannot be reached from the element before is left out; a sequence begins with the entry None."""
    rows = rows.sort_values("pos", kind="stable")
    live, begins = rows["score"].notna().to_numpy(), rows["entry"].isna().to_numpy()
    known = sorted({*rows["entry"].dropna(), *rows["exit"].dropna()})
    code = {x: i for i, x in enumerate(known)}
    entry = np.array([-1 if none else code[x] for x, none in zip(rows["entry"], begins)], np.int64)
    leave = np.array([code.get(x, -1) for x in rows["exit"]], np.int64)
    score, rank = rows["score"].fillna(0).to_numpy(np.int64), rows["rank"].to_numpy(np.int64)
    order = leave if rows["order"][live].isna().any() else rows["order"].fillna(0).to_numpy(np.int64)
    pos = rows["pos"].to_numpy(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(pos)) + 1).tolist(), len(pos)]
    steps, n = len(cuts) - 1, len(known)
    if steps * (n + 1) * n <= DENSE:
        # few candidates: all of them at each step, and None behind them at the first; what cannot be reached has no path in the product
        table = np.full((2, steps, n + 1, n, PER_TERMINAL), NONE, np.int64)
        table[1] = 0
        own = np.flatnonzero(live)
        at = (np.repeat(np.arange(steps), np.diff(cuts))[own], np.where(entry[own] < 0, n, entry[own]), leave[own], rank[own])
        table[(0, *at)], table[(1, *at)] = score[own], order[own]
        tables = [(table[0, 0], table[1, 0]), *((table[0, t, :n], table[1, t, :n]) for t in range(1, steps))]
        return pos[cuts[:-1]].tolist(), [[*known, None], *[known] * (steps - 1)], [known] * steps, tables
    entries, exits, tables = [], [], []
    for start, stop in zip(cuts, cuts[1:]):
        own = np.flatnonzero(live[start:stop]) + start
        before = exits[-1] if exits else np.unique(entry[own])
        place = np.searchsorted(before, entry[own])
        own = own[(place < len(before)) & (before[np.minimum(place, len(before) - 1)] == entry[own])] if len(before) else own[:0]
        after = np.unique(leave[own])
        at = (np.searchsorted(before, entry[own]), np.searchsorted(after, leave[own]), rank[own])
        table = np.full((2, len(before), len(after), PER_TERMINAL), NONE, np.int64)
        table[1] = 0
        table[(0, *at)], table[(1, *at)] = score[own], order[own]
        entries.append(before)
        exits.append(after)
        tables.append((table[0], table[1]))
    name = lambda codes: [None if c < 0 else known[c] for c in codes.tolist()]
    return pos[cuts[:-1]].tolist(), [name(e) for e in entries], [name(e) for e in exits], tables


def _chain(tables: list) -> tuple[tuple[np.ndarray, np.ndarray], list[np.ndarray]]:
    """The product of all tables, and what each product chose."""
    now, chosen = tables[0], []
    for other in tables[1:]:
        score, order, pick = _product(now, other)
        now = (score, order)
        chosen.append(pick)
    return now, chosen


class _Blocks:
    """The blocks of some rows (keys, block, pos, entry, exit, score, rank, order): those of few candidates side by side in arrays, the others one by one.

    batches: numbers of blocks (longest first), their steps, whether they begin sequences, and tables [step, block, entry, exit, rank] of scores and orders; beginnings are entered by None alone,
    other blocks by each candidate. many: numbers of blocks and what _through() gives for them.
    """

    def __init__(self, rows: pd.DataFrame, keys: list[str], whole: bool):
        self.by = [*keys, "block"]
        of = rows.groupby(self.by, sort=False, dropna=False).ngroup().to_numpy()
        order = np.lexsort((rows["pos"].to_numpy(np.int64), of))
        rows, of = rows.iloc[order].reset_index(drop=True), of[order]
        begins = np.searchsorted(of, np.arange(of[-1] + 1))
        self.names = rows.iloc[begins][self.by].reset_index(drop=True)
        pos, live = rows["pos"].to_numpy(np.int64), rows["score"].notna().to_numpy()
        no_entry, no_exit = rows["entry"].isna().to_numpy(), rows["exit"].isna().to_numpy()
        value = np.concatenate([rows["entry"][~no_entry].to_numpy(), rows["exit"][~no_exit].to_numpy()])
        if whole:
            value = value.astype(np.int64)
        self.values, code = np.unique(value, return_inverse=True)
        size = max(1, len(self.values))
        own = np.concatenate([of[~no_entry], of[~no_exit]]) * size + code
        self.size, self.known = size, np.unique(own)
        self.first = np.searchsorted(self.known, np.arange(len(begins)) * size)
        n = np.diff([*self.first, len(self.known)])
        local = np.searchsorted(self.known, own) - self.first[own // size]
        entry, leave = np.full(len(rows), -1), np.full(len(rows), -1)
        entry[~no_entry], leave[~no_exit] = local[: (~no_entry).sum()], local[(~no_entry).sum() :]
        opens = np.ones(len(rows), bool)
        opens[1:] = (of[1:] != of[:-1]) | (pos[1:] != pos[:-1])
        at = np.cumsum(opens) - 1
        self.begin = at[begins]  # of each block's steps among all
        self.places, step = pos[opens], at - at[begins][of]
        self.steps = np.diff([*self.begin, at[-1] + 1])
        score, rank = rows["score"].fillna(0).to_numpy(np.int64), rows["rank"].to_numpy(np.int64)
        placed = leave if rows["order"][live].isna().any() else rows["order"].fillna(0).to_numpy(np.int64)
        inner = np.zeros(len(begins), bool)
        inner[of[(step == 0) & live & ~no_entry]] = True
        few = (self.steps * (n + 1) * n <= DENSE) & (n > 0)
        self.many = [(b, _through(rows.iloc[x:y])) for b, x, y in zip(*[v[~few] for v in (np.arange(len(begins)), begins, np.append(begins[1:], len(rows)))])]
        self.batches = []
        for width, within in sorted(set(zip(n[few].tolist(), inner[few].tolist()))):
            chosen = np.flatnonzero(few & (n == width) & (inner == within))
            chosen = chosen[np.argsort(-self.steps[chosen], kind="stable")]
            entries = width + 1 if within else 1
            while len(chosen):
                take = max(1, DENSE // int(self.steps[chosen[0]] * entries * width))
                self.batches.append((chosen[:take], within, width))
                chosen = chosen[take:]
        self._rows = (of, step, entry, leave, rank, score, placed, live, no_entry)

    def tables(self, batch: tuple) -> np.ndarray:
        numbers, within, width = batch
        of, step, entry, leave, rank, score, placed, live, no_entry = self._rows
        slot = np.full(len(self.steps), -1)
        slot[numbers] = np.arange(len(numbers))
        own = np.flatnonzero((slot[of] >= 0) & live & ((step > 0) | within | no_entry))
        # the last entry is None, which only the first step has
        table = np.full((2, int(self.steps[numbers[0]]), len(numbers), width + 1, width, PER_TERMINAL), NONE, np.int64)
        table[1] = 0
        at = (step[own], slot[of[own]], np.where(no_entry[own], width, entry[own]), leave[own], rank[own])
        table[(0, *at)], table[(1, *at)] = score[own], placed[own]
        return table

    def chain(self, batch: tuple) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Scores and orders [block, entry, exit, rank] of the whole blocks, and what each product chose for those that had as many steps."""
        numbers, within, width = batch
        table, steps = self.tables(batch), self.steps[numbers]
        begin = slice(None) if within else slice(width, None)
        score, order, picks = table[0, 0][:, begin], table[1, 0][:, begin], []
        score, order = score.copy(), order.copy()
        for t in range(1, int(steps[0])):
            live = int((steps > t).sum())
            made = _products_of(score[:live], order[:live], table[0, t, :live, :width], table[1, t, :live, :width])
            score[:live], order[:live] = made[:2]
            picks.append(made[2])
        return score, order, picks

    def named(self, numbers: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The candidates of these codes in these blocks; None for -1."""
        out = np.full(len(codes), None, object)
        real = codes >= 0
        out[real] = self.values[self.known[self.first[numbers[real]] + codes[real]] % self.size]
        return out

    def coded(self, numbers: np.ndarray, values: pd.Series) -> np.ndarray:
        """The codes of candidates in these blocks; -1 for null."""
        out = np.full(len(values), -1)
        real = values.notna().to_numpy()
        own = numbers[real] * self.size + np.searchsorted(self.values, values[real].to_numpy().astype(self.values.dtype))
        out[real] = np.searchsorted(self.known, own) - self.first[numbers[real]]
        return out


def _products_of(p: np.ndarray, p_order: np.ndarray, q: np.ndarray, q_order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_product() of many blocks' tables at once; the block is the first axis."""
    s, i, m, _ = p.shape
    j = q.shape[2]
    width = int(q_order.max(initial=0)) + 1
    wide = lambda a, b: (a[:, :, None, :, :, None] + b.transpose(0, 2, 1, 3)[:, None, :, :, None, :]).reshape(s, i, j, m * PER_TERMINAL**2)
    total, order = wide(p, q), wide(p_order * width, q_order)
    total[total < -2 * MOST] = NONE
    chosen = np.lexsort((order, -total), axis=-1)[..., :PER_TERMINAL]
    score, order = np.take_along_axis(total, chosen, -1), np.take_along_axis(order, chosen, -1)
    none = score == NONE
    order[none] = np.iinfo(np.int64).max
    if (np.abs(score[~none]) > MOST).any():
        raise OverflowError("a path's score exceeds what 64 bits hold")
    return score, order.reshape(s, i, j * PER_TERMINAL).argsort(axis=-1, kind="stable").argsort(axis=-1, kind="stable").reshape(score.shape), chosen


def decode(candidates: DataFrame, transitions: DataFrame, keys: list[str], block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """keys, obs, candidate, runner_up (the second best path's candidate), score, runner_score, separation (null if there is one path only),
    ambiguous (the paths lie within AMBIGUOUS), point_ambiguous (and differ here), state (decoded, or no_path: then the rest is null or false).

    candidates: keys, obs (whole numbers), candidate, emission; transitions: keys, obs (of the later one), previous, candidate, score (absent or null:
    impossible). Scores are added in units of UNIT, exactly, so results depend on no order of addition; of equal paths the first in order of its candidates counts.
    No path is pruned. A sequence through which no path leads has the state no_path at each observation.

    A sequence is cut into blocks of `block` numbers of observations from its first. Each block's table holds the two best paths from each candidate that it can be entered
    by to each that it ends in; `fan` neighbouring tables at a time are multiplied (maximum for sum, sum for product) until one is left for a
    sequence; then the best two paths are traced back from the whole to the blocks and into them. So a long sequence is many tasks at each level, and a task
    holds one block. All levels are kept in the shared folder.
    """
    kinds = dict(candidates.dtypes)
    kind, key_kinds = kinds["candidate"], ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    begun, levels, best = _products(candidates, transitions, keys, block, fan)
    totals = kept(_totals(best, keys))
    asks = best.select(*keys, F.col("pos").alias("block"), "nth", F.col("entry").alias("a"), F.col("exit").alias("z"), "rank")
    asked_kind = f"{key_kinds}, pos long, nth int, a {kind}, z {kind}, rank int"
    for dealt in reversed(levels):

        def trace(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            columns = [*keys, "pos", "nth", "a", "z", "rank"]
            if asked.empty or rows.empty:
                return pd.DataFrame(columns=columns)
            blocks = _Blocks(rows, keys, kind in WHOLE)
            asked = asked.merge(blocks.names.assign(__of=range(len(blocks.names))), on=blocks.by)
            of, nth, rank = asked["__of"].to_numpy(), asked["nth"].to_numpy(), asked["rank"].to_numpy()
            out = []

            def add(own: np.ndarray, pos: np.ndarray, a: np.ndarray, z: np.ndarray, r: np.ndarray) -> None:
                keyed = blocks.names.iloc[of[own]][keys].reset_index(drop=True)
                out.append(keyed.assign(pos=pos, nth=nth[own], a=a, z=z, rank=r))

            a, z = blocks.coded(of, asked["a"]), blocks.coded(of, asked["z"])
            for batch in blocks.batches:
                slot = np.full(len(blocks.steps), -1)
                slot[batch[0]] = np.arange(len(batch[0]))
                own = np.flatnonzero(slot[of] >= 0)
                if not len(own):
                    continue
                _, _, chosen = blocks.chain(batch)
                i = np.where(a[own] < 0, batch[2] if batch[1] else 0, a[own])
                j, r = z[own].copy(), rank[own].copy()
                for t in reversed(range(1, len(chosen) + 1)):
                    at = np.flatnonzero(blocks.steps[of[own]] > t)
                    m, left, right = np.unravel_index(chosen[t - 1][slot[of[own[at]]], i[at], j[at], r[at]], (batch[2], PER_TERMINAL, PER_TERMINAL))
                    add(own[at], blocks.places[blocks.begin[of[own[at]]] + t], blocks.named(of[own[at]], m), blocks.named(of[own[at]], j[at]), right)
                    j[at], r[at] = m, left
                add(own, blocks.places[blocks.begin[of[own]]], blocks.named(of[own], a[own]), blocks.named(of[own], j), r)
            for number, (places, names, ends, tables) in blocks.many:
                _, chosen = _chain(tables)
                for q in np.flatnonzero(of == number):
                    first, end, r, found = asked["a"].iloc[q], asked["z"].iloc[q], int(rank[q]), []
                    i, j = names[0].index(None if pd.isna(first) else first), ends[-1].index(end)
                    for t in reversed(range(1, len(tables))):
                        m, left, right = np.unravel_index(chosen[t - 1][i, j, r], (len(ends[t - 1]), PER_TERMINAL, PER_TERMINAL))
                        found.append((places[t], ends[t - 1][m], ends[t][j], int(right)))
                        j, r = int(m), int(left)
                    found.append((places[0], names[0][i], ends[0][j], r))
                    pos, entry, leave, ranks = zip(*found)
                    add(np.full(len(found), q), np.array(pos), np.array(entry, object), np.array(leave, object), np.array(ranks))
            return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

        calls, n = dealt
        asks_dealt = asks.withColumn("call", F.pmod(F.xxhash64(*keys, "block"), F.lit(n // TOGETHER + 1)))
        left, right = spread(calls.withColumnRenamed("call", "__l"), n, "__l"), spread(asks_dealt.withColumnRenamed("call", "__r"), n, "__r")
        traced = left.groupBy("__l").cogroup(right.groupBy("__r")).applyInPandas(lambda x, y: trace(x.drop(columns="__l"), y.drop(columns="__r")), asked_kind)
        asks = stored(traced).withColumnRenamed("pos", "block")
    paths = asks.groupBy(*keys, F.col("block").alias("pos")).agg(F.max(F.when(F.col("nth") == 1, F.col("z"))).alias("candidate"), F.max(F.when(F.col("nth") == 2, F.col("z"))).alias("runner_up"))
    seen = begun.select(*keys, (F.col("pos") - F.col("__first")).alias("pos"), "__first").distinct().join(totals, keys, "left").join(paths, [*keys, "pos"], "left")
    apart = F.col("__a") - F.col("__b")
    near = F.coalesce(apart <= round(AMBIGUOUS / UNIT), F.lit(False))
    return seen.select(
        *keys, (F.col("pos") + F.col("__first")).cast(kinds["obs"]).alias("obs"), "candidate", "runner_up", (F.col("__a") * UNIT).alias("score"), (F.col("__b") * UNIT).alias("runner_score"), (apart * UNIT).alias("separation"),
        near.alias("ambiguous"), F.coalesce(near & (F.col("candidate") != F.col("runner_up")), F.lit(False)).alias("point_ambiguous"), F.when(F.col("__a").isNull(), "no_path").otherwise("decoded").alias("state"),
    )


def path_scores(candidates: DataFrame, transitions: DataFrame, keys: list[str], block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """keys, score, runner_score of the sequences through which a path leads, as decode() gives them, without tracing the paths."""
    _, _, best = _products(candidates, transitions, keys, block, fan)
    return _totals(best, keys).select(*keys, (F.col("__a") * UNIT).alias("score"), (F.col("__b") * UNIT).alias("runner_score"))


def _totals(best: DataFrame, keys: list[str]) -> DataFrame:
    return best.groupBy(*keys).agg(F.max(F.when(F.col("nth") == 1, F.col("score"))).alias("__a"), F.max(F.when(F.col("nth") == 2, F.col("score"))).alias("__b"))


def _products(candidates: DataFrame, transitions: DataFrame, keys: list[str], block: int, fan: int) -> tuple[DataFrame, list[tuple[DataFrame, int]], DataFrame]:
    """The observations' candidates with their places, the elements of each level, and the two best ways through each sequence."""
    kinds = dict(candidates.dtypes)
    kind, key_kinds = kinds["candidate"], ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    units = lambda c: F.round(c / UNIT).cast("long")
    own = candidates.select(*keys, F.col("obs").cast("long").alias("pos"), F.col("candidate").alias("exit"), units(F.col("emission")).alias("__e"))
    moves = transitions.filter(F.col("score").isNotNull() & ~F.isnan("score")).select(*keys, F.col("obs").cast("long").alias("pos"), F.col("candidate").alias("exit"), F.col("previous").alias("entry"), units(F.col("score")).alias("__m"))
    first = own.groupBy(*keys).agg(F.min("pos").alias("__first"))
    begun = own.join(first, keys).withColumn("__begins", F.col("pos") == F.col("__first"))
    place = (F.col("pos") - F.col("__first")).alias("pos")
    start = begun.filter("__begins").select(*keys, place, F.lit(None).cast(kind).alias("entry"), "exit", F.col("__e").alias("score"))
    # an observation that cannot be entered stays as a row without a score
    rest = begun.filter("NOT __begins").join(moves, [*keys, "pos", "exit"], "left").select(*keys, place, "entry", "exit", (F.col("__e") + F.col("__m")).alias("score"))
    level = stored(start.union(rest).withColumns({"rank": F.lit(0), "order": F.lit(None).cast("long")}))
    last = level.agg(F.max("pos")).first()[0] or 0
    levels, size = [], block
    rows_kind = f"{key_kinds}, pos long, entry {kind}, exit {kind}, score long, rank int, order long"
    while True:
        n = level.count()
        dealt = level.withColumn("block", F.floor(F.col("pos") / size).cast("long"))
        dealt = dealt.withColumn("call", F.pmod(F.xxhash64(*keys, "block"), F.lit(n // TOGETHER + 1)))
        levels.append((dealt, n))

        def multiply(rows: pd.DataFrame) -> pd.DataFrame:
            blocks, columns = _Blocks(rows, keys, kind in WHOLE), ["entry", "exit", "score", "rank", "order"]
            made, has = [], np.zeros(len(blocks.names), bool)

            def add(of: np.ndarray, *found: np.ndarray) -> None:
                keyed = blocks.names.iloc[of].reset_index(drop=True)
                made.append(keyed.assign(**{c: pd.Series(v, dtype=object) for c, v in zip(columns, found)}))
                has[of] = True

            for batch in blocks.batches:
                numbers, within, width = batch
                score, order, _ = blocks.chain(batch)
                s, i, j, r = np.nonzero(score != NONE)
                of = numbers[s]
                entry = np.where(i < width, i, -1) if within else np.full(len(i), -1)
                add(of, blocks.named(of, entry), blocks.named(of, j), score[s, i, j, r], r, order[s, i, j, r])
            for number, (_, names, ends, tables) in blocks.many:
                (score, order), _ = _chain(tables)
                i, j, r = np.nonzero(score != NONE)
                name = lambda of, at: np.array([of[x] for x in at], object)
                add(np.full(len(i), number), name(names[0], i), name(ends[-1], j), score[i, j, r], r, order[i, j, r])
            none = np.flatnonzero(~has)
            add(none, *[np.full(len(none), x, object) for x in (None, None, None, 0, None)])
            return pd.concat([m for m in made if len(m)]).rename(columns={"block": "pos"})

        level = stored(spread(dealt, n, "call").groupBy("call").applyInPandas(lambda rows: multiply(rows.drop(columns="call")), rows_kind))
        last //= size
        if not last:
            break
        size = fan
    # the two best ways through each sequence
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "order")
    best = level.filter("score IS NOT NULL AND entry IS NULL").withColumn("nth", F.row_number().over(w)).filter("nth <= 2")
    return begun, levels, best


def local_fits(t: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each sample: value and three derivatives of a cubic through the 9 samples around it, outliers weighing less."""
    n = len(t)
    first = np.maximum(0, np.minimum(np.maximum(0, np.arange(n) - HALF_WINDOW) + WINDOW, n) - WINDOW)
    index = first[:, None] + np.arange(WINDOW)
    inside = index < n
    index = np.minimum(index, n - 1)
    return robust_cubics(t[index] - t[:, None], y[index][:, :, None], inside)[:, :, 0]


def robust_fit(df: DataFrame, keys: list[str], row: str, time: Column, value: str, together: int = 4096) -> DataFrame:
    """keys, row, fit, d1, d2, d3 at each sample; time in the unit that derivatives refer to.

    A fit sees the nine samples around it, so a sequence is dealt in stretches of `together` samples with eight more at their ends,
    and a long one is split over tasks.
    """
    kinds = dict(df.dtypes)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("__t", row)) - 1
    own, place = F.floor(F.col("__n") / together), F.col("__n") % together
    shared = F.array_compact(F.array(own, F.when((place < WINDOW) & (own > 0), own - 1), F.when(place >= together - WINDOW, own + 1)))
    dealt = df.select(*keys, row, value, time.alias("__t")).withColumn("__n", nth).withColumn("__own", own).withColumn("__part", F.explode(shared))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__n", kind="stable")
        found = local_fits(rows["__t"].to_numpy(float), rows[value].to_numpy(float))
        mine = (rows["__own"] == key[-1]).to_numpy()
        return pd.DataFrame({**dict(zip(keys, key)), row: rows[row].to_numpy()[mine], **{n: found[mine, i] for i, n in enumerate(("fit", "d1", "d2", "d3"))}})

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"`{row}` {kinds[row]}", "fit double, d1 double, d2 double, d3 double"])
    return dealt.groupBy(*keys, "__part").applyInPandas(one, schema)
