"""Sorting byte strings the deep-shallow way: multikey quicksort to a shallow depth, then blind tries."""

from __future__ import annotations

import numpy as np

WORD = 8


def padded(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings as rows of bytes, zeros behind them, and their lengths; width must be a multiple of WORD."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    rows = np.zeros((len(strings), width), np.uint8)
    joined = np.frombuffer(b"".join(strings), np.uint8)
    rows[np.arange(width) < lengths[:, None]] = joined
    return rows, lengths


def multikey(words: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Three-way quicksort on words within groups (ascending numbers), all segments at once, until each is single or equal to `depth` words.

    Returns the order and, along it, the number of the segment that each row ended in.
    """
    n = len(words)
    order = np.arange(n)
    segment = np.cumsum(np.r_[False, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    level = np.zeros(n, np.int64)
    live = np.arange(n)
    while len(live):
        own = segment[live]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        sizes = np.diff(np.r_[first, len(own)])
        keep = np.repeat((sizes > 1) & (level[live[first]] < depth), sizes)
        live, own = live[keep], own[keep]
        if not len(live):
            break
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        sizes = np.diff(np.r_[first, len(own)])
        key = words[order[live], level[live]]
        pivot = np.repeat(key[first + sizes // 2], sizes)
        side = (key >= pivot).astype(np.int64) + (key > pivot)
        block = np.repeat(np.arange(len(first)), sizes) * 3 + side
        moved = np.argsort(block, kind="stable")
        order[live], level[live] = order[live][moved], (level[live] + (side == 1))[moved]
        block = block[moved]
        # numbers of new segments go on from the largest
        segment[live] = segment.max() + 1 + np.cumsum(np.r_[False, block[1:] != block[:-1]])
    return order, np.cumsum(np.r_[False, segment[1:] != segment[:-1]]) if n else segment


def common(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - (((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8)


class BlindTrie:
    """Keeps only where strings branch: inner nodes are [depth, {byte or -1 at an end: child}], leaves are lists of equal strings' numbers."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.top = strings, [0]
        for i in range(1, len(strings)):
            self.insert(i)

    def insert(self, i: int) -> None:
        s = self.strings[i]
        at = lambda d: s[d] if d < len(s) else -1
        node = self.top
        while isinstance(node, tuple):
            node = node[1].get(at(node[0])) or next(iter(node[1].values()))
        other = self.strings[node[0]]
        depth = common(s, other)
        if depth == len(s) == len(other):
            node.append(i)
            return
        above, node = None, self.top
        while isinstance(node, tuple) and node[0] < depth:
            above, node = node, node[1][at(node[0])]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][at(depth)] = [i]
            return
        made = (depth, {other[depth] if depth < len(other) else -1: node, at(depth): [i]})
        if above is None:
            self.top = made
        else:
            above[1][at(above[0])] = made

    def order(self) -> list[int]:
        out, stack = [], [self.top]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def deep_shallow(strings: list[bytes], group: np.ndarray, width: int, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings within their groups, and along it the common prefix with the one before (0 at a group's first)."""
    rows, lengths = padded(strings, width)
    words = rows.view(">u8").astype(np.uint64)
    order, segment = multikey(words, group, shallow)
    ends = np.flatnonzero(np.r_[segment[1:] != segment[:-1], True]) + 1 if len(order) else []
    start = 0
    for end in ends:
        if end - start > 1:
            own = order[start:end]
            order[start:end] = own[BlindTrie([strings[i] for i in own]).order()]
        start = end
    lcp = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 1 << 15):
        a, b = order[at - 1 : at - 1 + (1 << 15)], order[at : at + (1 << 15)]
        a = a[: len(b)]
        unlike = rows[a] != rows[b]
        lcp[at : at + len(b)] = np.minimum(np.where(unlike.any(axis=1), unlike.argmax(axis=1), width), np.minimum(lengths[a], lengths[b])) * (group[a] == group[b])
    return order, lcp
