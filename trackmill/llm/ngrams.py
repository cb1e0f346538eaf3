"""Hashed counts of character n-grams, for blocks of texts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts and characters that are counted together; longer texts are counted in segments, whose counts add up.
TEXTS, CHARS = 128, 1 << 18
ORDERS = (1, 2, 3)


def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(_is_letter())
    return _letters[0]


def segments(text: str) -> Iterator[str]:
    """The text behind one space, in segments; each has two more characters, at which no n-gram starts."""
    text = f" {text}  "
    for at in range(0, max(1, len(text) - 2), CHARS):
        yield text[at : at + CHARS + 2]


def blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Numbers of texts and their segments, in blocks."""
    numbers, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for part in segments(text):
            if parts and (size + len(part) > CHARS or i - numbers[0] >= TEXTS):
                yield np.array(numbers), parts
                numbers, parts, size = [], [], 0
            numbers.append(i)
            parts.append(part)
            size += len(part)
    if parts:
        yield np.array(numbers), parts


def buckets(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each code point."""
    h = np.full(len(codes) - order + 1, order, np.uint32)
    for k in range(order):
        h = h * np.uint32(0x9E3779B1) + codes[k : len(codes) - order + 1 + k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return np.pad(h >> np.uint32(32 - bits), (0, order - 1))


def counts(texts: list[str], bits: int, only_letters: bool) -> np.ndarray:
    """A row of 2**bits counts for each text. only_letters: lower-cased, with all else as spaces; otherwise every character as it is."""
    size = 1 << bits
    out = np.zeros((len(texts), size), np.float32)
    for numbers, parts in blocks([t.lower() for t in texts] if only_letters else texts):
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        if only_letters:
            codes = np.where(letters()[codes], codes, np.uint32(32))
        lengths = np.array([len(p) for p in parts])
        first = numbers[0]
        place = np.repeat(((numbers - first) * size).astype(np.int32), lengths)
        ends = np.cumsum(lengths)
        starts = np.ones(len(codes), bool)
        starts[ends - 1] = starts[ends - 2] = False
        rows = numbers[-1] - first + 1
        total = np.zeros(rows * size, np.int64)
        for order in ORDERS:
            total += np.bincount((buckets(codes, order, bits).astype(np.int32) + place)[starts], minlength=rows * size)
        out[first : first + rows] += total.reshape(rows, size)
    return out
