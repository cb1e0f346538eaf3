"""Scalar functions as column expressions: predicates, rounding, time, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_failing(rules: list[tuple[str, Column]], none: str | None = None) -> Column:
    """The name of the first rule that holds; `none` if none does."""
    out = F.lit(none)
    for name, rule in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def worst(level: Column, order: list[str]) -> Column:
    """An aggregate: the level that comes last in `order`."""
    rank = F.lit(0)
    for i, name in enumerate(order):
        rank = F.when(level == name, i).otherwise(rank)
    return F.element_at(F.array(*map(F.lit, order)), F.max(rank) + 1)


def close(a: Column, b: Column, relative: float = 1e-12, absolute: float = 1e-12) -> Column:
    return F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def exceeds(value: Column, threshold: Column) -> Column:
    """Greater, and not merely by rounding."""
    return (value > threshold) & ~close(value, threshold)


def compare(value: Column, op: str, threshold: Column) -> Column:
    """value op threshold, for the operators of requirement profiles."""
    return {
        "lt": lambda: value < threshold,
        "le": lambda: value <= threshold,
        "gt": lambda: value > threshold,
        "ge": lambda: value >= threshold,
        "eq": lambda: value == threshold,
        "abs_le": lambda: F.abs(value) <= threshold,
    }[op]()


def half_away(x: Column, digits: int = 0) -> Column:
    """Rounding of halves away from zero."""
    return F.round(x, digits)


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounding of halves to even; zero has no sign."""
    return F.bround(x, digits) + F.lit(0.0)


def wrapped(a: Column, b: Column) -> Column:
    """The absolute difference of two headings in radians, at most pi."""
    import math

    return F.abs(F.pmod(a - b + math.pi, F.lit(2 * math.pi)) - math.pi)


def seconds_to_ns(text: Column) -> Column:
    """Nanoseconds of decimal seconds in text, exactly: the tenth digit of the fraction rounds away from zero. Null if it is no number."""
    ok = text.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$")
    whole, part = F.regexp_extract(text, r"^[+-]?([0-9]+)", 1), F.regexp_extract(text, r"\.([0-9]*)$", 1)
    digits = F.rpad(part, 10, "0")
    up = F.when(F.substring(digits, 10, 1) >= "5", 1).otherwise(0)
    size = whole.cast("long") * 1_000_000_000 + F.substring(digits, 1, 9).cast("long") + up
    return F.when(ok, F.when(F.substring(text, 1, 1) == "-", -size).otherwise(size))


def slug(text: Column, most: int = 32) -> Column:
    """Lower case, runs of other signs as one dash, none at the ends."""
    return F.substring(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-")), 1, most)


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and the SHA-256 of the parts, joined by bars; nulls count as a sign of their own."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256))


def leaks_path(text: Column) -> Column:
    """Whether a text names a place on one machine: an absolute path, a drive, a file address or a step up."""
    return text.rlike(r"^(/|~|[A-Za-z]:[\\/]|file://)|(^|/)\.\.(/|$)")
