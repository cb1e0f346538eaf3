"""SplitMix64: the generator behind reproducible fixtures. Spark's arithmetic is signed and checked, so it runs on Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the generator.
GAMMA, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def draws(seed: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The nth (from 0) output of each seed."""
    with np.errstate(over="ignore"):
        z = seed.astype(np.uint64) + np.uint64(GAMMA) * (nth.astype(np.uint64) + np.uint64(1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
        return z ^ (z >> np.uint64(31))


def uniform(seed: Column, nth: Column) -> Column:
    """A double in [0, 1) from the upper 53 bits of the nth output."""

    @F.pandas_udf("double")
    def drawn(s: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series((draws(s.to_numpy(np.int64), n.to_numpy(np.int64)) >> np.uint64(11)) * 2.0**-53)

    return drawn(seed.cast("long"), nth.cast("long"))
