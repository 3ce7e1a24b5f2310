"""Random draws that depend on their keys alone: the same on any partitioning, in any order, after any retry."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime: products of two numbers below it fit 63 bits.
PRIME = 2_147_483_647

#: Poisson draws of a larger mean are sums of draws of this mean and of the rest.
LARGEST_MEAN = 1 << 32


def draw(*keys: Column | str | int) -> Column:
    """A number below 2^48 made from the keys by MD5."""
    text = F.concat_ws("|", *[F.lit(k).cast("string") if isinstance(k, int) else (F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def resamples(spark, n: int, seed: int) -> DataFrame:
    """k, c0 .. c3: a cubic polynomial for each resample; its values at any four places are independent."""
    k = F.col("id")
    return spark.range(n).select(k.alias("k"), *[(draw(k, j, seed) % PRIME).alias(f"c{j}") for j in range(4)])


def polynomial(coefficients: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of resamples (rows c0 .. c3) at places: a row for each place, numbers below PRIME."""
    x, h = (place % PRIME)[:, None], np.zeros((len(place), len(coefficients)), np.int64)
    for j in (3, 2, 1, 0):
        h = (h * x + coefficients[:, j]) % PRIME
    return h


@lru_cache(64)
def poisson_table(mean: int) -> tuple[int, np.ndarray]:
    """(lowest, shares): P(Poisson(mean) <= lowest + i), over all that lies within ten deviations."""
    wide = 10 * mean**0.5 + 30
    low, high = max(0, int(mean - wide)), int(mean + wide)
    steps = np.concatenate([[0.0], np.log(mean) - np.log(np.arange(low + 1, high + 1, dtype=np.float64))])
    logs = np.cumsum(steps)
    shares = np.cumsum(np.exp(logs - logs.max()))
    return low, shares / shares[-1]


def poisson_weights(coefficients: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """How often each resample holds each of several values that n rows have each: Poisson(n) draws by inversion, one for a value and
    resample. place is the number of the first of a value's rows among all, in order of values."""
    out, part = np.zeros((len(place), len(coefficients)), np.int64), 0
    while n > 0:  # n independent draws of mean 1 add up to one of mean n
        low, shares = poisson_table(min(n, LARGEST_MEAN))
        out += low + np.searchsorted(shares, (polynomial(coefficients, place + part) + 0.5) / PRIME)
        n, part = n - LARGEST_MEAN, part + 1
    return out
