"""Repeatable pseudo-random numbers: functions of a row's key, not of its place in a partition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) from the key columns and the seed."""
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def normal(seed: int, *keys: str) -> Column:
    """A standard normal number, by Box and Muller from two uniform ones."""
    radius = F.sqrt(-2.0 * F.log(1.0 - uniform(seed, *keys)))
    return radius * F.cos(2.0 * F.pi() * uniform(seed + 7919, *keys))
