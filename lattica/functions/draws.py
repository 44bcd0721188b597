"""Seeded random draws as Column expressions: each depends on the seed and the named columns alone, so a rerun of a
task, another partitioning or another engine size gives the same values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *columns: Column | str, low: float = 0.0, high: float = 1.0) -> Column:
    """Uniform in [low, high), with 52 bits."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 12)
    return F.lit(low) + (high - low) * (bits / float(1 << 52))


def normal(seed: int, *columns: Column | str, mean: float = 0.0, deviation: float = 1.0) -> Column:
    """By the polar form of two uniform draws."""
    radius = F.sqrt(-2 * F.log(1 - uniform(seed, F.lit("radius"), *columns)))
    return F.lit(mean) + deviation * radius * F.cos(2 * math.pi * uniform(seed, F.lit("angle"), *columns))


def exponential(seed: int, *columns: Column | str, rate: float = 1.0) -> Column:
    return -F.log(1 - uniform(seed, *columns)) / rate


def power_law(seed: int, *columns: Column | str, exponent: float = 2.0, least: float = 1.0) -> Column:
    """Density falls with ``exponent`` (over 1) from ``least`` on."""
    return least * F.pow(1 - uniform(seed, *columns), F.lit(-1 / (exponent - 1)))


def poisson(seed: int, *columns: Column | str, mean: float = 1.0) -> Column:
    """Counts by inversion: how many cumulated probabilities lie at or under one uniform draw. Means up to 500."""
    if not 0 <= mean <= 500:
        raise ValueError("poisson takes means from 0 to 500")
    terms, total, bounds = math.exp(-mean), 0.0, []
    for k in range(math.ceil(mean + 12 * math.sqrt(mean) + 12)):
        total += terms
        bounds.append(min(total, 1.0))
        terms *= mean / (k + 1)
    draw = uniform(seed, *columns)
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= draw))


def choice(seed: int, items: list, *columns: Column | str, weights: list[float] | None = None) -> Column:
    """One of ``items``, by weight where weights are given."""
    weights = weights or [1.0] * len(items)
    draw, total = uniform(seed, *columns) * sum(weights), 0.0
    picked = F.lit(items[-1])
    bounds = []
    for w in weights[:-1]:
        total += w
        bounds.append(total)
    for item, bound in reversed(list(zip(items, bounds))):
        picked = F.when(draw < bound, F.lit(item)).otherwise(picked)
    return picked
