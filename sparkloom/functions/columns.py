"""Scalar helpers, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xlogx(x: Column) -> Column:
    """x ln x, and 0 at 0."""
    return F.when(x > 0, x * F.ln(x)).otherwise(F.lit(0.0))


def logx(x: Column) -> Column:
    """ln x, and 0 where x is not positive."""
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(0.0))


def join_gain(a: Column, b: Column) -> Column:
    """What the sum of x ln x gains when two cells become one."""
    return xlogx(a + b) - xlogx(a) - xlogx(b)


def choose2(x: Column) -> Column:
    return x * (x - 1) / 2


def uniform(*keys) -> Column:
    """A number in (0, 1) that depends on the keys alone, so it is the same under any partitioning and retry.

    Plain numbers among the keys go in as one text: generated code refers to texts and has numbers written in, so code for
    another seed or turn is not compiled anew.
    """
    plain = " ".join(str(k) for k in keys if not isinstance(k, (Column, str)))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(plain), *[k for k in keys if isinstance(k, (Column, str))]), 11)
    return (h + F.lit(0.5)) / F.lit(float(1 << 53))


def race(weight: Column, *keys) -> Column:
    """A waiting time; of several rows the least is row i with probability proportional to its weight."""
    return -F.ln(uniform(*keys)) / weight


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def block_affinity(a: Column, b: Column, within: float, between: float) -> Column:
    """1 inside a block; between blocks what a block of the given ratio gives to each of five others."""
    return F.when(a == b, F.lit(1.0)).otherwise(F.lit(1.0 / (within / between) / 5.0))


def power_law(u: Column, exponent: float, low: int, high: int) -> Column:
    """A discrete power-law draw from ``low`` to ``high`` by inverse distribution, ``u`` being uniform."""
    import itertools

    weights = [k**exponent for k in range(low, high + 1)]
    total = sum(weights)
    bounds = list(itertools.accumulate(w / total for w in weights))
    table = F.array(*[F.lit(b) for b in bounds])
    return F.least(F.size(F.filter(table, lambda b: b <= u)) + low, F.lit(high)).cast("long")
