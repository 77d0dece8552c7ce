"""Column expressions over ``array<double>`` factor columns.

All of them expand to plain arithmetic on array elements, so they stay inside
whole-stage code generation; the higher-order functions would leave it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def elem(vec: Column, j: int) -> Column:
    return F.get(vec, F.lit(j))


def dot(a: Column, b: Column, k: int) -> Column:
    """Inner product of two length-``k`` arrays; NULL when either is NULL."""
    if k == 0:
        return F.lit(0.0)
    return reduce(lambda s, t: s + t, [elem(a, j) * elem(b, j) for j in range(k)])


def literal_vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def zeros(k: int) -> Column:
    return F.array_repeat(F.lit(0.0), k)


def vector_sum(weight: Column, vec: Column, k: int) -> Column:
    """Aggregate: sum of ``weight * vec``, element by element."""
    return F.array(*[F.sum(weight * elem(vec, j)) for j in range(k)])


def vector_mean(vec: Column, k: int) -> Column:
    return F.array(*[F.avg(elem(vec, j)) for j in range(k)])


def combine(a: Column, b: Column, k: int, fn) -> Column:
    return F.array(*[fn(elem(a, j), elem(b, j)) for j in range(k)])


def hash_uniform(ident: Column, j: int, seed: int) -> Column:
    """Uniform [0, 1) from a 52-bit hash of the id; same value on every run."""
    h = F.xxhash64(F.lit(seed), F.lit(j), ident)
    return F.shiftrightunsigned(h, 12).cast("double") / F.lit(float(2**52))


def grid_uniform(ident: Column, j: int, seed: int) -> Column:
    """Coarse uniform [0, 1) by integer arithmetic, so that SQL can state it."""
    n = (F.pmod(ident.cast("bigint"), F.lit(1000)) * 7919 + F.lit(j * 104729 + seed)) % 1000
    return n.cast("double") / F.lit(1000.0)


def start_vector(ident: Column, k: int, seed: int, init: str = "uniform") -> Column:
    """Starting factors as a function of the id alone.

    ``uniform`` and ``gaussian`` hash the id; ``grid`` is the arithmetic form
    used where another engine has to reproduce the numbers.
    """
    return F.array(*[start_value(ident, j, seed, init) for j in range(k)])


def start_value(ident: Column, j: int, seed: int, init: str = "uniform") -> Column:
    if init == "uniform":
        return hash_uniform(ident, j, seed)
    if init == "grid":
        return grid_uniform(ident, j, seed)
    if init == "zero":
        return F.lit(0.0)
    if init == "gaussian":
        radius = F.sqrt(-2.0 * F.log(1.0 - hash_uniform(ident, 2 * j, seed)))
        return radius * F.cos(2.0 * math.pi * hash_uniform(ident, 2 * j + 1, seed))
    raise ValueError(f"unknown init {init!r}")
