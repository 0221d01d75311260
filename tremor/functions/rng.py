"""Random numbers that depend on nothing but their key: the same in any plan, on any partition, in any engine."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest mean of a Poisson count that one uniform is inverted for; larger means are sums of equal parts.
PART = 50.0


def _digest(*key: Column | str | int) -> Column:
    parts = [k if isinstance(k, Column) else F.lit(k) for k in key]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))


def uniform(*key: Column | str | int) -> Column:
    """In [0, 1): 52 bits of the md5 of the key's parts joined by ``|``."""
    return F.conv(F.substring(_digest(*key), 1, 13), 16, 10).cast("double") / F.lit(16.0**13)


def uniform_of(*key: object) -> float:
    """The same number on the driver or in a worker."""
    return int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:13], 16) / 16.0**13


def key_id(*key: Column | str | int) -> Column:
    """A non-negative id: 60 bits of the md5 of the key's parts."""
    return F.conv(F.substring(_digest(*key), 1, 15), 16, 10).cast("long")


def normal(*key: Column | str | int) -> Column:
    """Standard normal, by Box and Muller's transform of two uniforms."""
    return F.sqrt(-2 * F.log(1 - uniform(*key, "n1"))) * F.cos(F.lit(2 * math.pi) * uniform(*key, "n2"))


def poisson_parts(mean: Column) -> Column:
    """Equal parts of a mean, each at most ``PART``."""
    return F.greatest(F.lit(1), F.ceil(mean / F.lit(PART))).cast("int")


def inverted_poisson(mean: Column, u: Column) -> Column:
    """Poisson count by inversion: the number of k for which ``u`` is not below the distribution at k.

    ``mean`` is at most ``PART``; the walk ends where less than a uniform's last bit is left.
    """
    last = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    first = F.exp(-mean)
    start = F.struct(u.alias("u"), mean.alias("m"), first.alias("p"), first.alias("cdf"), F.when(u >= first, 1).otherwise(0).alias("n"))

    def step(s: Column, k: Column) -> Column:
        p = s.p * s.m / k
        return F.struct(s.u.alias("u"), s.m.alias("m"), p.alias("p"), (s.cdf + p).alias("cdf"), (s.n + F.when(s.u >= s.cdf + p, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s.n)


def poisson(mean: Column, *key: Column | str | int) -> Column:
    """Poisson count, exact at every mean: equal parts of at most ``PART``, each by inversion of a uniform of its own."""
    parts = poisson_parts(mean)
    total = F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda n, i: n + inverted_poisson(mean / parts, uniform(*key, i)))
    return F.when(mean > 0, total).otherwise(0).cast("int")


def poisson_of(mean: float, *key: object) -> int:
    """The same count on the driver or in a worker."""
    if not mean > 0:
        return 0
    parts, total = max(1, math.ceil(mean / PART)), 0
    each = mean / parts
    for i in range(parts):
        u, k = uniform_of(*key, i), 0
        p = cdf = math.exp(-each)
        while u >= cdf and k < each + 12 * math.sqrt(each) + 20:
            k += 1
            p *= each / k
            cdf += p
        total += k
    return total
