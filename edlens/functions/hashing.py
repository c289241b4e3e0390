"""Seeded, engine-independent pseudo-random values derived from row keys.

``rand()`` depends on the partitioning, so a lost executor could redraw it. A hash of the key
and the seed gives the same value on every attempt and on every engine that has MD5.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_DIGITS = 13
UNIT_RANGE = float(16**UNIT_DIGITS)


def key_digest(ids: list[str | Column], seed: int | str) -> Column:
    """Hex MD5 of the key columns and the seed."""
    parts = [F.col(c) if isinstance(c, str) else c for c in ids]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed))))


def digest_unit(digest: Column, start: int = 1) -> Column:
    """Uniform value in [0, 1) from 13 hex digits of a digest."""
    return F.conv(F.substring(digest, start, UNIT_DIGITS), 16, 10).cast("bigint") / F.lit(UNIT_RANGE)


def key_unit(ids: list[str | Column], seed: int | str) -> Column:
    return digest_unit(key_digest(ids, seed))


def hashed_unit(text: str) -> float:
    """The same value outside Spark SQL: ``key_unit`` of the parts of ``text``, joined by |, seed last."""
    return int(hashlib.md5(text.encode()).hexdigest()[:UNIT_DIGITS], 16) / UNIT_RANGE


def poisson_one(unit: Column) -> Column:
    """Poisson(1) draw by inverting its distribution at ``unit`` (12 steps leave less than 1e-9)."""
    out, mass, upto = None, math.exp(-1.0), math.exp(-1.0)
    for k in range(12):
        hit = unit <= upto
        out = F.when(hit, float(k)) if out is None else out.when(hit, float(k))
        mass /= k + 1
        upto += mass
    return out.otherwise(12.0)


#: Rates from here on are drawn by transformed rejection, smaller ones by inversion.
REJECTION_FROM = 10
#: Inversion looks at this many counts (the rest has a mass below 1e-16), rejection tries as often (all fail in fewer than one of 1e19 draws).
POISSON_STEPS, POISSON_TRIES = 50, 24


def poisson_table(rate: Column) -> Column:
    """Distribution function of a Poisson law at 0, 1, ..: an array for small rates, empty for those drawn by rejection."""
    first = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("upto"), F.array(F.exp(-rate)).alias("out"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["upto"] + p).alias("upto"), F.array_append(acc["out"], acc["upto"] + p).alias("out"))

    small = F.aggregate(F.sequence(F.lit(1), F.lit(POISSON_STEPS)), first, step, lambda acc: acc["out"])
    return F.when(rate < REJECTION_FROM, small).otherwise(F.array().cast("array<double>"))


def log_poisson(k: Column, rate: Column) -> Column:
    """Logarithm of a Poisson probability; without cancellation at large rates, where k lies near the rate."""
    logs = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    d = (k - rate) / rate
    # (1 + d) log(1 + d) - d, by its series near 0.
    near = sum(((-1) ** j / (j * (j - 1))) * F.pow(d, F.lit(j)) for j in range(2, 11))
    excess = F.when(F.abs(d) < 0.01, near).otherwise((1 + d) * F.log1p(F.greatest(d, F.lit(-1 + 1e-12))) - d)
    stirling = 1 / (12 * k) - 1 / (360 * F.pow(k, F.lit(3))) + 1 / (1260 * F.pow(k, F.lit(5))) - 1 / (1680 * F.pow(k, F.lit(7)))
    large = -rate * excess - 0.5 * F.log(2 * math.pi * k) - stirling
    return F.when(k < 16, -rate + k * F.log(rate) - F.get(logs, k.cast("int"))).otherwise(large)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also inside lambda functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def poisson_draw(ids: list[str | Column], seed: int | str, rate: Column | float, table: Column | None = None) -> Column:
    """Poisson draw of any rate, exact up to floating point, from hashes of the ids and the seed.

    Small rates invert the distribution (``table``: their ``poisson_table``, worked out once where many draws share it);
    larger ones take the first accepted try of transformed rejection, two uniforms of one digest each.
    """
    rate = F.lit(float(rate)) if not isinstance(rate, Column) else rate.cast("double")
    unit = key_unit(ids, seed)
    small = bound(unit, lambda u: F.size(F.filter(poisson_table(rate) if table is None else table, lambda c: c < u)).cast("double"))
    # The published constants of the rejection method.
    b = 0.931 + 2.53 * F.sqrt(rate)
    a = -0.059 + 0.02483 * b
    scale, accept = 1.1239 + 1.1328 / (b - 3.4), 0.9277 - 3.6224 / (b - 2)

    def judge(x: Column) -> Column:
        u, v, edge, k = x["u"], x["v"], x["edge"], x["k"]
        quick = (edge >= 0.07) & (v <= accept)
        out = (k < 0) | ((edge < 0.013) & (v > edge))
        fits = F.log(v) + F.log(scale) - F.log(a / (edge * edge) + b) <= log_poisson(k, rate)
        return F.when(quick | (~out & fits), k)

    def place(x: Column) -> Column:
        k = F.floor((2 * a / x["edge"] + b) * x["u"] + rate + 0.43).cast("double")
        return bound(F.struct(x["u"].alias("u"), x["v"].alias("v"), x["edge"].alias("edge"), k.alias("k")), judge)

    def attempt(t: Column) -> Column:
        pair = bound(key_digest([*ids, t], seed), lambda d: F.struct((digest_unit(d) - 0.5).alias("u"), F.greatest(digest_unit(d, 14), F.lit(1e-300)).alias("v")))
        return bound(bound(pair, lambda x: F.struct(x["u"].alias("u"), x["v"].alias("v"), F.greatest(0.5 - F.abs(x["u"]), F.lit(1e-16)).alias("edge"))), place)

    none = F.lit(None).cast("double")
    large = F.aggregate(F.sequence(F.lit(1), F.lit(POISSON_TRIES)), none, lambda got, t: F.coalesce(got, attempt(t)), lambda got: F.coalesce(got, F.floor(rate).cast("double")))
    return F.when(rate == 1, poisson_one(unit)).when(rate < REJECTION_FROM, small).otherwise(large)
