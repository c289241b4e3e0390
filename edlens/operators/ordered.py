"""Ordered computation inside groups that may be arbitrarily large.

A plain window sends a whole group to one task, so a key with a third of all rows would stall
the job. Here one probe (a count per key, combined before the shuffle) decides:

* no group above ``max_group_rows``: an ordinary window;
* otherwise the rows of the large groups are cut into ranges of the ordering column, the window
  runs inside (key, range), and one small row per (key, range) carries counts, running totals and
  edge values across the cuts. Small groups keep their single window.

The cut points are approximate quantiles, fixed as literals before the main plan starts, so a
re-run task always assigns a row to the same range.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_GROUP_ROWS = 1_000_000  # a window takes about 400 bytes a row in one task
MAX_RANGES = 10_000
WHOLE = -2  # range id of groups that are not cut


def as_number(df: DataFrame, name: str) -> Column:
    """Order-preserving double for numbers, dates, timestamps and (by leading bytes) text."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(name).cast("timestamp").cast("double")
    if isinstance(kind, T.BooleanType):
        return F.col(name).cast("int").cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(name, "UTF-8"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    raise TypeError(f"cannot cut ranges on {name}: {kind.simpleString()}")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match; keeps the left keys."""
    right = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return left.join(right, on, how).drop(*[f"__k_{k}" for k in keys])


def largest_group(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    row = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    return int(row[0] or 0), int(row[1] or 0)


def _bucket(df: DataFrame, c: str, cuts: list[float], out: str) -> DataFrame:
    """0-based index of the left-closed range a number falls in; -1 for null, one more than the last for NaN."""
    splits = [-math.inf, *sorted(set(cuts)), math.inf]
    if len(splits) == 2:
        return df.withColumn(out, F.when(F.col(c).isNull(), F.lit(-1)).when(F.isnan(c), F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    filled = df.withColumn("__filled", F.when(F.isnan(c), F.lit(0.0)).otherwise(F.coalesce(c, F.lit(0.0))))
    got = Bucketizer(splits=splits, inputCol="__filled", outputCol="__idx").transform(filled)
    index = F.when(F.col(c).isNull(), F.lit(-1)).when(F.isnan(c), F.lit(len(splits) - 1)).otherwise(F.col("__idx")).cast("bigint")
    return got.withColumn(out, index).drop("__filled", "__idx")


def cut_large_groups(df: DataFrame, keys: list[str], order: list[str], max_group_rows: int) -> DataFrame | None:
    """Add ``__range``; ``None`` when no group is larger than ``max_group_rows``.

    Ranges follow the first ordering column. A value so frequent that it fills ranges alone (a day
    with a billion clicks) gets a range of its own, which is cut further along the second column.
    """
    on = as_number(df, order[0])  # refuses the types that cannot be cut, at any size
    top, total = largest_group(df, keys)
    if top <= max_group_rows:
        return None
    ranges = min(MAX_RANGES, max(2, -(-4 * total // max_group_rows)))
    probs = [i / ranges for i in range(1, ranges)]
    quantile = lambda c: F.percentile_approx(F.when(~F.isnan(c), F.col(c)), probs, 10 * MAX_RANGES)
    numbered = df.withColumn("__on", on)
    cuts, biggest = numbered.agg(quantile("__on"), F.max(F.when(~F.isnan("__on"), F.abs("__on")))).first()
    cuts = cuts or []
    frequent = [v for v, n in Counter(cuts).items() if n > 1]
    numbered = _bucket(numbered, "__on", [*cuts, *[math.nextafter(v, math.inf) for v in frequent]], "__b1")
    # Equal numbers must mean equal values: not so for text prefixes and integers beyond 2^53.
    exact = not isinstance(df.schema[order[0]].dataType, T.StringType) and (biggest or 0) < 2**53
    cut = F.col("__b1")
    if frequent and exact and len(order) > 1:
        tied = F.coalesce(F.col("__on").isin(frequent), F.lit(False))
        numbered = numbered.withColumn("__on2", as_number(df, order[1]))
        again = numbered.where(tied).agg(quantile("__on2")).first()[0] or []
        numbered = _bucket(numbered, "__on2", again, "__b2")
        cut = F.when(F.col("__b1") < 0, F.lit(-1)).otherwise(F.col("__b1") * (2 * MAX_RANGES) + F.when(tied, F.col("__b2") + 1).otherwise(F.lit(0)))
    if not keys:
        return numbered.select(*df.columns, cut.alias("__range"))
    large = numbered.groupBy(*keys).count().where(F.col("count") > max_group_rows)
    large = large.select(*keys, F.lit(True).alias("__large"))
    return null_safe_join(numbered, large, keys, "left").select(
        *df.columns, F.when(F.col("__large"), cut).otherwise(F.lit(WHOLE)).alias("__range")
    )


def in_order(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    position: str | None = None,
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
    running: dict[str, str] | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Add row position, previous / following values and inclusive running sums per group.

    ``order`` sorts ascending and must be unique inside a group; large groups are cut along its
    first column, a number, date, timestamp or text. ``previous``, ``following`` and ``running`` map new names to
    source columns.
    """
    previous, following, running = previous or {}, following or {}, running or {}
    cut = cut_large_groups(df, keys, order, max_group_rows)
    if cut is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        new = [F.lag(c).over(w).alias(n) for n, c in previous.items()]
        new += [F.lead(c).over(w).alias(n) for n, c in following.items()]
        new += [F.sum(c).over(upto).alias(n) for n, c in running.items()]
        if position:
            new.append(F.row_number().over(w).cast("bigint").alias(position))
        return df.select("*", *new)

    at = F.struct(*[F.col(c) for c in order])
    edge = sorted(set(previous.values()) | set(following.values()))
    values = F.struct(*[F.col(c) for c in edge]) if edge else F.struct(F.lit(1).alias("one"))
    carry = (
        cut.where(F.col("__range") > WHOLE)
        .groupBy(*keys, "__range")
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.min_by(values, at).alias("__first"),
            F.max_by(values, at).alias("__last"),
            *[F.sum(c).alias(f"__sum_{n}") for n, c in running.items()],
        )
    )
    across = Window.partitionBy(*keys).orderBy("__range")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(
        *keys,
        "__range",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__skip"),
        F.lag("__last").over(across).alias("__prev"),
        F.lead("__first").over(across).alias("__next"),
        *[F.sum(f"__sum_{n}").over(before).alias(f"__base_{n}") for n in running],
    )
    w = Window.partitionBy(*keys, "__range").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = cut.select(
        "*",
        F.row_number().over(w).alias("__rn"),
        F.lead(F.lit(1)).over(w).isNull().alias("__end"),
        *[F.lag(c).over(w).alias(f"__p_{n}") for n, c in previous.items()],
        *[F.lead(c).over(w).alias(f"__f_{n}") for n, c in following.items()],
        *[F.sum(c).over(upto).alias(f"__r_{n}") for n, c in running.items()],
    )
    j = null_safe_join(inner, carry, [*keys, "__range"], "left")
    out = [F.col(c) for c in df.columns]
    out += [
        F.when(F.col("__rn") == 1, F.col("__prev").getField(c)).otherwise(F.col(f"__p_{n}")).alias(n)
        for n, c in previous.items()
    ]
    out += [
        F.when(F.col("__end"), F.col("__next").getField(c)).otherwise(F.col(f"__f_{n}")).alias(n)
        for n, c in following.items()
    ]
    # Null on either side means "nothing but nulls there", as in a plain window.
    inside, base = (lambda n: F.col(f"__r_{n}")), (lambda n: F.col(f"__base_{n}"))
    out += [F.coalesce(inside(n) + base(n), inside(n), base(n)).alias(n) for n in running]
    if position:
        out.append((F.col("__rn") + F.coalesce("__skip", F.lit(0))).cast("bigint").alias(position))
    return j.select(*out)


def shuffled_position(df: DataFrame, strata: list[str], ids: list[str], seed: int | str) -> DataFrame:
    """Add ``__pos`` (1-based random position inside the stratum) and ``__size`` (stratum size).

    The order is the MD5 of (ids, seed). Its first three digits split every stratum into 4096 even
    parts, so two strata with a billion rows each still spread over thousands of tasks.
    """
    from edlens.functions.hashing import key_digest

    marked = df.withColumn("__digest", key_digest(list(ids), seed)).withColumn(
        "__part", F.substring("__digest", 1, 3)
    )
    parts = marked.groupBy(*strata, "__part").agg(F.count(F.lit(1)).alias("__n"))
    over = Window.partitionBy(*strata)
    before = over.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *strata,
        "__part",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__skip"),
        F.sum("__n").over(over).alias("__size"),
    )
    w = Window.partitionBy(*strata, "__part").orderBy("__digest", *ids)
    ranked = marked.withColumn("__rn", F.row_number().over(w))
    return null_safe_join(ranked, parts, [*strata, "__part"]).select(
        *df.columns,
        (F.col("__rn") + F.col("__skip")).cast("bigint").alias("__pos"),
        F.col("__size").cast("bigint").alias("__size"),
    )
