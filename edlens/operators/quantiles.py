"""Exact, linearly interpolated quantiles per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edlens.operators.ordered import in_order, null_safe_join

MAX_DISTINCT = 2_000_000


def quantiles(
    df: DataFrame,
    by: list[str],
    value: str,
    probs: dict[str, float],
    *,
    max_distinct: int = MAX_DISTINCT,
) -> DataFrame:
    """One row per group with a column per named probability.

    The built-in ``percentile`` keeps every distinct value of a group in one task. That is used
    only when a probe shows few distinct values; otherwise values are counted, ranked by running
    totals over ranges, and the two order statistics around each probability are picked.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    spread = rows.groupBy(*by).agg(F.approx_count_distinct("__v").alias("d")).agg(F.max("d")).first()[0]
    if (spread or 0) <= max_distinct:
        names = list(probs)
        arr = rows.groupBy(*by).agg(F.percentile("__v", F.array(*[F.lit(probs[n]) for n in names])).alias("__q"))
        return arr.select(*by, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])
    cells = rows.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n"))
    ranked = in_order(cells, by, ["__v"], running={"__cum": "__n"}, max_group_rows=max_distinct)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__total"))
    if by:
        ranked = null_safe_join(ranked, sizes, by)
    else:
        ranked = ranked.withColumn("__total", sizes.scalar())
    picks = []
    for name, p in probs.items():
        at = (F.col("__total") - 1) * F.lit(p)
        picks.append(F.min(F.when(F.col("__cum") > F.floor(at), F.col("__v"))).alias(f"__lo_{name}"))
        picks.append(F.min(F.when(F.col("__cum") > F.ceil(at), F.col("__v"))).alias(f"__hi_{name}"))
    picked = ranked.groupBy(*by).agg(F.first("__total").alias("__total"), *picks)
    out = []
    for name, p in probs.items():
        at = (F.col("__total") - 1) * F.lit(p)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return picked.select(*by, *out)
