"""Split conformal prediction sets for binary probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edlens.operators.quantiles import quantiles


def nonconformity(y: str = "y", p: str = "p") -> Column:
    return F.when(F.col(y) == 1, 1 - F.col(p)).otherwise(F.col(p))


def calibrate(df: DataFrame, alphas: list[float], y: str = "y", p: str = "p") -> DataFrame:
    """One row per alpha with the score quantile at level min(1, (n + 1)(1 - alpha) / n)."""
    scores = df.select(nonconformity(y, p).alias("s")).where(F.col("s").isNotNull())
    n = scores.count()
    names = {f"a{i}": min(1.0, (n + 1) * (1 - a) / n) for i, a in enumerate(alphas)}
    q = quantiles(scores, [], "s", names)
    rows = [F.struct(F.lit(a).alias("alpha"), F.col(f"a{i}").alias("threshold")) for i, a in enumerate(alphas)]
    return q.select(F.inline(F.array(*rows)))


def predict_sets(df: DataFrame, threshold: Column | float, p: str = "p") -> DataFrame:
    """Flags ``has_0`` / ``has_1``; an empty set becomes the likelier class."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    zero, one = F.col(p) <= t, (1 - F.col(p)) <= t
    empty = ~zero & ~one
    return df.select("*", (zero | (empty & (F.col(p) <= 0.5))).alias("has_0"), (one | (empty & (F.col(p) > 0.5))).alias("has_1"), empty.alias("was_empty"))


def coverage(sets: DataFrame, by: list[str], alpha: Column | float, y: str = "y") -> DataFrame:
    """Coverage and set sizes; sets that were empty before the fallback are reported as ``empty_rate``."""
    size = F.col("has_0").cast("int") + F.col("has_1").cast("int")
    covered = F.when(F.col(y) == 1, F.col("has_1")).otherwise(F.col("has_0")).cast("int")
    target = 1 - (F.max(alpha) if isinstance(alpha, Column) else F.lit(alpha))
    rate = lambda c: F.avg(c.cast("int"))
    return sets.groupBy(*by).agg(
        F.avg(covered).alias("coverage"), target.alias("target"), (F.avg(covered) - target).alias("gap"), F.avg(size).alias("mean_set_size"),
        rate(size == 1).alias("singleton_rate"), rate(F.col("was_empty")).alias("empty_rate"), rate(size == 2).alias("full_rate"), F.count(F.lit(1)).alias("n"),
    )


def _per_alpha(cal: DataFrame, test: DataFrame, alphas: list[float], y: str, p: str) -> DataFrame:
    """Test rows once per alpha; the thresholds enter as one small array."""
    levels = calibrate(cal, alphas, y, p).agg(F.collect_list(F.struct("alpha", "threshold")).alias("l")).scalar()
    rows = test.select("*", F.explode(levels).alias("__l")).select(*test.columns, "__l.alpha", "__l.threshold")
    return predict_sets(rows, F.col("threshold"), p)


def conformal_run(cal: DataFrame, test: DataFrame, alphas: list[float], by: list[str] | None = None, y: str = "y", p: str = "p") -> DataFrame:
    sets = _per_alpha(cal, test, alphas, y, p)
    return coverage(sets, ["alpha", "threshold", *(by or [])], F.col("alpha"), y)


def set_sizes(cal: DataFrame, test: DataFrame, alphas: list[float], y: str = "y", p: str = "p") -> DataFrame:
    size = F.col("has_0").cast("int") + F.col("has_1").cast("int")
    return _per_alpha(cal, test, alphas, y, p).groupBy("alpha", size.alias("set_size")).agg(F.count(F.lit(1)).alias("n"))
