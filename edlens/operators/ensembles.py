"""Combination of prediction columns and weight search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edlens.functions.scalars import clip
from edlens.operators.calibration import optimal_threshold
from edlens.operators.features import one_to_one_join, shared_keys
from edlens.operators.metrics import LOSS_CLIP, ratio


def weighted_probability(weights: dict[str, float]) -> Column:
    """Weighted mean of columns, weights by name and normalised, clamped to [0, 1]."""
    total = sum(weights.values())
    return clip(reduce(lambda a, b: a + b, [F.col(c) * F.lit(w / total) for c, w in weights.items()]), 0.0, 1.0)


def weighted_ensemble(frames: dict[str, DataFrame], weights: dict[str, float], defaults: list[str], prob: str = "p") -> DataFrame:
    """Join one prediction table per model on their shared keys and average."""
    names = list(frames)
    keys = shared_keys(list(frames.values()), defaults)
    out = None
    for n in names:
        f = frames[n].select(*keys, F.col(prob).alias(n))
        out = f if out is None else one_to_one_join(out, f, keys)
    return out.withColumn(prob, weighted_probability({n: weights[n] for n in names}))


def apply_stacking_calibrator(df: DataFrame, calibrator: dict, prefix: str = "prob_", out: str = "p") -> DataFrame:
    """sigmoid(w.x + b) with weights by model name; a model that is absent counts as 0."""
    z = F.lit(float(calibrator["bias"]))
    for name, w in zip(calibrator["names"], calibrator["weights"]):
        if f"{prefix}{name}" in df.columns:
            z = z + F.col(f"{prefix}{name}") * F.lit(float(w))
    return df.withColumn(out, 1 / (1 + F.exp(-z)))


def simplex(k: int, steps: int) -> list[list[int]]:
    """All ways to hand out ``steps`` units to k models."""
    if k == 1:
        return [[steps]]
    return [[i, *rest] for i in range(steps + 1) for rest in simplex(k - 1, steps - i)]


def weight_search(df: DataFrame, cols: list[str], y: str = "y", steps: int = 20, metric: str = "log_loss") -> DataFrame:
    """Score of every weight vector on the simplex grid, best first.

    Rows are counted per distinct (label, probabilities) cell, then expanded by the grid in the map
    stage; log-loss is one number per grid point and task. Average precision needs an order: the cells of a
    grid point are counted per mixed score, as exact as doubles are, and ordered in ranges.
    """
    cells = df.groupBy(F.col(y).cast("int").alias("y"), *cols).agg(F.count(F.lit(1)).alias("n"))
    grid = F.array(*[F.struct(F.lit(i).alias("id"), F.array(*[F.lit(u / steps) for u in g]).alias("w")) for i, g in enumerate(simplex(len(cols), steps))])
    mixed = cells.select("*", F.explode(grid).alias("g"))
    p = reduce(lambda a, b: a + b, [F.col(c) * F.col("g.w")[i] for i, c in enumerate(cols)])
    mixed = mixed.select(F.col("g.id").alias("id"), F.col("g.w").alias("w"), "y", "n", p.alias("p"))
    if metric == "log_loss":
        c = F.greatest(F.least("p", F.lit(1 - LOSS_CLIP)), F.lit(LOSS_CLIP))
        loss = -F.log(F.when(F.col("y") == 1, c).otherwise(1 - c))
        scores = mixed.groupBy("id", "w").agg((F.sum(loss * F.col("n")) / F.sum("n")).alias("score"))
        order = [F.col("score"), F.col("id")]
    elif metric == "average_precision":
        from edlens.operators.ordered import in_order

        cell = mixed.groupBy("id", "w", F.col("p").alias("score")).agg(F.sum(F.col("y") * F.col("n")).alias("pos"), F.sum("n").alias("n"))
        run = in_order(cell.withColumn("__neg", -F.col("score")), ["id", "w"], ["__neg"], running={"tp": "pos", "called": "n"})
        scores = run.groupBy("id", "w").agg(ratio(F.sum(F.col("pos") * F.col("tp") / F.col("called")), F.sum("pos")).alias("score"))
        order = [F.desc("score"), F.col("id")]
    else:
        raise ValueError(f"unknown metric {metric}")
    return scores.orderBy(*order).select("id", *[F.col("w")[i].alias(f"w_{c}") for i, c in enumerate(cols)], "score")


def mean_ensemble(df: DataFrame, cols: list[str], y: str = "y", metric: str = "f1") -> DataFrame:
    """Plain mean of the columns with the label, and its best threshold for the metric."""
    mean = df.withColumn("p", reduce(lambda a, b: a + b, [F.col(c) for c in cols]) / len(cols))
    best = optimal_threshold(mean, [], metric, y=y).select("threshold").scalar()
    return mean.withColumn("pred", (F.col("p") >= best).cast("int")).withColumn("threshold", best)
