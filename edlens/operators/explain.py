"""Model explanation by perturbation: shuffled columns, replaced columns, value grids.

Perturbed copies are made row by row in the map stage and scored there; only the metric sums are
shuffled. A shuffled column takes the value of the next row in a random cyclic order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edlens.operators.models import Fitted, evaluate
from edlens.operators.ordered import null_safe_join, shuffled_position
from edlens.operators.quantiles import quantiles


def _with_donor(df: DataFrame, key: list[str], features: list[str], keep: list[str], seed: str) -> DataFrame:
    """Each row with the feature values of another row (``__d_<feature>``), every row donating once."""
    placed = shuffled_position(df.select(*key, *features, *keep), [], key, seed)
    shifted = F.when(F.col("__pos") == 1, F.col("__size")).otherwise(F.col("__pos") - 1).alias("__pos")
    donor = placed.select(shifted, *[F.col(f).alias(f"__d_{f}") for f in features])
    return placed.join(donor, "__pos").drop("__pos", "__size")


def permutation_importance(model: Fitted, df: DataFrame, key: list[str], label: str, repeats: int = 10, metric: str = "roc_auc", by: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Mean and std over repeats of the metric drop per feature, optionally per group."""
    by, feats = by or [], model.features
    base = evaluate(model.score(df.select(*key, *by, *feats, label)), label, by).select(*by, F.col(metric).alias("baseline"))
    scored = None
    for r in range(repeats):
        rows = _with_donor(df, key, feats, [*by, label], f"{seed}-{r}")
        copies = [F.struct(F.lit(f).alias("feature"), *[F.col(f"__d_{g}" if g == f else g).cast("double").alias(g) for g in feats]) for f in feats]
        long = rows.select(*by, F.col(label).alias(label), F.inline(F.array(*copies)))
        s = model.score(long).select("feature", *by, label, "p", F.lit(r).alias("repeat"))
        scored = s if scored is None else scored.unionByName(s)
    shuffled = evaluate(scored, label, ["feature", "repeat", *by]).select("feature", "repeat", *by, F.col(metric).alias("value"))
    j = null_safe_join(shuffled, base, by) if by else shuffled.withColumn("baseline", base.scalar())
    drop = F.col("baseline") - F.col("value")
    return j.groupBy("feature", *by).agg(F.avg(drop).alias("importance_mean"), F.stddev_pop(drop).alias("importance_std"))


def faithfulness(model: Fitted, df: DataFrame, key: list[str], label: str, top: list[str], method: str = "remove", seed: int = 42) -> DataFrame:
    """AUC and accuracy lost when the top features are set to their mean or shuffled."""
    feats = model.features
    if method == "remove":
        m = df.agg(F.struct(*[F.avg(f).alias(f) for f in top]).alias("m")).scalar()
        changed = df.select(*key, label, *[m[f].alias(f) if f in top else F.col(f) for f in feats])
    elif method == "randomize":
        d = _with_donor(df, key, feats, [label], f"{seed}-faith")
        changed = d.select(*key, label, *[F.col(f"__d_{f}").alias(f) if f in top else F.col(f) for f in feats])
    else:
        raise ValueError(f"unknown method {method}")
    after = evaluate(model.score(changed), label).select(F.struct("roc_auc", "accuracy").alias("a")).scalar()
    before = evaluate(model.score(df.select(*key, label, *feats)), label)
    return before.select(
        F.col("roc_auc").alias("baseline_auc"), after["roc_auc"].alias("perturbed_auc"), (F.col("roc_auc") - after["roc_auc"]).alias("auc_drop"),
        (F.col("accuracy") - after["accuracy"]).alias("accuracy_drop"))


def partial_dependence(model: Fitted, df: DataFrame, features: list[str], points: int = 10) -> DataFrame:
    """Mean score with one feature set to each point of its quantile grid."""
    feats = model.features
    long = df.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], features, "feature", "value")
    probs = {f"g{i}": i / (points - 1) for i in range(points)}
    grids = {r["feature"]: sorted({r[g] for g in probs}) for r in quantiles(long, ["feature"], "value", probs).collect()}  # one row per feature
    out = None
    for f in features:
        values = F.explode(F.array(*[F.lit(float(v)) for v in grids[f]])).alias("__v")
        rows = df.select(*[F.col(g).cast("double").alias(g) for g in feats if g != f], values).withColumn(f, F.col("__v"))
        s = model.score(rows).groupBy(F.col("__v").alias("value")).agg(F.avg("p").alias("mean_prediction")).select(F.lit(f).alias("feature"), "value", "mean_prediction")
        out = s if out is None else out.unionByName(s)
    return out


def feature_importance_table(model: Fitted, df: DataFrame, label: str) -> DataFrame:
    """Mutual information with the label (decile bins) beside the model's importances."""
    from edlens.operators.profile import mutual_information, quantile_bin

    mi = mutual_information(quantile_bin(df, model.features), model.features, label)
    return mi.join(model.importances(), "feature").orderBy(F.desc("importance"), "feature")
