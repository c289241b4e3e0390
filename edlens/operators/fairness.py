"""Group fairness of predictions, and weights or thresholds that change it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edlens.operators.calibration import threshold_scan
from edlens.operators.features import before_after, join_dimension
from edlens.operators.metrics import ranking_metrics
from edlens.operators.ordered import null_safe_join


def group_rates(y: str = "y", pred: str = "pred") -> dict[str, Column]:
    hit, pos = F.col(y) == 1, F.col(pred) == 1
    mean = lambda c: F.avg(c.cast("int"))
    return {
        "n": F.count(F.lit(1)), "selection_rate": mean(pos),
        "tpr": F.coalesce(F.avg(F.when(hit, pos.cast("int"))), F.lit(0.0)), "fpr": F.coalesce(F.avg(F.when(~hit, pos.cast("int"))), F.lit(0.0)),
        "accuracy": mean(hit == pos),
    }


def fairness_by_group(df: DataFrame, groups: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    return df.groupBy(*groups).agg(*[c.alias(n) for n, c in group_rates(y, pred).items()])


def _gap(c: str) -> Column:
    return F.max(c) - F.min(c)


def parity_gaps(df: DataFrame, groups: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    return fairness_by_group(df, groups, y, pred).agg(
        _gap("selection_rate").alias("demographic_parity_diff"), F.greatest(_gap("tpr"), _gap("fpr")).alias("equalized_odds_diff"),
        _gap("tpr").alias("tpr_gap"), _gap("fpr").alias("fpr_gap"), (1 - F.min("accuracy")).alias("worst_group_error"),
    )


def fairness_table(df: DataFrame, groups: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Per group: selection rate and its distance from the overall TPR / FPR, whichever is larger."""
    overall = df.agg(F.struct(*[c.alias(n) for n, c in group_rates(y, pred).items()]).alias("o")).scalar()
    per = fairness_by_group(df, groups, y, pred)
    odds = F.greatest(F.abs(F.col("tpr") - overall["tpr"]), F.abs(F.col("fpr") - overall["fpr"]))
    return per.select(*groups, "n", "selection_rate", odds.alias("equalized_odds"), "accuracy")


def mitigation_delta(pre: DataFrame, post: DataFrame, groups: list[str]) -> DataFrame:
    return before_after(pre, post, groups, ["selection_rate", "equalized_odds"])


def overall_gaps(df: DataFrame, group: str, y: str = "y", pred: str = "pred") -> DataFrame:
    """Mean and largest distance of the groups from the overall positive rate and TPR."""
    overall = df.agg(F.struct(*[c.alias(n) for n, c in group_rates(y, pred).items()]).alias("o")).scalar()
    per = df.groupBy(group).agg(*[c.alias(n) for n, c in group_rates(y, pred).items()], F.count_distinct(y).alias("classes"))
    dp = F.abs(F.col("selection_rate") - overall["selection_rate"])
    eo = F.when(F.col("classes") > 1, F.abs(F.col("tpr") - overall["tpr"]))
    return per.agg(
        F.avg(dp).alias("demographic_parity_diff"), F.max(dp).alias("max_demographic_parity_diff"),
        F.coalesce(F.avg(eo), F.lit(0.0)).alias("equalized_odds_diff"), F.coalesce(F.max(eo), F.lit(0.0)).alias("max_equalized_odds_diff"),
    )


def group_quality(df: DataFrame, group: str, y: str = "y", pred: str = "pred", p: str = "p") -> DataFrame:
    """Size, accuracy, AUC and positive rate per group."""
    base = fairness_by_group(df, [group], y, pred).select(group, F.col("n").alias("size"), "accuracy", F.col("selection_rate").alias("positive_rate"))
    return null_safe_join(base, ranking_metrics(df, [group], y, p).select(group, F.col("roc_auc").alias("auc")), [group])


def reweighing(df: DataFrame, group: str, label: str) -> DataFrame:
    """Weight P(g) P(y) / P(g, y): group and label become independent under the weights."""
    cells = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    g = cells.groupBy(group).agg(F.sum("n").alias("ng"))
    y = cells.groupBy(label).agg(F.sum("n").alias("ny"))
    total = cells.agg(F.sum("n")).scalar()
    w = null_safe_join(null_safe_join(cells, g, [group]), y, [label]).select(group, label, (F.col("ng") * F.col("ny") / (total * F.col("n"))).alias("weight"))
    return null_safe_join(df, w, [group, label])


def inverse_frequency_weights(df: DataFrame, keys: list[str]) -> DataFrame:
    """1 / cell size, scaled to mean 1: rows / (cells x size)."""
    cells = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    t = cells.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("cells")).alias("t")).scalar()
    return join_dimension(df, cells.select(*keys, (t["rows"] / (t["cells"] * F.col("n"))).alias("weight")), keys, unique=True)


def group_thresholds(df: DataFrame, group: str, constraint: str = "demographic_parity", steps: int = 100, y: str = "y", p: str = "p") -> DataFrame:
    """One threshold per group under a common target rate.

    For each target j / steps every group takes the grid threshold whose selection rate
    (demographic parity) or TPR (equalized odds) lies nearest, the lowest on ties. The target with
    the best overall accuracy wins; for equalized odds the spread of the FPR is subtracted from it.
    All of this works on groups x steps rows of histogram sums.
    """
    on = {"demographic_parity": "selection_rate", "equalized_odds": "recall"}[constraint]
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    scan = null_safe_join(threshold_scan(df, [group], steps, y, p), sizes, [group])
    slots = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("target")
    dist = F.round(F.abs(F.col(on) - F.col("target") / steps), 9)
    pick = scan.select("*", slots).groupBy("target", group).agg(
        F.min_by(F.struct("threshold", "accuracy", "fpr", "size", F.col(on).alias("rate")), F.struct(dist, F.col("threshold"))).alias("b")
    ).select("target", group, "b.*")
    total = F.sum("size")
    score = F.sum(F.col("accuracy") * F.col("size")) / total
    if constraint == "equalized_odds":
        score = score - (F.max("fpr") - F.min("fpr"))
    best = pick.groupBy("target").agg(F.round(score, 9).alias("score")).agg(F.min_by("target", F.struct(-F.col("score"), F.col("target")))).scalar()
    return pick.where(F.col("target") == best).select(group, "threshold", F.col("rate").alias(on), "accuracy")


def worst_group_accuracy(df: DataFrame, group: str, y: str = "y", pred: str = "pred") -> DataFrame:
    per = fairness_by_group(df, [group], y, pred)
    return per.agg(F.min("accuracy").alias("worst_accuracy"), F.min_by(group, F.struct("accuracy", group)).alias("worst_group"), F.max("accuracy").alias("best_accuracy"))
