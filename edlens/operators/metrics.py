"""Classification, ranking and regression metrics on prediction tables (keys, y, p).

Ranking metrics first count rows per distinct score, so a global order is only ever needed over
distinct scores, and that order goes through ``in_order``. Ties share their rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edlens.operators.ordered import MAX_GROUP_ROWS, in_order, null_safe_join
from edlens.operators.quantiles import quantiles


def ratio(a: Column | str, b: Column | str, default: float = 0.0) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.when(b != 0, a / b).otherwise(F.lit(default))


def confusion_counts(df: DataFrame, by: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    hit, pos = F.col(y) == 1, F.col(pred) == 1
    return df.groupBy(*by).agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(~hit & pos).alias("fp"), F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fn")
    )


def rates(tp="tp", fp="fp", tn="tn", fn="fn") -> dict[str, Column]:
    tp, fp, tn, fn = (F.col(c) for c in (tp, fp, tn, fn))
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    return {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": precision, "recall": recall,
        "f1": ratio(2 * precision * recall, precision + recall), "specificity": specificity, "balanced_accuracy": (recall + specificity) / 2,
    }


def classification_metrics(df: DataFrame, by: list[str], y: str = "y", pred: str = "pred") -> DataFrame:
    return confusion_counts(df, by, y, pred).select(*by, *[c.alias(n) for n, c in rates().items()])


def classification_report(df: DataFrame, group: str | None = None, y: str = "y", pred: str = "pred") -> DataFrame:
    """Per class precision / recall / F1 / support with macro and weighted means, overall and per group."""
    g = F.col(group).cast("string") if group else F.lit(None).cast("string")
    cells = df.groupBy(g.alias("group"), F.col(y).cast("string").alias("t"), F.col(pred).cast("string").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    if group:
        cells = cells.select(F.explode(F.array(F.struct("group", "t", "q", "n"), F.struct(F.lit("all").alias("group"), "t", "q", "n"))).alias("c")).select("c.*")
    else:
        cells = cells.withColumn("group", F.lit("all"))
    side = F.explode(F.array(
        F.struct(F.col("t").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.when(F.col("t") == F.col("q"), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("q").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
    )).alias("s")
    per = cells.select("group", side).select("group", "s.*").groupBy("group", "class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    precision, recall = ratio("hits", "predicted"), ratio("hits", "support")
    per = per.select("group", "class", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"), "support")
    names = ["precision", "recall", "f1"]
    total = F.sum("support")
    macro = per.groupBy("group").agg(*[F.avg(n).alias(n) for n in names], total.alias("support")).withColumn("class", F.lit("macro avg"))
    weighted = per.groupBy("group").agg(*[(F.sum(F.col(n) * F.col("support")) / total).alias(n) for n in names], total.alias("support")).withColumn("class", F.lit("weighted avg"))
    return per.unionByName(macro).unionByName(weighted)


def score_cells(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(*by, F.col(p).alias("score")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))


def score_runs(df: DataFrame, by: list[str], y: str = "y", p: str = "p", max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Per distinct score: cell counts and cumulative tp / all at and above it."""
    cells = score_cells(df, by, y, p).withColumn("__neg", -F.col("score"))
    return in_order(cells, by, ["__neg"], running={"tp": "pos", "called": "n"}, max_group_rows=max_group_rows).drop("__neg")


def score_curve(df: DataFrame, by: list[str], y: str = "y", p: str = "p", max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """``score_runs`` with the totals of the group (``P`` positives, ``total`` rows) on every line."""
    curve = score_runs(df, by, y, p, max_group_rows)
    totals = score_cells(df, by, y, p).groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("n").alias("total"))  # same shuffle as the cells
    if by:
        return null_safe_join(curve, totals, by)
    t = totals.select(F.struct("P", "total").alias("t")).scalar()
    return curve.select("*", t["P"].alias("P"), t["total"].alias("total"))


LOSS_CLIP = 1e-7


def ranking_metrics(df: DataFrame, by: list[str], y: str = "y", p: str = "p", **kw) -> DataFrame:
    """ROC-AUC (.5 for one class), average precision (0 without positives), log-loss, Brier score."""
    s, pos, n = F.col("score"), F.col("pos"), F.col("n")
    c = F.greatest(F.least(s, F.lit(1 - LOSS_CLIP)), F.lit(LOSS_CLIP))
    g = score_runs(df, by, y, p, **kw).groupBy(*by).agg(
        F.sum("pos").alias("__P"), F.sum("n").alias("n"),
        F.sum((n - pos) * (F.col("tp") - pos / 2.0)).alias("__area"),
        F.sum(pos * F.col("tp") / F.col("called")).alias("__ap"),
        F.sum(-(pos * F.log(c) + (n - pos) * F.log(1 - c))).alias("__loss"),
        F.sum(pos * F.pow(1 - s, F.lit(2)) + (n - pos) * s * s).alias("__brier"),
    )
    P, N = F.col("__P"), F.col("n") - F.col("__P")
    return g.select(
        *by, "n", ratio(F.col("__area"), P * N, 0.5).alias("roc_auc"), ratio(F.col("__ap"), P).alias("average_precision"),
        (F.col("__loss") / F.col("n")).alias("log_loss"), (F.col("__brier") / F.col("n")).alias("brier"),
    )


def log_loss(y: str = "y", p: str = "p") -> Column:
    c = F.greatest(F.least(F.col(p), F.lit(1 - LOSS_CLIP)), F.lit(LOSS_CLIP))
    return F.avg(-F.log(F.when(F.col(y) == 1, c).otherwise(1 - c)))


def brier(y: str = "y", p: str = "p") -> Column:
    return F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y)))


def curves(df: DataFrame, by: list[str], y: str = "y", p: str = "p", **kw) -> DataFrame:
    """Points of the PR and ROC curves, one per distinct score."""
    tp, called, P = F.col("tp"), F.col("called"), F.col("P")
    return score_curve(df, by, y, p, **kw).select(
        *by, F.col("score").alias("threshold"), "tp", (called - tp).alias("fp"), (tp / called).alias("precision"),
        ratio(tp, P).alias("recall"), ratio(called - tp, F.col("total") - P).alias("fpr"),
    )


def unpivot_models(df: DataFrame, keep: list[str], prefix: str = "prob_") -> DataFrame:
    cols = [c for c in df.columns if c.startswith(prefix)]
    return df.unpivot(keep, cols, "model", "p")


def early_warning_curve(df: DataFrame, lengths: list[int], pos: str = "pos", y: str = "y", p: str = "p", **kw) -> DataFrame:
    """Ranking metrics when only the first K events of each sequence count."""
    ks = F.explode(F.filter(F.array(*map(F.lit, sorted(lengths))), lambda k: F.col(pos) <= k)).alias("k")
    return ranking_metrics(df.select(ks, y, p), ["k"], y, p, **kw)


def regression_metrics(df: DataFrame, by: list[str], y: str, yhat: str) -> DataFrame:
    e = F.col(y) - F.col(yhat)
    sst = F.var_pop(y) * F.count(y)
    return df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.when(sst > 0, 1 - F.sum(e * e) / sst).alias("r2"), F.count(F.lit(1)).alias("n")
    )


def majority_baseline(df: DataFrame, by: list[str], y: str = "y") -> DataFrame:
    return df.groupBy(*by, y).agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg((F.max("n") / F.sum("n")).alias("majority_accuracy"))


def improvement_over_baseline(results: DataFrame, name: str, baseline: str, metrics: list[str]) -> DataFrame:
    base = results.where(F.col(name) == baseline).agg(F.struct(*[F.max(m).alias(m) for m in metrics]).alias("b")).scalar()
    return results.select(name, *metrics, *[(F.col(m) - base[m]).alias(f"{m}_gain") for m in metrics])


def residuals_by_group(df: DataFrame, by: list[str], y: str, yhat: str) -> DataFrame:
    r = df.select(*by, (F.col(y) - F.col(yhat)).alias("residual"))
    q = quantiles(r, by, "residual", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return r.groupBy(*by).agg(F.avg("residual").alias("mean"), F.count("residual").alias("n")).transform(lambda x: null_safe_join(x, q, by))
