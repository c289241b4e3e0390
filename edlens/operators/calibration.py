"""Calibration error, reliability, Brier decomposition and threshold choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edlens.operators.metrics import ratio, score_cells, score_curve
from edlens.operators.ordered import null_safe_join
from edlens.operators.quantiles import quantiles


def calibration_bins(
    df: DataFrame, by: list[str], n_bins: int = 10, strategy: str = "uniform", include_zero: bool = True, y: str = "y", p: str = "p"
) -> DataFrame:
    """Right-closed probability bins: mean probability, observed rate, count, share of all rows.

    A probability equal to the lowest edge belongs to no bin, except 0 with ``include_zero``; it
    still counts in the total, as in the definitions this follows.
    """
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(p).alias("__p"), F.col(y).alias("__y"))
    if strategy == "uniform":
        bin_ = F.ceil(F.round(F.col("__p") * n_bins, 9))
        rows = rows.withColumn("bin", bin_)
        zero = F.col("__p") == 0
    elif strategy == "quantile":
        names = {f"e{i}": i / n_bins for i in range(n_bins + 1)}
        edges = quantiles(rows, by, "__p", names).select(*by, F.array(*names).alias("__edges"))
        rows = null_safe_join(rows, edges, by) if by else rows.withColumn("__edges", edges.scalar())
        rows = rows.withColumn("bin", F.size(F.filter("__edges", lambda e: e < F.col("__p"))))
        zero = (F.col("__p") == 0) & (F.col("__edges")[0] == 0)
    else:
        raise ValueError(f"unknown strategy {strategy}")
    if include_zero:
        rows = rows.withColumn("bin", F.when(zero, F.lit(1)).otherwise(F.col("bin")))
    bins = rows.groupBy(*by, F.col("bin").cast("int").alias("bin")).agg(
        F.avg("__p").alias("mean_prob"), F.avg("__y").alias("observed"), F.count(F.lit(1)).alias("n")
    )
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return bins.withColumn("share", share).where("bin > 0")


def calibration_error(df: DataFrame, by: list[str], **kw) -> DataFrame:
    """Expected and maximum calibration error."""
    gap = F.abs(F.col("mean_prob") - F.col("observed"))
    return calibration_bins(df, by, **kw).groupBy(*by).agg(F.sum(gap * F.col("share")).alias("ece"), F.max(gap).alias("mce"))


def reliability_table(df: DataFrame, by: list[str], **kw) -> DataFrame:
    return calibration_bins(df, by, **kw).select(*by, "bin", "mean_prob", "observed", "n")


def brier_decomposition(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Reliability, resolution and uncertainty over distinct probabilities."""
    n, s, pos = F.col("n"), F.col("score"), F.col("pos")
    g = score_cells(df, by, y, p).groupBy(*by).agg(
        F.sum("n").alias("rows"), F.sum("pos").alias("P"), F.sum(pos * F.pow(1 - s, F.lit(2)) + (n - pos) * s * s).alias("b"),
        F.sum(n * F.pow(s - pos / n, F.lit(2))).alias("rel"), F.sum(pos * pos / n).alias("o2"),
    )
    base = F.col("P") / F.col("rows")
    rel, res, unc = F.col("rel") / F.col("rows"), F.col("o2") / F.col("rows") - base * base, base * (1 - base)
    return g.select(
        *by, (F.col("b") / F.col("rows")).alias("brier_score"), rel.alias("reliability"), res.alias("resolution"), unc.alias("uncertainty"),
        (rel - res + unc).alias("verification"),
    )


def threshold_scan(df: DataFrame, by: list[str], steps: int = 100, y: str = "y", p: str = "p") -> DataFrame:
    """Counts and scores at every threshold j / steps, from a histogram of at most steps + 1 cells per group."""
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    cell = F.least(F.floor(F.round(F.col(p) * steps, 9)), F.lit(steps)).cast("int")
    hist = rows.groupBy(*by, cell.alias("j")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
    slots = F.sequence(F.lit(0), F.lit(steps))
    totals = hist.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("j", F.struct("pos", "n")))).alias("__m"))
    grid = totals.select(*by, "P", "total", "__m", F.explode(slots).alias("j"))
    got = F.try_element_at("__m", F.col("j"))
    grid = grid.select(*by, "P", "total", "j", F.coalesce(got["pos"], F.lit(0)).alias("pos"), F.coalesce(got["n"], F.lit(0)).alias("n"))
    down = Window.partitionBy(*by).orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tp, called = F.sum("pos").over(down), F.sum("n").over(down)
    t = grid.select(*by, (F.col("j") / steps).alias("threshold"), "P", "total", tp.alias("tp"), called.alias("called"))
    return t.select(*by, "threshold", *[c.alias(n) for n, c in scan_scores().items()])


def scan_scores() -> dict[str, Column]:
    tp, called, P, total = (F.col(c) for c in ("tp", "called", "P", "total"))
    fp, neg = called - tp, total - P
    precision, recall, fpr = ratio(tp, called), ratio(tp, P), ratio(fp, neg)
    return {
        "tp": tp, "fp": fp, "selection_rate": ratio(called, total), "precision": precision, "recall": recall, "fpr": fpr,
        "f1": ratio(2 * precision * recall, precision + recall), "accuracy": ratio(tp + neg - fp, total), "youden": recall - fpr,
        "balanced_accuracy": (recall + 1 - fpr) / 2,
    }


def best_threshold(scan: DataFrame, by: list[str], metric: str) -> DataFrame:
    """First (lowest) threshold with the highest score."""
    return scan.groupBy(*by).agg(F.min_by("threshold", F.struct(-F.col(metric), F.col("threshold"))).alias("threshold"), F.max(metric).alias(metric))


def grouped_predictions(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """One row per group: mean probability, label 1 when half of its rows are positive."""
    return df.groupBy(*keys).agg(F.avg(p).alias(p), (F.avg(y) >= 0.5).cast("int").alias(y))


def best_thresholds(df: DataFrame, by: list[str], metrics: Sequence[str], floor: float = 0.7, **kw) -> DataFrame:
    """Best observed score as threshold, for each metric, from one score curve and one aggregate.

    ``precision`` is maximised where recall reaches ``floor`` and ``recall`` where precision does
    (anywhere when nothing does). Ties: the lowest threshold for f1 / precision / recall, the
    highest for youden / balanced_accuracy / accuracy.
    """
    c = score_curve(df, by, **kw).select(*by, F.col("score").alias("threshold"), *[v.alias(n) for n, v in scan_scores().items()])

    def best(metric: str) -> Column:
        if metric == "f1":
            value, ok, low = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-8), F.lit(True), True
        elif metric == "precision":
            value, ok, low = F.col("precision"), F.col("recall") >= floor, True
        elif metric == "recall":
            value, ok, low = F.col("recall"), F.col("precision") >= floor, True
        elif metric in ("youden", "balanced_accuracy", "accuracy"):
            value, ok, low = F.col(metric), F.lit(True), False
        else:
            raise ValueError(f"unknown metric {metric}")
        tie = F.col("threshold") if low else -F.col("threshold")
        rank = F.struct((~ok).cast("int").alias("o"), (-value).alias("v"), tie.alias("t"))
        return F.min_by(F.struct(F.lit(metric).alias("metric"), "threshold", value.alias("score")), rank)

    return c.groupBy(*by).agg(F.array(*map(best, metrics)).alias("b")).select(*by, F.inline("b"))


def optimal_threshold(df: DataFrame, by: list[str], metric: str = "f1", floor: float = 0.7, **kw) -> DataFrame:
    """``best_thresholds`` for one metric."""
    return best_thresholds(df, by, [metric], floor, **kw)


def confidence_histogram(df: DataFrame, by: list[str], bins: int = 20, y: str = "y", p: str = "p") -> DataFrame:
    slot = F.least(F.floor(F.round(F.col(p) * bins, 9)), F.lit(bins - 1)).cast("int")
    return df.groupBy(*by, slot.alias("bin"), y).agg(F.count(F.lit(1)).alias("n"))


def calibration_summary(df: DataFrame, by: list[str], n_bins: int = 10, metrics: tuple[str, ...] = ("f1", "youden")) -> DataFrame:
    """One row per model: errors, Brier parts and best thresholds."""
    out = null_safe_join(calibration_error(df, by, n_bins=n_bins), brier_decomposition(df, by), by)
    best = best_thresholds(df, by, metrics)
    best = best.groupBy(*by).agg(*[F.max(F.when(F.col("metric") == m, F.col("threshold"))).alias(f"{m}_threshold") for m in metrics])
    return null_safe_join(out, best, by)
