"""Distribution shift between a source and a target side of one table (``domain`` 0 / 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edlens.functions.pvalues import ks_p
from edlens.functions.scalars import histogram_bin
from edlens.operators.ordered import MAX_GROUP_ROWS, in_order, shuffled_position
from edlens.operators.quantiles import quantiles
from edlens.session import materialise

EPS = 1e-8


def stack_domains(source: DataFrame, target: DataFrame, cols: list[str]) -> DataFrame:
    side = lambda df, d: df.select(*cols, F.lit(d).alias("domain"))
    return side(source, 0).unionByName(side(target, 1))


def value_cells(df: DataFrame, cols: list[str]) -> DataFrame:
    """``feature``, ``value`` (also null) and the rows of either side: all that the comparisons below need of the data."""
    long = df.select("domain", *[F.col(c).cast("double").alias(c) for c in cols]).unpivot("domain", cols, "feature", "value")
    return long.groupBy("feature", "value").agg(F.count_if(F.col("domain") == 0).alias("ns"), F.count_if(F.col("domain") == 1).alias("nt"))


def _psi(cells: DataFrame, bins: int) -> DataFrame:
    known = F.when((F.col("ns") > 0) & ~F.isnan("value"), F.col("value"))
    ends = cells.groupBy("feature").agg(F.min(known).alias("lo"), F.max(known).alias("hi"), F.sum("ns").alias("ts"), F.sum("nt").alias("tt"))
    binned = cells.join(ends, "feature").select("feature", "ts", "tt", "ns", "nt", histogram_bin("value", F.col("lo"), F.col("hi"), bins).alias("bin"))
    per = binned.groupBy("feature", "ts", "tt", "bin").agg(F.sum("ns").alias("ns"), F.sum("nt").alias("nt"))
    e, a = F.col("ns") / F.col("ts") + EPS, F.col("nt") / F.col("tt") + EPS
    return per.groupBy("feature").agg(F.sum(F.when(F.col("bin").isNotNull(), (a - e) * F.log(a / e)).otherwise(0.0)).alias("psi"))


def psi(df: DataFrame, cols: list[str], bins: int = 10) -> DataFrame:
    """Population stability index on equal-width bins of the source range.

    Target values outside the range fall in no bin but stay in the denominator.
    """
    return _psi(value_cells(df, cols), bins)


def _ks(cells: DataFrame, p_value: bool, max_group_rows: int) -> DataFrame:
    cells = cells.where("value is not null")
    run = in_order(cells, ["feature"], ["value"], running={"cs": "ns", "ct": "nt"}, max_group_rows=max_group_rows)
    totals = cells.groupBy("feature").agg(F.sum("ns").alias("ts"), F.sum("nt").alias("tt"))
    out = run.join(totals, "feature").groupBy("feature").agg(
        F.max(F.abs(F.col("cs") / F.col("ts") - F.col("ct") / F.col("tt"))).alias("ks"), F.first("ts").alias("n_source"), F.first("tt").alias("n_target"))
    return out.withColumn("ks_p", ks_p("ks", "n_source", "n_target")) if p_value else out


def ks_two_sample(df: DataFrame, cols: list[str], p_value: bool = True, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Largest distance of the two empirical distribution functions, over distinct values."""
    return _ks(value_cells(df, cols), p_value, max_group_rows)


def shift_report(df: DataFrame, cols: list[str], bins: int = 10, p_value: bool = True, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Stability index, KS distance, means and deviations of both sides, from one table of value cells that is read off the data once."""
    cells = materialise(value_cells(df, cols))
    mean = lambda n: F.sum(F.col(n) * F.col("value")) / F.sum(n)
    known = cells.where("value is not null")
    stats = known.groupBy("feature").agg(mean("ns").alias("source_mean"), mean("nt").alias("target_mean"))
    off = known.join(stats, "feature")
    std = lambda n, m: F.sqrt(F.sum(F.col(n) * F.pow(F.col("value") - F.col(m), F.lit(2))) / F.sum(n))
    moments = off.groupBy("feature", "source_mean", "target_mean").agg(std("ns", "source_mean").alias("source_std"), std("nt", "target_mean").alias("target_std"))
    return _psi(cells, bins).join(_ks(cells, p_value, max_group_rows), "feature").join(moments, "feature")


def shift_summary(report: DataFrame) -> DataFrame:
    report = materialise(report)  # one row per feature, read three times
    mid = quantiles(report, [], "psi", {"median_psi": 0.5}).scalar()
    return report.agg(F.avg("psi").alias("mean_psi"), F.max("psi").alias("max_psi"), F.avg("ks").alias("mean_ks"), F.max("ks").alias("max_ks"),
                      F.count_if(F.col("psi") > 0.2).alias("shifted_features")).withColumn("median_psi", mid)


def label_shift_counts(source: DataFrame, target: DataFrame, label: str, predicted: str) -> DataFrame:
    """Class shares of source labels against predicted target classes, with a flag above .1."""
    a = source.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("m"))
    b = target.groupBy(F.col(predicted).alias("class")).agg(F.lit(0).cast("bigint").alias("n"), F.count(F.lit(1)).alias("m"))
    both = a.unionByName(b).groupBy("class").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    t = both.agg(F.struct(F.sum("n").alias("n"), F.sum("m").alias("m")).alias("t")).scalar()
    ps, pt = F.col("n") / t["n"], F.col("m") / t["m"]
    return both.select("class", ps.alias("source_share"), pt.alias("target_share"), (F.abs(pt - ps) > 0.1).alias("shifted"))


def correct_priors(p: Column | str, source_prior: Column | float, target_prior: Column | float) -> Column:
    """Positive-class probability after replacing the class priors."""
    p = F.col(p) if isinstance(p, str) else p
    one, zero = p * target_prior / source_prior, (1 - p) * (1 - target_prior) / (1 - source_prior)
    return one / (one + zero)


#: Log-odds of the priors between which the expected prior is tabulated, and Chebyshev nodes to a unit of them.
ODDS, NODES = 40, 16


def label_shift_em(df: DataFrame, source_prior: float, p: str = "p", max_iter: int = 100, tol: float = 1e-6, variant: str = "saerens") -> tuple[float, int]:
    """Target prior of the positive class and the number of iterations.

    One pass over the distinct probabilities tabulates what an iteration makes of a prior, at the Chebyshev nodes
    of each unit of log-odds. As a function of them every term is a logistic curve, whose nearest singularity lies pi
    away, so 16 nodes interpolate to the last digits; the iterations then run on the table. ``variant='em'``
    weights by the prior alone, without dividing by the source prior.
    """
    base = source_prior if variant == "saerens" else 0.5
    if not 0 < source_prior < 1:  # no iteration leaves the ends
        return source_prior, 1
    cells = df.where(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    angle = np.pi * (np.arange(NODES) + 0.5) / NODES
    nodes = (np.arange(-ODDS, ODDS)[:, None] + 0.5 + 0.5 * np.cos(angle)).reshape(-1)

    def tabulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros(len(nodes)), 0.0
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                q, n = pdf["p"].to_numpy()[i : i + 256, None], pdf["n"].to_numpy()[i : i + 256]
                with np.errstate(divide="ignore", over="ignore"):  # probabilities of 0 and 1 stay what they are
                    total += n @ (1 / (1 + np.exp(np.log1p(-q) - np.log(q) + np.log(base) - np.log1p(-base) - nodes)))
                rows += n.sum()
        yield pd.DataFrame({"at": range(-1, len(nodes)), "s": [rows, *total]})

    sums = cells.mapInPandas(tabulate, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()  # one row per node
    if not sums or not sums[0]["s"]:
        return source_prior, 0
    values = np.array([r["s"] for r in sums[1:]]).reshape(-1, NODES) / sums[0]["s"]
    nodes, weight = nodes.reshape(-1, NODES), (-1.0) ** np.arange(NODES) * np.sin(angle)

    def expected(prior: float) -> float:
        if not 0 < prior < 1:
            return prior
        t = min(max(np.log(prior) - np.log1p(-prior), -ODDS + 1e-9), ODDS - 1e-9)
        unit = int(np.floor(t)) + ODDS
        gap = t - nodes[unit]
        if (gap == 0).any():
            return float(values[unit][gap == 0][0])
        return float((weight / gap) @ values[unit] / (weight / gap).sum())

    prior = source_prior
    for i in range(1, max_iter + 1):
        new = expected(prior)
        if abs(new - prior) * 2**0.5 < tol:
            return prior, i
        prior = new
    return prior, max_iter


def label_shift_confusion(source: DataFrame, target: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Solve C^T prior = q with C = P(predicted | true); counts in Spark, a classes x classes solve here."""
    counts = source.groupBy(y, pred).agg(F.count(F.lit(1)).alias("n")).collect()
    q = {r[0]: r[1] for r in target.groupBy(pred).agg(F.count(F.lit(1))).collect()}
    classes = sorted({r[y] for r in counts} | {r[pred] for r in counts} | set(q))
    at = {c: i for i, c in enumerate(classes)}
    m = np.zeros((len(classes), len(classes)))
    for r in counts:
        m[at[r[y]], at[r[pred]]] = r["n"]
    shares = m.sum(axis=1) / m.sum()
    seen = np.array([q.get(c, 0) for c in classes], dtype=float)
    try:
        prior = np.clip(np.linalg.solve((m / m.sum(axis=1, keepdims=True)).T, seen / seen.sum()), 0, 1)
        prior = prior / prior.sum()
    except np.linalg.LinAlgError:
        prior = shares
    rows = [(c, float(s), float(v)) for c, s, v in zip(classes, shares, prior)]
    return source.sparkSession.createDataFrame(rows, f"class {source.schema[y].dataType.simpleString()}, source_prior double, target_prior double")


def shift_distances(priors: DataFrame, source: str = "source_prior", target: str = "target_prior") -> DataFrame:
    s, t = F.col(source), F.col(target)
    tv = F.sum(F.abs(t - s)) * 0.5
    return priors.agg(
        tv.alias("total_variation"), F.sum((t + EPS) * F.log((t + EPS) / (s + EPS))).alias("kl_divergence"), F.max(F.abs(t - s)).alias("max_class_difference"),
        F.sum((t - s) * (t - s) / s).alias("chi_square"), (tv > 0.1).alias("shift_detected"))


def moment_match(df: DataFrame, reference: DataFrame, cols: list[str]) -> DataFrame:
    """Standardise by the table's own moments, rescale to those of the reference."""
    stats = lambda d: d.agg(F.struct(*[x for c in cols for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))]).alias("s")).scalar()
    a, b = stats(df), stats(reference)
    return df.withColumns({c: (F.col(c) - a[f"{c}_m"]) / (a[f"{c}_s"] + EPS) * (b[f"{c}_s"] + EPS) + b[f"{c}_m"] for c in cols})


def gaussian_weights(source: DataFrame, target: DataFrame, cols: list[str], name: str = "weight") -> DataFrame:
    """Product over features of exp(-|x - target mean| / (2 source std)), scaled to mean 1; nulls count as 1."""
    t = target.agg(F.struct(*[F.avg(c).alias(c) for c in cols]).alias("t")).scalar()
    s = source.agg(F.struct(*[F.stddev_samp(c).alias(c) for c in cols]).alias("s")).scalar()
    w = F.lit(1.0)
    for c in cols:
        one = F.exp(-F.abs(F.col(c) - t[c]) / s[c] / 2)
        w = w * F.coalesce(F.when(s[c] > 0, one), F.lit(1.0))
    raw = source.withColumn("__w", w)
    return raw.select(*source.columns, (F.col("__w") / raw.agg(F.avg("__w")).scalar()).alias(name))


def odds_weights(df: DataFrame, p_target: str, clip_at: float | None = 0.95, name: str = "weight") -> DataFrame:
    """Importance weights p / (1 - p) of a domain classifier, clipped at a quantile, mean 1."""
    raw = df.withColumn("__w", F.col(p_target) / F.greatest(1 - F.col(p_target), F.lit(EPS)))
    if clip_at is not None:
        top = quantiles(raw, [], "__w", {"q": clip_at}).scalar()
        raw = raw.withColumn("__w", F.least("__w", top))
    return raw.select(*df.columns, (F.col("__w") / raw.agg(F.avg("__w")).scalar()).alias(name))


def weight_quality(source: DataFrame, target: DataFrame, cols: list[str], weight: str = "weight") -> DataFrame:
    """Effective sample size, weight statistics and standardised mean differences after weighting."""
    w = F.col(weight)
    aggs = [F.sum(w * F.col(c)).alias(f"wm_{c}") for c in cols] + [F.stddev_pop(c).alias(f"sd_{c}") for c in cols]
    one = source.agg(F.avg(w).alias("mean"), F.stddev_pop(w).alias("std"), F.min(w).alias("min"), F.max(w).alias("max"), F.sum(w).alias("sw"),
                     (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_sample_size"), *aggs)
    t = target.agg(F.struct(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).alias("t")).scalar()
    one = one.select("*", *[t[f"m_{c}"].alias(f"tm_{c}") for c in cols], *[t[f"s_{c}"].alias(f"ts_{c}") for c in cols])
    diffs = []
    for c in cols:
        sd = (F.col(f"sd_{c}") + F.col(f"ts_{c}")) / 2
        diffs.append(F.abs(F.col(f"wm_{c}") / F.col("sw") - F.col(f"tm_{c}")) / F.when(sd == 0, 1.0).otherwise(sd))
    arr = F.array(*diffs)
    mid = quantiles(source, [], weight, {"median": 0.5}).scalar()
    return one.select("mean", "std", "min", "max", mid.alias("median"), "effective_sample_size",
                      (F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / len(cols)).alias("mean_standardized_diff"),
                      F.array_max(arr).alias("max_standardized_diff"), F.size(F.filter(arr, lambda x: x > 0.2)).alias("features_with_large_diff"))


def entropy_confidence(p: str = "p") -> dict[str, Column]:
    a, b = F.greatest(F.col(p), F.lit(EPS)), F.greatest(1 - F.col(p), F.lit(EPS))
    return {"entropy": F.avg(-(a * F.log(a) + b * F.log(b))), "confidence_loss": -F.avg(F.greatest(F.col(p), 1 - F.col(p)))}


def pseudo_label(df: DataFrame, key: list[str], p: str = "p", threshold: float = 0.8, balanced: bool = True, seed: int = 42) -> DataFrame:
    """Confident rows with their predicted label; balanced: as many per class as the rarer class has."""
    sure = df.where(F.greatest(F.col(p), 1 - F.col(p)) > threshold).withColumn("pseudo_label", (F.col(p) > 0.5).cast("int"))
    if not balanced:
        return sure
    placed = shuffled_position(sure, ["pseudo_label"], key, seed)
    least = sure.groupBy("pseudo_label").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).scalar()
    return placed.where(F.col("__pos") <= least).drop("__pos", "__size")
