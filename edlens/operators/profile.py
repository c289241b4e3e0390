"""Profiling: counts, moments, correlation, association, summaries and result tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edlens.functions.pvalues import chi2_p, t_p
from edlens.operators.quantiles import quantiles

WIDE_AGG = 100  # expressions per aggregate: keeps generated methods below the JVM size limit


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def group_counts(df: DataFrame, attributes: list[str]) -> DataFrame:
    """Rows per value of each attribute, with the attribute's number of nulls."""
    long = df.select(*[F.col(a).cast("string").alias(a) for a in attributes]).unpivot([], attributes, "attribute", "group")
    counts = long.groupBy("attribute", "group").agg(F.count(F.lit(1)).alias("n"))
    nulls = counts.groupBy("attribute").agg(F.coalesce(F.sum(F.when(F.col("group").isNull(), F.col("n"))), F.lit(0)).alias("missing"))
    return counts.where(F.col("group").isNotNull()).join(nulls, "attribute")


def category_summary(df: DataFrame, attributes: list[str]) -> DataFrame:
    total = df.agg(F.count(F.lit(1))).scalar()
    return group_counts(df, attributes).withColumn("percent", F.col("n") * 100.0 / total)


def describe_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or numeric_columns(df)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    q = quantiles(long, ["column"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    stats = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    return stats.join(q, "column", "left")


def describe_strings(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Count, distinct values, and the most frequent value (ties: the smallest)."""
    cols = cols or string_columns(df)
    counts = df.select(*cols).unpivot([], cols, "column", "value").where(F.col("value").isNotNull())
    counts = counts.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), F.min_by("value", F.struct(-F.col("n"), "value")).alias("top"), F.max("n").alias("freq")
    )


def grouped_moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def rate_by_group(df: DataFrame, attributes: list[str], label: str) -> DataFrame:
    """Share and count of positives per value of each attribute."""
    long = df.select(F.col(label).alias("__y"), *[F.col(a).cast("string").alias(a) for a in attributes]).unpivot("__y", attributes, "attribute", "group")
    return long.where(F.col("group").isNotNull()).groupBy("attribute", "group").agg(
        F.avg("__y").alias("pass_rate"), F.count("__y").alias("count"), F.sum("__y").alias("pass_count")
    )


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of each column pair, long form (a < b by position)."""
    pairs = list(combinations(cols, 2))
    out = None
    for at in range(0, len(pairs), WIDE_AGG):
        part = pairs[at : at + WIDE_AGG]
        row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(part)])
        cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(part)]
        long = row.select(F.inline(F.array(*cells)))
        out = long if out is None else out.unionByName(long)
    return out


def corr_with_target(df: DataFrame, cols: list[str], label: str, top: int = 10) -> DataFrame:
    row = df.agg(*[F.abs(F.corr(c, label)).alias(c) for c in cols])
    return row.unpivot([], cols, "feature", "abs_corr").orderBy(F.desc("abs_corr"), "feature").limit(top)


def class_balance(df: DataFrame, label: str) -> DataFrame:
    zero, one = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.agg(zero.alias("class_0"), one.alias("class_1"), (zero / F.nullif(one, F.lit(0))).alias("imbalance_ratio"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def pair_cells(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Contingency cells of several column pairs from one pass: (a, b, va, vb, n) with margins."""
    rows = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("va"), F.col(b).cast("string").alias("vb")) for a, b in pairs
    ]
    long = df.select(F.inline(F.array(*rows))).where(F.col("va").isNotNull() & F.col("vb").isNotNull())
    cells = long.groupBy("a", "b", "va", "vb").agg(F.count(F.lit(1)).alias("n"))
    total = cells.groupBy("a", "b").agg(F.sum("n").alias("total"))
    for side, name in (("va", "row_n"), ("vb", "col_n")):
        cells = cells.join(cells.groupBy("a", "b", side).agg(F.sum("n").alias(name)), ["a", "b", side])
    return cells.join(total, ["a", "b"])


def association(df: DataFrame, pairs: list[tuple[str, str]], p_value: bool = True) -> DataFrame:
    """Chi-square (continuity-corrected for 2 x 2) with plain and bias-corrected Cramer's V.

    Absent cells need no zero rows: the plain statistic is N (sum n_ij^2 / (r_i c_j) - 1), and in a
    2 x 2 table every cell has the same distance from its expectation. The k cells of a row each
    add n / row total of it, so sums over cells also give the number of rows and the sum of 1 / row.
    """
    cells = pair_cells(df, pairs)
    n, r, c, total = (F.col(x) for x in ("n", "row_n", "col_n", "total"))
    sums = cells.groupBy("a", "b").agg(
        F.max("total").alias("n"),
        F.round(F.sum(n / r)).cast("bigint").alias("rows"),
        F.round(F.sum(n / c)).cast("bigint").alias("cols"),
        F.sum(n / r * n / c).alias("__q"),
        F.max(F.abs(n - r * c / total)).alias("__d"),
        F.sum(n / (r * r)).alias("__ir"),
        F.sum(n / (c * c)).alias("__ic"),
    )
    n = F.col("n")
    plain = F.greatest(n * (F.col("__q") - 1), F.lit(0.0))
    yates = F.pow(F.greatest(F.col("__d") - 0.5, F.lit(0.0)), F.lit(2)) * n * F.col("__ir") * F.col("__ic")
    dof = (F.col("rows") - 1) * (F.col("cols") - 1)
    out = sums.select("a", "b", "n", "rows", "cols", dof.alias("dof"), F.when(dof == 1, yates).otherwise(plain).alias("chi2"))
    phi2, k, q = F.col("chi2") / F.col("n"), F.col("cols"), F.col("rows")
    least = F.least(q, k) - 1
    shrink = lambda m: m - F.pow(m - 1, F.lit(2)) / (F.col("n") - 1)
    corrected = F.greatest(phi2 - (k - 1) * (q - 1) / (F.col("n") - 1), F.lit(0.0))
    out = out.select(
        "*",
        F.when(least > 0, F.sqrt(phi2 / least)).otherwise(0.0).alias("cramers_v"),
        F.when(least > 0, F.sqrt(corrected / (F.least(shrink(q), shrink(k)) - 1))).otherwise(0.0).alias("cramers_v_corrected"),
    )
    return out.withColumn("p_value", chi2_p("chi2", "dof")) if p_value else out


def cramers_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    return association(df, list(combinations(cols, 2)), p_value=False).select("a", "b", "cramers_v", "cramers_v_corrected")


def quantile_bin(df: DataFrame, cols: list[str], k: int = 10) -> DataFrame:
    """Replace numeric columns by the index of their quantile bin (number of cut points below); null stays null."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    cuts = quantiles(long, ["column"], "value", {f"q{i}": i / k for i in range(1, k)}).collect()  # one row per column
    at = {r["column"]: [r[f"q{i}"] for i in range(1, k)] for r in cuts}
    binned = {c: F.when(F.col(c).isNotNull(), sum((F.when(F.col(c) > v, 1).otherwise(0) for v in at.get(c, [])), F.lit(0))) for c in cols}
    return df.withColumns(binned)


def mutual_information(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Plug-in mutual information (nats) of discrete features with the label, strongest first."""
    cells = pair_cells(df, [(f, label) for f in features])
    p = F.col("n") / F.col("total")
    return cells.groupBy(F.col("a").alias("feature")).agg(
        F.sum(p * F.log(F.col("n") * F.col("total") / (F.col("row_n") * F.col("col_n")))).alias("mutual_information")
    ).orderBy(F.desc("mutual_information"), "feature")


def dataset_summary(df: DataFrame, rates: list[str], distinct: list[str]) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(r).alias(f"{r}_rate") for r in rates],
        *[F.count_distinct(c).alias(f"{c}_distinct") for c in distinct],
    )


def risk_list(preds: DataFrame, keys: list[str], prob: str, threshold: float) -> DataFrame:
    """Mean and top risk per group; null keys are a group of their own.

    The mean is compared after rounding to 12 places, so the flag does not depend on summation order.
    """
    return preds.groupBy(*keys).agg(F.avg(prob).alias("prob_avg"), F.max(prob).alias("prob_max"), F.count(prob).alias("n_rows")).withColumn(
        "high_risk", (F.round("prob_avg", 12) >= threshold).cast("int")
    )


# The quantile levels of the score report.
SCORE_LEVELS = [0.0, 0.01, 0.05, 0.1, 0.5, 0.9, 0.95, 0.99, 1.0]


def score_quantiles(df: DataFrame, score: str, levels: list[float] = SCORE_LEVELS) -> DataFrame:
    names = {f"q{round(p * 100):02d}": p for p in levels}
    q = quantiles(df, [], score, names)
    stats = df.agg(F.count(score).alias("count"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"))
    s = stats.select(F.struct("*").alias("s")).scalar()
    return q.select(s["count"].alias("count"), s["mean"].alias("mean"), s["std"].alias("std"), *names)


def top_and_bottom(df: DataFrame, by: list[str], score: str, n: int = 5) -> DataFrame:
    """Groups with the highest and the lowest mean score."""
    means = df.groupBy(*by).agg(F.avg(score).alias("mean_pred"))
    top = means.orderBy(F.desc("mean_pred"), *by).limit(n).withColumn("side", F.lit("top"))
    low = means.orderBy("mean_pred", *by).limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


def concept_effects(df: DataFrame, concepts: list[str], outcome: str) -> DataFrame:
    """Absolute slope of the outcome on each concept, and their correlation."""
    parts = [x for c in concepts for x in (F.abs(F.regr_slope(F.col(outcome), F.col(c))).alias(f"s_{c}"), F.corr(c, outcome).alias(f"r_{c}"))]
    cells = [F.struct(F.lit(c).alias("concept"), F.col(f"s_{c}").alias("effect"), F.col(f"r_{c}").alias("corr")) for c in concepts]
    return df.agg(*parts).select(F.inline(F.array(*cells))).orderBy(F.desc("effect"), "concept")


def transfer_matrix(results: DataFrame, source: str, target: str, metric: str, targets: list[str]) -> DataFrame:
    return results.groupBy(source).pivot(target, targets).agg(F.avg(metric)).na.fill(0)


def component_effects(results: DataFrame, flags: list[str], metric: str, p_value: bool = True) -> DataFrame:
    """Mean metric with and without each flag, and the pooled two-sample t of the difference."""
    long = results.select(F.col(metric).alias("__m"), *flags).unpivot("__m", flags, "component", "on")
    on = F.coalesce(F.col("on"), F.lit(False))
    w, o = F.when(on, F.col("__m")), F.when(~on, F.col("__m"))
    g = long.groupBy("component").agg(
        F.avg(w).alias("mean_with"), F.avg(o).alias("mean_without"), F.count(w).alias("n_with"), F.count(o).alias("n_without"),
        F.var_samp(w).alias("v1"), F.var_samp(o).alias("v0"),
    ).where("n_with > 0 AND n_without > 0")
    df = F.col("n_with") + F.col("n_without") - 2
    pooled = ((F.col("n_with") - 1) * F.col("v1") + (F.col("n_without") - 1) * F.col("v0")) / df
    effect = F.col("mean_with") - F.col("mean_without")
    t = F.when((F.col("n_with") > 1) & (F.col("n_without") > 1), effect / F.sqrt(pooled * (1 / F.col("n_with") + 1 / F.col("n_without"))))
    out = g.select("component", "mean_with", "mean_without", "n_with", "n_without", effect.alias("effect_size"), t.alias("t"))
    return out.withColumn("p_value", t_p("t", F.col("n_with") + F.col("n_without") - 2)) if p_value else out


def leaderboard(results: DataFrame, name: str, metrics: list[str]) -> DataFrame:
    """Best and worst run and the spread of each metric."""
    long = results.unpivot(name, metrics, "metric", "value").where(F.col("value").isNotNull())
    return long.groupBy("metric").agg(
        F.min_by(name, F.struct(-F.col("value"), F.col(name))).alias("best"), F.max("value").alias("best_value"),
        F.min_by(name, F.struct("value", name)).alias("worst"), F.min("value").alias("worst_value"),
        (F.max("value") - F.min("value")).alias("spread"),
    )


def robust_runs(results: DataFrame, name: str, std: str) -> DataFrame:
    """Runs whose spread lies below the median spread."""
    mid = quantiles(results, [], std, {"m": 0.5}).scalar()
    return results.where(F.col(std) < mid).select(name, std)


def best_per_group(results: DataFrame, by: list[str], metric: str, name: str) -> DataFrame:
    return results.groupBy(*by).agg(F.min_by(name, F.struct(-F.col(metric), F.col(name))).alias(name), F.max(metric).alias(metric))


def top_n(results: DataFrame, by: list[str], metric: str, name: str, n: int = 10) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(metric), name)
    return results.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def multi_attribute(df: DataFrame, attributes: list[str], aggs: list[Column], pairs: bool = True) -> DataFrame:
    """Aggregates per attribute and per attribute pair through grouping sets."""
    sets = [[F.col(a)] for a in attributes]
    if pairs:
        sets += [[F.col(a), F.col(b)] for a, b in combinations(attributes, 2)]
    grouped = df.groupingSets(sets, *[F.col(a) for a in attributes])
    level = F.concat_ws("+", *[F.when(F.grouping(a) == 0, F.lit(a)) for a in attributes])
    return grouped.agg(level.alias("level"), *aggs)
