"""Resampling and hypothesis tests.

Resampling never copies the data: rows are first counted per distinct cell (or summed per
cluster), and every replicate reweights those with Poisson draws hashed from the cell and the
replicate number. p-values come last, on tables with one row per test.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edlens.functions.hashing import hashed_unit, key_unit, poisson_draw, poisson_one, poisson_table
from edlens.functions.pvalues import chi2_p, f_p, normal_p, t_p, t_quantile
from edlens.operators.metrics import ratio, score_cells
from edlens.operators.ordered import in_order, null_safe_join
from edlens.operators.quantiles import quantiles
from edlens.session import fan_out, materialise

Metrics = Callable[[Column], dict[str, Column]]


def weighted_mean(value: Column | str, w: Column) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.sum(value * w) / F.sum(w)


def summarise_replicates(reps: DataFrame, by: list[str], names: list[str], level: float = 0.95) -> DataFrame:
    """Mean, population std and percentile interval of each metric over the replicates."""
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    long = reps.unpivot([*by, "rep"], names, "metric", "value")
    q = quantiles(long, [*by, "metric"], "value", {"ci_lower": lo, "ci_upper": hi})
    m = long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return null_safe_join(m, q, [*by, "metric"]).withColumn("ci_width", F.col("ci_upper") - F.col("ci_lower"))


def bootstrap_replicates(df: DataFrame, by: list[str], cell: list[str], metrics: Metrics, reps: int = 1000, seed: int = 42) -> DataFrame:
    """One row per (group, replicate). ``metrics`` gets the weight column and returns aggregate columns.

    A cell that stands for n equal rows gets one Poisson(n) weight, the sum of its n Poisson(1) weights.
    """
    cells = fan_out(df.groupBy(*by, *cell).agg(F.count(F.lit(1)).cast("double").alias("__n")), *by, *cell).withColumn("__table", poisson_table(F.col("__n")))
    drawn = cells.select("*", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    drawn = drawn.withColumn("__w", poisson_draw([*by, *cell, "rep"], seed, F.col("__n"), F.col("__table")))
    return drawn.groupBy(*by, "rep").agg(*[c.alias(n) for n, c in metrics(F.col("__w")).items()])


def bootstrap_ci(df: DataFrame, by: list[str], cell: list[str], metrics: Metrics, reps: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    out = bootstrap_replicates(df, by, cell, metrics, reps, seed)
    return summarise_replicates(out, by, [c for c in out.columns if c not in (*by, "rep")], level)


def label_metrics(w: Column, y: str = "y", pred: str = "pred") -> dict[str, Column]:
    """Weighted accuracy, precision, recall and F1 over (y, pred) cells."""
    hit, pos = F.col(y) == 1, F.col(pred) == 1
    s = lambda cond: F.sum(F.when(cond, w).otherwise(0.0))
    tp, fp, fn = s(hit & pos), s(~hit & pos), s(hit & ~pos)
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return {"accuracy": s(hit == pos) / F.sum(w), "precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn), "f1": safe(2 * tp, 2 * tp + fp + fn)}


def cluster_bootstrap(df: DataFrame, cluster: str, sums: dict[str, Column], metrics: Callable[[], dict[str, Column]], reps: int = 1000, seed: int = 42,
                      with_multiplicity: bool = False, level: float = 0.95) -> DataFrame:
    """Resample clusters. ``sums`` are additive columns per cluster, ``metrics`` combines their totals.

    Without multiplicity a cluster drawn twice counts once, as a membership test would have it.
    """
    per = df.groupBy(cluster).agg(*[c.alias(n) for n, c in sums.items()])
    drawn = per.select("*", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    w = poisson_one(key_unit([cluster, "rep"], seed))
    drawn = drawn.withColumn("__w", w if with_multiplicity else F.least(w, F.lit(1.0)))
    totals = drawn.groupBy("rep").agg(*[F.sum(F.col(n) * F.col("__w")).alias(n) for n in sums])
    wanted = metrics()
    return summarise_replicates(totals.select("rep", *[c.alias(n) for n, c in wanted.items()]), [], list(wanted), level)


#: Distinct scores that one task walks through at a time, with a weight per replicate for each.
SCORE_RANGE = 1024


def _ranges(cells: DataFrame, by: list[str]) -> DataFrame:
    """Distinct scores of each group with ``__part``, the number of their range, from the highest score down."""
    placed = in_order(cells.withColumn("__neg", -F.col("score")), by, ["__neg"], position="__at")
    return placed.withColumn("__part", F.expr(f"(__at - 1) div {SCORE_RANGE}")).drop("__neg", "__at")


def _score_metrics(drawn: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """(by, rep) with accuracy, precision, recall, F1, ROC-AUC and average precision.

    ``drawn``: ``score``, ``__part`` and the arrays ``wp``, ``wn``, the drawn positives and negatives of the score in
    each replicate. A task adds up one range of scores for all replicates at once; what lies above a range
    is carried into it as one sum per replicate.
    """
    kinds = [f"`{c}` {drawn.schema[c].dataType.simpleString()}" for c in by]
    ranges = [*by, "__part"]

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[ranges].iloc[:1].assign(tp=[np.stack(pdf["wp"]).sum(axis=0)], fp=[np.stack(pdf["wn"]).sum(axis=0)])

    sums = drawn.groupBy(*ranges).applyInPandas(total, ", ".join([*kinds, "__part bigint, tp array<double>, fp array<double>"]))
    each = sums.select(*ranges, F.posexplode(F.arrays_zip("tp", "fp")).alias("rep", "s"))
    above = Window.partitionBy(*by, "rep").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = lambda c: F.coalesce(F.sum(f"s.{c}").over(above), F.lit(0.0)).alias(c)
    each = each.select(*ranges, "rep", carried("tp"), carried("fp"))
    carry = each.groupBy(*ranges).agg(F.array_sort(F.collect_list(F.struct("rep", "tp", "fp"))).alias("c")).select(*ranges, F.col("c.tp").alias("tp"), F.col("c.fp").alias("fp"))

    def walk(cells: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("score", ascending=False)
        wp, wn = np.stack(cells["wp"]), np.stack(cells["wn"])
        tp = np.asarray(before["tp"].iloc[0]) + wp.cumsum(axis=0)
        called = tp + np.asarray(before["fp"].iloc[0]) + wn.cumsum(axis=0)
        hit = (cells["score"] >= threshold).to_numpy()
        out = pd.DataFrame({"rep": np.arange(1, wp.shape[1] + 1), "pos": wp.sum(axis=0), "neg": wn.sum(axis=0), "area": (wn * (tp - wp / 2)).sum(axis=0),
                            "ap": (wp * tp / np.maximum(called, 1)).sum(axis=0), "hits": wp[hit].sum(axis=0), "false": wn[hit].sum(axis=0)})
        for c in by:
            out[c] = pd.Series([cells[c].iloc[0]] * len(out), dtype=cells[c].dtype)
        return out[[*by, "rep", "pos", "neg", "area", "ap", "hits", "false"]]

    names = ["pos", "neg", "area", "ap", "hits", "false"]
    schema = ", ".join([*kinds, "rep int", *(f"{n} double" for n in names)])
    parts = drawn.groupBy(*ranges).cogroup(carry.groupBy(*ranges)).applyInPandas(walk, schema)
    g = parts.groupBy(*by, "rep").agg(*[F.sum(n).alias(n) for n in names])
    pos, neg, hits, false = (F.col(n) for n in ("pos", "neg", "hits", "false"))
    precision, recall = ratio(hits, hits + false), ratio(hits, pos)
    return g.select(*by, "rep", ratio(hits + neg - false, pos + neg).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), ratio(2 * hits, hits + false + pos).alias("f1"),
                    ratio(F.col("area"), pos * neg, 0.5).alias("roc_auc"), ratio(F.col("ap"), pos).alias("average_precision"))


SCORE_METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "average_precision"]


def bootstrap_scores(df: DataFrame, by: list[str], reps: int = 1000, seed: int = 42, level: float = 0.95, threshold: float = 0.5, y: str = "y", p: str = "p") -> DataFrame:
    """Intervals of the threshold metrics, ROC-AUC and average precision of a score, all from the same resamples.

    Positives and negatives are counted per distinct score; a replicate reweights these cells. Rows without label or score
    take no part; null groups are groups; a replicate without positives or negatives has an AUC of one half.
    """
    cells = _ranges(score_cells(df, by, y, p), by)
    counts = {"p": F.col("pos").cast("double"), "n": (F.col("n") - F.col("pos")).cast("double")}
    cells = fan_out(cells.select("*", *(poisson_table(c).alias(f"__t{k}") for k, c in counts.items())), *by, "score")  # the shuffle keeps the tables, one per cell
    draws = lambda k: F.transform(F.sequence(F.lit(1), F.lit(reps)), lambda r: poisson_draw([*by, "score", r, F.lit(k)], seed, counts[k], F.col(f"__t{k}")))
    drawn = cells.select(*by, "score", "__part", draws("p").alias("wp"), draws("n").alias("wn"))
    return summarise_replicates(_score_metrics(drawn, by, threshold), by, SCORE_METRICS, level)


def cluster_bootstrap_scores(df: DataFrame, cluster: str, reps: int = 1000, seed: int = 42, with_multiplicity: bool = False, level: float = 0.95, threshold: float = 0.5, y: str = "y", p: str = "p") -> DataFrame:
    """The same metrics when whole clusters are resampled, on the draws of ``cluster_bootstrap``.

    A cluster's counts per score meet its draw of every replicate; sums per (score, replicate) are combined before
    the shuffle, so neither a score nor a cluster in a third of all rows fills a task.
    """
    cells = score_cells(df, [cluster], y, p)
    drawn = fan_out(cells, cluster, "score").select("*", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    w = poisson_one(key_unit([cluster, "rep"], seed))
    drawn = drawn.withColumn("__w", w if with_multiplicity else F.least(w, F.lit(1.0)))
    sums = drawn.groupBy("score", "rep").agg(F.sum(F.col("pos") * F.col("__w")).alias("wp"), F.sum((F.col("n") - F.col("pos")) * F.col("__w")).alias("wn"))
    arrays = sums.groupBy("score").agg(F.array_sort(F.collect_list(F.struct("rep", "wp", "wn"))).alias("a"))
    arrays = materialise(_ranges(arrays.select("score", F.col("a.wp").alias("wp"), F.col("a.wn").alias("wn")), []))
    return summarise_replicates(_score_metrics(arrays, [], threshold), [], SCORE_METRICS, level)


def _p_value(reps: DataFrame, observed: Column, alternative: str) -> Column:
    hit = {
        "two-sided": F.abs(F.col("diff")) >= F.abs(observed), "greater": F.col("diff") >= observed, "less": F.col("diff") <= observed,
    }[alternative]
    return F.avg(hit.cast("int"))


def _observed(df: DataFrame, arm: str, value: str) -> DataFrame:
    a, b = F.when(F.col(arm) == 1, F.col(value)), F.when(F.col(arm) == 0, F.col(value))
    return df.agg(F.struct(F.avg(a).alias("m1"), F.avg(b).alias("m0"), F.count(a).alias("n1"), F.count(b).alias("n0"), F.sum(value).alias("s")).alias("o"))


def bootstrap_two_sample(df: DataFrame, arm: str, value: str, reps: int = 1000, seed: int = 42, alternative: str = "two-sided") -> DataFrame:
    """Difference of means against both arms redrawn from the pooled values."""
    o = _observed(df, arm, value).scalar()
    observed = o["m1"] - o["m0"]
    cells = df.where(F.col(arm).isin(0, 1)).groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    share = o["n1"] / (o["n1"] + o["n0"])
    cells = cells.select(value, (F.col("__n") * share).alias("__r1"), (F.col("__n") * (1 - share)).alias("__r0"))
    drawn = fan_out(cells, value).select("*", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    w1 = poisson_draw([value, "rep", F.lit("a")], seed, F.col("__r1"))
    w0 = poisson_draw([value, "rep", F.lit("b")], seed, F.col("__r0"))
    diffs = drawn.groupBy("rep").agg((weighted_mean(value, w1) - weighted_mean(value, w0)).alias("diff"))
    return diffs.agg(F.first(observed).alias("observed"), _p_value(diffs, observed, alternative).alias("p_value"), F.count(F.lit(1)).alias("replicates"))


#: Value cells below one node of the tree along which relabelled rows are handed down.
FAN = 1024


def hypergeometric(good: int, bad: int, draws: int, u: float) -> int:
    """How many of ``draws`` drawn without replacement are good, by inversion at ``u``.

    Probabilities relative to the mode come from ratios of neighbours, out to where they vanish; their sum
    normalises them, so populations of any size lose no digits.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    n = good + bad
    mode = min(max((draws + 1) * (good + 1) // (n + 2), low), high)
    reach = int(12 * (draws * (good / n) * (bad / n) * (n - draws) / max(1, n - 1)) ** 0.5) + 64
    up = np.arange(mode, min(high, mode + reach), dtype=float)
    rising = np.cumprod((good - up) / (up + 1) * ((draws - up) / (bad - draws + up + 1)))
    down = np.arange(mode, max(low, mode - reach), -1, dtype=float)
    falling = np.cumprod(down / (good - down + 1) * ((bad - draws + down) / (draws - down + 1)))
    mass = np.concatenate([falling[::-1], [1.0], rising]).cumsum()
    return mode - len(falling) + min(int(np.searchsorted(mass, u * mass[-1], side="right")), len(mass) - 1)


def permutation_test(df: DataFrame, key: str, arm: str, value: str, reps: int = 1000, seed: int = 42, alternative: str = "two-sided") -> DataFrame:
    """Difference of means against exact random relabellings of n1 rows.

    Rows are counted per distinct value. A relabelling takes a multivariate hypergeometric number of rows from
    each cell: the n1 rows are handed down a tree over the cells, ``FAN`` children to a node, one draw to a child
    on a hash of (replicate, child). Cost follows cells and replicates, not rows; ``key`` is kept for callers.
    """
    rows = df.where(F.col(arm).isin(0, 1)).select(arm, F.col(value).cast("double").alias("__v"))
    o = _observed(rows, arm, "__v").scalar()
    counts = rows.groupBy("__v").agg(F.count(F.lit(1)).alias("n"))
    cells = materialise(in_order(counts.where("__v is not null"), [], ["__v"], position="at").select((F.col("at") - 1).alias("cell"), "__v", "n"))
    size = cells.count()
    levels = 1
    while FAN**levels < size:
        levels += 1
    first = rows.agg(F.count(F.when(F.col(arm) == 1, F.col("__v"))).alias("n1"))
    handed = first.select(F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"), F.lit(0).cast("bigint").alias("node"), "n1")
    for level in range(levels, 0, -1):
        node, child = F.expr(f"cell div {FAN**level}"), F.expr(f"cell div {FAN ** (level - 1)}")
        under = cells.groupBy(node.alias("node"), child.alias("child")).agg(F.sum("n").alias("n"), F.min("__v").alias("v"))
        under = under.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("child", "n", "v"))).alias("kids")).select("node", F.col("kids.child").alias("child"), F.col("kids.n").alias("n"), F.col("kids.v").alias("v"))
        last = level == 1

        def deal(batches: Iterator[pd.DataFrame], level=level, last=last) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for rep, left, child, n, v in zip(pdf["rep"], pdf["n1"], pdf["child"], pdf["n"], pdf["v"]):
                    rest, total = int(sum(n)), 0.0
                    for c, m, x in zip(child, n, v):
                        rest -= int(m)
                        k = hypergeometric(int(m), rest, int(left), hashed_unit(f"{rep}|{level - 1}|{c}|{seed}"))
                        left -= k
                        if last:
                            total += k * x
                        elif k:
                            out.append((rep, c, k))
                    if last:
                        out.append((rep, total))
                yield pd.DataFrame(out, columns=["rep", "sum"] if last else ["rep", "node", "n1"])

        met = fan_out(handed.join(under, "node").select("rep", "n1", "child", "n", "v"), "rep")
        handed = met.mapInPandas(deal, "rep int, sum double" if last else "rep int, node bigint, n1 bigint")
    sums = handed.groupBy("rep").agg(F.sum("sum").alias("a"))
    diffs = materialise(sums.select("rep", (F.col("a") / o["n1"] - (o["s"] - F.col("a")) / o["n0"]).alias("diff")))
    observed = o["m1"] - o["m0"]
    return diffs.agg(F.first(observed).alias("observed"), _p_value(diffs, observed, alternative).alias("p_value"), F.avg("diff").alias("mean_diff"), F.count(F.lit(1)).alias("replicates"))


def mcnemar(df: DataFrame, pairs: list[tuple[str, str]], y: str = "y", p_value: bool = True) -> DataFrame:
    """Continuity-corrected McNemar statistic for pairs of prediction columns, from one pass."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, (a, b) in enumerate(pairs):
        ca, cb = F.col(a) == F.col(y), F.col(b) == F.col(y)
        aggs += [F.count_if(ca & cb).alias(f"bc{i}"), F.count_if(ca & ~cb).alias(f"b{i}"), F.count_if(~ca & cb).alias(f"c{i}"), F.count_if(~ca & ~cb).alias(f"bw{i}")]
    rows = []
    for i, (m1, m2) in enumerate(pairs):
        bc, b, c, bw = (F.col(f"{x}{i}") for x in ("bc", "b", "c", "bw"))
        stat = F.when(b + c == 0, 0.0).otherwise(F.pow(F.abs(b - c) - 1, F.lit(2)) / (b + c))
        rows.append(F.struct(
            F.lit(m1).alias("model_1"), F.lit(m2).alias("model_2"), bc.alias("both_correct"), b.alias("only_1"), c.alias("only_2"), bw.alias("both_wrong"),
            stat.alias("statistic"), ((bc + b) / F.col("n")).alias("accuracy_1"), ((bc + c) / F.col("n")).alias("accuracy_2"),
            ((b - c) / F.col("n")).alias("accuracy_diff"), ((b + c) / F.col("n")).alias("disagreement"),
        ))
    out = df.agg(*aggs).select(F.inline(F.array(*rows)))
    return out.withColumn("p_value", F.when(F.col("only_1") + F.col("only_2") == 0, 1.0).otherwise(chi2_p("statistic", F.lit(1)))) if p_value else out


def correct_p_values(tests: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Bonferroni and Holm decisions over all rows of a test table (one row per model pair)."""
    n = tests.agg(F.count(F.lit(1))).scalar()
    w = Window.orderBy(p, *[c for c in tests.columns if c != p])
    ranked = tests.withColumn("__i", F.row_number().over(w) - 1)
    step = (F.col(p) <= alpha / (n - F.col("__i"))).cast("int")
    ranked = ranked.withColumn("__ok", F.min(step).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return ranked.select(*tests.columns, (F.col(p) < alpha / n).alias("bonferroni_significant"), (F.col("__ok") == 1).alias("holm_significant"))


def pairwise_compare(df: DataFrame, models: list[str], y: str = "y", alpha: float = 0.05) -> DataFrame:
    return correct_p_values(mcnemar(df, list(combinations(models, 2)), y), alpha=alpha)


def paired_t(df: DataFrame, by: list[str], a: str, b: str, alpha: float = 0.05, p_value: bool = True) -> DataFrame:
    """t, confidence interval of the mean difference and Cohen's d of paired columns."""
    d = F.col(a) - F.col(b)
    g = df.groupBy(*by).agg(F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("__s"), F.count(d).alias("n"))
    m, s, se = F.col("mean_difference"), F.col("__s"), F.col("__s") / F.sqrt("n")
    out = g.select(*by, "mean_difference", "n", (F.col("n") - 1).alias("df"), F.when(s > 0, m / se).alias("t"), F.when(s > 0, m / s).otherwise(0.0).alias("cohens_d"), se.alias("se"))
    if not p_value:
        return out
    half = t_quantile(1 - alpha / 2, "df") * F.col("se")
    return out.select("*", t_p("t", "df").alias("p_value"), (m - half).alias("ci_lower"), (m + half).alias("ci_upper"))


def group_moments(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def one_way_anova(df: DataFrame, group: str, value: str, p_value: bool = True) -> DataFrame:
    g = group_moments(df, group, value)
    grand = g.agg(F.sum(F.col("n") * F.col("mean")) / F.sum("n")).scalar()
    s = g.agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - grand, F.lit(2))).alias("ssb"), F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("ssw"),
        (F.count(F.lit(1)) - 1).alias("df_between"), (F.sum("n") - F.count(F.lit(1))).alias("df_within"),
    )
    f = (F.col("ssb") / F.col("df_between")) / (F.col("ssw") / F.col("df_within"))
    out = s.select("*", f.alias("f"), (F.col("ssb") / (F.col("ssb") + F.col("ssw"))).alias("eta_squared"))
    return out.withColumn("p_value", f_p("f", "df_between", "df_within")) if p_value else out


# Critical values at 5 % by number of groups (used for every unlisted case: k = 5).
CRITICAL_5 = {3: 3.314, 4: 3.633, 5: 3.858, 6: 4.030, 7: 4.170, 8: 4.286, 9: 4.387, 10: 4.474}


def critical_value(k: Column) -> Column:
    pairs = [F.lit(x) for kv in CRITICAL_5.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), k.cast("int")), F.lit(CRITICAL_5[5]))


def tukey_pairs(df: DataFrame, group: str, value: str) -> DataFrame:
    """All group pairs: mean difference, pooled standard error, q statistic against a critical value, Cohen's d."""
    g = group_moments(df, group, value)
    t = g.agg(F.struct(
        (F.sum((F.col("n") - 1) * F.col("var")) / (F.sum("n") - F.count(F.lit(1)))).alias("msw"), F.count(F.lit(1)).alias("k")).alias("t")).scalar()
    a = g.select(F.col(group).alias("group_1"), F.col("n").alias("n1"), F.col("mean").alias("m1"), F.col("var").alias("v1"))
    b = g.select(F.col(group).alias("group_2"), F.col("n").alias("n2"), F.col("mean").alias("m2"), F.col("var").alias("v2"))
    pair = a.join(b, F.col("group_1") < F.col("group_2"))
    diff = F.col("m2") - F.col("m1")
    se = F.sqrt(t["msw"] / 2 * (1 / F.col("n1") + 1 / F.col("n2")))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    return pair.select(
        "group_1", "group_2", diff.alias("mean_diff"), se.alias("se"), (F.abs(diff) / se).alias("q"), critical_value(t["k"]).alias("q_critical"),
        (F.abs(diff) / se > critical_value(t["k"])).alias("significant"), F.when(pooled > 0, -diff / pooled).otherwise(0.0).alias("cohens_d"),
    )


def rm_anova(df: DataFrame, subject: str, model: str, score: str, p_value: bool = True) -> DataFrame:
    """Model and subject effects of a balanced subject x model table."""
    grand = df.agg(F.avg(score)).scalar()
    c = df.select(subject, model, (F.col(score) - grand).alias("__c"))
    total = c.agg(F.struct(F.sum(F.col("__c") * F.col("__c")).alias("ss"), F.count(F.lit(1)).alias("n")).alias("t")).scalar()

    def effect(key: str) -> Column:
        g = c.groupBy(key).agg(F.sum("__c").alias("s"), F.count(F.lit(1)).alias("m"))
        return g.agg(F.struct(F.sum(F.col("s") * F.col("s") / F.col("m")).alias("ss"), F.count(F.lit(1)).alias("k")).alias("e")).scalar()

    m, s = effect(model), effect(subject)
    one = df.sparkSession.range(1).select(
        m["ss"].alias("ss_model"), s["ss"].alias("ss_subject"), (total["ss"] - m["ss"] - s["ss"]).alias("ss_error"), (m["k"] - 1).alias("df_model"),
        (s["k"] - 1).alias("df_subject"), ((m["k"] - 1) * (s["k"] - 1)).alias("df_error"), (m["k"] * s["k"] == total["n"]).alias("balanced"),
    )
    mse = F.col("ss_error") / F.col("df_error")
    out = one.select(
        "*", (F.col("ss_model") / F.col("df_model") / mse).alias("model_f"), (F.col("ss_subject") / F.col("df_subject") / mse).alias("subject_f"),
        (F.col("ss_model") / (F.col("ss_model") + F.col("ss_error"))).alias("partial_eta_squared"),
    )
    return out.withColumn("model_p", f_p("model_f", "df_model", "df_error")) if p_value else out


def block_ranks(df: DataFrame, block: str, model: str, score: str) -> DataFrame:
    """Average ranks inside each block; a block has one row per model, so it stays small."""
    w = Window.partitionBy(block)
    ties = F.count(F.lit(1)).over(Window.partitionBy(block, score))
    return df.select(block, model, (F.rank().over(w.orderBy(score)) + (ties - 1) / 2.0).alias("rank"), ties.alias("ties"))


def friedman(df: DataFrame, block: str, model: str, score: str, p_value: bool = True) -> DataFrame:
    """Tie-corrected Friedman statistic and Kendall's W."""
    r = block_ranks(df, block, model, score)
    ties = r.agg(F.sum(F.col("ties") * F.col("ties") - 1)).scalar()  # each tied group of t rows adds t (t^2 - 1)
    sums = r.groupBy(model).agg(F.sum("rank").alias("s"), F.count(F.lit(1)).alias("n"))
    k, n = F.count(F.lit(1)), F.max("n")
    g = sums.agg(k.alias("k"), n.alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"), (F.var_pop("s") * k).alias("dev"))
    K, N = F.col("k"), F.col("n")
    correction = 1 - ties / (K * (K * K - 1) * N)
    stat = (12.0 / (K * N * (K + 1)) * F.col("ss") - 3 * N * (K + 1)) / correction
    out = g.select(stat.alias("statistic"), (12 * F.col("dev") / (N * N * (K * K * K - K))).alias("kendalls_w"), N.alias("n_blocks"), K.alias("k_models"))
    return out.withColumn("p_value", chi2_p("statistic", F.col("k_models") - 1)) if p_value else out


def nemenyi(df: DataFrame, block: str, model: str, score: str) -> DataFrame:
    ranks = block_ranks(df, block, model, score).groupBy(model).agg(F.avg("rank").alias("r"), F.count(F.lit(1)).alias("n"))
    k = ranks.agg(F.count(F.lit(1))).scalar()
    a = ranks.select(F.col(model).alias("model_1"), F.col("r").alias("avg_rank_1"), "n")
    b = ranks.select(F.col(model).alias("model_2"), F.col("r").alias("avg_rank_2"))
    diff = F.abs(F.col("avg_rank_1") - F.col("avg_rank_2"))
    cd = critical_value(k) * F.sqrt(k * (k + 1) / (6 * F.col("n")))
    return a.join(b, F.col("model_1") < F.col("model_2")).select(
        "model_1", "model_2", "avg_rank_1", "avg_rank_2", diff.alias("rank_diff"), cd.alias("critical_diff"), (diff > cd).alias("significant"))


def wilcoxon(df: DataFrame, by: list[str], a: str, b: str, p_value: bool = True) -> DataFrame:
    """Signed-rank test of paired columns with tie-corrected normal approximation and rank-biserial correlation."""
    d = df.select(*by, (F.col(a) - F.col(b)).alias("__d")).where(F.col("__d").isNotNull())
    sizes = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    cells = d.where("__d <> 0").groupBy(*by, F.abs("__d").alias("__m")).agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col("__d") > 0).alias("__up"))
    ranked = in_order(cells, by, ["__m"], running={"__upto": "__n"})
    rank = F.col("__upto") - (F.col("__n") - 1) / 2.0
    g = ranked.groupBy(*by).agg(
        F.sum(rank * F.col("__up")).alias("w_plus"), F.sum(rank * (F.col("__n") - F.col("__up"))).alias("w_minus"), F.sum("__n").alias("m"),
        F.sum(F.pow(F.col("__n"), F.lit(3)) - F.col("__n")).alias("__t"),
    )
    g = null_safe_join(g, sizes, by) if by else g.withColumn("n", sizes.scalar())
    w, m, n = F.least("w_plus", "w_minus"), F.col("m").cast("double"), F.col("n").cast("double")  # cubes of counts leave the long range
    z = (w - m * (m + 1) / 4) / F.sqrt((m * (m + 1) * (2 * m + 1) - F.col("__t") / 2) / 24)
    out = g.select(*by, "n", w.alias("statistic"), z.alias("z"), (1 - 2 * w / (n * (n + 1) / 2)).alias("effect_size"))
    return out.withColumn("p_value", normal_p("z")) if p_value else out


def paired_compare(scores: DataFrame, block: str, model: str, score: str, base: str, test: str = "paired_t", p_value: bool = True) -> DataFrame:
    """Every model against the base model on shared blocks; the caller names the test."""
    b = scores.where(F.col(model) == base).select(block, F.col(score).alias("__base"))
    pairs = scores.where(F.col(model) != base).join(b, block)
    if test == "paired_t":
        return paired_t(pairs, [model], "__base", score, p_value=p_value)
    if test == "wilcoxon":
        return wilcoxon(pairs, [model], "__base", score, p_value=p_value)
    raise ValueError(f"unknown test {test}")


def threshold_bootstrap(df: DataFrame, threshold: Column | float, reps: int = 100, seed: int = 42, y: str = "y", p: str = "p") -> DataFrame:
    """Precision, recall and F1 at a fixed threshold over resamples."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    called = df.select(F.col(y).cast("int").alias("y"), (F.col(p) >= t).cast("int").alias("pred"))
    keep = lambda w: {k: v for k, v in label_metrics(w).items() if k != "accuracy"}
    return bootstrap_ci(called, [], ["y", "pred"], keep, reps, seed)
