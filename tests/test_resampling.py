"""Isotonic fits, exact relabelling, folds, label shift, null groups and cross-domain draws against plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from edlens.functions.hashing import hashed_unit, key_unit
from edlens.operators import calibration as C
from edlens.operators import drift as D
from edlens.operators import ensembles as E
from edlens.operators import explain as X
from edlens.operators import fairness as B
from edlens.operators import inference as I
from edlens.operators import isotonic as O
from edlens.operators import models as M
from edlens.operators import metrics
from edlens.operators import neighbours as N
from edlens.operators import prep as P
from edlens.operators import splits as L


def one_pool(rows):
    """The fit of all rows pooled at once: score -> value."""
    cells = pd.DataFrame(rows, columns=["lo", "y"]).groupby("lo").y.agg(["sum", "count"]).reset_index()
    blocks = O.pool(pd.DataFrame({"lo": cells["lo"], "hi": cells["lo"], "s": cells["sum"], "w": cells["count"]}))
    return {x: b.s / b.w for b in blocks.itertuples() for x in cells["lo"] if b.lo <= x <= b.hi}


@pytest.mark.parametrize("shape", ["rising", "falling", "waves", "noise"])
def test_isotonic_in_ranges_equals_one_range(spark, shape):
    rng = random.Random(1)
    chance = {"rising": lambda x: x, "falling": lambda x: 1 - x, "waves": lambda x: 0.5 + 0.5 * math.sin(25 * x), "noise": lambda x: 0.5}[shape]
    rows = [(x, int(rng.random() < chance(x))) for x in (round(rng.random(), 3) for _ in range(1500))]
    df = spark.createDataFrame([*rows, (None, 1), (0.5, None)], "p double, y int")
    blocks = O.fit(df, block_rows=16)
    want = one_pool(rows)
    got = {r.p: r.calibrated for r in O.predict(df, blocks).where("y is not null and p is not null").collect()}
    assert got == pytest.approx(want)
    edges = blocks.orderBy("block").collect()
    outside = {r.p: r.calibrated for r in O.predict(spark.createDataFrame([(-5.0,), (9.0,), (None,)], "p double"), blocks).collect()}
    assert outside == {-5.0: edges[0].value, 9.0: edges[-1].value, None: None}
    if len(edges) > 1:
        a, b = edges[0], edges[1]
        middle = (a.hi + b.lo) / 2
        assert O.predict(spark.createDataFrame([(middle,)], "p double"), blocks).first().calibrated == pytest.approx((a.value + b.value) / 2)


def test_isotonic_of_nothing(spark):
    none = spark.createDataFrame([], "p double, y int")
    assert O.fit(none).count() == 0


def test_hypergeometric_law():
    """All outcomes of small populations, moments of large ones."""
    for good, bad, draws in ((3, 4, 2), (5, 1, 4), (0, 6, 3), (6, 0, 3), (4, 4, 8)):
        n = 20_000
        got = Counter(I.hypergeometric(good, bad, draws, (i + 0.5) / n) for i in range(n))
        for k in range(max(0, draws - bad), min(draws, good) + 1):
            want = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)
            assert got[k] / n == pytest.approx(want, abs=2e-4)
    good, bad, draws = 3_000_000_000, 5_000_000_000, 1_000_000_000
    got = np.array([I.hypergeometric(good, bad, draws, (i + 0.5) / 2000) for i in range(2000)], dtype=float)
    share = good / (good + bad)
    assert got.mean() == pytest.approx(draws * share, rel=1e-6) and got.var() == pytest.approx(draws * share * (1 - share) * (good + bad - draws) / (good + bad - 1), rel=0.01)


def test_hashed_unit_equals_the_column(spark):
    got = spark.range(5).select(key_unit(["id", F.lit(3)], 42).alias("u")).collect()
    assert [r.u for r in got] == [hashed_unit(f"{i}|3|42") for i in range(5)]


@pytest.mark.parametrize("fan", [1024, 3])
def test_permutation_moments(spark, monkeypatch, fan):
    """Differences of relabelled means have mean 0 and the known variance, with one level of cells or many."""
    monkeypatch.setattr(I, "FAN", fan)
    rng = random.Random(2)
    rows = [(i, int(i % 3 == 0), float(rng.choice([0, 0, 0, 1, 2, 5, 9, 11, 12, 20]))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, arm int, v double")
    diffs = []
    keep = I._p_value
    monkeypatch.setattr(I, "_p_value", lambda reps, o, alt: diffs.extend(r["diff"] for r in reps.collect()) or keep(reps, o, alt))
    got = I.permutation_test(df, "id", "arm", "v", reps=400).first()
    values = np.array([r[2] for r in rows])
    var = values.var(ddof=1) * (1 / 100 + 1 / 200)
    assert got.replicates == 400 and len(diffs) == 400
    assert np.mean(diffs) == pytest.approx(0, abs=4 * math.sqrt(var / 400)) and np.var(diffs) == pytest.approx(var, rel=0.25)
    assert got.observed == pytest.approx(np.mean([r[2] for r in rows if r[1]]) - np.mean([r[2] for r in rows if not r[1]]))


def test_greedy_folds(spark):
    rng = random.Random(3)
    for k, sizes in ((3, [rng.choice([1, 2, 2, 3, 7, 40]) for _ in range(60)]), (5, [1] * 23 + [100]), (4, [5, 5, 5])):
        loads, want = [0] * k, {}
        for size, g in sorted(((n, f"g{i:03}") for i, n in enumerate(sizes)), key=lambda x: (-x[0], x[1])):
            at = loads.index(min(loads))
            want[g] = at
            loads[at] += size
        df = spark.createDataFrame([(f"g{i:03}", j) for i, n in enumerate(sizes) for j in range(n)], "g string, j int")
        got = {r.g: r.fold for r in L.group_kfold(df, "g", k).select("g", "fold").distinct().collect()}
        assert got == want
    for _ in range(200):  # in closed form as one by one
        loads, size, m = [rng.randint(0, 30) for _ in range(rng.randint(1, 6))], rng.randint(1, 9), rng.randint(0, 40)
        plain = list(loads)
        for j in range(m):
            assert L.fold_of(loads, size, j) == plain.index(min(plain))
            plain[plain.index(min(plain))] += size
        assert L.deal(loads, size, m) == plain


def test_label_shift_table(spark):
    rng = random.Random(4)
    ps = [rng.choice([0.0, 1.0, 1e-9, 0.999999, round(rng.random(), 4)]) for _ in range(3000)]
    df = spark.createDataFrame([(p,) for p in [*ps, None]], "p double")
    for source, variant, most, tol in ((0.3, "saerens", 100, 1e-6), (0.9, "em", 20, 0.0), (0.01, "saerens", 7, 1e-3)):
        base, prior, steps = (source if variant == "saerens" else 0.5), source, most
        for i in range(1, most + 1):
            new = sum(p * prior / base / (p * prior / base + (1 - p) * (1 - prior) / (1 - base)) for p in ps) / len(ps)
            if abs(new - prior) * 2**0.5 < tol:
                steps = i
                break
            prior = new
        got, n = D.label_shift_em(df, source, max_iter=most, tol=tol, variant=variant)
        assert got == pytest.approx(prior, abs=1e-9) and n == steps
    assert D.label_shift_em(df.limit(0), 0.3) == (0.3, 0)


def test_shift_report_reads_the_data_once(spark):
    rows = [(d, random.Random(i).gauss(d * 0.3, 1), None if i % 7 == 0 else float(i % 5)) for i in range(400) for d in (i % 2,)]
    df = spark.createDataFrame(rows, "domain int, a double, b double")
    got = {r.feature: r for r in D.shift_report(df, ["a", "b"]).collect()}
    for j, c in ((1, "a"), (2, "b")):
        for d, side in ((0, "source"), (1, "target")):
            v = np.array([r[j] for r in rows if r[0] == d and r[j] is not None])
            assert got[c][f"{side}_mean"] == pytest.approx(v.mean()) and got[c][f"{side}_std"] == pytest.approx(v.std()) and got[c][f"n_{side}"] == len(v)
    assert {r.feature: r.psi for r in D.psi(df, ["a", "b"]).collect()} == pytest.approx({c: r.psi for c, r in got.items()})


def grouped(spark):
    rng = random.Random(6)
    rows = [(i, g, y, round(min(1.0, max(0.0, rng.gauss(0.35 + 0.3 * y, 0.2))), 3)) for i in range(240) for g in [["a", "b", None][i % 3]] for y in [int(rng.random() < 0.4)]]
    return spark.createDataFrame(rows, "id long, g string, y int, p double").withColumn("pred", (F.col("p") >= 0.5).cast("int"))


OVER_GROUPS = {
    "summary": lambda d: C.calibration_summary(d, ["g"]), "ece": lambda d: C.calibration_error(d, ["g"], strategy="quantile", n_bins=4), "bins": lambda d: C.calibration_bins(d, ["g"]),
    "brier": lambda d: C.brier_decomposition(d, ["g"]), "thresholds": lambda d: C.best_thresholds(d, ["g"], ["f1"]), "scan": lambda d: C.threshold_scan(d, ["g"], 10), "group_thresholds": lambda d: B.group_thresholds(d, "g"),
    "bootstrap": lambda d: I.bootstrap_ci(d, ["g"], ["y", "pred"], I.label_metrics, reps=20), "scores": lambda d: I.bootstrap_scores(d, ["g"], reps=20), "wilcoxon": lambda d: I.wilcoxon(d, ["g"], "p", "y"),
    "paired_t": lambda d: I.paired_t(d, ["g"], "p", "y"), "evaluate": lambda d: M.evaluate(d, "y", ["g"]), "fairness": lambda d: B.fairness_by_group(d, ["g"]), "reweighing": lambda d: B.reweighing(d, "g", "y"),
}


@pytest.mark.parametrize("name", OVER_GROUPS)
def test_a_null_group_is_a_group(spark, name):
    got = {r.g for r in OVER_GROUPS[name](grouped(spark)).select("g").distinct().collect()}
    assert got == {"a", "b", None}


def test_importance_of_a_null_group(spark):
    df = grouped(spark).withColumnRenamed("p", "x")
    m = M.fit_model(df, ["x"], "y")
    got = X.permutation_importance(m, df, ["id"], "y", repeats=1, by=["g"]).collect()
    assert {r.g for r in got} == {"a", "b", None}


def points(spark, classes, n, shift=0.0):
    rng = random.Random(9)
    return spark.createDataFrame([(i, [rng.gauss(shift, 1), rng.gauss(0, 1)], classes[i % len(classes)]) for i in range(n)], "k long, v array<double>, y string")


def test_smote_of_null_classes(spark):
    df = points(spark, ["a", "a", "a", None, "b", "a"], 60)
    made = N.smote(df, "k", "v", "y", 3).collect()
    assert Counter(r.y for r in made) == {None: 30, "b": 30}
    assert N.smote(df.limit(0), "k", "v", "y").count() == 0


def test_smote_across_domains(spark):
    df, target = points(spark, ["a", "a", "a", None], 80), points(spark, ["z"], 40, 50.0)
    rows = {r.k: r.v for r in df.collect()}
    made = N.smote(df, "k", "v", "y", 4, target=target, intra_ratio=0.5, domain_weight=0.2).collect()
    kinds = Counter(r.kind for r in made)
    assert len(made) == 40 and 8 < kinds["cross"] < 32
    for r in made:  # the target lies 50 away along the first axis
        assert (r.v[0] - rows[r.k][0] > 5) == (r.kind == "cross")
    assert Counter(r.kind for r in N.smote(df, "k", "v", "y", 4, target=target.limit(0)).collect()) == {"intra": 40}


def test_mixup_of_null_classes(spark):
    df = points(spark, ["a", None, "b"], 9).withColumn("y", F.when(F.col("y") == "a", 1.0).when(F.col("y") == "b", 2.0))
    got = N.mixup(df, "k", "v", "y").collect()
    assert len(got) == 9 and Counter(r.soft_label for r in got) == {None: 3, 1.0: 3, 2.0: 3}


def test_mixup_across_domains(spark):
    source, target = points(spark, ["a", None], 60), points(spark, ["a", "b", None], 90, 50.0)
    of, other = {r.k: r for r in source.collect()}, {r.k: r for r in target.collect()}
    got = N.mixup_domains(source, target, "k", "v", "y", cross_ratio=0.5).collect()
    assert 12 <= len(got) <= 30 and len({r.draw for r in got}) == len(got) and {r.kind for r in got} == {"cross", "intra"}
    for r in got:
        a, b = of[r.k], (other if r.kind == "cross" else of)[r.partner]
        assert r.v == pytest.approx([r.lam * x + (1 - r.lam) * z for x, z in zip(a.v, b.v)]) and r.y in (a.y, b.y)
        assert a.y == b.y if r.kind == "cross" else r.k != r.partner
    assert {r.kind for r in N.mixup_domains(source, target.drop("y"), "k", "v", "y", cross_ratio=0.5).collect()} == {"intra"}


def test_average_precision_without_rounding(spark):
    """Scores that differ in the ninth digit are no ties."""
    rows = [(1, 0.5000000011, 0.1), (0, 0.5000000010, 0.2), (1, 0.5000000009, 0.3), (0, 0.1, 0.4)]
    df = spark.createDataFrame(rows, "y int, a double, b double")
    got = {r.w_a: r.score for r in E.weight_search(df, ["a", "b"], steps=1, metric="average_precision").collect()}
    assert got[1.0] == pytest.approx((1 + 2 / 3) / 2) and got[0.0] == pytest.approx((1 / 2 + 2 / 4) / 2)


def test_vectors_of_many_values(spark):
    """Thousands of values encode without a list of them on the driver; null and unseen ones are the zero vector."""
    rows = [(i, f"v{i % 5000}" if i % 11 else None, float(i % 7)) for i in range(12_000)]
    df = spark.createDataFrame([*rows, (-1, "v1", 0.0)], "id long, c string, x double")
    out = P.one_hot_vectors(df, df, "c", "vec")
    got = {r.id: r.vec for r in out.where("id < 40").collect()}
    n = df.where("c is not null").select("c").distinct().count()
    assert all(v.size == n for v in got.values()) and got[0].numNonzeros() == 0 and got[1].numNonzeros() == 1
    assert got[1].indices[0] == 0 and len({int(got[i].indices[0]) for i in range(1, 40) if i % 11}) == 36  # v1 is the most frequent
    new = P.one_hot_vectors(spark.createDataFrame([(1, "unseen"), (2, None), (3, "v1")], "id long, c string"), df, "c", "vec").collect()
    assert {r.id: r.vec.numNonzeros() for r in new} == {1: 0, 2: 0, 3: 1}
    base = P.one_hot_vectors(df, df, "c", "vec", drop_base=True).select("vec").first().vec
    assert base.size == n - 1
    one = P.one_hot_vectors(spark.createDataFrame([(1, "a"), (2, None)], "id long, c string"), spark.createDataFrame([("a",)], "c string"), "c", "vec", drop_base=True).collect()
    assert all(r.vec.numNonzeros() == 0 for r in one)


def test_evaluate_scores_rows_once(spark):
    df = grouped(spark)
    got = {r.g: r for r in M.evaluate(df, "y", ["g"]).collect()}
    for r in metrics.ranking_metrics(df, ["g"]).join(metrics.classification_metrics(df, ["g"]).withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h"))).collect():
        assert (got[r.g].accuracy, got[r.g].f1, got[r.g].balanced_accuracy, got[r.g].roc_auc) == pytest.approx((r.accuracy, r.f1, r.balanced_accuracy, r.roc_auc))
    whole = M.evaluate(df, "y").first()
    assert whole.roc_auc == pytest.approx(metrics.ranking_metrics(df, []).first().roc_auc)
