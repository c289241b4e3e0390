"""p-values against table values; pairwise measures against brute force on small data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from edlens.functions import tails
from edlens.functions.hashing import log_poisson, poisson_draw
from edlens.operators import alignment as A
from edlens.operators import inference as I
from edlens.operators import neighbours as N


def test_tail_table_values():
    assert tails.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.student_t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.f_sf(3.3258345304130112, 5, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.student_t_quantile(0.975, 10) == pytest.approx(2.2281388519649385, abs=1e-8)
    assert 2 * tails.normal_sf(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert tails.kolmogorov_sf(1.3580986 / math.sqrt(50), 100, 100) == pytest.approx(0.05, abs=1e-4)


def test_p_value_columns(spark):
    df = spark.createDataFrame([(i, float(i % 7), float((i * 3) % 5), ["a", "b", "c"][i % 3]) for i in range(200)], "id long, x double, z double, g string")
    t = I.paired_t(df, [], "x", "z").first()
    assert 0 <= t.p_value <= 1 and t.ci_lower < t.mean_difference < t.ci_upper
    a = I.one_way_anova(df, "g", "x").first()
    assert a.p_value == pytest.approx(tails.f_sf(a.f, a.df_between, a.df_within))
    m = I.mcnemar(df.select((F.col("id") % 2).alias("y"), (F.col("x") > 3).cast("int").alias("m1"), (F.col("z") > 2).cast("int").alias("m2")), [("m1", "m2")]).first()
    assert m.p_value == pytest.approx(math.erfc(math.sqrt(m.statistic / 2)))


def test_poisson_draws_follow_one_law(spark):
    """Mean, variance and distribution function on both sides of the change of method, and at a rate of a million."""
    for rate in (0.5, 1.0, 7.0, 9.5, 10.0, 39.0, 41.0, 100.0, 1e6):
        n = 4000
        w = sorted(r.w for r in spark.range(n).select(poisson_draw(["id"], f"p{rate}", F.lit(rate)).alias("w")).collect())
        m = sum(w) / n
        v = sum((x - m) ** 2 for x in w) / n
        assert abs(m - rate) < 5 * math.sqrt(rate / n) and v == pytest.approx(rate, rel=0.12)
        low = int(max(0, rate - 8 * math.sqrt(rate)))
        upto, worst, i = 0.0, 0.0, 0
        for k in range(low, int(rate + 8 * math.sqrt(rate) + 10)):
            upto += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
            while i < n and w[i] <= k:
                i += 1
            worst = max(worst, abs(i / n - upto))
        assert worst < 1.9 / math.sqrt(n)  # Kolmogorov distance of a correct sampler: fewer than one in a thousand


def test_log_poisson_without_cancellation(spark):
    rows = [(3.0, 10.0), (15.0, 20.0), (16.0, 12.0), (1e6 + 700, 1e6), (1e12 + 1e6, 1e12), (40.0, 100.0)]
    got = spark.createDataFrame(rows, "k double, rate double").select("k", "rate", log_poisson(F.col("k"), F.col("rate")).alias("l")).collect()
    for r in got:
        if r.rate < 1e9:
            assert r.l == pytest.approx(-r.rate + r.k * math.log(r.rate) - math.lgamma(r.k + 1), abs=1e-7)
        else:
            assert r.l == pytest.approx(-0.5 * math.log(2 * math.pi * r.rate) - (r.k - r.rate) ** 2 / (2 * r.rate), abs=1e-5)


def test_beta_draws(spark):
    r = spark.range(4000).select(N.beta_symmetric(["id"], 0.4, 1).alias("b")).agg(F.avg("b").alias("m"), F.var_pop("b").alias("v"), F.min("b"), F.max("b")).first()
    assert r.m == pytest.approx(0.5, abs=0.03) and r.v == pytest.approx(0.25 / 1.8, rel=0.08)
    for a in (0.05, 2.0, 5.0):
        r = spark.range(4000).select(N.beta_symmetric(["id"], a, 1).alias("b")).agg(F.avg("b").alias("m"), F.var_pop("b").alias("v"), F.count_if(F.col("b") == 0.5).alias("half")).first()
        assert r.m == pytest.approx(0.5, abs=0.03) and r.v == pytest.approx(0.25 / (2 * a + 1), rel=0.08) and r.half == 0


def test_smote_repeats_a_single_row(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(4)] + [(9, [5.0, 5.0], 1)], "k long, x array<double>, y int")
    made = N.smote(df, "k", "x", "y", k=2).collect()
    assert [(r.k, r.x) for r in made] == [(9, [5.0, 5.0])] * 3


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (150, 3)), rng.normal(1, 1, (120, 3))])
    x[40:80] = x[40]  # a heap of equal points
    df = spark.createDataFrame([(i, int(i >= 150), x[i].tolist()) for i in range(len(x))], "id long, domain int, v array<double>")
    return x, df


@pytest.mark.parametrize("shard", [16, 4096])
def test_knn_join_is_exact(points, shard):
    x, df = points
    got = {}
    for r in N.knn_join(df, df, 4, query_id="id", ref_id="id", exclude_same=True, pivots=9, shard_rows=shard).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.rid))
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        assert [rid for _, rid in sorted(got[i])] == np.lexsort((np.arange(len(x)), d))[:4].tolist()


def test_smote_balances_and_interpolates(points):
    x, df = points
    made = N.smote(df, "id", "v", "domain", 3).collect()
    assert len(made) == 30 and {r.domain for r in made} == {1}
    lo, hi = x[150:].min(axis=0), x[150:].max(axis=0)
    assert all((np.array(r.v) >= lo - 1e-9).all() and (np.array(r.v) <= hi + 1e-9).all() for r in made)


def test_mixup_pairs_rows_once(points):
    _, df = points
    m = N.mixup(df, "id", "v", "domain", 0.2).collect()
    assert len({r.id for r in m}) == len({r.partner for r in m}) == 270
    assert {round(r.soft_label, 9) for r in m} == {0.0, 1.0}


def test_kernel_distances_match_all_pairs(points):
    x, df = points
    s, t = x[:150], x[150:]

    def mean_kernel(f):
        return f(s, s).mean() - 2 * f(s, t).mean() + f(t, t).mean()

    for degree in (2, 3):
        want = mean_kernel(lambda a, b: (a @ b.T / 3 + 1.0) ** degree)
        assert A.mmd_polynomial(df, ["v"], degree) == pytest.approx(want, rel=1e-9)
    want = mean_kernel(lambda a, b: np.exp(-0.5 * ((a[:, None] - b[None]) ** 2).sum(axis=2)))
    assert A.mmd_rbf(df, ["v"], 0.5) == pytest.approx(want, rel=0.1)
    same = df.unionByName(df.withColumn("domain", 1 - F.col("domain")))
    assert A.mmd_rbf(same, ["v"], 0.5) < 1e-12


def test_coral_aligns_second_moments(points):
    x, df = points
    wide = df.select("domain", *[F.col("v")[i].alias(f"x{i}") for i in range(3)])
    cols = ["x0", "x1", "x2"]
    m = A.domain_moments(wide, cols)
    assert np.allclose(m[0].cov, np.cov(x[:150], rowvar=False)) and np.allclose(m[1].mean, x[150:].mean(axis=0))
    for variant in ("power", "cholesky"):
        model = A.coral_fit(wide, cols, regularization=1e-9, variant=variant)
        out = np.array([[r.x0, r.x1, r.x2] for r in A.coral_apply(wide.where("domain = 0"), cols, model).collect()])
        assert np.allclose(np.cov(out, rowvar=False), np.cov(x[150:], rowvar=False), atol=1e-6)
    assert A.alignment_metrics(wide, model).first().frobenius_after < 1e-6
    assert A.coral_loss(wide, cols).first()[0] == pytest.approx(np.linalg.norm(np.cov(x[:150], rowvar=False) - np.cov(x[150:], rowvar=False)))


def test_wilcoxon_of_two_million_pairs(spark):
    """The cube of the count does not fit a long."""
    n = 2_000_000
    d = spark.range(n).select(((F.col("id") % 4) - 1.0).alias("a"), F.lit(0.0).alias("b"))
    got = I.wilcoxon(d, [], "a", "b", p_value=False).first()
    ones, twos = n // 2, n // 4  # half of the rest is 1 or -1, a quarter of all 2; zeros take no rank
    w, m = n // 4 * (ones + 1) / 2, ones + twos
    ties = ones**3 - ones + twos**3 - twos
    z = (w - m * (m + 1) / 4) / math.sqrt((m * (m + 1) * (2 * m + 1) - ties / 2) / 24)
    assert (got.n, got.statistic) == (n, w) and got.z == pytest.approx(z) and got.effect_size == pytest.approx(1 - 2 * w / (n * (n + 1) / 2))
