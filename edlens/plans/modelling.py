"""Models, experiments, ensembles and explanations on the test tables.

Fitted coefficients depend on the optimiser, so these queries mostly carry no SQL; those whose
result is arithmetic on the tables do.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from edlens.operators import calibration as C
from edlens.operators import ensembles as N
from edlens.operators import explain as X
from edlens.operators import isotonic as I
from edlens.operators import models as M
from edlens.plans.domains import dom
from edlens.plans.evaluation import wide
from edlens.plans.registry import query
from edlens.plans.relational import rounded
from edlens.plans.standins import MODELS

FEATS = ["G1", "G2", "absences", "studytime", "Medu", "health"]


def grades(t):
    return t.grades.withColumn("y", (F.col("G3") >= 10).cast("int"))


def sides(t):
    w = wide(t).select("id", "y", "p", "sex")
    return w.where("sex = 'F'"), w.where("sex = 'M'")


def _kind(kind, **p):
    def build(t):
        g = grades(t)
        m = M.fit_model(g, FEATS, "y", kind, **p)
        return rounded(M.evaluate(m.score(g), "y"), 4)

    return build


for _name, _params in (("logistic", {}), ("random_forest", {"numTrees": 20}), ("gradient_boosting", {"maxIter": 5}), ("svm", {"maxIter": 20}), ("mlp", {"maxIter": 30}), ("decision_tree", {})):
    query(f"fit_{_name}")(_kind(_name, **_params))


def _moments(c):
    return ", ".join(f"avg({x}) FILTER (WHERE y = {k}) AS m{k}_{x}, var_pop({x}) FILTER (WHERE y = {k}) + any_value(eps) AS v{k}_{x}" for x in FEATS for k in (0, 1))


# Gaussian naive Bayes is arithmetic on class means and variances, so it is compared with SQL.
_ODDS = " + ".join(f"0.5 * ln(v0_{x} / v1_{x}) - ({x} - m1_{x}) ** 2 / (2 * v1_{x}) + ({x} - m0_{x}) ** 2 / (2 * v0_{x})" for x in FEATS)


@query("fit_naive_bayes", "grades", f"""WITH g AS (SELECT *, (G3 >= 10)::INTEGER AS y FROM grades), e AS (SELECT 1e-9 * greatest({", ".join(f"var_pop({x})" for x in FEATS)}) AS eps FROM g),
 m AS (SELECT {_moments("g")}, ln(sum(y) / (count(*) - sum(y))) AS prior FROM g, e), o AS (SELECT y, prior + {_ODDS} AS o FROM g, m), p AS (SELECT y, o, (o >= 0)::INTEGER AS pred, rank() OVER (ORDER BY o) + (count(*) OVER (PARTITION BY o) - 1) / 2.0 AS rk FROM o),
 c AS (SELECT sum(y * pred)::DOUBLE AS tp, sum((1 - y) * pred)::DOUBLE AS fp, sum((1 - y) * (1 - pred))::DOUBLE AS tn, sum(y * (1 - pred))::DOUBLE AS fn, sum(rk) FILTER (WHERE y = 1) AS rs FROM p)
 SELECT round((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 4) AS balanced_accuracy, round((rs - (tp + fn) * (tp + fn + 1) / 2) / ((tp + fn) * (tn + fp)), 4) AS roc_auc FROM c""")
def _(t):
    return _kind("naive_bayes")(t)


def _regress(kind, **p):
    def build(t):
        from edlens.operators.metrics import regression_metrics

        m = M.fit_model(t.grades, FEATS, "G3", kind, "regression", **p)
        return rounded(regression_metrics(m.score(t.grades, "yhat"), [], "G3", "yhat"), 4)

    return build


for _name, _params in (("ridge", {}), ("lasso", {"regParam": 0.1}), ("random_forest", {"numTrees": 20}), ("gradient_boosting", {"maxIter": 5}), ("decision_tree", {})):
    query(f"regress_{_name}")(_regress(_name, **_params))


# Least squares on one column has a closed form, so this fit is compared with SQL.
@query("regress_linear", "grades", "SELECT round(sqrt(avg((G3 - (a + b * G1)) ** 2)), 4) AS rmse, round(avg(abs(G3 - (a + b * G1))), 4) AS mae, round(1 - sum((G3 - (a + b * G1)) ** 2) / any_value(t), 4) AS r2, count(*) AS n FROM grades, (SELECT regr_slope(G3, G1) AS b, regr_intercept(G3, G1) AS a, var_pop(G3) * count(*) AS t FROM grades)")
def _(t):
    from edlens.operators.metrics import regression_metrics

    m = M.fit_model(t.grades, ["G1"], "G3", "linear", "regression")
    return rounded(regression_metrics(m.score(t.grades, "yhat"), [], "G3", "yhat"), 4)


@query("platt_calibration")
def _(t):
    cal, test = sides(t)
    return rounded(C.calibration_error(M.platt(cal, test).drop("p").withColumnRenamed("calibrated", "p"), []), 4)


# The rising fit at a score is the highest, over beginnings at or before it, of the lowest mean up to an end at or behind it.
ISO = """cells AS (SELECT p, sum(y)::DOUBLE AS s, count(*)::DOUBLE AS w, row_number() OVER (ORDER BY p) AS i FROM cal GROUP BY p), sums AS (SELECT p, i, sum(s) OVER (ORDER BY i) AS s1, sum(w) OVER (ORDER BY i) AS w1, sum(s) OVER (ORDER BY i) - s AS s0, sum(w) OVER (ORDER BY i) - w AS w0 FROM cells),
 low AS (SELECT a.i AS a, b.i AS b, min((b.s1 - a.s0) / (b.w1 - a.w0)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS v FROM sums a JOIN sums b ON a.i <= b.i), fit AS (SELECT s.p, max(v) AS value FROM low JOIN sums s ON s.i = low.b GROUP BY s.p)"""


@query("isotonic_calibration", "predictions", f"""WITH cal AS (SELECT prob_gru AS p, y FROM predictions WHERE sex = 'F'), {ISO}, x AS (SELECT prob_gru AS p, y FROM predictions WHERE sex = 'M'),
 l AS (SELECT x.*, f.p AS p0, f.value AS v0 FROM x ASOF LEFT JOIN fit f ON x.p >= f.p), h AS (SELECT l.*, f.p AS p1, f.value AS v1 FROM l ASOF LEFT JOIN fit f ON l.p <= f.p),
 c AS (SELECT y, CASE WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL OR p0 = p1 THEN v0 ELSE v0 + (p - p0) / (p1 - p0) * (v1 - v0) END AS q FROM h), b AS (SELECT CASE WHEN q = 0 THEN 1 ELSE ceil(round(q * 10, 9)) END AS bin, avg(q) AS mp, avg(y) AS ob, count(*) / (SELECT count(*) FROM c)::DOUBLE AS sh FROM c GROUP BY 1)
 SELECT round(sum(abs(mp - ob) * sh), 4) AS ece, round(max(abs(mp - ob)), 4) AS mce FROM b WHERE bin > 0""")
def _(t):
    cal, test = sides(t)
    return rounded(C.calibration_error(M.isotonic(cal, test).drop("p").withColumnRenamed("calibrated", "p"), []), 4)


@query("isotonic_fit", "predictions", f"WITH cal AS (SELECT round(prob_lstm, 2) AS p, y FROM predictions), {ISO} SELECT p, round(value, 6) AS value FROM fit")
def _(t):
    rows = t.predictions.select(F.round("prob_lstm", 2).alias("p"), "y")
    return rounded(I.predict(rows.select("p").distinct(), I.fit(rows), out="value"))


@query("calibration_grid")
def _(t):
    return rounded(M.calibration_grid(*sides(t)), 4)


@query("stacking_calibrator")
def _(t):
    cal = M.fit_stacking_calibrator(t.predictions, "y")
    out = N.apply_stacking_calibrator(t.predictions, cal)
    return rounded(M.evaluate(out, "y"), 4)


@query("apply_stacking_calibrator", "predictions", "SELECT id, round(1 / (1 + exp(-(2.0 * prob_gru - 1.5 * prob_lstm + 0.25))), 6) AS p FROM predictions")
def _(t):
    cal = {"names": ["gru", "lstm", "absent"], "weights": [2.0, -1.5, 3.0], "bias": 0.25}
    return rounded(N.apply_stacking_calibrator(t.predictions, cal).select("id", "p"))


@query("weighted_ensemble", "predictions", "SELECT id, prob_gru AS gru, prob_tcn AS tcn, round(prob_gru * 0.75 + prob_tcn * 0.25, 6) AS p FROM predictions")
def _(t):
    frames = {m: t.predictions.select("id", F.col(f"prob_{m}").alias("p")) for m in ("gru", "tcn")}
    return rounded(N.weighted_ensemble(frames, {"tcn": 1.0, "gru": 3.0}, ["id"]))


GRID = """g AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS id, a / 4.0 AS w1, b / 4.0 AS w2, c / 4.0 AS w3, (4 - a - b - c) / 4.0 AS w4 FROM (SELECT unnest(range(0, 5)) AS a), (SELECT unnest(range(0, 5)) AS b), (SELECT unnest(range(0, 5)) AS c) WHERE a + b + c <= 4),
 m AS (SELECT id, w1, w2, w3, w4, y, prob_gru * w1 + prob_lstm * w2 + prob_transformer * w3 + prob_tcn * w4 AS p FROM (SELECT y, prob_gru, prob_lstm, prob_transformer, prob_tcn FROM predictions), g)"""
WS = "w1::DOUBLE AS w_prob_gru, w2::DOUBLE AS w_prob_lstm, w3::DOUBLE AS w_prob_transformer, w4::DOUBLE AS w_prob_tcn"


@query("ensemble_weight_search", "predictions", f"WITH {GRID} SELECT id::INTEGER AS id, {WS}, round(avg(-ln(CASE WHEN y = 1 THEN greatest(least(p, 1 - 1e-7), 1e-7) ELSE 1 - greatest(least(p, 1 - 1e-7), 1e-7) END)), 6) AS score FROM m GROUP BY id, w1, w2, w3, w4")
def _(t):
    return rounded(N.weight_search(t.predictions, MODELS, steps=4))


@query("ensemble_weight_search_ap", "predictions", f"WITH {GRID}, c AS (SELECT id, w1, w2, w3, w4, p, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM m GROUP BY ALL), r AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS called FROM c WINDOW w AS (PARTITION BY id ORDER BY p DESC)) SELECT id::INTEGER AS id, {WS}, round(sum(pos * tp / called) / sum(pos), 4) AS score FROM r GROUP BY id, w1, w2, w3, w4")
def _(t):
    return rounded(N.weight_search(t.predictions, MODELS, steps=4, metric="average_precision"), 4)


@query("mean_ensemble", "predictions", """WITH m AS (SELECT id, y, round((prob_gru + prob_lstm) / 2, 9) AS p FROM predictions), c AS (SELECT p, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM m GROUP BY p), r AS (SELECT p, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS called, sum(pos) OVER () AS pt FROM c),
 b AS (SELECT p AS threshold FROM r ORDER BY round(2 * (tp / called) * (tp / pt) / (tp / called + tp / pt + 1e-8), 12) DESC, p LIMIT 1) SELECT round(threshold, 6) AS threshold, count(*) FILTER (WHERE p >= threshold) AS called, count(*) AS n FROM m, b GROUP BY 1""")
def _(t):
    p = t.predictions.select("id", "y", F.round((F.col("prob_gru") + F.col("prob_lstm")) / 2, 9).alias("mean"))
    out = N.mean_ensemble(p, ["mean"])
    return rounded(out.groupBy("threshold").agg(F.sum("pred").alias("called"), F.count(F.lit(1)).alias("n")))


@query("stack_models")
def _(t):
    return rounded(M.evaluate(M.stack(grades(t), ["id"], FEATS, "y", ["logistic", "decision_tree"], folds=3), "y"), 4)


@query("bag_models")
def _(t):
    g = grades(t)
    return rounded(M.evaluate(M.bag(g, g, ["id"], FEATS, "y", models=3), "y"), 4)


@query("grid_search")
def _(t):
    return rounded(M.grid_search(grades(t), ["id"], FEATS, "y", "logistic", {"regParam": [0.0, 0.1]}, folds=3)[1], 4)


@query("nested_cv")
def _(t):
    return rounded(M.nested_cv(t.grades, ["id"], FEATS, "G3", "linear", {"regParam": [0.0, 0.5]}, outer=3, inner=2)[0], 4)


@query("train_regression")
def _(t):
    return rounded(M.train_regression(t.grades.select("id", "sex", "G1", "G2", "absences", "G3"), ["id"]), 4)


@query("early_risk")
def _(t):
    return rounded(M.early_risk(grades(t), ["id"], ["G1", "studytime", "absences"], "y", "sex", folds=3)[1], 4)


@query("segment")
def _(t):
    return rounded(M.segment(t.grades, ["G1", "G2", "absences", "age"], "G3"), 4)


# The components of two scaled columns have variances 1 + |r| and 1 - |r|.
@query("pca_features", "grades", "SELECT round(1 + abs(corr(G1, G2)), 4) AS var_1, round(1 - abs(corr(G1, G2)), 4) AS var_2, 0.0::DOUBLE AS corr_12, count(*) AS n FROM grades")
def _(t):
    p = M.pca_features(t.grades, ["G1", "G2"], 5)
    return rounded(p.agg(F.var_samp("pc_1").alias("var_1"), F.var_samp("pc_2").alias("var_2"), F.abs(F.round(F.corr("pc_1", "pc_2"), 4)).alias("corr_12"), F.count(F.lit(1)).alias("n")), 4)


@query("domain_classifier")
def _(t):
    d = t.raw("lineitem").select(F.col("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").cast("int").alias("domain"), "l_quantity",
                                 (F.col("l_extendedprice") * F.when(F.col("l_returnflag") == "R", 1.3).otherwise(1.0)).alias("price"))
    return rounded(M.domain_classifier(d, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity", "price"], folds=3), 4)


@query("importance_weights")
def _(t):
    w = M.importance_weights(dom(t), ["l_quantity", "l_extendedprice"])
    return rounded(w.agg(F.avg("weight").alias("mean"), F.count(F.lit(1)).alias("n"), F.max("weight").alias("max")), 4)


@query("transfer_experiment")
def _(t):
    g = grades(t)
    return rounded(M.transfer_experiment(g.where("school = 'BUILDING'"), g.where("school <> 'BUILDING'"), "id", ["G1", "absences", "famsup"], "y", "sex", ["logistic"], ("building", "others")), 4)


@query("ablation")
def _(t):
    g = grades(t)

    def run(flags):
        feats = ["absences", *(["G1"] if flags["use_first_grade"] else []), *(["G2"] if flags["use_second_grade"] else [])]
        return M.evaluate(M.fit_model(g, feats, "y").score(g), "y")

    return rounded(M.ablation(M.ablation_plan(["use_first_grade", "use_second_grade"]), run), 4)


@query("progressive_mix")
def _(t):
    g = grades(t)
    f, m = g.where("sex = 'F'"), g.where("sex = 'M'")
    return rounded(M.progressive_mix(f, m, m, ["id"], FEATS, "y", "decision_tree", shares=(0.2, 1.0)), 4)


_SIDE = "SELECT fold, share, '{0}' AS side, sqrt(avg((G3 - a - b * G1) ** 2)) AS rmse, count(*) AS n FROM k JOIN m ON {1} GROUP BY fold, share"


@query("learning_curve", "grades", f"""WITH k AS (SELECT G1, G3, ((row_number() OVER (ORDER BY md5(concat_ws('|', id, '42'))) - 1) % 2) AS f, CAST('0x' || substr(md5(concat_ws('|', id, 'curve')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM grades),
 m AS (SELECT h.fold, s.share, regr_slope(G3, G1) AS b, regr_intercept(G3, G1) AS a FROM k, (SELECT unnest([0, 1]) AS fold) h, (SELECT unnest([0.2::DOUBLE, 1.0]) AS share) s WHERE f <> fold AND u <= share GROUP BY 1, 2),
 r AS ({_SIDE.format('train', 'f <> fold AND u <= share')} UNION ALL {_SIDE.format('validation', 'f = fold')}) SELECT share, side, round(avg(rmse), 4) AS rmse, round(avg(n), 4) AS rows FROM r GROUP BY share, side""")
def _(t):
    return rounded(M.learning_curve(t.grades, ["id"], ["G1"], "G3", shares=(0.2, 1.0), folds=2), 4)


@query("permutation_importance")
def _(t):
    g = grades(t)
    return rounded(X.permutation_importance(M.fit_model(g, FEATS, "y"), g, ["id"], "y", repeats=2), 4)


@query("importance_by_group")
def _(t):
    g = grades(t)
    return rounded(X.permutation_importance(M.fit_model(g, ["G1", "absences"], "y"), g, ["id"], "y", repeats=2, metric="accuracy", by=["sex"]), 4)


@query("faithfulness")
def _(t):
    g = grades(t)
    m = M.fit_model(g, FEATS, "y")
    return rounded(X.faithfulness(m, g, ["id"], "y", ["G1", "G2"]), 4)


@query("partial_dependence")
def _(t):
    g = grades(t)
    return rounded(X.partial_dependence(M.fit_model(g, FEATS, "y"), g, ["G1", "absences"], 5), 4)


@query("feature_importance_table")
def _(t):
    g = grades(t)
    return rounded(X.feature_importance_table(M.fit_model(g, FEATS, "y", "random_forest", numTrees=10), g, "y"), 4)
