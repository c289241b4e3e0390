"""Metrics, calibration, fairness and conformal sets on the prediction view."""

from __future__ import annotations

from pyspark.sql import functions as F

from edlens.operators import calibration as C
from edlens.operators import conformal as U
from edlens.operators import fairness as B
from edlens.operators import metrics as M
from edlens.plans.registry import query
from edlens.plans.relational import rounded

LP = "long_predictions"
PRED = "lp AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM long_predictions)"
CONF = """c AS (SELECT model, (count(*) FILTER (WHERE y = 1 AND pred = 1))::DOUBLE AS tp, (count(*) FILTER (WHERE y = 0 AND pred = 1))::DOUBLE AS fp, (count(*) FILTER (WHERE y = 0 AND pred = 0))::DOUBLE AS tn, (count(*) FILTER (WHERE y = 1 AND pred = 0))::DOUBLE AS fn FROM lp GROUP BY model)"""


def lp(t):
    return t.long_predictions.withColumn("pred", (F.col("p") >= 0.5).cast("int"))


def wide(t, model="prob_gru"):
    return t.predictions.select("*", F.col(model).alias("p"), (F.col(model) >= 0.5).cast("int").alias("pred"))


W = "w AS (SELECT *, prob_gru AS p, CASE WHEN prob_gru >= 0.5 THEN 1 ELSE 0 END AS pred FROM predictions)"


@query("confusion_counts", LP, f"WITH {PRED}, {CONF} SELECT model, tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn FROM c")
def _(t):
    return M.confusion_counts(lp(t), ["model"])


@query("classification_metrics", LP, f"""WITH {PRED}, {CONF}, r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS sp FROM c)
 SELECT model, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, round(sp, 6) AS specificity, round((re + sp) / 2, 6) AS balanced_accuracy FROM r""")
def _(t):
    return rounded(M.classification_metrics(lp(t), ["model"]))


@query("classification_report", "predictions", f"""WITH {W}, g AS (SELECT sex AS "group", y, pred FROM w UNION ALL SELECT 'all', y, pred FROM w),
 k AS (SELECT "group", c.class, (count(*) FILTER (WHERE y = c.class))::DOUBLE AS s, (count(*) FILTER (WHERE pred = c.class))::DOUBLE AS q, (count(*) FILTER (WHERE y = c.class AND pred = c.class))::DOUBLE AS h FROM g, (SELECT 0 AS class UNION ALL SELECT 1) c GROUP BY 1, 2),
 m AS (SELECT "group", CAST(class AS VARCHAR) AS class, CASE WHEN q > 0 THEN h / q ELSE 0 END AS p, CASE WHEN s > 0 THEN h / s ELSE 0 END AS r, s FROM k),
 f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM m)
 SELECT "group", class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, s::BIGINT AS support FROM f UNION ALL
 SELECT "group", 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(s)::BIGINT FROM f GROUP BY 1 UNION ALL
 SELECT "group", 'weighted avg', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6), round(sum(f * s) / sum(s), 6), sum(s)::BIGINT FROM f GROUP BY 1""")
def _(t):
    return rounded(M.classification_report(wide(t), "sex"))


RANK = """r AS (SELECT model, y, p, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2.0 AS rk FROM long_predictions),
 auc AS (SELECT model, (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * (count(*) - sum(y))) AS roc_auc FROM r GROUP BY model),
 cells AS (SELECT model, p, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM long_predictions GROUP BY model, p),
 cum AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY p DESC) AS tp, sum(n) OVER (PARTITION BY model ORDER BY p DESC) AS called, sum(pos) OVER (PARTITION BY model) AS P_, sum(n) OVER (PARTITION BY model) AS tot FROM cells),
 ap AS (SELECT model, sum(pos * tp / called) / sum(pos) AS average_precision FROM cum GROUP BY model),
 ll AS (SELECT model, count(*) AS n, avg(-ln(CASE WHEN y = 1 THEN greatest(least(p, 1 - 1e-7), 1e-7) ELSE 1 - greatest(least(p, 1 - 1e-7), 1e-7) END)) AS log_loss, avg((p - y) * (p - y)) AS brier FROM long_predictions GROUP BY model)"""


@query("ranking_metrics", LP, f"WITH {RANK} SELECT model, n, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier FROM auc JOIN ap USING (model) JOIN ll USING (model)")
def _(t):
    return rounded(M.ranking_metrics(t.long_predictions, ["model"]))


@query("roc_auc", LP, f"WITH {RANK} SELECT model, round(roc_auc, 6) AS roc_auc FROM auc")
def _(t):
    return rounded(M.ranking_metrics(M.unpivot_models(t.predictions, ["y"]), ["model"]).select("model", "roc_auc"))


@query("log_loss_brier", LP, f"WITH {RANK} SELECT model, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier FROM ll")
def _(t):
    return rounded(t.long_predictions.groupBy("model").agg(M.log_loss().alias("log_loss"), M.brier().alias("brier")))


@query("pr_roc_curves", LP, f"WITH {RANK} SELECT model, p AS threshold, tp::BIGINT AS tp, (called - tp)::BIGINT AS fp, round(tp / called, 6) AS precision, round(tp / P_, 6) AS recall, round((called - tp) / (tot - P_), 6) AS fpr FROM cum")
def _(t):
    return rounded(M.curves(t.long_predictions, ["model"]))


@query("early_warning_curve", "predictions", """WITH s AS (SELECT *, row_number() OVER (PARTITION BY id_student ORDER BY id) AS pos FROM predictions), k AS (SELECT k.k::INTEGER AS k, y, prob_gru AS p FROM s JOIN (SELECT unnest([2, 5, 20]) AS k) k ON pos <= k.k),
 r AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY p) + (count(*) OVER (PARTITION BY k, p) - 1) / 2.0 AS rk FROM k),
 c AS (SELECT k, p, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM k GROUP BY k, p), cu AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS called FROM c WINDOW w AS (PARTITION BY k ORDER BY p DESC)), ap AS (SELECT k, sum(pos * tp / called) / sum(pos) AS ap FROM cu GROUP BY k)
 SELECT k, count(*) AS n, round((sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * (count(*) - sum(y))), 6) AS roc_auc, round(any_value(ap), 6) AS average_precision,
 round(avg(-ln(CASE WHEN y = 1 THEN greatest(least(p, 1 - 1e-7), 1e-7) ELSE 1 - greatest(least(p, 1 - 1e-7), 1e-7) END)), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier FROM r JOIN ap USING (k) GROUP BY k""")
def _(t):
    from edlens.operators.sequences import order_events

    s = order_events(t.predictions.select("id_student", "id", "y", F.col("prob_gru").alias("p")), ["id_student"], ["id"])
    return rounded(M.early_warning_curve(s, [2, 5, 20]))


@query("regression_metrics", "grades", "SELECT sex, round(sqrt(avg((G3 - G2) ** 2)), 6) AS rmse, round(avg(abs(G3 - G2)), 6) AS mae, round(1 - sum((G3 - G2) ** 2) / (var_pop(G3) * count(*)), 6) AS r2, count(*) AS n FROM grades GROUP BY sex")
def _(t):
    return rounded(M.regression_metrics(t.grades, ["sex"], "G3", "G2"))


@query("baseline_majority", "predictions", "SELECT grp, round(greatest(avg(y), 1 - avg(y)), 6) AS majority_accuracy FROM predictions GROUP BY grp")
def _(t):
    return rounded(M.majority_baseline(t.predictions, ["grp"]))


@query("improvement_over_baseline", LP, f"WITH {RANK} SELECT model, round(log_loss, 6) AS log_loss, round(brier, 6) AS brier, round(log_loss - (SELECT log_loss FROM ll WHERE model = 'prob_tcn'), 6) AS log_loss_gain, round(brier - (SELECT brier FROM ll WHERE model = 'prob_tcn'), 6) AS brier_gain FROM ll")
def _(t):
    m = t.long_predictions.groupBy("model").agg(M.log_loss().alias("log_loss"), M.brier().alias("brier"))
    return rounded(M.improvement_over_baseline(m, "model", "prob_tcn", ["log_loss", "brier"]))


@query("residuals_by_group", "grades", "SELECT sex, round(avg(G3 - G2), 6) AS mean, count(*) AS n, quantile_cont(G3 - G2, 0.25) AS q25, median(G3 - G2) AS median, quantile_cont(G3 - G2, 0.75) AS q75 FROM grades GROUP BY sex")
def _(t):
    return rounded(M.residuals_by_group(t.grades, ["sex"], "G3", "G2"))


# ---- calibration
BINS = "b AS (SELECT model, bin, avg(p) AS mp, avg(y) AS ob, count(*)::DOUBLE AS n, count(*) / any_value(t)::DOUBLE AS sh FROM (SELECT *, CASE WHEN p = 0 THEN {zero} ELSE ceil(round(p * 10, 9)) END AS bin, count(*) OVER (PARTITION BY model) AS t FROM long_predictions) GROUP BY model, bin)"


@query("ece", LP, f"WITH {BINS.format(zero=1)} SELECT model, round(sum(abs(mp - ob) * sh), 6) AS ece, round(max(abs(mp - ob)), 6) AS mce FROM b GROUP BY model")
def _(t):
    return rounded(C.calibration_error(t.long_predictions, ["model"]))


@query("ece_without_zero", LP, f"WITH {BINS.format(zero=0)} SELECT model, round(sum(abs(mp - ob) * sh), 6) AS ece, round(max(abs(mp - ob)), 6) AS mce FROM b WHERE bin > 0 GROUP BY model")
def _(t):
    return rounded(C.calibration_error(t.long_predictions, ["model"], include_zero=False))


@query("ece_quantile", LP, """WITH e AS (SELECT model, quantile_cont(p, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM long_predictions GROUP BY model),
 x AS (SELECT l.model, y, p, CASE WHEN p = 0 AND e[1] = 0 THEN 1 ELSE len(list_filter(e, lambda v: v < p)) END AS bin, count(*) OVER (PARTITION BY l.model) AS t FROM long_predictions l JOIN e ON e.model = l.model),
 b AS (SELECT model, bin, avg(p) AS mp, avg(y) AS ob, count(*) / any_value(t)::DOUBLE AS sh FROM x GROUP BY model, bin) SELECT model, round(sum(abs(mp - ob) * sh), 6) AS ece, round(max(abs(mp - ob)), 6) AS mce FROM b WHERE bin > 0 GROUP BY model""")
def _(t):
    return rounded(C.calibration_error(t.long_predictions, ["model"], n_bins=5, strategy="quantile"))


@query("reliability_table", LP, f"WITH {BINS.format(zero=1)} SELECT model, bin::INTEGER AS bin, round(mp, 6) AS mean_prob, round(ob, 6) AS observed, n::BIGINT AS n FROM b")
def _(t):
    return rounded(C.reliability_table(t.long_predictions, ["model"]))


BRIER = """k AS (SELECT model, p, count(*)::DOUBLE AS n, avg(y) AS o FROM long_predictions GROUP BY model, p), a AS (SELECT model, count(*)::DOUBLE AS t, avg(y) AS base, avg((p - y) ** 2) AS bs FROM long_predictions GROUP BY model),
 d AS (SELECT model, any_value(bs) AS brier_score, sum(n * (p - o) ** 2) / any_value(t) AS reliability, sum(n * (o - base) ** 2) / any_value(t) AS resolution, any_value(base * (1 - base)) AS uncertainty FROM k JOIN a USING (model) GROUP BY model)"""


@query("brier_decomposition", LP, f"WITH {BRIER} SELECT model, round(brier_score, 6) AS brier_score, round(reliability, 6) AS reliability, round(resolution, 6) AS resolution, round(uncertainty, 6) AS uncertainty, round(reliability - resolution + uncertainty, 6) AS verification FROM d")
def _(t):
    return rounded(C.brier_decomposition(t.long_predictions, ["model"]))


def _scan(rel, by, steps):
    return f"""g AS (SELECT unnest(range(0, {steps + 1})) AS j), k AS (SELECT x.{by}, g.j / {steps}.0 AS threshold, sum(y)::DOUBLE AS P_, count(*)::DOUBLE AS tot, (count(*) FILTER (WHERE round(p * {steps}, 9) >= j AND y = 1))::DOUBLE AS tp, (count(*) FILTER (WHERE round(p * {steps}, 9) >= j))::DOUBLE AS called FROM {rel} x, g GROUP BY x.{by}, g.j),
 s AS (SELECT {by}, threshold::DOUBLE AS threshold, tp, called - tp AS fp, called / tot AS selection_rate, CASE WHEN called > 0 THEN tp / called ELSE 0 END AS precision, CASE WHEN P_ > 0 THEN tp / P_ ELSE 0 END AS recall, CASE WHEN tot > P_ THEN (called - tp) / (tot - P_) ELSE 0 END AS fpr, (tp + tot - P_ - called + tp) / tot AS accuracy, tot FROM k),
 f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, recall - fpr AS youden FROM s)"""


@query("threshold_scan", LP, f"WITH {_scan('long_predictions', 'model', 50)} SELECT model, threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(selection_rate, 6) AS selection_rate, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy, round(youden, 6) AS youden, round((recall + 1 - fpr) / 2, 6) AS balanced_accuracy FROM f")
def _(t):
    return rounded(C.threshold_scan(t.long_predictions, ["model"], 50))


@query("best_threshold", LP, f"WITH {_scan('long_predictions', 'model', 50)} SELECT model, min(threshold) AS threshold, round(any_value(f1), 6) AS f1 FROM f WHERE round(f1, 12) = (SELECT round(max(f1), 12) FROM f f2 WHERE f2.model = f.model) GROUP BY model")
def _(t):
    return rounded(C.best_threshold(C.threshold_scan(t.long_predictions, ["model"], 50), ["model"], "f1"))


@query("threshold_scan_grouped", LP, f"WITH q AS (SELECT id_student, model, round(avg(p), 9) AS p, CASE WHEN avg(y) >= 0.5 THEN 1 ELSE 0 END AS y FROM long_predictions GROUP BY 1, 2), {_scan('q', 'model', 20)} SELECT model, min(threshold) AS threshold, round(any_value(youden), 6) AS youden FROM f WHERE round(youden, 12) = (SELECT round(max(youden), 12) FROM f f2 WHERE f2.model = f.model) GROUP BY model")
def _(t):
    g = C.grouped_predictions(t.long_predictions, ["id_student", "model"]).withColumn("p", F.round("p", 9))
    return rounded(C.best_threshold(C.threshold_scan(g, ["model"], 20), ["model"], "youden"))


OPT = f"WITH {RANK}, z AS (SELECT model, p AS threshold, tp / called AS pr, tp / P_ AS re, tp / P_ - (called - tp) / (tot - P_) AS yo, (tp + tot - P_ - called + tp) / tot AS ac FROM cum)"


def _opt(metric, expr, ok, low):
    return f"SELECT model, '{metric}' AS metric, threshold, round({expr}, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ({ok}) DESC, round({expr}, 12) DESC, threshold {'ASC' if low else 'DESC'}) AS rn FROM z) WHERE rn = 1"


@query("optimal_threshold", LP, OPT + " UNION ALL ".join([
    " " + _opt("f1", "2 * pr * re / (pr + re + 1e-8)", "true", True), _opt("precision", "pr", "re >= 0.7", True), _opt("recall", "re", "pr >= 0.7", True),
    _opt("youden", "yo", "true", False), _opt("accuracy", "ac", "true", False), _opt("balanced_accuracy", "(yo + 1) / 2", "true", False)]))
def _(t):
    metrics = ("f1", "precision", "recall", "youden", "accuracy", "balanced_accuracy")
    out = C.best_thresholds(t.long_predictions, ["model"], metrics)
    return rounded(out)


@query("confidence_histogram", LP, "SELECT model, least(floor(round(p * 20, 9)), 19)::INTEGER AS bin, y, count(*) AS n FROM long_predictions GROUP BY 1, 2, 3")
def _(t):
    return C.confidence_histogram(t.long_predictions, ["model"])


@query("calibration_summary", LP, f"{OPT}, {BINS.format(zero=1)}, {BRIER}, e AS (SELECT model, sum(abs(mp - ob) * sh) AS ece, max(abs(mp - ob)) AS mce FROM b GROUP BY model), o1 AS ({_opt('f1', '2 * pr * re / (pr + re + 1e-8)', 'true', True)}), o2 AS ({_opt('youden', 'yo', 'true', False)})"
       " SELECT model, round(ece, 6) AS ece, round(mce, 6) AS mce, round(brier_score, 6) AS brier_score, round(reliability, 6) AS reliability, round(resolution, 6) AS resolution, round(uncertainty, 6) AS uncertainty, round(reliability - resolution + uncertainty, 6) AS verification, o1.threshold AS f1_threshold, o2.threshold AS youden_threshold FROM e JOIN d USING (model) JOIN o1 USING (model) JOIN o2 USING (model)")
def _(t):
    return rounded(C.calibration_summary(t.long_predictions, ["model"]))


# ---- fairness
RATES = "count(*) AS n, avg(pred) AS selection_rate, coalesce(avg(pred) FILTER (WHERE y = 1), 0) AS tpr, coalesce(avg(pred) FILTER (WHERE y = 0), 0) AS fpr, avg(CASE WHEN y = pred THEN 1 ELSE 0 END) AS accuracy"
G = f"g AS (SELECT grp, {RATES} FROM w GROUP BY grp), o AS (SELECT {RATES} FROM w)"


@query("fairness_by_group", "predictions", f"WITH {W} SELECT sex, grp, " + ", ".join(f"round({x.split(' AS ')[0]}, 6) AS {x.split(' AS ')[1]}" if not x.startswith("count(*) AS n") else x for x in [
    "count(*) AS n", "avg(pred) AS selection_rate", "coalesce(avg(pred) FILTER (WHERE y = 1), 0) AS tpr", "coalesce(avg(pred) FILTER (WHERE y = 0), 0) AS fpr", "avg(CASE WHEN y = pred THEN 1 ELSE 0 END) AS accuracy"]) + " FROM w GROUP BY sex, grp")
def _(t):
    return rounded(B.fairness_by_group(wide(t), ["sex", "grp"]))


@query("parity_gaps", "predictions", f"WITH {W}, {G} SELECT round(max(selection_rate) - min(selection_rate), 6) AS demographic_parity_diff, round(greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)), 6) AS equalized_odds_diff, round(max(tpr) - min(tpr), 6) AS tpr_gap, round(max(fpr) - min(fpr), 6) AS fpr_gap, round(1 - min(accuracy), 6) AS worst_group_error FROM g")
def _(t):
    return rounded(B.parity_gaps(wide(t), ["grp"]))


@query("fairness_table", "predictions", f"WITH {W}, {G} SELECT g.grp, g.n, round(g.selection_rate, 6) AS selection_rate, round(greatest(abs(g.tpr - o.tpr), abs(g.fpr - o.fpr)), 6) AS equalized_odds, round(g.accuracy, 6) AS accuracy FROM g, o")
def _(t):
    return rounded(B.fairness_table(wide(t), ["grp"]))


@query("mitigation_delta", "predictions", f"""WITH {W}, {G}, w2 AS (SELECT *, CASE WHEN p >= 0.6 THEN 1 ELSE 0 END AS pred FROM (SELECT y, p, grp FROM w)), g2 AS (SELECT grp, {RATES} FROM w2 GROUP BY grp), o2 AS (SELECT {RATES} FROM w2),
 a AS (SELECT g.grp, g.selection_rate AS s, greatest(abs(g.tpr - o.tpr), abs(g.fpr - o.fpr)) AS e FROM g, o), b AS (SELECT g2.grp, g2.selection_rate AS s, greatest(abs(g2.tpr - o2.tpr), abs(g2.fpr - o2.fpr)) AS e FROM g2, o2)
 SELECT grp, round(a.s, 6) AS selection_rate_pre, round(a.e, 6) AS equalized_odds_pre, round(b.s, 6) AS selection_rate_post, round(b.e, 6) AS equalized_odds_post, round(b.s - a.s, 6) AS selection_rate_delta, round(b.e - a.e, 6) AS equalized_odds_delta FROM a JOIN b USING (grp)""")
def _(t):
    w = wide(t)
    post = w.withColumn("pred", (F.col("p") >= 0.6).cast("int"))
    return rounded(B.mitigation_delta(B.fairness_table(w, ["grp"]), B.fairness_table(post, ["grp"]), ["grp"]))


@query("overall_gaps", "predictions", f"WITH {W}, {G} SELECT round(avg(abs(g.selection_rate - o.selection_rate)), 6) AS demographic_parity_diff, round(max(abs(g.selection_rate - o.selection_rate)), 6) AS max_demographic_parity_diff, round(avg(abs(g.tpr - o.tpr)), 6) AS equalized_odds_diff, round(max(abs(g.tpr - o.tpr)), 6) AS max_equalized_odds_diff FROM g, o")
def _(t):
    return rounded(B.overall_gaps(wide(t), "grp"))


@query("group_quality", "predictions", f"""WITH {W}, {G}, r AS (SELECT grp, y, rank() OVER (PARTITION BY grp ORDER BY p) + (count(*) OVER (PARTITION BY grp, p) - 1) / 2.0 AS rk FROM w), a AS (SELECT grp, (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * (count(*) - sum(y))) AS auc FROM r GROUP BY grp)
 SELECT grp, n AS size, round(accuracy, 6) AS accuracy, round(selection_rate, 6) AS positive_rate, round(auc, 6) AS auc FROM g JOIN a USING (grp)""")
def _(t):
    return rounded(B.group_quality(wide(t), "grp"))


@query("reweighing", "predictions", "SELECT id, round((count(*) OVER (PARTITION BY grp))::DOUBLE * count(*) OVER (PARTITION BY y) / (count(*) OVER ()::DOUBLE * count(*) OVER (PARTITION BY grp, y)), 6) AS weight FROM predictions")
def _(t):
    return rounded(B.reweighing(t.predictions.select("id", "grp", "y"), "grp", "y").select("id", "weight"))


@query("inverse_freq_weights", "predictions", "WITH a AS (SELECT id, 1.0::DOUBLE / count(*) OVER (PARTITION BY sex, y) AS w FROM predictions) SELECT id, round(w / (SELECT avg(w) FROM a), 6) AS weight FROM a")
def _(t):
    return rounded(B.inverse_frequency_weights(t.predictions.select("id", "sex", "y"), ["sex", "y"]).select("id", "weight"))


def _gt(on, extra):
    return f"""WITH {W}, {_scan('w', 'grp', 20)}, t AS (SELECT unnest(range(0, 21)) AS target), p AS (SELECT t.target, f.*, row_number() OVER (PARTITION BY t.target, f.grp ORDER BY round(abs({on} - target / 20.0), 9), threshold) AS rn FROM f, t),
 b AS (SELECT * FROM p WHERE rn = 1), o AS (SELECT target FROM b GROUP BY target ORDER BY round(sum(accuracy * tot) / sum(tot){extra}, 9) DESC, target LIMIT 1)
 SELECT grp, threshold, round({on}, 6) AS {on}, round(accuracy, 6) AS accuracy FROM b JOIN o USING (target)"""


@query("group_thresholds_parity", "predictions", _gt("selection_rate", ""))
def _(t):
    return rounded(B.group_thresholds(wide(t), "grp", steps=20))


@query("group_thresholds_odds", "predictions", _gt("recall", " - (max(fpr) - min(fpr))"))
def _(t):
    return rounded(B.group_thresholds(wide(t), "grp", "equalized_odds", steps=20))


@query("worst_group_accuracy", "predictions", f"WITH {W}, {G} SELECT round(min(accuracy), 6) AS worst_accuracy, arg_min(grp, accuracy) AS worst_group, round(max(accuracy), 6) AS best_accuracy FROM g")
def _(t):
    return rounded(B.worst_group_accuracy(wide(t), "grp"))


# ---- conformal
CAL = "cal AS (SELECT y, prob_gru AS p, CASE WHEN y = 1 THEN 1 - prob_gru ELSE prob_gru END AS s FROM predictions WHERE sex = 'F'), tst AS (SELECT y, grp, prob_gru AS p FROM predictions WHERE sex = 'M')"
THR = "th AS (SELECT a AS alpha, (SELECT s0.v[1 + CAST(floor(least(1, (n + 1) * (1 - a) / n) * (n - 1)) AS BIGINT)] + (least(1, (n + 1) * (1 - a) / n) * (n - 1) - floor(least(1, (n + 1) * (1 - a) / n) * (n - 1))) * (s0.v[1 + CAST(ceil(least(1, (n + 1) * (1 - a) / n) * (n - 1)) AS BIGINT)] - s0.v[1 + CAST(floor(least(1, (n + 1) * (1 - a) / n) * (n - 1)) AS BIGINT)]) FROM (SELECT list(s ORDER BY s) AS v, count(*)::DOUBLE AS n FROM cal) s0) AS threshold FROM (SELECT unnest([0.1::DOUBLE, 0.3]) AS a))"
SETS = "st AS (SELECT alpha, threshold, y, grp, (p <= threshold OR (p > threshold AND 1 - p > threshold AND p <= 0.5))::INTEGER AS h0, (1 - p <= threshold OR (p > threshold AND 1 - p > threshold AND p > 0.5))::INTEGER AS h1, (p > threshold AND 1 - p > threshold)::INTEGER AS em FROM tst, th)"
COV = "round(avg(CASE WHEN y = 1 THEN h1 ELSE h0 END), 6) AS coverage, round(1 - alpha, 6) AS target, round(avg(CASE WHEN y = 1 THEN h1 ELSE h0 END) - (1 - alpha), 6) AS gap, round(avg(h0 + h1), 6) AS mean_set_size, round(avg((h0 + h1 = 1)::INTEGER), 6) AS singleton_rate, round(avg(em), 6) AS empty_rate, round(avg((h0 + h1 = 2)::INTEGER), 6) AS full_rate, count(*) AS n"


@query("nonconformity", "predictions", "SELECT id, round(CASE WHEN y = 1 THEN 1 - prob_gru ELSE prob_gru END, 6) AS score FROM predictions")
def _(t):
    return rounded(wide(t).select("id", U.nonconformity().alias("score")))


def _sides(t):
    w = wide(t).select("y", "p", "grp", "sex")
    return w.where("sex = 'F'"), w.where("sex = 'M'")


@query("conformal_calibrate", "predictions", f"WITH {CAL}, {THR} SELECT alpha, round(threshold, 6) AS threshold FROM th")
def _(t):
    return rounded(U.calibrate(_sides(t)[0], [0.1, 0.3]))


@query("conformal_sets", "predictions", f"WITH {CAL}, th AS (SELECT quantile_cont(s, 0.8) AS threshold, 0.2 AS alpha FROM cal), {SETS} SELECT y, h0 = 1 AS has_0, h1 = 1 AS has_1, em = 1 AS was_empty, count(*) AS n FROM st GROUP BY 1, 2, 3, 4")
def _(t):
    from edlens.operators.quantiles import quantiles

    cal, test = _sides(t)
    thr = quantiles(cal.select(U.nonconformity().alias("s")), [], "s", {"t": 0.8}).scalar()
    return U.predict_sets(test, thr).groupBy("y", "has_0", "has_1", "was_empty").agg(F.count(F.lit(1)).alias("n"))


@query("conformal_run", "predictions", f"WITH {CAL}, {THR}, {SETS} SELECT alpha, round(threshold, 6) AS threshold, {COV} FROM st GROUP BY alpha, threshold")
def _(t):
    return rounded(U.conformal_run(*_sides(t), [0.1, 0.3]))


@query("conformal_coverage_by_group", "predictions", f"WITH {CAL}, {THR}, {SETS} SELECT alpha, round(threshold, 6) AS threshold, grp, {COV} FROM st GROUP BY alpha, threshold, grp")
def _(t):
    return rounded(U.conformal_run(*_sides(t), [0.1, 0.3], ["grp"]))


@query("conformal_set_sizes", "predictions", f"WITH {CAL}, {THR}, {SETS} SELECT alpha, h0 + h1 AS set_size, count(*) AS n FROM st GROUP BY 1, 2")
def _(t):
    return U.set_sizes(*_sides(t), [0.1, 0.3])
