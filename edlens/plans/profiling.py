"""Profiles, association, result tables and validation on the course views."""

from __future__ import annotations

from pyspark.sql import functions as F

from edlens.operators import features as X
from edlens.operators import profile as P
from edlens.operators import validation as V
from edlens.plans.registry import query
from edlens.plans.relational import rounded
from edlens.plans.splitting import LAB

G3 = ["G1", "G2", "absences", "age"]
CATS = ["gender", "age_band", "imd_band"]


@query("group_counts", "students", " UNION ALL ".join(
    f"""SELECT '{c}' AS attribute, {c} AS "group", count(*) AS n, (SELECT count(*) FROM students WHERE {c} IS NULL) AS missing FROM students WHERE {c} IS NOT NULL GROUP BY {c}""" for c in CATS))
def _(t):
    return P.group_counts(t.students, CATS)


@query("category_summary", "students", " UNION ALL ".join(
    f"""SELECT '{c}' AS attribute, {c} AS "group", count(*) AS n, (SELECT count(*) FROM students WHERE {c} IS NULL) AS missing, round(count(*) * 100.0 / (SELECT count(*) FROM students), 6) AS percent FROM students WHERE {c} IS NOT NULL GROUP BY {c}""" for c in CATS))
def _(t):
    return rounded(P.category_summary(t.students, CATS))


@query("describe_numeric", "", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.25), 6) AS q25, round(median({c}), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75 FROM lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_discount")))
def _(t):
    return rounded(P.describe_numeric(t.raw("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("describe_strings", "students", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, count(DISTINCT {c}) AS "unique", (SELECT {c} FROM students WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top, (SELECT count(*) AS k FROM students WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY k DESC LIMIT 1) AS freq FROM students"""
    for c in ("region", "imd_band")))
def _(t):
    return P.describe_strings(t.students, ["region", "imd_band"])


@query("grouped_moments", "grades", "SELECT school, sex, count(G3) AS count, round(avg(G3), 6) AS mean, round(stddev_samp(G3), 6) AS std FROM grades GROUP BY school, sex")
def _(t):
    return rounded(P.grouped_moments(t.grades, ["school", "sex"], "G3"))


@query("rate_by_group", "registrations students", f"""WITH {LAB} SELECT 'sex' AS attribute, sex AS "group", round(avg(label_pass), 6) AS pass_rate, count(*) AS count, CAST(sum(label_pass) AS BIGINT) AS pass_count FROM lab GROUP BY sex
 UNION ALL SELECT 'code_module', code_module, round(avg(label_pass), 6), count(*), CAST(sum(label_pass) AS BIGINT) FROM lab GROUP BY code_module""")
def _(t):
    return rounded(P.rate_by_group(X.derive_labels(t.students, t.registrations), ["sex", "code_module"], "label_pass"))


@query("corr_matrix", "", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for i, a in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"]) for b in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"][i + 1:]))
def _(t):
    return rounded(P.corr_matrix(t.raw("lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query("corr_with_target", "grades", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(corr({c}, G3)), 6) AS abs_corr FROM grades" for c in ["G1", "G2", "absences", "age", "Medu"]) + ") ORDER BY abs_corr DESC LIMIT 3")
def _(t):
    return rounded(P.corr_with_target(t.grades, ["G1", "G2", "absences", "age", "Medu"], "G3", 3))


@query("class_balance", "predictions", "SELECT count(*) FILTER (WHERE y = 0) AS class_0, count(*) FILTER (WHERE y = 1) AS class_1, round(count(*) FILTER (WHERE y = 0) / count(*) FILTER (WHERE y = 1), 6) AS imbalance_ratio FROM predictions")
def _(t):
    return rounded(P.class_balance(t.predictions, "y"))


@query("crosstab", "students", "SELECT age_band, imd_band, count(*) AS n FROM students WHERE imd_band IS NOT NULL GROUP BY 1, 2")
def _(t):
    return P.crosstab(t.students, "age_band", "imd_band")


def _chi(a, b, table="students"):
    return f"""SELECT '{a}' AS a, '{b}' AS b, n, k1 AS rows, k2 AS cols, (k1 - 1) * (k2 - 1) AS dof, chi2 FROM (
 SELECT CAST(max(tot) AS BIGINT) AS n, count(DISTINCT x) AS k1, count(DISTINCT z) AS k2,
 CASE WHEN count(DISTINCT x) = 2 AND count(DISTINCT z) = 2 THEN sum(greatest(abs(o - e) - 0.5, 0) ** 2 / e) ELSE sum((o - e) ** 2 / e) END AS chi2 FROM (
 SELECT r.x, c.z, coalesce(k.o, 0) AS o, r.n * c.n / t.tot::DOUBLE AS e, t.tot FROM (SELECT {a} AS x, count(*) AS n FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1) r
 CROSS JOIN (SELECT {b} AS z, count(*) AS n FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1) c CROSS JOIN (SELECT count(*) AS tot FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL) t
 LEFT JOIN (SELECT {a} AS x, {b} AS z, count(*) AS o FROM {table} GROUP BY 1, 2) k ON k.x = r.x AND k.z = c.z))"""


PAIRS = [("gender", "disability"), ("age_band", "imd_band"), ("gender", "region")]
ASSOC = "WITH chi AS (" + " UNION ALL ".join(_chi(a, b) for a, b in PAIRS) + """), v AS (SELECT *, sqrt(chi2 / n / (least(rows, cols) - 1)) AS cramers_v,
 sqrt(greatest(chi2 / n - (rows - 1) * (cols - 1) / (n - 1), 0) / (least(rows - (rows - 1) ** 2 / (n - 1), cols - (cols - 1) ** 2 / (n - 1)) - 1)) AS cramers_v_corrected FROM chi) """


@query("chi2_association", "students", ASSOC + "SELECT a, b, n, rows, cols, dof, round(chi2, 6) AS chi2, round(cramers_v, 6) AS cramers_v, round(cramers_v_corrected, 6) AS cramers_v_corrected FROM v")
def _(t):
    return rounded(P.association(t.students, PAIRS, p_value=False))


@query("cramers_matrix", "students", ASSOC.replace(_chi("gender", "disability"), _chi("gender", "age_band")).replace(_chi("gender", "region"), _chi("gender", "imd_band")) + "SELECT a, b, round(cramers_v, 6) AS cramers_v, round(cramers_v_corrected, 6) AS cramers_v_corrected FROM v")
def _(t):
    return rounded(P.cramers_matrix(t.students, CATS))


def _mi(f, table, y):
    return f"""SELECT '{f}' AS feature, round(sum(n / t * ln(n * t / (r * c))), 6) AS mutual_information FROM (SELECT n::DOUBLE AS n, sum(n) OVER (PARTITION BY {f})::DOUBLE AS r, sum(n) OVER (PARTITION BY {y})::DOUBLE AS c, sum(n) OVER ()::DOUBLE AS t
 FROM (SELECT {f}, {y}, count(*) AS n FROM {table} GROUP BY 1, 2))"""


@query("mutual_information", "grades", " UNION ALL ".join(_mi(f, "grades", "failures") for f in ("studytime", "Medu", "school")))
def _(t):
    return rounded(P.mutual_information(t.grades, ["studytime", "Medu", "school"], "failures"))


@query("mutual_information_binned", "predictions", "WITH q AS (SELECT quantile_cont(price, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS a, quantile_cont(prob_gru, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS b FROM predictions), bins AS (SELECT y, len(list_filter(a, lambda v: price > v)) AS price, len(list_filter(b, lambda v: prob_gru > v)) AS prob_gru FROM predictions, q) "
       + " UNION ALL ".join(_mi(f, "bins", "y") for f in ("price", "prob_gru")))
def _(t):
    return rounded(P.mutual_information(P.quantile_bin(t.predictions, ["price", "prob_gru"]), ["price", "prob_gru"], "y"))


@query("dataset_summary", "registrations students", f"WITH {LAB} SELECT count(*) AS rows, round(avg(label_pass), 6) AS label_pass_rate, count(DISTINCT code_module) AS code_module_distinct, count(DISTINCT id_student) AS id_student_distinct FROM lab")
def _(t):
    return rounded(P.dataset_summary(X.derive_labels(t.students, t.registrations), ["label_pass"], ["code_module", "id_student"]))


@query("risk_list", "predictions", """SELECT CASE WHEN id_student % 10 = 0 THEN NULL ELSE id_student END AS student, grp, round(avg(prob_gru), 6) AS prob_avg, max(prob_gru) AS prob_max, count(prob_gru) AS n_rows, CASE WHEN round(avg(prob_gru), 12) >= 0.4 THEN 1 ELSE 0 END AS high_risk FROM predictions GROUP BY 1, 2""")
def _(t):
    p = t.predictions.withColumn("student", F.when(F.col("id_student") % 10 != 0, F.col("id_student")))
    return rounded(P.risk_list(p, ["student", "grp"], "prob_gru", 0.4))


@query("score_quantiles", "predictions", "SELECT count(prob_gru) AS count, round(avg(prob_gru), 6) AS mean, round(stddev_samp(prob_gru), 6) AS std, " + ", ".join(f"round(quantile_cont(prob_gru, {p}), 6) AS q{round(p * 100):02d}" for p in P.SCORE_LEVELS) + " FROM predictions")
def _(t):
    return rounded(P.score_quantiles(t.predictions, "prob_gru"))


@query("top_and_bottom", "predictions", """WITH m AS (SELECT id_student, avg(prob_gru) AS mean_pred FROM predictions GROUP BY 1) SELECT id_student, round(mean_pred, 6) AS mean_pred, 'top' AS side FROM (SELECT * FROM m ORDER BY round(mean_pred, 9) DESC, id_student LIMIT 5)
 UNION ALL SELECT id_student, round(mean_pred, 6), 'bottom' FROM (SELECT * FROM m ORDER BY round(mean_pred, 9), id_student LIMIT 5)""")
def _(t):
    return rounded(P.top_and_bottom(t.predictions, ["id_student"], "prob_gru"))


@query("concept_effects", "grades", "WITH c AS (SELECT G3, (absences + failures) / 2.0 AS attendance, (Medu + Fedu + traveltime) / 3.0 AS socio_economic_status, (studytime + goout + Dalc + Walc + freetime) / 5.0 AS engagement FROM grades) "
       + " UNION ALL ".join(f"SELECT '{c}' AS concept, round(abs(regr_slope(G3, {c})), 6) AS effect, round(corr({c}, G3), 6) AS corr FROM c" for c in ("attendance", "socio_economic_status", "engagement")))
def _(t):
    g = t.grades.select("G3", *X.concept_means(t.grades))
    return rounded(P.concept_effects(g, ["attendance", "socio_economic_status", "engagement"], "G3"))


RUNS = """runs AS (SELECT model || ':' || grp AS run, model, grp, sex, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, avg((p - y) * (p - y)) AS brier, stddev_samp(p) AS spread,
 model IN ('prob_gru', 'prob_lstm') AS use_recurrent, sex = 'F' AS use_first FROM long_predictions GROUP BY model, grp, sex)"""


def runs(t):
    """Result table of experiments: accuracy and Brier score per model, group and sex."""
    p = t.long_predictions.groupBy("model", "grp", "sex").agg(
        F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int")).alias("accuracy"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"),
        F.stddev_samp("p").alias("spread"))
    return p.select(F.concat_ws(":", "model", "grp").alias("run"), "*", F.col("model").isin("prob_gru", "prob_lstm").alias("use_recurrent"), (F.col("sex") == "F").alias("use_first"))


@query("transfer_matrix", "long_predictions", f"WITH {RUNS} SELECT model, round(coalesce(avg(accuracy) FILTER (WHERE sex = 'F'), 0), 6) AS F, round(coalesce(avg(accuracy) FILTER (WHERE sex = 'M'), 0), 6) AS M, 0.0::DOUBLE AS X FROM runs GROUP BY model")
def _(t):
    return rounded(P.transfer_matrix(runs(t), "model", "sex", "accuracy", ["F", "M", "X"]))


@query("component_effects", "long_predictions", f"WITH {RUNS}, l AS (SELECT 'use_recurrent' AS component, use_recurrent AS o, accuracy AS m FROM runs UNION ALL SELECT 'use_first', use_first, accuracy FROM runs)," """
 g AS (SELECT component, avg(m) FILTER (WHERE o) AS mw, avg(m) FILTER (WHERE NOT o) AS mo, count(*) FILTER (WHERE o) AS nw, count(*) FILTER (WHERE NOT o) AS no_, var_samp(m) FILTER (WHERE o) AS vw, var_samp(m) FILTER (WHERE NOT o) AS vo FROM l GROUP BY component)
 SELECT component, round(mw, 6) AS mean_with, round(mo, 6) AS mean_without, nw AS n_with, no_ AS n_without, round(mw - mo, 6) AS effect_size, round((mw - mo) / sqrt(((nw - 1) * vw + (no_ - 1) * vo) / (nw + no_ - 2) * (1.0 / nw + 1.0 / no_)), 6) AS t FROM g""")
def _(t):
    return rounded(P.component_effects(runs(t), ["use_recurrent", "use_first"], "accuracy", p_value=False))


@query("leaderboard", "long_predictions", f"WITH {RUNS}, l AS (SELECT run || sex AS run, 'accuracy' AS metric, accuracy AS v FROM runs UNION ALL SELECT run || sex, 'brier', brier FROM runs)" """
 SELECT metric, arg_max(run, v) AS best, round(max(v), 6) AS best_value, arg_min(run, v) AS worst, round(min(v), 6) AS worst_value, round(max(v) - min(v), 6) AS spread FROM l GROUP BY metric""")
def _(t):
    return rounded(P.leaderboard(runs(t).withColumn("run", F.concat("run", "sex")), "run", ["accuracy", "brier"]))


@query("robust_runs", "long_predictions", f"WITH {RUNS} SELECT run || sex AS run, round(spread, 6) AS spread FROM runs WHERE spread < (SELECT median(spread) FROM runs)")
def _(t):
    return rounded(P.robust_runs(runs(t).withColumn("run", F.concat("run", "sex")), "run", "spread"))


@query("best_per_group", "long_predictions", f"WITH {RUNS} SELECT grp, arg_max(model || sex, accuracy) AS run, round(max(accuracy), 6) AS accuracy FROM runs GROUP BY grp")
def _(t):
    return rounded(P.best_per_group(runs(t).withColumn("run", F.concat("model", "sex")), ["grp"], "accuracy", "run"))


@query("top_n_per_group", "long_predictions", f"WITH {RUNS} SELECT * FROM (SELECT grp, model || sex AS run, round(accuracy, 6) AS accuracy, row_number() OVER (PARTITION BY grp ORDER BY accuracy DESC, model || sex)::INTEGER AS rank FROM runs) WHERE rank <= 3")
def _(t):
    return rounded(P.top_n(runs(t).withColumn("run", F.concat("model", "sex")), ["grp"], "accuracy", "run", 3).select("grp", "run", "accuracy", "rank"))


@query("multi_attribute", "predictions", """SELECT sex, grp, concat_ws('+', CASE WHEN grouping(sex) = 0 THEN 'sex' END, CASE WHEN grouping(grp) = 0 THEN 'grp' END) AS level, count(*) AS n, round(avg(y), 6) AS rate
 FROM predictions GROUP BY GROUPING SETS ((sex), (grp), (sex, grp))""")
def _(t):
    return rounded(P.multi_attribute(t.predictions, ["sex", "grp"], [F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate")]))


# ---- validation
def _r(check, level, item, value, ok):
    return f"SELECT '{check}' AS \"check\", '{level}' AS level, '{item}' AS item, round(({value})::DOUBLE, 6) AS value, ({ok}) AS passed"


@query("check_structure", "", " UNION ALL ".join([_r("structure", "error", "not_empty", "1", "true"), _r("structure", "error", "c_custkey", "1", "true"), _r("structure", "error", "final_result", "0", "false")]))
def _(t):
    return rounded(V.check_structure(t.raw("customer"), ["c_custkey", "final_result"]))


@query("check_identifiers", "", "WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT sum(n) AS r, count(*) AS k FROM k) " + " UNION ALL ".join([
    _r("identifiers", "error", "null_keys", "0", "true"), _r("identifiers", "error", "duplicate_keys", "SELECT r - k FROM s", "SELECT r = k FROM s"), _r("identifiers", "info", "distinct_keys", "SELECT k FROM s", "true")]))
def _(t):
    return rounded(V.check_identifiers(t.raw("lineitem"), ["l_orderkey", "l_linenumber"]))


@query("check_labels", "predictions", " UNION ALL ".join([
    _r("labels", "error", "y_null", "0", "true"), _r("labels", "error", "y_not_binary", "0", "true"), _r("labels", "warning", "y_rate", "SELECT avg(y) FROM predictions", "SELECT avg(y) BETWEEN 0.1 AND 0.9 FROM predictions")]))
def _(t):
    return rounded(V.check_labels(t.predictions, ["y"]))


@query("check_features", "assessments", " UNION ALL ".join([
    _r("features", "error", "deadline_infinite", "0", "true"), _r("features", "warning", "deadline_missing", "SELECT avg(CASE WHEN deadline IS NULL THEN 1 ELSE 0 END) FROM assessments", "true"),
    _r("features", "error", "id_assessment_infinite", "0", "true"), _r("features", "warning", "id_assessment_missing", "0", "true"),
    _r("features", "warning", "vle_columns", "0", "false"), _r("features", "warning", "assessment_columns", "0", "false")]))
def _(t):
    return rounded(V.check_features(t.assessments, ["deadline", "id_assessment"]))


@query("check_sensitive", "students", " UNION ALL ".join(
    x for c in ("imd_band", "region") for x in (
        _r("sensitive", "warning", f"{c}_missing", f"SELECT avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) FROM students", f"SELECT avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) <= 0.3 FROM students"),
        _r("sensitive", "warning", f"{c}_smallest_group", f"SELECT min(n) FROM (SELECT count(*) AS n FROM students WHERE {c} IS NOT NULL GROUP BY {c})", f"SELECT min(n) >= 30 FROM (SELECT count(*) AS n FROM students WHERE {c} IS NOT NULL GROUP BY {c})"))))
def _(t):
    return rounded(V.check_sensitive(t.students, ["imd_band", "region"]))


@query("validation_report", "predictions students", "SELECT 0::BIGINT AS errors, (SELECT count(*) FROM (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM students GROUP BY region)) WHERE m < 30) + (SELECT count(*) FROM (SELECT avg(y) AS a FROM predictions) WHERE a NOT BETWEEN 0.1 AND 0.9) AS warnings, true AS passed")
def _(t):
    p, s = t.predictions, t.students
    return V.verdict(V.validation_report(V.check_structure(p, ["id", "y"]), V.check_identifiers(p, ["id"]), V.check_labels(p, ["y"]), V.check_sensitive(s, ["region"])))


CANON = """c AS (SELECT id, sex, CASE WHEN absences > 20 THEN NULL ELSE Medu::DOUBLE END AS ses_index, G1 / 18.0 AS prior_performance FROM grades)"""


def canonical(t):
    g = t.grades
    return g.select("id", "sex", F.when(F.col("absences") <= 20, F.col("Medu").cast("double")).alias("ses_index"), (F.col("G1") / 18.0).alias("prior_performance"))


@query("check_canonical", "grades", f"WITH {CANON} " + " UNION ALL ".join([
    _r("canonical", "warning", "sex_missing", "0", "true"), _r("canonical", "warning", "ses_index_missing", "SELECT avg((ses_index IS NULL)::INTEGER) FROM c", "SELECT avg((ses_index IS NULL)::INTEGER) <= 0.2 FROM c"),
    _r("canonical", "warning", "prior_performance_missing", "0", "true"), _r("canonical", "error", "prior_performance_out_of_range", "SELECT count(*) FROM c WHERE prior_performance > 1", "SELECT count(*) = 0 FROM c WHERE prior_performance > 1")]))
def _(t):
    return rounded(V.check_canonical(canonical(t)))


@query("fill_canonical", "grades", f"WITH {CANON} SELECT id, sex, coalesce(ses_index, 2.0) AS ses_index, round(prior_performance, 6) AS prior_performance FROM c")
def _(t):
    return rounded(V.fill_canonical(canonical(t)))


PROBS = ["prob_gru", "prob_lstm", "prob_transformer", "prob_tcn"]


@query("interaction_choice", "predictions", "WITH p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM predictions" for i, a in enumerate(PROBS) for b in PROBS[i + 1:]) + ") SELECT a, b FROM p WHERE abs(r) > 0.1 AND abs(r) < 0.8")
def _(t):
    from edlens.operators.prep import interaction_choice

    return t.spark.createDataFrame(interaction_choice(t.predictions, PROBS), "a string, b string")


@query("drop_leaky", "grades", "SELECT id, sex, G1, label_pass, count(*) AS n FROM (SELECT id, sex, G1, (G3 >= 10)::INTEGER AS label_pass FROM grades) GROUP BY ALL")
def _(t):
    from edlens.sources.readers import drop_leaky, with_label

    g = drop_leaky(with_label(t.grades.select("id", "sex", "G1", "G2", "G3")), ["G2", "G3"])
    return g.groupBy("id", "sex", "G1", "label_pass").agg(F.count(F.lit(1)).alias("n"))
