"""Drift, weighting, mapping and alignment between two sides of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from edlens.operators import alignment as A
from edlens.operators import drift as D
from edlens.operators import features as X
from edlens.operators import mapping as Mp
from edlens.plans.evaluation import W, wide
from edlens.plans.registry import query
from edlens.plans.relational import CLICK_SQL, K, rounded

COLS = ["l_quantity", "l_extendedprice", "l_discount"]
# Source: not returned. Target: returned, with the price raised so that there is a shift to find.
DOM = "d AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS domain, l_quantity, l_extendedprice * (CASE WHEN l_returnflag = 'R' THEN 1.3::DOUBLE ELSE 1 END) AS l_extendedprice, l_discount FROM lineitem)"


def dom(t):
    r = F.col("l_returnflag") == "R"
    return t.raw("lineitem").select(r.cast("int").alias("domain"), "l_quantity", (F.col("l_extendedprice") * F.when(r, 1.3).otherwise(1.0)).alias("l_extendedprice"), "l_discount")


def _psi(c):
    return f"""SELECT '{c}' AS feature, sum((a - e) * ln(a / e)) AS psi FROM (SELECT b, coalesce(ns, 0) / ts + 1e-8 AS e, coalesce(nt, 0) / tt + 1e-8 AS a FROM
 (SELECT least(floor(({c} - lo) * 10 / (hi - lo)), 9) AS b, (count(*) FILTER (WHERE domain = 0))::DOUBLE AS ns, (count(*) FILTER (WHERE domain = 1))::DOUBLE AS nt FROM d, (SELECT min({c}) AS lo, max({c}) AS hi FROM d WHERE domain = 0) WHERE {c} BETWEEN lo AND hi GROUP BY 1),
 (SELECT (count(*) FILTER (WHERE domain = 0))::DOUBLE AS ts, (count(*) FILTER (WHERE domain = 1))::DOUBLE AS tt FROM d))"""


def _ks(c):
    return f"""SELECT '{c}' AS feature, max(abs(cs / ts - ct / tt)) AS ks, any_value(ts)::BIGINT AS n_source, any_value(tt)::BIGINT AS n_target FROM (SELECT sum(ns) OVER (ORDER BY v) AS cs, sum(nt) OVER (ORDER BY v) AS ct, sum(ns) OVER () AS ts, sum(nt) OVER () AS tt
 FROM (SELECT {c} AS v, (count(*) FILTER (WHERE domain = 0))::DOUBLE AS ns, (count(*) FILTER (WHERE domain = 1))::DOUBLE AS nt FROM d GROUP BY 1))"""


PSI = "psi AS (" + " UNION ALL ".join(map(_psi, COLS)) + ")"
KS = "ks AS (" + " UNION ALL ".join(map(_ks, COLS)) + ")"


@query("psi", "", f"WITH {DOM}, {PSI} SELECT feature, round(psi, 6) AS psi FROM psi")
def _(t):
    return rounded(D.psi(dom(t), COLS))


@query("ks_two_sample", "", f"WITH {DOM}, {KS} SELECT feature, round(ks, 6) AS ks, n_source, n_target FROM ks")
def _(t):
    return rounded(D.ks_two_sample(dom(t), COLS, p_value=False))


ST = "st AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) FILTER (WHERE domain = 0) AS source_mean, avg({c}) FILTER (WHERE domain = 1) AS target_mean, stddev_pop({c}) FILTER (WHERE domain = 0) AS source_std, stddev_pop({c}) FILTER (WHERE domain = 1) AS target_std FROM d" for c in COLS) + ")"


@query("shift_report", "", f"WITH {DOM}, {PSI}, {KS}, {ST} SELECT feature, round(psi, 6) AS psi, round(ks, 6) AS ks, n_source, n_target, round(source_mean, 5) AS source_mean, round(target_mean, 5) AS target_mean, round(source_std, 5) AS source_std, round(target_std, 5) AS target_std FROM psi JOIN ks USING (feature) JOIN st USING (feature)")
def _(t):
    r = D.shift_report(dom(t), COLS, p_value=False)
    return rounded(r.withColumns({c: F.round(c, 5) for c in ("source_mean", "target_mean", "source_std", "target_std")}))


@query("shift_summary", "", f"WITH {DOM}, {PSI}, {KS} SELECT round(avg(psi), 6) AS mean_psi, round(max(psi), 6) AS max_psi, round(avg(ks), 6) AS mean_ks, round(max(ks), 6) AS max_ks, count(*) FILTER (WHERE psi > 0.2) AS shifted_features, round(median(psi), 6) AS median_psi FROM psi JOIN ks USING (feature)")
def _(t):
    return rounded(D.shift_summary(D.shift_report(dom(t), COLS, p_value=False)))


SIDES = "s AS (SELECT * FROM w WHERE sex = 'F'), t AS (SELECT * FROM w WHERE sex = 'M')"


def sides(t):
    w = wide(t)
    return w.where("sex = 'F'"), w.where("sex = 'M'")


@query("label_shift_counts", "predictions", f"WITH {W}, {SIDES} SELECT c AS class, round((SELECT avg((y = c)::INTEGER) FROM s), 6) AS source_share, round((SELECT avg((pred = c)::INTEGER) FROM t), 6) AS target_share, abs((SELECT avg((y = c)::INTEGER) FROM s) - (SELECT avg((pred = c)::INTEGER) FROM t)) > 0.1 AS shifted FROM (SELECT unnest([0, 1]) AS c)")
def _(t):
    return rounded(D.label_shift_counts(*sides(t), "y", "pred"))


@query("correct_priors", "predictions", "SELECT id, round(prob_gru * 0.5 / 0.33 / (prob_gru * 0.5 / 0.33 + (1 - prob_gru) * 0.5 / 0.67), 6) AS p FROM predictions")
def _(t):
    return rounded(wide(t).select("id", D.correct_priors("p", 0.33, 0.5).alias("p")))


@query("label_shift_em", "predictions", """WITH RECURSIVE c AS (SELECT prob_gru AS p, count(*)::DOUBLE AS n FROM predictions WHERE sex = 'M' GROUP BY 1), b AS (SELECT avg(y) AS pi FROM predictions WHERE sex = 'F'),
 e(i, q) AS (SELECT 0, pi FROM b UNION ALL SELECT i + 1, (SELECT sum(n * (p * e.q / pi) / (p * e.q / pi + (1 - p) * (1 - e.q) / (1 - pi))) / sum(n) FROM c, b) FROM e WHERE i < 8)
 SELECT round(max(q) FILTER (WHERE i = 8), 6) AS target_prior, 8 AS iterations FROM e""")
def _(t):
    s, g = sides(t)
    prior, n = D.label_shift_em(g, s.agg(F.avg("y")).first()[0], max_iter=8, tol=0.0)
    return t.spark.createDataFrame([(round(prior, 6), n)], "target_prior double, iterations int")


@query("label_shift_confusion", "predictions", f"""WITH {W}, {SIDES}, r AS (SELECT avg(pred) FILTER (WHERE y = 0) AS f, avg(pred) FILTER (WHERE y = 1) AS h, avg(y) AS b FROM s), q AS (SELECT avg(pred) AS q FROM t),
 z AS (SELECT greatest(least((q - f) / (h - f), 1), 0) AS one, greatest(least(1 - (q - f) / (h - f), 1), 0) AS zero, b FROM r, q)
 SELECT 0 AS class, round(1 - b, 6) AS source_prior, round(zero / (one + zero), 6) AS target_prior FROM z UNION ALL SELECT 1, round(b, 6), round(one / (one + zero), 6) FROM z""")
def _(t):
    return rounded(D.label_shift_confusion(*sides(t)))


@query("shift_distances", "predictions", f"""WITH {W}, {SIDES}, p AS (SELECT c, (SELECT avg((y = c)::INTEGER) FROM s) AS a, (SELECT avg((pred = c)::INTEGER) FROM t) AS b FROM (SELECT unnest([0, 1]) AS c))
 SELECT round(sum(abs(b - a)) * 0.5, 6) AS total_variation, round(sum((b + 1e-8) * ln((b + 1e-8) / (a + 1e-8))), 6) AS kl_divergence, round(max(abs(b - a)), 6) AS max_class_difference, round(sum((b - a) ** 2 / a), 6) AS chi_square, sum(abs(b - a)) * 0.5 > 0.1 AS shift_detected FROM p""")
def _(t):
    return rounded(D.shift_distances(D.label_shift_counts(*sides(t), "y", "pred"), "source_share", "target_share"))


@query("moment_match", "predictions", """WITH a AS (SELECT avg(price) AS m, stddev_pop(price) AS s FROM predictions WHERE sex = 'F'), b AS (SELECT avg(price * 2) AS m, stddev_pop(price * 2) AS s FROM predictions WHERE sex = 'M')
 SELECT id, round((price - a.m) / (a.s + 1e-8) * (b.s + 1e-8) + b.m, 3) AS price FROM predictions, a, b WHERE sex = 'F'""")
def _(t):
    s, g = sides(t)
    return rounded(D.moment_match(s, g.withColumn("price", F.col("price") * 2), ["price"]).select("id", "price"), 3)


GW = "gw AS (SELECT id, price, p, exp(-abs(price - tp) / sp / 2) * exp(-abs(p - tq) / sq / 2) AS w FROM s, (SELECT avg(price) AS tp, avg(p) AS tq FROM t), (SELECT stddev_samp(price) AS sp, stddev_samp(p) AS sq FROM s)), nw AS (SELECT *, w / (SELECT avg(w) FROM gw) AS weight FROM gw)"
WP = "w AS (SELECT *, prob_gru AS p FROM predictions)"


@query("gaussian_weights", "predictions", f"WITH {WP}, {SIDES}, {GW} SELECT id, round(weight, 6) AS weight FROM nw")
def _(t):
    return rounded(D.gaussian_weights(*sides(t), ["price", "p"]).select("id", "weight"))


@query("weight_quality", "predictions", f"""WITH {WP}, {SIDES}, {GW}, q AS (SELECT abs(sum(weight * price) / sum(weight) - (SELECT avg(price) FROM t)) / ((stddev_pop(price) + (SELECT stddev_pop(price) FROM t)) / 2) AS a, abs(sum(weight * p) / sum(weight) - (SELECT avg(p) FROM t)) / ((stddev_pop(p) + (SELECT stddev_pop(p) FROM t)) / 2) AS b FROM nw)
 SELECT round(avg(weight), 6) AS mean, round(stddev_pop(weight), 6) AS std, round(min(weight), 6) AS min, round(max(weight), 6) AS max, round(median(weight), 6) AS median, round(sum(weight) ** 2 / sum(weight * weight), 4) AS effective_sample_size,
 round((any_value(a) + any_value(b)) / 2, 6) AS mean_standardized_diff, round(greatest(any_value(a), any_value(b)), 6) AS max_standardized_diff, any_value((a > 0.2)::INTEGER + (b > 0.2)::INTEGER) AS features_with_large_diff FROM nw, q""")
def _(t):
    s, g = sides(t)
    out = D.weight_quality(D.gaussian_weights(s, g, ["price", "p"]), g, ["price", "p"])
    return rounded(out.withColumn("effective_sample_size", F.round("effective_sample_size", 4)))


@query("odds_weights", "predictions", "WITH r AS (SELECT id, prob_gru / greatest(1 - prob_gru, 1e-8) AS w FROM predictions), c AS (SELECT id, least(w, (SELECT quantile_cont(w, 0.95) FROM r)) AS w FROM r) SELECT id, round(w / (SELECT avg(w) FROM c), 6) AS weight FROM c")
def _(t):
    return rounded(D.odds_weights(wide(t), "p").select("id", "weight"))


@query("entropy_confidence", "predictions", "SELECT sex, round(avg(-(greatest(p, 1e-8) * ln(greatest(p, 1e-8)) + greatest(1 - p, 1e-8) * ln(greatest(1 - p, 1e-8)))), 6) AS entropy, round(-avg(greatest(p, 1 - p)), 6) AS confidence_loss FROM (SELECT sex, prob_gru AS p FROM predictions) GROUP BY sex")
def _(t):
    return rounded(wide(t).groupBy("sex").agg(*[c.alias(n) for n, c in D.entropy_confidence().items()]))


@query("pseudo_label", "predictions", """WITH c AS (SELECT id, (prob_gru > 0.5)::INTEGER AS pseudo_label FROM predictions WHERE greatest(prob_gru, 1 - prob_gru) > 0.8), r AS (SELECT *, row_number() OVER (PARTITION BY pseudo_label ORDER BY md5(concat_ws('|', id, '42'))) AS k FROM c)
 SELECT id, pseudo_label FROM r WHERE k <= (SELECT min(n) FROM (SELECT count(*) AS n FROM c GROUP BY pseudo_label))""")
def _(t):
    return D.pseudo_label(wide(t).select("id", "p"), ["id"]).select("id", "pseudo_label")


# ---- mappings
@query("canonical_bridge_uci", "grades", """SELECT id, sex, CASE WHEN age BETWEEN 15 AND 17 THEN 'young' WHEN age BETWEEN 18 AND 20 THEN 'middle' ELSE 'older' END AS age_group, Medu::DOUBLE AS ses_index, (famrel - 1)::DOUBLE AS family_support, round(least(G1 / 20.0, 1), 6) AS prior_performance,
 studytime / 4.0::DOUBLE AS study_load, studytime / 4.0::DOUBLE AS activity_level, studytime::DOUBLE AS study_time, (G3 >= 10)::INTEGER AS label_pass FROM grades""")
def _(t):
    return rounded(Mp.canonical_bridge(t.grades, "uci", ["id"]))


def course(t):
    base = X.derive_labels(t.students, t.registrations).withColumnRenamed("num_of_prev_attempts", "prev_attempts")
    base = base.withColumn("sex", F.col("gender"))
    return X.assemble(base, [X.click_features(t.clicks).select("id_student", "code_module", "code_presentation", "vle_total_clicks")])


COURSE = f"co AS (SELECT s.*, r.final_result, CASE WHEN final_result = 'Pass' THEN 1 ELSE 0 END AS label_pass, coalesce(vle_total_clicks, 0) AS vle_total_clicks FROM registrations r JOIN students s USING ({K}) LEFT JOIN ({CLICK_SQL} GROUP BY {K}) c USING ({K}))"


@query("canonical_bridge_oulad", "clicks students registrations", f"""WITH {COURSE} SELECT id_student, gender AS sex, CASE age_band WHEN '0-35' THEN 'young' WHEN '35-55' THEN 'middle' ELSE 'older' END AS age_group,
 round(CASE imd_band WHEN '0-10%' THEN 4 - 5 / 25.0 WHEN '10-20%' THEN 4 - 15 / 25.0 WHEN '20-30%' THEN 4 - 25 / 25.0 WHEN '30-40%' THEN 4 - 35 / 25.0 WHEN '40-50%' THEN 4 - 45 / 25.0 ELSE 2 END, 6) AS ses_index, CASE disability WHEN 'N' THEN 3.0::DOUBLE ELSE 1 END AS family_support,
 CASE num_of_prev_attempts WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 ELSE 0.1 END AS prior_performance, round((studied_credits - 30) / 210.0, 6) AS study_load, round(least(ln(1 + vle_total_clicks) / ln(10001), 1), 6) AS activity_level,
 CASE WHEN vle_total_clicks <= 100 THEN 0.0::DOUBLE WHEN vle_total_clicks <= 500 THEN 1 WHEN vle_total_clicks <= 2000 THEN 2 ELSE 3 END AS study_time, (final_result IN ('Pass', 'Distinction'))::INTEGER AS label_pass FROM co""")
def _(t):
    return rounded(Mp.canonical_bridge(course(t), "oulad", ["id_student"]))


@query("shared_features_oulad", "clicks students registrations", f"""WITH {COURSE} SELECT id_student, gender AS sex, age_band, CASE imd_band WHEN '0-10%' THEN 0.9::DOUBLE WHEN '10-20%' THEN 0.7 WHEN '20-30%' THEN 0.5 WHEN '30-40%' THEN 0.3 WHEN '40-50%' THEN 0.1 ELSE 0.5 END AS ses_proxy,
 round((vle_total_clicks - lo) / (hi - lo + 1e-8), 6) AS attendance_proxy, CASE WHEN vle_total_clicks > 0 THEN 'yes' ELSE 'no' END AS internet, label_pass AS label FROM co, (SELECT min(vle_total_clicks) AS lo, max(vle_total_clicks) AS hi FROM co)""")
def _(t):
    return rounded(Mp.shared_features(course(t), "oulad", ["id_student"]))


@query("shared_features_uci", "grades", """SELECT id, sex, studytime, goout, famsup, CASE WHEN age <= 22 THEN '0-35' ELSE '35-55' END AS age_band, Medu / 4.0::DOUBLE AS ses_proxy, round(1 - absences / ((SELECT max(absences) FROM grades) + 1.0), 6) AS attendance_proxy, internet, freetime, famrel, (G3 >= 10)::INTEGER AS label FROM grades""")
def _(t):
    return rounded(Mp.shared_features(t.grades, "uci", ["id"]))


@query("common_features", "grades", """SELECT id, (G3 >= 10)::INTEGER AS label_pass, sex AS gender, age AS age_normalized, greatest(Medu, Fedu) AS education, (SELECT max(absences) FROM grades) - absences AS engagement_score, G1 AS prior_performance, sex || '_x_young' AS gender_x_age FROM grades""")
def _(t):
    return Mp.common_features(t.grades, ["id"])


@query("align_columns", "grades", """SELECT 0 AS domain, sex, failures, 'med' AS absences_binned, label, count(*) AS n FROM (SELECT sex, failures, (G3 >= 10)::INTEGER AS label FROM grades) GROUP BY ALL UNION ALL
 SELECT 1, sex, failures, CASE WHEN b = 0 THEN 'low' WHEN b = 1 THEN 'med' ELSE 'high' END, label, count(*) FROM (SELECT sex, failures, (G3 >= 10)::INTEGER AS label, greatest(least(ceil((absences - lo) * 3.0 / (hi - lo)) - 1, 2), 0) AS b FROM grades, (SELECT min(absences)::DOUBLE AS lo, max(absences)::DOUBLE AS hi FROM grades)) GROUP BY ALL""")
def _(t):
    g = t.grades.withColumn("label", (F.col("G3") >= 10).cast("int"))
    a, b = Mp.align_columns(g.select("sex", "failures", "age", "label"), g.select("sex", "failures", "absences", "label"))
    both = a.withColumn("domain", F.lit(0)).unionByName(b.withColumn("domain", F.lit(1)))
    return both.groupBy("domain", "sex", "failures", "absences_binned", "label").agg(F.count(F.lit(1)).alias("n"))


@query("rescale_to_reference", "grades students", """SELECT id, round((absences - lo) / (hi - lo)::DOUBLE * (rhi - rlo) + rlo, 6) AS absences FROM grades, (SELECT min(absences) AS lo, max(absences) AS hi FROM grades), (SELECT min(studied_credits) AS rlo, max(studied_credits) AS rhi FROM students)""")
def _(t):
    ref = t.students.select(F.col("studied_credits").alias("absences"))
    return rounded(Mp.rescale_to_reference(t.grades, ref, ["absences"]).select("id", "absences"))


@query("unknown_to_mode", "students", """SELECT id_student, CASE WHEN region IN (SELECT region FROM students WHERE gender = 'F' AND num_of_prev_attempts < 2) THEN region ELSE (SELECT region FROM students WHERE gender = 'F' AND num_of_prev_attempts < 2 GROUP BY region ORDER BY count(*) DESC, region LIMIT 1) END AS region FROM students""")
def _(t):
    ref = t.students.where("gender = 'F' AND num_of_prev_attempts < 2")
    return Mp.unknown_to_mode(t.students, ref, "region").select("id_student", "region")


@query("joint_prepare", "grades", """WITH g AS (SELECT id, CASE WHEN sex = 'F' THEN 0 ELSE 1 END AS domain, G1::DOUBLE AS G1, absences::DOUBLE AS absences, (dense_rank() OVER (ORDER BY school) - 1)::DOUBLE AS school FROM grades), x AS (SELECT *, G1 * absences AS G1_x_absences, G1 * school AS G1_x_school, absences * school AS absences_x_school FROM g)
 SELECT id, domain, """ + ", ".join(f"round(({c} - (SELECT median({c}) FROM x WHERE domain = 0)) / (SELECT CASE WHEN q = 0 THEN 1 ELSE q END FROM (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS q FROM x WHERE domain = 0)), 6) AS {c}" for c in ("G1", "absences", "school", "G1_x_absences", "G1_x_school", "absences_x_school")) + " FROM x")
def _(t):
    g = t.grades
    return rounded(Mp.joint_prepare(g.where("sex = 'F'"), g.where("sex = 'M'"), ["G1", "absences", "school"], ["id"]))


# ---- alignment
@query("mmd_linear", "", f"WITH {DOM} SELECT round((avg(l_quantity) FILTER (WHERE domain = 0) - avg(l_quantity) FILTER (WHERE domain = 1)) ** 2 + (avg(l_discount) FILTER (WHERE domain = 0) - avg(l_discount) FILTER (WHERE domain = 1)) ** 2, 6) AS mmd_linear FROM d")
def _(t):
    return rounded(A.mmd_linear(dom(t), ["l_quantity", "l_discount"]))


def _vectors(t):
    return t.raw("embeddings").select((F.col("label") >= 5).cast("int").alias("domain"), "embedding")


@query("mmd_polynomial", "", """WITH e AS (SELECT vec_id, (label >= 5)::INTEGER AS d, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT a.d AS da, b.d AS db, avg((list_dot_product(a.v, b.v) / 64.0 + 1) ** 2) AS k FROM e a, e b GROUP BY 1, 2)
 SELECT round(sum(CASE WHEN da = db THEN k ELSE -k END), 5) AS mmd_polynomial FROM p""")
def _(t):
    return t.spark.createDataFrame([(round(A.mmd_polynomial(_vectors(t), ["embedding"], 2), 5),)], "mmd_polynomial double")


@query("mmd_rbf", "")
def _(t):
    return t.spark.createDataFrame([(round(A.mmd_rbf(_vectors(t), ["embedding"], 0.5), 6),)], "mmd_rbf double")


CV = "c AS (SELECT covar_samp(l_quantity, l_quantity) FILTER (WHERE domain = 0) - covar_samp(l_quantity, l_quantity) FILTER (WHERE domain = 1) AS a, covar_samp(l_quantity, l_discount) FILTER (WHERE domain = 0) - covar_samp(l_quantity, l_discount) FILTER (WHERE domain = 1) AS b, covar_samp(l_discount, l_discount) FILTER (WHERE domain = 0) - covar_samp(l_discount, l_discount) FILTER (WHERE domain = 1) AS e FROM d)"


@query("coral_loss", "", f"WITH {DOM}, {CV} SELECT round(sqrt(a * a + 2 * b * b + e * e), 6) AS coral_loss FROM c")
def _(t):
    return rounded(A.coral_loss(dom(t), ["l_quantity", "l_discount"]))


# After alignment the source side has the covariance of the target side, and mean 0.
@query("coral_apply", "", f"""WITH {DOM} SELECT 0.0::DOUBLE AS mean_q, round(stddev_samp(l_quantity), 3) AS std_q, round(stddev_samp(l_extendedprice), 3) AS std_price, round(corr(l_quantity, l_extendedprice), 3) AS corr FROM d WHERE domain = 1""")
def _(t):
    d = dom(t)
    model = A.coral_fit(d, ["l_quantity", "l_extendedprice"], regularization=1e-3)
    out = A.coral_apply(d.where("domain = 0"), ["l_quantity", "l_extendedprice"], model)
    return rounded(out.agg(F.avg("l_quantity").alias("mean_q"), F.stddev_samp("l_quantity").alias("std_q"), F.stddev_samp("l_extendedprice").alias("std_price"),
                           F.corr("l_quantity", "l_extendedprice").alias("corr")).withColumn("mean_q", F.abs(F.round("mean_q", 3))), 3)


def _eigen(d):
    a, b, e = (f"covar_samp({x}, {y}) FILTER (WHERE domain = {d})" for x, y in (("l_quantity", "l_quantity"), ("l_quantity", "l_discount"), ("l_discount", "l_discount")))
    mid, half = f"(({a}) + ({e}) + 0.002) / 2", f"sqrt(((({a}) - ({e})) / 2) ** 2 + ({b}) ** 2)"
    return f"({mid} + {half}) / ({mid} - {half})"


@query("alignment_metrics", "", f"""WITH {DOM}, {CV}, f AS (SELECT sqrt(a * a + 2 * b * b + e * e) AS f FROM c), k AS (SELECT {_eigen(0)} AS s, {_eigen(1)} AS t FROM d)
 SELECT round(f, 4) AS frobenius_before, 0.0::DOUBLE AS frobenius_after, round(f, 4) AS improvement, 1.0::DOUBLE AS relative_improvement, round(s, 0) AS source_condition, round(t, 0) AS target_condition FROM f, k""")
def _(t):
    d = dom(t)
    out = A.alignment_metrics(d, A.coral_fit(d, ["l_quantity", "l_discount"]))
    return rounded(out.withColumns({c: F.round(c, 0) for c in ("source_condition", "target_condition")}), 4)
