"""Feature building, labels and joins on the course views."""

from __future__ import annotations

from pyspark.sql import functions as F

from edlens.operators import features as X
from edlens.plans.registry import query
from edlens.plans.standins import KEYS, Tables

K = "id_student, code_module, code_presentation"


def rounded(df, places: int = 6):
    """Doubles rounded so that two engines' summation orders give one text."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("pass_rate_by_activity", "", """
WITH ev AS (SELECT user_id, event_type, value, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events),
feat AS (SELECT user_id, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total, avg(floor(value)) AS mean_clicks,
   CAST(max(CAST(floor(value) AS BIGINT)) AS BIGINT) AS max_clicks, CAST(sum(CASE WHEN day < 7 THEN floor(value) ELSE 0 END) AS BIGINT) AS week1,
   count(DISTINCT day) AS days FROM ev WHERE day < 23 GROUP BY user_id),
lab AS (SELECT DISTINCT user_id, 1 AS passed FROM ev WHERE day >= 23 AND event_type = 'purchase'),
q AS (SELECT quantile_cont(total, 1/3.0) AS a, quantile_cont(total, 2/3.0) AS b FROM feat),
j AS (SELECT feat.*, coalesce(passed, 0) AS label, CASE WHEN total <= a THEN 'low' WHEN total <= b THEN 'mid' ELSE 'high' END AS activity
  FROM feat LEFT JOIN lab USING (user_id), q)
SELECT activity, count(*) AS students, round(avg(label), 6) AS pass_rate, round(avg(total), 6) AS mean_clicks,
  round(avg(week1), 6) AS mean_week1, round(avg(days), 6) AS mean_days, max(max_clicks) AS max_clicks FROM j GROUP BY activity""")
def _(t: Tables):
    ev = t.clicks.select("id_student", "activity", "date", "sum_click")
    early = ev.where("date < 23")
    feat = early.groupBy("id_student").agg(
        F.sum("sum_click").alias("total"), F.max("sum_click").alias("max_clicks"),
        F.sum(F.when(F.col("date") < 7, F.col("sum_click")).otherwise(0)).alias("week1"),
        F.count_distinct("date").alias("days"),
    )
    label = ev.where("date >= 23 AND activity = 'purchase'").select("id_student", F.lit(1).alias("passed")).distinct()
    from edlens.operators.quantiles import quantiles

    q = quantiles(feat, [], "total", {"a": 1 / 3, "b": 2 / 3}).select(F.struct("a", "b")).scalar()
    tercile = F.when(F.col("total") <= q["a"], "low").when(F.col("total") <= q["b"], "mid").otherwise("high")
    out = feat.join(label, "id_student", "left").groupBy(tercile.alias("activity")).agg(
        F.count(F.lit(1)).alias("students"), F.avg(F.coalesce("passed", F.lit(0))).alias("pass_rate"),
        F.avg("total").alias("mean_clicks"), F.avg("week1").alias("mean_week1"), F.avg("days").alias("mean_days"),
        F.max("max_clicks").alias("max_clicks"),
    )
    return rounded(out)


CLICK_SQL = f"""SELECT {K}, CAST(sum(sum_click) AS BIGINT) AS vle_total_clicks, round(avg(sum_click), 6) AS vle_mean_clicks,
 max(sum_click) AS vle_max_clicks, CAST(coalesce(sum(CASE WHEN date <= 28 THEN sum_click END), 0) AS BIGINT) AS vle_first4_clicks,
 CAST(coalesce(sum(CASE WHEN date >= -28 THEN sum_click END), 0) AS BIGINT) AS vle_last4_clicks,
 CAST(sum(sum_click) AS BIGINT) AS vle_cumulative_clicks, count(DISTINCT date) AS vle_days_active FROM clicks"""


@query("click_features", "clicks", CLICK_SQL + f" GROUP BY {K}")
def _(t):
    return rounded(X.click_features(t.clicks))


@query("click_features_cutoff", "clicks", CLICK_SQL + f" WHERE date <= 14 GROUP BY {K}")
def _(t):
    return rounded(X.click_features(t.clicks, cutoff_day=14))


@query("click_features_final_weeks", "clicks", CLICK_SQL.replace(" FROM clicks",
    ", CAST(coalesce(sum(CASE WHEN date > 30 - 7 THEN sum_click END), 0) AS BIGINT) AS vle_final_clicks FROM clicks") + f" GROUP BY {K}")
def _(t):
    return rounded(X.click_features(t.clicks.withColumn("length", F.lit(30)), course_length="length", last_days=7))


@query("click_features_ext", "clicks", f"""SELECT {K}, CAST(sum(sum_click) AS BIGINT) AS vle_total_clicks, round(avg(sum_click), 6) AS vle_mean_clicks,
 round(coalesce(stddev_samp(sum_click), 0), 6) AS vle_std_clicks, max(sum_click) AS vle_max_clicks, min(date) AS vle_first_access,
 max(date) AS vle_last_access, count(DISTINCT date) AS vle_days_active, count(DISTINCT id_site) AS vle_unique_resources,
 max(date) - min(date) AS vle_activity_duration FROM clicks WHERE date <= 28 GROUP BY {K}""")
def _(t):
    return rounded(X.click_features_ext(t.clicks))


SUBS = f"""WITH subs AS (SELECT s.*, {K}, CASE WHEN date_submitted <= deadline THEN 1 ELSE 0 END AS on_time
 FROM submissions s LEFT JOIN assessments a USING (id_assessment))"""


def _subs(t):
    return X.attach_deadlines(t.submissions, t.assessments)


@query("submission_features", "submissions assessments", SUBS + f"""
SELECT {K}, count(*) AS assessment_count, round(avg(score), 6) AS assessment_mean_score,
 arg_max(score, (date_submitted, id_assessment, l_linenumber, l_partkey, l_suppkey, score)) AS assessment_last_score,
 round(avg(on_time), 6) AS assessment_ontime_rate FROM subs GROUP BY {K}""")
def _(t):
    tie = ["id_assessment", "l_linenumber", "l_partkey", "l_suppkey", "score"]
    return rounded(X.submission_features(_subs(t), tiebreak=tie))


@query("submission_features_ext", "submissions assessments", SUBS + f"""
SELECT {K}, count(score) AS assessment_count, round(avg(score), 6) AS assessment_mean_score, max(score) AS assessment_max_score,
 min(score) AS assessment_min_score, round(coalesce(stddev_samp(score), 0), 6) AS assessment_std_score,
 min(date_submitted) AS assessment_first_submit, max(date_submitted) AS assessment_last_submit,
 CAST(sum(is_banked) AS BIGINT) AS assessment_banked_count, round(avg(on_time), 6) AS assessment_ontime_rate FROM subs GROUP BY {K}""")
def _(t):
    return rounded(X.submission_features_ext(_subs(t)))


LABELS = f"""SELECT {K}, date_registration, final_result, gender, age_band,
 CASE WHEN final_result = 'Pass' THEN 1 ELSE 0 END AS label_pass, CASE WHEN final_result IN ('Fail', 'Withdrawn') THEN 1 ELSE 0 END AS label_fail_or_withdraw,
 CASE gender WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' ELSE gender END AS sex,
 concat_ws('_x_', CASE gender WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' ELSE coalesce(gender, 'Unknown') END, coalesce(age_band, 'Unknown')) AS sex_x_age"""


@query("derive_labels", "registrations students", LABELS + f" FROM registrations LEFT JOIN students USING ({K})")
def _(t):
    cols = [*KEYS, "date_registration", "final_result", "gender", "age_band", "label_pass", "label_fail_or_withdraw", "sex", "sex_x_age"]
    return X.derive_labels(t.students, t.registrations).select(*cols)


@query("derive_labels_inner", "registrations students", LABELS.replace("final_result = 'Pass'", "final_result IN ('Pass', 'Distinction')")
       + f" FROM registrations JOIN students USING ({K})")
def _(t):
    cols = [*KEYS, "date_registration", "final_result", "gender", "age_band", "label_pass", "label_fail_or_withdraw", "sex", "sex_x_age"]
    return X.derive_labels(t.students, t.registrations, "inner", ("Pass", "Distinction")).select(*cols)


def course_table(t):
    base = X.derive_labels(t.students, t.registrations)
    return X.assemble(base, [X.click_features(t.clicks), X.submission_features(_subs(t), tiebreak=["id_assessment", "l_linenumber", "l_partkey", "l_suppkey", "score"])])


@query("course_table", "clicks registrations students submissions assessments", f"""
WITH c AS ({CLICK_SQL} GROUP BY {K}), subs AS (SELECT s.*, {K}, CASE WHEN date_submitted <= deadline THEN 1 ELSE 0 END AS on_time
 FROM submissions s LEFT JOIN assessments a USING (id_assessment)),
s AS (SELECT {K}, count(*) AS n, avg(score) AS m, avg(on_time) AS ot FROM subs GROUP BY {K}), l AS ({LABELS} FROM registrations LEFT JOIN students USING ({K}))
SELECT {K}, label_pass, sex_x_age, coalesce(vle_total_clicks, 0) AS vle_total_clicks, coalesce(vle_days_active, 0) AS vle_days_active,
 coalesce(n, 0) AS assessment_count, round(coalesce(m, 0), 6) AS assessment_mean_score, round(coalesce(ot, 0), 6) AS assessment_ontime_rate
FROM l LEFT JOIN c USING ({K}) LEFT JOIN s USING ({K})""")
def _(t):
    return rounded(course_table(t).select(*KEYS, "label_pass", "sex_x_age", "vle_total_clicks", "vle_days_active",
                                          "assessment_count", "assessment_mean_score", "assessment_ontime_rate"))


@query("dimension_join", "clicks resources", """SELECT activity_type, count(*) AS n, CAST(sum(sum_click) AS BIGINT) AS clicks
 FROM clicks LEFT JOIN resources USING (id_site) GROUP BY activity_type""")
def _(t):
    return X.join_dimension(t.clicks, t.resources, ["id_site"]).groupBy("activity_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sum_click").alias("clicks"))


@query("deadline_join", "submissions assessments", """SELECT coalesce(date_submitted <= deadline, false) AS on_time, deadline IS NULL AS no_deadline,
 count(*) AS n, round(avg(score), 6) AS mean_score FROM submissions LEFT JOIN assessments USING (id_assessment) GROUP BY 1, 2""")
def _(t):
    return rounded(_subs(t).groupBy((F.col("on_time") == 1).alias("on_time"), F.col("deadline").isNull().alias("no_deadline")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score")))


@query("one_to_one_join", "predictions registrations", """SELECT p.id_student, sum(y)::BIGINT AS positives, r.final_result FROM predictions p
 JOIN registrations r USING (id_student) GROUP BY p.id_student, r.final_result""")
def _(t):
    sums = t.predictions.groupBy("id_student").agg(F.sum("y").alias("positives"))
    return X.one_to_one_join(sums, t.registrations.select("id_student", "final_result"), ["id_student"])


@query("shared_key_join", "predictions", """WITH a AS (SELECT id_student, sex, prob_gru, row_number() OVER (PARTITION BY id_student, sex ORDER BY prob_gru) AS r FROM predictions),
 b AS (SELECT id_student, sex, prob_lstm, row_number() OVER (PARTITION BY id_student, sex ORDER BY prob_lstm) AS r FROM predictions)
 SELECT id_student, sex, prob_gru AS p_0, prob_lstm AS p_1 FROM a JOIN b USING (id_student, sex, r)""")
def _(t):
    a = t.predictions.select("id_student", "sex", "grp", F.col("prob_gru").alias("p"))
    b = t.predictions.select("id_student", "sex", F.col("prob_lstm").alias("p"))
    return X.join_on_shared_keys([a, b], ["id_student", "sex", "grp"], "p")


@query("lookup_with_default", "actions students", """SELECT a.event_id, a.username, coalesce(s.balance, 0) AS balance, 0.0::DOUBLE AS birth
 FROM actions a LEFT JOIN (SELECT CAST(id_student AS STRING) AS username, balance FROM students) s USING (username)""")
def _(t):
    dim = t.students.select(F.col("id_student").cast("string").alias("username"), "balance")
    return X.lookup_with_default(t.actions.select("event_id", "username"), dim, "username", ["balance", "birth"])


@query("membership", "clicks registrations", """SELECT 'in' AS side, count(*) AS n, CAST(sum(sum_click) AS BIGINT) AS clicks FROM clicks WHERE id_student IN (SELECT id_student FROM registrations WHERE final_result = 'Pass')
 UNION ALL SELECT 'out', count(*), CAST(sum(sum_click) AS BIGINT) FROM clicks WHERE id_student NOT IN (SELECT id_student FROM registrations WHERE final_result = 'Pass')""")
def _(t):
    ids = t.registrations.where("final_result = 'Pass'")
    parts = [X.members(t.clicks, ids, ["id_student"], keep).agg(F.count(F.lit(1)).alias("n"), F.sum("sum_click").alias("clicks"))
             .select(F.lit("in" if keep else "out").alias("side"), "n", "clicks") for keep in (True, False)]
    return parts[0].unionByName(parts[1])


@query("early_window", "clicks", "SELECT date, count(*) AS n FROM clicks WHERE date <= 10 GROUP BY date")
def _(t):
    return X.early_window(t.clicks, 10).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("drop_missing", "students", """SELECT count(*) FILTER (WHERE imd_band IS NULL) AS dropped, count(*) AS total, (SELECT count(*) FROM students WHERE imd_band IS NOT NULL) AS kept FROM students""")
def _(t):
    kept, dropped = X.drop_missing(t.students, ["imd_band", "id_student"])
    return dropped.withColumn("kept", kept.agg(F.count(F.lit(1))).scalar())


@query("at_risk_rows", "predictions", "SELECT id, id_student, prob_gru FROM predictions WHERE y = 0 OR prob_gru < 0.5")
def _(t):
    return X.at_risk_rows(t.predictions, "y", "prob_gru").select("id", "id_student", "prob_gru")
