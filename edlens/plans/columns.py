"""Projections and scalar mappings on the course views."""

from __future__ import annotations

from pyspark.sql import functions as F

from edlens.functions import scalars as S
from edlens.operators import columns as C
from edlens.operators import features as X
from edlens.plans.registry import query
from edlens.plans.relational import rounded


@query("encode_labels", "registrations", """SELECT id_student, CASE WHEN lower(final_result) IN ('withdrawn', '1', 'true', 'fail', 'withdraw', 'at-risk') THEN 1 ELSE 0 END AS label FROM registrations""")
def _(t):
    return t.registrations.select("id_student", S.encode_label("final_result", "Withdrawn").alias("label"))


@query("map_values", "students", """SELECT id_student, CASE gender WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female' ELSE gender END AS sex,
 CASE age_band WHEN '0-35' THEN 'young' WHEN '35-55' THEN 'middle' ELSE 'other' END AS age_word FROM students""")
def _(t):
    return t.students.select("id_student", S.map_values("gender", {"M": "Male", "F": "Female"}).alias("sex"),
                             S.map_values("age_band", {"0-35": "young", "35-55": "middle"}, "other").alias("age_word"))


@query("intersect_key", "students", """SELECT id_student, concat_ws('_x_', coalesce(gender, 'Unknown'), coalesce(imd_band, 'Unknown')) AS key FROM students""")
def _(t):
    return t.students.select("id_student", S.intersect_key("gender", "imd_band").alias("key"))


@query("age_bands", "grades", """SELECT id, CASE WHEN age <= 22 THEN '0-35' ELSE '35-55' END AS band,
 CASE WHEN age BETWEEN 15 AND 17 THEN 'young' WHEN age BETWEEN 18 AND 20 THEN 'middle' WHEN age BETWEEN 21 AND 25 THEN 'older' ELSE 'middle' END AS grp FROM grades""")
def _(t):
    return t.grades.select("id", S.age_band("age").alias("band"), S.age_group("age").alias("grp"))


@query("cut_bins", "predictions", """SELECT id, CASE WHEN price >= 0 AND price <= 100000 THEN 0 WHEN price > 100000 AND price <= 250000 THEN 1 WHEN price > 250000 AND price <= 400000 THEN 2 END AS bin FROM predictions""")
def _(t):
    return t.predictions.select("id", S.cut_bins("price", [0, 100_000, 250_000, 400_000], [0, 1, 2]).alias("bin"))


@query("cut_equal_width", "grades", """SELECT id, CAST(greatest(least(ceil((absences - lo) * 3.0 / (hi - lo)) - 1, 2), 0) AS INTEGER) AS absences_bin,
 CAST(greatest(least(ceil((G1 - glo) * 3.0 / (ghi - glo)) - 1, 2), 0) AS INTEGER) AS G1_bin
 FROM grades, (SELECT min(absences)::DOUBLE AS lo, max(absences)::DOUBLE AS hi, min(G1)::DOUBLE AS glo, max(G1)::DOUBLE AS ghi FROM grades)""")
def _(t):
    return C.cut_equal_width(t.grades, ["absences", "G1"], 3).select("id", "absences_bin", "G1_bin")


@query("minmax_scale", "grades", """SELECT id, round((G1 - lo) / (hi - lo + 1e-8), 6) AS G1_scaled, round(1 - absences / (amax + 1.0), 6) AS absences_inverted
 FROM grades, (SELECT min(G1) AS lo, max(G1) AS hi, max(absences) AS amax FROM grades)""")
def _(t):
    return rounded(C.minmax_scale(t.grades, ["G1"], ("absences",)).select("id", "G1_scaled", "absences_inverted"))


@query("clip_scale", "students", """SELECT id_student, round(greatest(least((studied_credits - 30) / 210.0, 1), 0), 6) AS study_load,
 round(coalesce(greatest(least(balance / 5000.0, 1), 0), 0.5), 6) AS wealth FROM students""")
def _(t):
    return rounded(t.students.select("id_student", S.clip_scale("studied_credits", 30, 240, 0.5).alias("study_load"),
                                     S.clip_scale("balance", 0, 5000, 0.5).alias("wealth")))


@query("log_scale", "actions", """SELECT event_id, round(greatest(least(ln(1 + value) / ln(10001), 1), 0), 6) AS level, round(ln(1 + value), 6) AS log_value FROM actions""")
def _(t):
    return rounded(t.actions.select("event_id", S.log_scale("value").alias("level"), F.log1p("value").alias("log_value")))


@query("ses_proxy", "students", """SELECT id_student, CASE imd_band WHEN '0-10%' THEN 0.9::DOUBLE WHEN '10-20%' THEN 0.7 WHEN '20-30%' THEN 0.5 WHEN '30-40%' THEN 0.3 WHEN '40-50%' THEN 0.1 ELSE 0.5 END AS ses,
 round(greatest(least(4 - (balance / 100.0) / 25.0, 4), 0), 6) AS ses_percentile FROM students""")
def _(t):
    return rounded(t.students.select("id_student", S.ses_from_band("imd_band").alias("ses"), S.ses_from_percentile(F.col("balance") / 100.0).alias("ses_percentile")))


@query("attempts_to_performance", "students", """SELECT id_student, CASE num_of_prev_attempts WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 ELSE 0.1 END AS prior FROM students""")
def _(t):
    return t.students.select("id_student", S.attempts_to_performance("num_of_prev_attempts").alias("prior"))


@query("binary_proxy", "grades", """SELECT id, CASE WHEN absences > 0 THEN 'yes' ELSE 'no' END AS internet, CASE WHEN goout > 3 THEN 'yes' ELSE 'no' END AS activities,
 5 - studytime AS freetime, CASE famsup WHEN 'yes' THEN 3 ELSE 3 END AS famrel FROM grades""")
def _(t):
    return t.grades.select("id", S.yes_no(F.col("absences") > 0).alias("internet"), S.yes_no(F.col("goout") > 3).alias("activities"),
                           (5 - F.col("studytime")).alias("freetime"), S.map_values("famsup", S.SUPPORT_SCORE, 3).alias("famrel"))


@query("concept_means", "grades", """SELECT id, round((absences + failures) / 2.0, 6) AS attendance, round((Medu + Fedu + traveltime) / 3.0, 6) AS socio_economic_status,
 round((studytime + goout + Dalc + Walc + freetime) / 5.0, 6) AS engagement FROM grades""")
def _(t):
    return rounded(t.grades.select("id", *X.concept_means(t.grades)))


@query("row_stats", "grades", """WITH l AS (SELECT id, unnest([G1, G2, absences, age, health]) AS v FROM grades)
 SELECT id, round(avg(v), 6) AS row_mean, round(stddev_pop(v), 6) AS row_std, max(v)::DOUBLE AS row_max, min(v)::DOUBLE AS row_min, median(v) AS row_median,
 quantile_cont(v, 0.25) AS row_p25, quantile_cont(v, 0.75) AS row_p75, round(quantile_cont(v, 0.9), 6) AS row_p90,
 round(avg((v - m) ** 3) / stddev_pop(v) ** 3, 6) AS row_skewness, round(avg((v - m) ** 4) / stddev_pop(v) ** 4 - 3, 6) AS row_kurtosis
 FROM l JOIN (SELECT id, avg(v) AS m FROM l GROUP BY id) USING (id) GROUP BY id""")
def _(t):
    stats = S.row_array_stats(["G1", "G2", "absences", "age", "health"])
    return rounded(t.grades.select("id", *[c.alias(n) for n, c in stats.items()]))


@query("interactions", "grades", """SELECT id, G1 * G1 AS G1_squared, G2 * G2 AS G2_squared, G1 * G2 AS G1_x_G2, round(greatest(least(G1 / (G2 + 1e-8), 10), -10), 6) AS G1_over_G2 FROM grades""")
def _(t):
    return rounded(t.grades.select("id", *[c.alias(n) for n, c in S.interaction_columns(["G1", "G2"]).items()]))


@query("engagement_features", "grades", """SELECT id, round(least(G1 / (s1 + 1e-8), 3), 6) AS G1_intensity, round(least(G2 / (s2 + 1e-8), 3), 6) AS G2_intensity, round(least(G3 / (s3 + 1e-8), 3), 6) AS G3_intensity,
 round(least(1 / (sqrt(((G1 - m) ** 2 + (G2 - m) ** 2 + (G3 - m) ** 2) / 2) + 1e-8), 10), 6) AS engagement_consistency, round((G3 - G1) / 2.0, 6) AS performance_trend,
 round(greatest(least(G3 / (G1 + 1e-8), 10), 0), 6) AS early_late_engagement_ratio
 FROM (SELECT *, (G1 + G2 + G3) / 3.0 AS m FROM grades), (SELECT stddev_pop(G1) AS s1, stddev_pop(G2) AS s2, stddev_pop(G3) AS s3 FROM grades)""")
def _(t):
    cols = ["G1", "G2", "G3"]
    out = C.engagement_features(t.grades, cols).drop(*[c for c in t.grades.columns if c != "id"])
    return rounded(out)


@query("household_indices", "grades", """SELECT id, round((famrel + freetime + goout) / 3.0, 6) AS social_support_index, greatest(Medu, Fedu) AS family_education_max,
 abs(Medu - Fedu) AS education_balance, round((Dalc + Walc + health) / 3.0, 6) AS lifestyle_risk_score FROM grades""")
def _(t):
    return rounded(t.grades.select("id", *[c.alias(n) for n, c in S.household_columns().items()]))


@query("transfer_indices", "grades", """SELECT id, round((1 - absences / 33.0) * (1 + Medu / 4.0), 6) AS engagement_ses_index,
 round(failures * (1 + 1 / (1.0 + age)), 6) AS digital_access_score, G1 * G1 AS G1_squared, G2 * G2 AS G2_squared, age * age AS age_squared FROM grades""")
def _(t):
    g = t.grades.withColumn("att", 1 - F.col("absences") / 33.0).withColumn("ses", F.col("Medu") / 4.0)
    out = C.transfer_indices(g, "att", "ses", "failures", "age", ["G1", "G2", "age", "health"])
    return rounded(out.select("id", "engagement_ses_index", "digital_access_score", "G1_squared", "G2_squared", "age_squared"))


@query("frequency_codes", "students", """SELECT region, n, row_number() OVER (ORDER BY n DESC, region) - 1 AS code FROM (SELECT region, count(*) AS n FROM students GROUP BY region)""")
def _(t):
    return C.frequency_codes(t.students, "region").select("region", "n", F.col("code").cast("bigint").alias("code"))


@query("infer_columns", "", "SELECT user_id AS case_id, event_type AS activity, event_id FROM events")
def _(t):
    ev = t.raw("events").withColumnRenamed("event_type", "event")
    return C.infer_columns(ev).select("case_id", "activity", "event_id")


@query("parse_timestamps", "", """SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 1 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) ELSE date_trunc('second', ts) END AS parsed FROM events""")
def _(t):
    ts = F.col("ts")
    text = (F.when(F.col("event_id") % 4 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 4 == 1, F.date_format(ts, "yyyy-MM-dd"))
            .when(F.col("event_id") % 4 == 2, F.date_format(ts, "dd/MM/yyyy HH:mm:ss")).otherwise(F.lit("soon")))
    return t.raw("events").select("event_id", C.parse_timestamp(text).cast("timestamp_ntz").alias("parsed"))


@query("number_or_zero", "", "SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 5 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END AS DOUBLE), 0) AS v FROM events")
def _(t):
    x = F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return t.raw("events").select("event_id", S.number_or_zero(x).alias("v"))


@query("mooc_labels", "grades", """SELECT id, round(G1 / 20.0 * 0.3 + studytime / (SELECT max(studytime) FROM grades)::DOUBLE * 0.3 + goout / (SELECT max(goout) FROM grades)::DOUBLE * 0.2
 + absences / (SELECT max(absences) FROM grades)::DOUBLE * 0.2, 6) AS engagement_score, CASE WHEN G2 * 5 >= 60 THEN 1 ELSE 0 END AS label_pass, CASE WHEN G2 * 5 >= 80 THEN 1 ELSE 0 END AS label_certificate,
 CASE WHEN G1 / 20.0 >= 0.8 AND studytime >= 6 THEN 1 ELSE 0 END AS label_complete, round(G3 / (absences + 1.0), 6) AS engagement_intensity FROM grades""")
def _(t):
    g = t.grades.select("id", (F.col("G1") / 20.0).alias("video_completion_rate"), F.col("studytime").alias("assignments_submitted"), F.col("goout").alias("forum_posts"),
                        F.col("absences").alias("days_active"), (F.col("G2") * 5).alias("final_score"), F.col("G3").alias("total_video_time"))
    return rounded(C.mooc_labels(g).select("id", "engagement_score", "label_pass", "label_certificate", "label_complete", "engagement_intensity"))


@query("custom_groups", "grades", """SELECT id, CASE WHEN Medu >= 3 AND Fedu >= 3 THEN 'high' WHEN Medu = 2 AND Fedu = 2 THEN 'medium' WHEN Medu <= 1 AND Fedu <= 1 THEN 'low' END AS ses,
 CASE WHEN age <= 17 THEN 'young' WHEN age > 17 THEN 'older' END AS age_group FROM grades""")
def _(t):
    rules = {"ses": {"high": "Medu >= 3 AND Fedu >= 3", "medium": "Medu = 2 AND Fedu = 2", "low": "Medu <= 1 AND Fedu <= 1"},
             "age_group": {"young": "age <= 17", "older": "age > 17"}}
    return C.custom_groups(t.grades, rules).select("id", "ses", "age_group")


@query("performance_band", "predictions", """SELECT id, CASE WHEN prob_gru >= 0.8 THEN 'Excellent' WHEN prob_gru >= 0.6 THEN 'Good' ELSE 'Needs improvement' END AS band FROM predictions""")
def _(t):
    return t.predictions.select("id", S.band("prob_gru", [(0.8, "Excellent"), (0.6, "Good")], "Needs improvement").alias("band"))


@query("extract_direction", "", "SELECT p_partkey, p_brand AS source, p_type AS target FROM part")
def _(t):
    s, g = S.direction(F.concat_ws("_to_", "p_brand", "p_type"))
    return t.raw("part").select("p_partkey", s.alias("source"), g.alias("target"))


@query("recommend_by_risk", "predictions", """SELECT id, unnest(CASE WHEN 1 - prob_gru > 0.5 THEN ['Schedule time with a tutor', 'Join a study group', 'Review class materials twice a week']
 ELSE ['Keep up the good work!', 'Explore enrichment activities'] END) AS recommendation FROM predictions""")
def _(t):
    return C.recommend(t.predictions.select("id", (1 - F.col("prob_gru")).alias("risk")), "risk").select("id", "recommendation")
