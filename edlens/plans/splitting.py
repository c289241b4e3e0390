"""Splits, folds and table inspection on the course views."""

from __future__ import annotations

from pyspark.sql import functions as F

from edlens.operators import features as X
from edlens.operators import splits as L
from edlens.plans.registry import query
from edlens.plans.relational import rounded
from edlens.sources import readers as R
from edlens.sources import writers as Wr


def labelled(t):
    return X.derive_labels(t.students, t.registrations).select("id_student", "code_module", "code_presentation", "label_pass", "sex")


LAB = """lab AS (SELECT id_student, code_module, code_presentation, CASE WHEN final_result = 'Pass' THEN 1 ELSE 0 END AS label_pass,
 CASE gender WHEN 'M' THEN 'Male' ELSE 'Female' END AS sex FROM registrations JOIN students USING (id_student, code_module, code_presentation))"""
V = "registrations students"


@query("stratified_random_split", V, f"""WITH {LAB}, r AS (SELECT *, row_number() OVER (PARTITION BY label_pass, sex ORDER BY md5(concat_ws('|', id_student, '42'))) AS p, count(*) OVER (PARTITION BY label_pass, sex) AS n FROM lab)
 SELECT id_student, CASE WHEN p <= round(n * 0.1) THEN 'test' WHEN p <= round(n * 0.2) THEN 'val' ELSE 'train' END AS split FROM r""")
def _(t):
    return L.stratified_random_split(labelled(t), strata=["label_pass", "sex"]).select("id_student", "split")


@query("random_split", V, f"""WITH {LAB}, r AS (SELECT id_student, row_number() OVER (ORDER BY md5(concat_ws('|', id_student, '7'))) AS p, count(*) OVER () AS n FROM lab)
 SELECT id_student, CASE WHEN p <= round(n * 0.2) THEN 'test' WHEN p <= round(n * 0.4) THEN 'val' ELSE 'train' END AS split FROM r""")
def _(t):
    return L.stratified_random_split(labelled(t), test=0.2, val=0.2, seed=7)


@query("chronological_split", "clicks", """SELECT id_student, event_id, code_presentation, CASE code_presentation WHEN '2014J' THEN 'test' WHEN '2014B' THEN 'val' ELSE 'train' END AS split FROM clicks""")
def _(t):
    return L.chronological_split(t.clicks.select("id_student", "event_id", "code_presentation"), "code_presentation")


@query("holdout_split", V, f"""WITH {LAB}, r AS (SELECT *, row_number() OVER (PARTITION BY code_module, label_pass, sex ORDER BY md5(concat_ws('|', id_student, '42'))) AS p, count(*) OVER (PARTITION BY code_module, label_pass, sex) AS n FROM lab),
 a AS (SELECT *, CASE WHEN p <= round(n * 0.2) THEN 'val' ELSE 'train' END AS split FROM r)
 SELECT m.code_module, count(*) FILTER (WHERE a.code_module <> m.code_module AND split = 'train') AS train, count(*) FILTER (WHERE a.code_module <> m.code_module AND split = 'val') AS val,
 count(*) FILTER (WHERE a.code_module = m.code_module) AS test FROM a, (SELECT DISTINCT code_module FROM lab) m GROUP BY m.code_module""")
def _(t):
    return L.holdout_sizes(L.holdout_split(labelled(t), "code_module", strata=["label_pass", "sex"]), "code_module")


@query("check_leakage", "clicks", """WITH s AS (SELECT DISTINCT id_site, CASE code_presentation WHEN '2014J' THEN 'test' WHEN '2014B' THEN 'val' ELSE 'train' END AS split FROM clicks),
 p AS (SELECT * FROM (VALUES ('train', 'val'), ('train', 'test'), ('val', 'test')) v(a, b))
 SELECT p.a, p.b, (SELECT count(*) FROM s x JOIN s y USING (id_site) WHERE x.split = p.a AND y.split = p.b) AS overlap FROM p""")
def _(t):
    return L.check_leakage(L.chronological_split(t.clicks, "code_presentation"), "id_site", ["train", "val", "test"])


@query("leakage_free_split", "clicks", """WITH s AS (SELECT event_id, id_student, CASE WHEN event_type_day >= 20 THEN 'test' ELSE 'train' END AS split FROM (SELECT *, date AS event_type_day FROM clicks))
 SELECT event_id, split FROM s WHERE split = 'test' OR id_student NOT IN (SELECT id_student FROM s WHERE split = 'test')""")
def _(t):
    a = t.clicks.select("event_id", "id_student", F.when(F.col("date") >= 20, "test").otherwise("train").alias("split"))
    return L.resolve_overlap(a, "id_student", "train_excludes_test").select("event_id", "split")


@query("group_kfold", "clicks", """WITH RECURSIVE g AS (SELECT concat_ws('_', code_module, code_presentation) AS grp, count(*) AS n FROM clicks GROUP BY 1),
 o AS (SELECT *, row_number() OVER (ORDER BY n DESC, grp) AS i FROM g),
 f(i, grp, fold, load) AS (SELECT 0::BIGINT, ''::VARCHAR, 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[] UNION ALL
 SELECT o.i, o.grp, list_position(f.load, list_min(f.load)) - 1, list_transform(range(1, 6), lambda x: f.load[x] + CASE WHEN x = list_position(f.load, list_min(f.load)) THEN o.n ELSE 0 END) FROM f JOIN o ON o.i = f.i + 1)
 SELECT f.grp, f.fold::INTEGER AS fold, g.n FROM f JOIN g ON g.grp = f.grp""")
def _(t):
    keyed = t.clicks.withColumn("grp", L.group_key(t.clicks))
    return L.group_kfold(keyed, "grp", 5).groupBy("grp", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_kfold", V, f"""WITH {LAB} SELECT id_student, ((row_number() OVER (PARTITION BY label_pass ORDER BY md5(concat_ws('|', id_student, '42'))) - 1) % 5)::INTEGER AS fold FROM lab""")
def _(t):
    return L.stratified_kfold(labelled(t), ["id_student"], ["label_pass"]).select("id_student", "fold")


@query("fold_report", V, f"""WITH {LAB}, f AS (SELECT *, ((row_number() OVER (PARTITION BY label_pass ORDER BY md5(concat_ws('|', id_student, '42'))) - 1) % 5)::INTEGER AS fold FROM lab)
 SELECT k.fold, count(*) FILTER (WHERE f.fold = k.fold) AS val_size, count(*) FILTER (WHERE f.fold <> k.fold) AS train_size, round(avg(label_pass) FILTER (WHERE f.fold = k.fold), 6) AS val_positive_rate,
 round(avg(label_pass) FILTER (WHERE f.fold <> k.fold), 6) AS train_positive_rate, 0::BIGINT AS ids_in_several_folds FROM f, (SELECT DISTINCT fold FROM f) k GROUP BY k.fold""")
def _(t):
    return rounded(L.fold_report(L.stratified_kfold(labelled(t), ["id_student"], ["label_pass"]), "id_student", "label_pass"))


@query("sequence_split", "actions", """SELECT event_id, CASE WHEN CAST('0x' || substr(md5(concat_ws('|', username, course_id, '42')), 1, 13) AS BIGINT) / 4503599627370496.0 < 0.1 THEN 'val' ELSE 'train' END AS split FROM actions""")
def _(t):
    return L.sequence_split(t.actions, ["username", "course_id"]).select("event_id", "split")


@query("table_inventory", "", """WITH i AS (SELECT 'events' AS "table", count(*) AS rows, 6 AS columns FROM events UNION ALL SELECT 'customer', count(*), 5 FROM customer UNION ALL SELECT 'orders', count(*), 6 FROM orders)
 SELECT * FROM i UNION ALL SELECT 'total', CAST(sum(rows) AS BIGINT), CAST(sum(columns) AS INTEGER) FROM i""")
def _(t):
    return R.table_inventory({n: t.raw(n) for n in ("events", "customer", "orders")})


@query("dataset_info", "students", """SELECT 'rows' AS item, NULL AS name, NULL AS text, count(*) AS n FROM students UNION ALL SELECT 'columns', NULL, NULL, 5 UNION ALL
 SELECT 'nulls', 'id_student', 'bigint', 0 UNION ALL SELECT 'nulls', 'gender', 'string', 0 UNION ALL SELECT 'nulls', 'imd_band', 'string', count(*) FROM students WHERE imd_band IS NULL UNION ALL
 SELECT 'nulls', 'age_band', 'string', 0 UNION ALL SELECT 'nulls', 'balance', 'double', 0 UNION ALL SELECT 'label', 'age_band', age_band, count(*) FROM students GROUP BY age_band""")
def _(t):
    return R.dataset_info(t.students.select("id_student", "gender", "imd_band", "age_band", "balance"), "age_band")


@query("metrics_long", "predictions", """WITH m AS (SELECT grp, avg(y) AS rate, avg(prob_gru) AS p, min(prob_gru) AS lo, max(prob_gru) AS hi FROM predictions GROUP BY grp)
 SELECT grp AS experiment, 'rate' AS metric, round(rate, 6) AS value, NULL::DOUBLE AS ci_lower, NULL::DOUBLE AS ci_upper FROM m UNION ALL SELECT grp, 'p', round(p, 6), lo, hi FROM m""")
def _(t):
    m = t.predictions.groupBy("grp").agg(F.avg("y").alias("rate"), F.avg("prob_gru").alias("p"), F.min("prob_gru").alias("lo"), F.max("prob_gru").alias("hi"))
    return rounded(Wr.metrics_long(m, "grp", ["rate", "p"], {"p": ("lo", "hi")}))


@query("conform_columns", "assessments submissions", """SELECT id_assessment, l_suppkey AS id_student, date_submitted, is_banked, score FROM submissions""")
def _(t):
    from edlens.contracts import COURSE_TABLES, conform_columns

    raw = t.submissions.withColumnRenamed("date_submitted", "date").withColumnRenamed("l_suppkey", "id_student")
    return conform_columns(raw, COURSE_TABLES["studentAssessment"], {"date": "date_submitted"})
