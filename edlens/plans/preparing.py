"""Preparation and neighbour operators on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from edlens.operators import neighbours as N
from edlens.operators import prep as R
from edlens.plans.registry import query
from edlens.plans.relational import rounded


@query("detect_feature_types", "grades students", """SELECT 'G1' AS "column", 'numeric' AS kind, count(DISTINCT G1) AS distinct, 0::BIGINT AS missing FROM grades UNION ALL SELECT 'Medu', 'ordinal', count(DISTINCT Medu), 0 FROM grades
 UNION ALL SELECT 'sex', 'categorical', count(DISTINCT sex), 0 FROM grades UNION ALL SELECT 'studytime', 'ordinal', count(DISTINCT studytime), 0 FROM grades""")
def _(t):
    return R.detect_feature_types(t.grades, ["G1", "Medu", "sex", "studytime"])


@query("detect_feature_types_share", "students", """SELECT 'balance' AS "column", 'numeric' AS kind, count(DISTINCT balance) AS distinct, 0::BIGINT AS missing FROM students UNION ALL SELECT 'studied_credits', 'categorical', count(DISTINCT studied_credits), 0 FROM students
 UNION ALL SELECT 'imd_band', 'categorical', count(DISTINCT imd_band), count(*) FILTER (WHERE imd_band IS NULL) FROM students""")
def _(t):
    return R.detect_feature_types(t.students, ["balance", "studied_credits", "imd_band"], "share")


@query("impute", "assessments students", """SELECT id_assessment, round(coalesce(deadline::DOUBLE, (SELECT median(deadline) FROM assessments)), 6) AS deadline_median, round(coalesce(deadline::DOUBLE, (SELECT avg(deadline) FROM assessments)), 4) AS deadline_mean, coalesce(deadline, -1) AS deadline_constant FROM assessments""")
def _(t):
    a = t.assessments.select("id_assessment", F.col("deadline").alias("deadline_median"), F.col("deadline").alias("deadline_mean"), F.col("deadline").alias("deadline_constant"))
    a = R.impute(R.impute(R.impute(a, ["deadline_median"], "median"), ["deadline_mean"], "mean"), ["deadline_constant"], "constant", -1)
    return rounded(a.withColumn("deadline_mean", F.round("deadline_mean", 4)))


@query("impute_mode", "students", "SELECT id_student, coalesce(imd_band, (SELECT imd_band FROM students WHERE imd_band IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, imd_band LIMIT 1)) AS imd_band FROM students")
def _(t):
    return R.impute(t.students.select("id_student", "imd_band"), ["imd_band"], "mode")


@query("encode_label_codes", "students", """WITH v AS (SELECT region, row_number() OVER (ORDER BY region) - 1 AS code FROM (SELECT DISTINCT region FROM students WHERE gender = 'F' AND num_of_prev_attempts < 2))
 SELECT id_student, coalesce(code, (SELECT count(*) FROM v))::INTEGER AS region FROM students LEFT JOIN v USING (region)""")
def _(t):
    return R.encode_labels(t.students, t.students.where("gender = 'F' AND num_of_prev_attempts < 2"), "region").select("id_student", "region")


@query("encode_ordinal", "students", "SELECT id_student, CASE age_band WHEN '0-35' THEN 0 WHEN '35-55' THEN 1 ELSE -1 END AS age FROM students")
def _(t):
    return t.students.select("id_student", R.encode_ordinal("age_band", ["0-35", "35-55"]).alias("age"))


@query("one_hot", "students", """SELECT id_student, coalesce(age_band = '35-55', false)::INTEGER AS "age_band_35_55", coalesce(age_band = '55<=', false)::INTEGER AS "age_band_55" FROM students""")
def _(t):
    s = t.students.select("id_student", "age_band")
    return R.one_hot(s, "age_band", R.levels_of(s, "age_band"), drop_first=True)


@query("top_levels", "students", "SELECT id_student, CASE WHEN region IN (SELECT region FROM students GROUP BY 1 ORDER BY count(*) DESC, region LIMIT 5) THEN region ELSE 'other' END AS region FROM students")
def _(t):
    return R.top_levels(t.students.select("id_student", "region"), "region", 5)


@query("demographics", "clicks students", """WITH u AS (SELECT CAST(c.id_student AS VARCHAR) AS username, arg_min(s.balance, c.event_id) AS balance, arg_min(s.gender, c.event_id) AS gender FROM clicks c JOIN students s USING (id_student) GROUP BY 1)
 SELECT username, round(balance, 6) AS demog_balance, (gender = 'F')::INTEGER AS demog_gender_F, (gender = 'M')::INTEGER AS demog_gender_M FROM u""")
def _(t):
    u = t.clicks.select("id_student", "event_id").join(t.students.select("id_student", "balance", "gender"), "id_student")
    u = u.select(F.col("id_student").cast("string").alias("username"), "event_id", "balance", "gender")
    return rounded(R.demographics(u, "username", "balance", ["gender"], ["event_id"]))


@query("scale", "grades", """SELECT id, round((G1 - (SELECT avg(G1) FROM grades)) / (SELECT stddev_pop(G1) FROM grades), 6) AS G1, round((G2 - (SELECT median(G2) FROM grades)) / (SELECT quantile_cont(G2, 0.75) - quantile_cont(G2, 0.25) FROM grades), 6) AS G2,
 round((absences - (SELECT min(absences) FROM grades)) / (SELECT max(absences) - min(absences) FROM grades)::DOUBLE, 6) AS absences FROM grades""")
def _(t):
    g = t.grades.select("id", "G1", "G2", "absences")
    return rounded(R.scale(R.scale(R.scale(g, ["G1"], "standard"), ["G2"], "robust"), ["absences"], "minmax"))


def _f(c):
    return f"""SELECT '{c}' AS feature, (sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS score FROM (SELECT y, count(*)::DOUBLE AS n, avg({c}) AS m, var_pop({c}) AS v FROM g GROUP BY y), (SELECT avg({c}) AS gm FROM g)"""


FEATURES = ["G1", "G2", "absences", "age", "health"]


@query("select_k_best", "grades", "WITH g AS (SELECT *, (G3 >= 10)::INTEGER AS y FROM grades), f AS (" + " UNION ALL ".join(map(_f, FEATURES)) + ") SELECT feature, round(score, 4) AS score FROM f ORDER BY score DESC LIMIT 3")
def _(t):
    g = t.grades.withColumn("y", (F.col("G3") >= 10).cast("int"))
    return rounded(R.select_k_best(g, FEATURES, "y", 3), 4)


@query("class_weight", "predictions", "SELECT round(greatest(count(*) FILTER (WHERE y = 0) / count(*) FILTER (WHERE y = 1), 1), 6) AS pos_weight, count(*) FILTER (WHERE y = 1) AS positives, count(*) FILTER (WHERE y = 0) AS negatives FROM predictions")
def _(t):
    return rounded(R.class_weight(t.predictions, "y"))


E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def vectors(t):
    return t.raw("embeddings").select(F.col("vec_id").alias("qid"), F.col("vec_id").alias("rid"), F.col("embedding").cast("array<double>").alias("v"), "label")


@query("knn_join", "", f"""WITH {E} SELECT qid, rid, round(d, 6) AS distance, rank FROM (SELECT a.vec_id AS qid, b.vec_id AS rid, list_distance(a.v, b.v) AS d, (row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id))::INTEGER AS rank FROM e a JOIN e b ON a.vec_id <> b.vec_id) WHERE rank <= 3""")
def _(t):
    v = vectors(t)
    return rounded(N.knn_join(v, v, 3, exclude_same=True))


@query("knn_predict", "", f"""WITH {E}, n AS (SELECT a.vec_id AS qid, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS r FROM e a JOIN e b ON a.vec_id <> b.vec_id)
 SELECT qid, round(avg((label >= 5)::INTEGER), 6) AS p FROM n WHERE r <= 5 GROUP BY qid""")
def _(t):
    v = vectors(t).withColumn("label", (F.col("label") >= 5).cast("int"))
    return rounded(N.knn_predict(v, v, 5, exclude_same=True))


@query("nearest_distance_weights", "", f"""WITH {E}, n AS (SELECT a.vec_id AS qid, min(list_distance(a.v, b.v)) AS d FROM e a JOIN e b ON a.label < 5 AND b.label >= 5 GROUP BY 1), w AS (SELECT qid, exp(-d / (SELECT avg(d) FROM n)) AS w FROM n) SELECT qid, round(w / (SELECT avg(w) FROM w), 6) AS weight FROM w""")
def _(t):
    v = vectors(t)
    return rounded(N.nearest_distance_weights(v.where("label < 5"), v.where("label >= 5")))


UNIT = "CAST('0x' || substr(md5(concat_ws('|', {}, '{}')), {}, 13) AS BIGINT) / 4503599627370496.0"


def _near(n: str, a: str, b: str, k: int, same: bool) -> str:
    """CTEs ``n`` (the k nearest rows of ``b`` for each of ``a``) and ``n_found`` (how many there are)."""
    return f"""{n} AS (SELECT * FROM (SELECT x.qid, y.qid AS rid, y.v AS nv, row_number() OVER (PARTITION BY x.qid ORDER BY list_distance(x.v, y.v), y.qid) AS r FROM {a} x JOIN {b} y ON {'x.qid <> y.qid' if same else 'true'}) WHERE r <= {k}),
 {n}_found AS (SELECT qid, count(*) AS f FROM {n} GROUP BY qid)"""


# Rows of labels below 8 are the source, the rest the target; label 0 is the small class.
SMOTE = f"""src AS (SELECT vec_id AS qid, v, (label = 0)::INTEGER AS y FROM e WHERE label < 8), own AS (SELECT qid, v, row_number() OVER (ORDER BY md5(concat_ws('|', qid, '42')), qid) AS pos FROM src WHERE y = 1), tgt AS (SELECT vec_id AS qid, v FROM e WHERE label >= 8),
 n AS (SELECT count(*) FILTER (y = 0) - count(*) FILTER (y = 1) AS lack, count(*) FILTER (y = 1) AS size FROM src), made AS (SELECT qid, v, unnest(range(1, lack // size + (pos <= lack % size)::BIGINT + 1)) AS copy FROM own, n),
 {_near('near', 'own', 'own', 3, True)}, {_near('aims', 'own', 'tgt', 3, False)},
 d AS (SELECT m.qid, m.copy, m.v, k.nv, a.nv AS tv, {UNIT.format('m.qid, copy', '42', 14)} AS alpha, CASE WHEN {UNIT.format('m.qid, copy', '42-domain', 1)} < 0.7 THEN 'intra' ELSE 'cross' END AS kind FROM made m JOIN near_found g ON g.qid = m.qid JOIN aims_found h ON h.qid = m.qid
 JOIN near k ON k.qid = m.qid AND k.r = least(floor({UNIT.format('m.qid, copy', '42', 1)} * g.f) + 1, g.f) JOIN aims a ON a.qid = m.qid AND a.r = least(floor({UNIT.format('m.qid, copy', '42-domain', 14)} * h.f) + 1, h.f)),
 x AS (SELECT *, list_transform(range(1, len(v) + 1), lambda i: v[i] + alpha * (nv[i] - v[i])) AS w FROM d)"""
VECTOR = "round(list_sum({0}), 6) AS total, round({0}[1], 6) AS head, round(list_sum(list_transform({0}, lambda z: z * z)), 6) AS square"


def shown(df):
    return rounded(df.select(*[c for c in df.columns if c != "v"], F.aggregate("v", F.lit(0.0), lambda a, z: a + z).alias("total"), F.col("v")[0].alias("head"), F.aggregate("v", F.lit(0.0), lambda a, z: a + z * z).alias("square")))


def domains(t):
    v = vectors(t).withColumn("y", (F.col("label") == 0).cast("int"))
    return v.where("label < 8"), v.where("label >= 8")


@query("smote", "", f"WITH {E}, {SMOTE} SELECT 1 AS y, qid, copy::INTEGER AS copy, {VECTOR.format('w')} FROM x")
def _(t):
    return shown(N.smote(domains(t)[0], "qid", "v", "y", 3))


@query("smote_domains", "", f"WITH {E}, {SMOTE}, z AS (SELECT qid, copy, kind, CASE WHEN kind = 'cross' THEN list_transform(range(1, len(v) + 1), lambda i: w[i] + 0.3 * (tv[i] - v[i])) ELSE w END AS w FROM x) SELECT 1 AS y, qid, copy::INTEGER AS copy, kind, {VECTOR.format('w')} FROM z")
def _(t):
    source, target = domains(t)
    return shown(N.smote(source, "qid", "v", "y", 3, target=target))


@query("mixup", "", """WITH o AS (SELECT vec_id AS qid, label, row_number() OVER w AS pos, count(*) OVER (PARTITION BY label) AS size FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY md5(concat_ws('|', vec_id, '42')), vec_id))
 SELECT a.qid, b.qid AS partner, round(a.label::DOUBLE, 6) AS soft_label, true AS between FROM o a JOIN o b ON a.label = b.label AND b.pos = a.pos % a.size + 1""")
def _(t):
    v = vectors(t)
    m = N.mixup(v, "qid", "v", "label", 0.2).join(v.select("qid", F.col("v")[0].alias("a")), "qid").join(v.select(F.col("qid").alias("partner"), F.col("v")[0].alias("b")), "partner")
    on_line = F.abs(F.col("v")[0] - (F.col("lam") * F.col("a") + (1 - F.col("lam")) * F.col("b"))) < 1e-9
    return rounded(m.select("qid", "partner", "soft_label", (on_line & F.col("lam").between(0, 1)).alias("between")))


@query("mixup_domains", "", f"""WITH v AS (SELECT vec_id AS k, label % 3 AS y, label < 8 AS own FROM embeddings), o AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY md5(concat_ws('|', k, '42-order')), k) AS pos FROM v),
 n AS (SELECT count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM v), d AS (SELECT draw, s, t, {UNIT.format('draw', '42-kind', 1)} < 0.3 AS crossed FROM n, LATERAL (SELECT unnest(range(1, least(s, t) // 2 + 1)) AS draw)),
 p AS (SELECT draw, crossed, floor({UNIT.format('draw', '42-kind', 14)} * s) + 1 AS one, floor({UNIT.format('draw', '42-partner', 1)} * CASE WHEN crossed THEN t ELSE s END) + 1 AS two FROM d)
 SELECT draw, CASE WHEN crossed THEN 'cross' ELSE 'intra' END AS kind, a.k AS qid, b.k AS partner, CASE WHEN a.y = b.y THEN a.y END AS y, true AS between FROM p JOIN o a ON a.own AND a.pos = one JOIN o b ON b.own <> crossed AND b.pos = two WHERE CASE WHEN crossed THEN a.y = b.y ELSE one <> two END""")
def _(t):
    v = vectors(t).withColumn("y", F.col("label") % 3)
    m = N.mixup_domains(v.where("label < 8"), v.where("label >= 8"), "qid", "v", "y")
    first, second = v.select("qid", F.col("v")[0].alias("a"), F.col("y").alias("y1")), v.select(F.col("qid").alias("partner"), F.col("v")[0].alias("b"), F.col("y").alias("y2"))
    on_line = F.abs(F.col("v")[0] - (F.col("lam") * F.col("a") + (1 - F.col("lam")) * F.col("b"))) < 1e-9
    ok = on_line & F.col("lam").between(0, 1) & F.col("y").isin(F.col("y1"), F.col("y2"))
    return m.join(first, "qid").join(second, "partner").select("draw", "kind", "qid", "partner", F.when(F.col("y1") == F.col("y2"), F.col("y")).alias("y"), ok.alias("between"))
