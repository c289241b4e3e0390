"""Statistical tests and resampling on the prediction view."""

from __future__ import annotations

from pyspark.sql import functions as F

from edlens.functions.hashing import poisson_draw
from edlens.operators import calibration as C
from edlens.operators import inference as I
from edlens.plans.evaluation import LP, OPT, _opt, lp, wide
from edlens.plans.registry import query
from edlens.plans.relational import rounded
from edlens.plans.standins import MODELS

UNIT = "CAST('0x' || substr(md5(concat_ws('|', {}, '42')), {}, 13) AS BIGINT) / 4503599627370496.0"


def poisson_sql(name: str, rel: str, ids: str) -> str:
    """CTE ``name``: the rows of ``rel`` with ``w``, the Poisson draw of rate ``n`` that the operators make from the same hashes."""
    u, v = UNIT.format(f"{ids}, t", 1), UNIT.format(f"{ids}, t", 14)
    cdf = "list_transform(range(0, 51), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: CASE WHEN n = 0 THEN (j = 0)::INT ELSE exp(-n + j * ln(n) - lgamma(j + 1)) END)))"
    return f"""{name}_d AS (SELECT *, row_number() OVER () AS rid, {UNIT.format(ids, 1)} AS u FROM {rel}), {name}_t AS (SELECT n, {cdf} AS cdf FROM (SELECT DISTINCT n FROM {name}_d WHERE n < 10)),
 {name}_l AS (SELECT rid, arg_min(k, t) AS k FROM (SELECT *, floor((2 * a / e + b) * uu + n + 0.43) AS k FROM (SELECT *, 0.5 - abs(uu) AS e, -0.059 + 0.02483 * b AS a FROM (SELECT rid, n, t, {u} - 0.5 AS uu, {v} AS v, 0.931 + 2.53 * sqrt(n) AS b FROM {name}_d, range(1, 25) r(t) WHERE n >= 10)))
 WHERE (e >= 0.07 AND v <= 0.9277 - 3.6224 / (b - 2)) OR (k >= 0 AND NOT (e < 0.013 AND v > e) AND ln(v) + ln(1.1239 + 1.1328 / (b - 3.4)) - ln(a / (e * e) + b) <= -n + k * ln(n) - lgamma(greatest(k, 0) + 1)) GROUP BY rid),
 {name} AS (SELECT d.*, CASE WHEN n < 10 THEN len(list_filter(cdf, lambda c: c < u)) ELSE k END::DOUBLE AS w FROM {name}_d d LEFT JOIN {name}_t USING (n) LEFT JOIN {name}_l USING (rid))"""


def _summary(reps, by, metrics):
    pre = f"{by}, " if by else ""
    un = " UNION ALL ".join(f"SELECT {pre}'{m}' AS metric, {m} AS v FROM {reps}" for m in metrics)
    return f"""SELECT {pre}metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.025), 6) AS ci_lower, round(quantile_cont(v, 0.975), 6) AS ci_upper, round(quantile_cont(v, 0.975) - quantile_cont(v, 0.025), 6) AS ci_width FROM ({un}) GROUP BY {pre}metric"""


def _boot(rel, by, reps, metrics):
    pre = f"{by}, " if by else ""
    sel = ", ".join(f"{e} AS {n}" for n, e in metrics.items())
    return f"""bcells AS (SELECT {pre}y, pred, count(*)::DOUBLE AS n FROM {rel} GROUP BY {pre}y, pred), dr AS (SELECT * FROM bcells, (SELECT unnest(range(1, {reps + 1})) AS rep)),
 {poisson_sql('ww', 'dr', f'{pre}y, pred, rep')}, reps AS (SELECT {pre}rep, {sel} FROM ww GROUP BY {pre}rep) {_summary('reps', by, metrics)}"""


def _score_boot(draws, by):
    """Metrics per replicate from ``draws``: (by, score, rep, wp, wn)."""
    pre = f"{by}, " if by else ""
    return f"""run AS (SELECT *, sum(wp) OVER o AS tp, sum(wp + wn) OVER o AS called FROM {draws} WINDOW o AS (PARTITION BY {pre}rep ORDER BY score DESC)),
 g AS (SELECT {pre}rep, sum(wp) AS P, sum(wn) AS N, sum(wn * (tp - wp / 2)) AS area, sum(CASE WHEN called > 0 THEN wp * tp / called ELSE 0 END) AS ap, coalesce(sum(wp) FILTER (score >= 0.5), 0) AS hit, coalesce(sum(wn) FILTER (score >= 0.5), 0) AS fls FROM run GROUP BY {pre}rep),
 reps AS (SELECT {pre}rep, (hit + N - fls) / (P + N) AS accuracy, hit / (hit + fls) AS precision, hit / P AS recall, 2 * hit / (hit + fls + P) AS f1, area / (P * N) AS roc_auc, ap / P AS average_precision FROM g)"""


SIX = ["accuracy", "precision", "recall", "f1", "roc_auc", "average_precision"]
TP, FP, FN = ("sum(w) FILTER (WHERE y = 1 AND pred = 1)", "sum(w) FILTER (WHERE y = 0 AND pred = 1)", "sum(w) FILTER (WHERE y = 1 AND pred = 0)")
LM = {"accuracy": "sum(w) FILTER (WHERE y = pred) / sum(w)", "precision": f"{TP} / ({TP} + {FP})", "recall": f"{TP} / ({TP} + {FN})", "f1": f"2 * {TP} / (2 * {TP} + {FP} + {FN})"}
W = "w0 AS (SELECT y, sex, grp, id_student, prob_gru AS p, CASE WHEN prob_gru >= 0.5 THEN 1 ELSE 0 END AS pred FROM predictions)"


@query("bootstrap_ci", "predictions", f"WITH {W}, {_boot('w0', '', 200, LM)}")
def _(t):
    return rounded(I.bootstrap_ci(wide(t), [], ["y", "pred"], I.label_metrics, reps=200))


@query("bootstrap_model_comparison", LP, f"""WITH sc AS (SELECT model, p AS score, sum(y)::DOUBLE AS pos, (count(*) - sum(y))::DOUBLE AS neg FROM long_predictions GROUP BY model, p), rp AS (SELECT unnest(range(1, 101)) AS rep),
 dp AS (SELECT model, score, rep, pos AS n, 'p' AS side FROM sc, rp UNION ALL SELECT model, score, rep, neg, 'n' FROM sc, rp), {poisson_sql('ww', 'dp', 'model, score, rep, side')},
 dd AS (SELECT model, score, rep, sum(w) FILTER (side = 'p') AS wp, sum(w) FILTER (side = 'n') AS wn FROM ww GROUP BY model, score, rep), {_score_boot('dd', 'model')} {_summary('reps', 'model', SIX)}""")
def _(t):
    return rounded(I.bootstrap_scores(lp(t), ["model"], reps=100))


@query("mean_ci_by_model", LP, f"""WITH cells AS (SELECT model, floor(round(abs(p - y) * 3, 6)) / 3 AS err, count(*)::DOUBLE AS n FROM long_predictions GROUP BY 1, 2), dr AS (SELECT * FROM cells, (SELECT unnest(range(1, 101)) AS rep)),
 {poisson_sql('ww', 'dr', 'model, CAST(CAST(round(err * 3) AS BIGINT) AS VARCHAR), rep')}, reps AS (SELECT model, rep, sum(err * w) / sum(w) AS v FROM ww GROUP BY model, rep)
 SELECT model, 'mean_error' AS metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.025), 6) AS ci_lower, round(quantile_cont(v, 0.975), 6) AS ci_upper, round(quantile_cont(v, 0.975) - quantile_cont(v, 0.025), 6) AS ci_width FROM reps GROUP BY model""")
def _(t):
    cells = lp(t).withColumn("err", F.floor(F.round(F.abs(F.col("p") - F.col("y")) * 3, 6)).cast("bigint"))
    return rounded(I.bootstrap_ci(cells, ["model"], ["err"], lambda w: {"mean_error": I.weighted_mean(F.col("err") / 3, w)}, reps=100))


@query("cluster_bootstrap", "predictions", f"""WITH {W}, k AS (SELECT id_student, rep, CASE WHEN {UNIT.format('id_student, rep', 1)} <= exp(-1) THEN 0.0 ELSE 1.0 END AS w FROM (SELECT DISTINCT id_student FROM predictions), (SELECT unnest(range(1, 51)) AS rep)),
 c AS (SELECT id_student, sum((p - y) ** 2) AS se, count(*)::DOUBLE AS n FROM w0 GROUP BY 1), b AS (SELECT rep, sum(se * w) / sum(n * w) AS brier FROM c JOIN k USING (id_student) GROUP BY rep),
 sc AS (SELECT id_student, p AS score, sum(y)::DOUBLE AS pos, (count(*) - sum(y))::DOUBLE AS neg FROM w0 GROUP BY 1, 2), dd AS (SELECT score, rep, sum(pos * w) AS wp, sum(neg * w) AS wn FROM sc JOIN k USING (id_student) GROUP BY score, rep), {_score_boot('dd', '')},
 all_reps AS (SELECT * FROM reps JOIN b USING (rep)) {_summary('all_reps', '', [*SIX, 'brier'])}""")
def _(t):
    sums = {"n": F.count(F.lit(1)).cast("double"), "se": F.sum(F.pow(F.col("p") - F.col("y"), F.lit(2)))}
    brier = I.cluster_bootstrap(wide(t), "id_student", sums, lambda: {"brier": F.col("se") / F.col("n")}, reps=50)
    return rounded(brier.unionByName(I.cluster_bootstrap_scores(wide(t), "id_student", reps=50)))


@query("bootstrap_two_sample", "predictions", f"""WITH v AS (SELECT CASE WHEN sex = 'F' THEN 1 ELSE 0 END AS arm, CAST(round(prob_gru * 10) AS BIGINT) AS v FROM predictions), o AS (SELECT avg(v) FILTER (WHERE arm = 1) - avg(v) FILTER (WHERE arm = 0) AS d, (count(*) FILTER (WHERE arm = 1))::DOUBLE / count(*) AS s FROM v),
 c AS (SELECT v, count(*)::DOUBLE AS kk FROM v GROUP BY v), r AS (SELECT * FROM c, o, (SELECT unnest(range(1, 101)) AS rep)),
 ra AS (SELECT *, kk * s AS n FROM r), rb AS (SELECT *, kk * (1 - s) AS n FROM r), {poisson_sql('a', 'ra', "v, rep, 'a'")}, {poisson_sql('b', 'rb', "v, rep, 'b'")},
 m AS (SELECT rep, (SELECT sum(a.v * a.w) / sum(a.w) FROM a WHERE a.rep = x.rep) - (SELECT sum(b.v * b.w) / sum(b.w) FROM b WHERE b.rep = x.rep) AS diff FROM (SELECT DISTINCT rep FROM r) x)
 SELECT round(any_value(d), 6) AS observed, round(avg(CASE WHEN abs(diff) >= abs(d) THEN 1 ELSE 0 END), 6) AS p_value, count(*) AS replicates FROM m, o""")
def _(t):
    v = t.predictions.select((F.col("sex") == "F").cast("int").alias("arm"), F.round(F.col("prob_gru") * 10).cast("bigint").alias("v"))
    return rounded(I.bootstrap_two_sample(v, "arm", "v", reps=100))


@query("permutation_test", "predictions", """WITH RECURSIVE v AS (SELECT CASE WHEN sex = 'F' THEN 1 ELSE 0 END AS arm, prob_gru AS v FROM predictions), o AS (SELECT avg(v) FILTER (WHERE arm = 1) - avg(v) FILTER (WHERE arm = 0) AS d, sum(arm)::BIGINT AS n1, (count(*) - sum(arm))::BIGINT AS n0, sum(v) AS s FROM v),
 c AS (SELECT v, count(*)::BIGINT AS m, row_number() OVER (ORDER BY v) - 1 AS cell, (SELECT count(*) FROM v) - sum(count(*)) OVER (ORDER BY v) AS rest FROM v GROUP BY v),
 w(rep, cell, n, a) AS (SELECT unnest(range(1, 31)), -1::BIGINT, n1, 0.0::DOUBLE FROM o UNION ALL
 SELECT rep, cell, n - k, a + k * v FROM (SELECT x.*, low + least(len(list_filter(p, lambda q: q <= u * p[len(p)])), len(p) - 1) AS k FROM (SELECT y.*, list_transform(range(1, len(raw) + 1), lambda i: list_sum(raw[1:i])) AS p FROM (
 SELECT w.rep, c.cell, w.n, w.a, c.v, greatest(0, w.n - c.rest)::BIGINT AS low, CAST('0x' || substr(md5(concat_ws('|', w.rep, 0, c.cell, '42')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u,
 list_transform(range(greatest(0, w.n - c.rest)::BIGINT, least(w.n, c.m) + 1), lambda k: exp(lgamma(c.m + 1) - lgamma(k + 1) - lgamma(c.m - k + 1) + lgamma(c.rest + 1) - lgamma(w.n - k + 1) - lgamma(c.rest - w.n + k + 1) - lgamma(c.m + c.rest + 1) + lgamma(w.n + 1) + lgamma(c.m + c.rest - w.n + 1))) AS raw
 FROM w JOIN c ON c.cell = w.cell + 1) y) x) z),
 f AS (SELECT rep, a / n1 - (s - a) / n0 AS diff, d FROM w, o WHERE cell = (SELECT max(cell) FROM c))
 SELECT round(any_value(d), 6) AS observed, round(avg(CASE WHEN abs(diff) >= abs(d) THEN 1 ELSE 0 END), 6) AS p_value, round(avg(diff), 6) AS mean_diff, count(*) AS replicates FROM f""")
def _(t):
    v = t.predictions.select("id", (F.col("sex") == "F").cast("int").alias("arm"), F.col("prob_gru").alias("v"))
    return rounded(I.permutation_test(v, "id", "arm", "v", reps=30))


@query("poisson_cells", "predictions", f"""WITH cells AS (SELECT CAST(floor(prob_gru * 20) AS BIGINT) AS cell, y, count(*)::DOUBLE AS n FROM predictions WHERE id % 3 > 0 GROUP BY 1, 2), few AS (SELECT id_student % 997 AS cell, 2 AS y, count(*)::DOUBLE AS n FROM predictions GROUP BY 1),
 dr AS (SELECT * FROM (SELECT * FROM cells UNION ALL SELECT * FROM few), (SELECT unnest(range(1, 6)) AS rep)), {poisson_sql('ww', 'dr', 'cell, y, rep')} SELECT cell, y, rep, n, w FROM ww""")
def _(t):
    p = t.predictions
    cells = p.where("id % 3 > 0").groupBy(F.floor(F.col("prob_gru") * 20).cast("bigint").alias("cell"), "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    few = p.groupBy((F.col("id_student") % 997).alias("cell"), F.lit(2).alias("y")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    drawn = cells.union(few).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(5))))
    return drawn.select("cell", "y", "rep", "n", poisson_draw(["cell", "y", "rep"], 42, F.col("n")).alias("w"))


def calls(t):
    return t.predictions.select("y", *[(F.col(m) >= 0.5).cast("int").alias(m) for m in MODELS])


def _mc(a, b):
    ca, cb = f"(({a} >= 0.5)::INTEGER = y)", f"(({b} >= 0.5)::INTEGER = y)"
    return f"""SELECT '{a}' AS model_1, '{b}' AS model_2, count(*) FILTER (WHERE {ca} AND {cb}) AS both_correct, count(*) FILTER (WHERE {ca} AND NOT {cb}) AS only_1, count(*) FILTER (WHERE NOT {ca} AND {cb}) AS only_2, count(*) FILTER (WHERE NOT {ca} AND NOT {cb}) AS both_wrong, count(*) AS n FROM predictions"""


MC = "WITH m AS (" + " UNION ALL ".join(_mc(a, b) for i, a in enumerate(MODELS) for b in MODELS[i + 1:]) + ")"


@query("mcnemar", "predictions", MC + """ SELECT model_1, model_2, both_correct, only_1, only_2, both_wrong, round(CASE WHEN only_1 + only_2 = 0 THEN 0 ELSE (abs(only_1 - only_2) - 1) ** 2 / (only_1 + only_2)::DOUBLE END, 6) AS statistic,
 round((both_correct + only_1) / n, 6) AS accuracy_1, round((both_correct + only_2) / n, 6) AS accuracy_2, round((only_1 - only_2) / n, 6) AS accuracy_diff, round((only_1 + only_2) / n, 6) AS disagreement FROM m""")
def _(t):
    from itertools import combinations

    return rounded(I.mcnemar(calls(t), list(combinations(MODELS, 2)), p_value=False))


@query("pairwise_compare", "predictions", MC + """, s AS (SELECT model_1, model_2, CASE WHEN only_1 + only_2 = 0 THEN 0 ELSE (abs(only_1 - only_2) - 1) ** 2 / (only_1 + only_2)::DOUBLE END AS statistic FROM m),
 k AS (SELECT *, row_number() OVER (ORDER BY statistic DESC) AS i FROM s), crit AS (SELECT unnest([6.960396706, 6.634896601, 6.238532680, 5.730434264, 5.023886187, 3.841458821]) AS c, unnest(range(1, 7)) AS i)
 SELECT model_1, model_2, statistic > 6.960396706 AS bonferroni_significant, (SELECT bool_and(k2.statistic > crit.c) FROM k k2 JOIN crit USING (i) WHERE k2.i <= k.i) AS holm_significant FROM k""")
def _(t):
    return I.pairwise_compare(calls(t), MODELS).select("model_1", "model_2", "bonferroni_significant", "holm_significant")


SC = "sc AS (SELECT id, model, (p - y) * (p - y) AS score FROM long_predictions)"


def scores(t):
    return t.long_predictions.select("id", "model", ((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("score"))


@query("paired_t", "predictions", """WITH d AS (SELECT sex, prob_gru - prob_lstm AS d FROM predictions) SELECT sex, round(avg(d), 6) AS mean_difference, count(*) AS n, count(*) - 1 AS df, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, round(avg(d) / stddev_samp(d), 6) AS cohens_d, round(stddev_samp(d) / sqrt(count(*)), 6) AS se FROM d GROUP BY sex""")
def _(t):
    return rounded(I.paired_t(t.predictions, ["sex"], "prob_gru", "prob_lstm", p_value=False))


@query("one_way_anova", "predictions", """WITH g AS (SELECT grp, count(*) AS n, avg(price) AS m, var_samp(price) AS v FROM predictions GROUP BY grp), s AS (SELECT sum(n * (m - (SELECT avg(price) FROM predictions)) ** 2) AS ssb, sum((n - 1) * v) AS ssw, count(*) - 1 AS db, CAST(sum(n) AS BIGINT) - count(*) AS dw FROM g)
 SELECT round(ssb / 1e9, 4) AS ssb, round(ssw / 1e9, 4) AS ssw, db AS df_between, dw AS df_within, round((ssb / db) / (ssw / dw), 6) AS f, round(ssb / (ssb + ssw), 6) AS eta_squared FROM s""")
def _(t):
    a = I.one_way_anova(t.predictions, "grp", "price", p_value=False)
    return rounded(a.withColumns({"ssb": F.round(F.col("ssb") / 1e9, 4), "ssw": F.round(F.col("ssw") / 1e9, 4)}))


@query("tukey_pairs", "predictions", """WITH g AS (SELECT grp, count(*)::DOUBLE AS n, avg(price) AS m, var_samp(price) AS v FROM predictions GROUP BY grp), t AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS msw FROM g),
 p AS (SELECT a.grp AS group_1, b.grp AS group_2, b.m - a.m AS d, sqrt(msw / 2 * (1 / a.n + 1 / b.n)) AS se, sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS sp FROM g a JOIN g b ON a.grp < b.grp, t)
 SELECT group_1, group_2, round(d, 4) AS mean_diff, round(se, 4) AS se, round(abs(d) / se, 4) AS q, 3.858::DOUBLE AS q_critical, abs(d) / se > 3.858 AS significant, round(-d / sp, 4) AS cohens_d FROM p""")
def _(t):
    return rounded(I.tukey_pairs(t.predictions, "grp", "price"), 4)


@query("rm_anova", LP, f"""WITH {SC}, g AS (SELECT avg(score) AS a, count(*) AS n FROM sc), m AS (SELECT sum(k * (x - a) ** 2) AS ss, count(*) AS k FROM (SELECT model, avg(score) AS x, count(*) AS k FROM sc GROUP BY model), g),
 s AS (SELECT sum(k * (x - a) ** 2) AS ss, count(*) AS k FROM (SELECT id, avg(score) AS x, count(*) AS k FROM sc GROUP BY id), g), t AS (SELECT sum((score - a) ** 2) AS ss FROM sc, g), e AS (SELECT t.ss - m.ss - s.ss AS ss, (m.k - 1) * (s.k - 1) AS d FROM t, m, s)
 SELECT round(m.ss, 6) AS ss_model, round(s.ss, 6) AS ss_subject, round(e.ss, 6) AS ss_error, m.k - 1 AS df_model, s.k - 1 AS df_subject, e.d AS df_error, m.k * s.k = g.n AS balanced, round(m.ss / (m.k - 1) / (e.ss / e.d), 6) AS model_f, round(s.ss / (s.k - 1) / (e.ss / e.d), 6) AS subject_f, round(m.ss / (m.ss + e.ss), 6) AS partial_eta_squared FROM m, s, e, g""")
def _(t):
    return rounded(I.rm_anova(scores(t), "id", "model", "score", p_value=False))


RK = f"{SC}, rk AS (SELECT id, model, rank() OVER (PARTITION BY id ORDER BY score) + (count(*) OVER (PARTITION BY id, score) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY id, score)::DOUBLE AS ti FROM sc), rs AS (SELECT model, sum(r)::DOUBLE AS s, avg(r) AS a, count(*)::DOUBLE AS n FROM rk GROUP BY model)"


@query("friedman", LP, f"""WITH {RK}, z AS (SELECT any_value(n) AS n, count(*)::DOUBLE AS k, sum(s * s) AS ss, sum((s - (SELECT avg(s) FROM rs)) ** 2) AS dev FROM rs), ti AS (SELECT sum(ti * ti - 1) AS t FROM rk)
 SELECT round((12 / (k * n * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - t / (k * (k * k - 1) * n)), 6) AS statistic, round(12 * dev / (n * n * (k ** 3 - k)), 6) AS kendalls_w, n::BIGINT AS n_blocks, k::BIGINT AS k_models FROM z, ti""")
def _(t):
    return rounded(I.friedman(scores(t), "id", "model", "score", p_value=False))


@query("nemenyi", LP, f"""WITH {RK} SELECT a.model AS model_1, b.model AS model_2, round(a.a, 6) AS avg_rank_1, round(b.a, 6) AS avg_rank_2, round(abs(a.a - b.a), 6) AS rank_diff, round(3.633 * sqrt(20 / (6 * a.n)), 6) AS critical_diff, abs(a.a - b.a) > 3.633 * sqrt(20 / (6 * a.n)) AS significant FROM rs a JOIN rs b ON a.model < b.model""")
def _(t):
    return rounded(I.nemenyi(scores(t), "id", "model", "score"))


PC = f"{SC}, pc AS (SELECT m.model, round(b.score - m.score, 9) AS d FROM sc m JOIN sc b ON b.id = m.id AND b.model = 'prob_tcn' WHERE m.model <> 'prob_tcn')"


@query("paired_compare_t", LP, f"WITH {PC} SELECT model, round(avg(d), 6) AS mean_difference, count(*) AS n, count(*) - 1 AS df, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 4) AS t, round(avg(d) / stddev_samp(d), 6) AS cohens_d, round(stddev_samp(d) / sqrt(count(*)), 6) AS se FROM pc GROUP BY model")
def _(t):
    out = I.paired_compare(scores(t), "id", "model", "score", "prob_tcn", p_value=False)
    return rounded(out.withColumn("t", F.round("t", 4)))


@query("wilcoxon", "predictions", """WITH d AS (SELECT sex, round(prob_gru - prob_lstm, 3) AS d FROM predictions), r AS (SELECT sex, d, rank() OVER (PARTITION BY sex ORDER BY abs(d)) + (count(*) OVER (PARTITION BY sex, abs(d)) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY sex, abs(d))::DOUBLE AS ti FROM d WHERE d <> 0),
 g AS (SELECT sex, least(sum(k) FILTER (WHERE d > 0), sum(k) FILTER (WHERE d < 0))::DOUBLE AS w, count(*)::DOUBLE AS m, sum(ti * ti - 1) AS t FROM r GROUP BY sex)
 SELECT sex, n, w AS statistic, round((w - m * (m + 1) / 4) / sqrt((m * (m + 1) * (2 * m + 1) - t / 2) / 24), 6) AS z, round(1 - 2 * w / (n * (n + 1) / 2.0), 6) AS effect_size FROM g JOIN (SELECT sex, count(*) AS n FROM d GROUP BY sex) USING (sex)""")
def _(t):
    d = t.predictions.select("sex", F.round(F.col("prob_gru") - F.col("prob_lstm"), 3).alias("a"), F.lit(0.0).alias("b"))
    return rounded(I.wilcoxon(d, ["sex"], "a", "b", p_value=False))


TB = {k: v for k, v in LM.items() if k != "accuracy"}


@query("threshold_bootstrap", LP, f"{OPT}, th AS ({_opt('youden', 'yo', 'true', False)}), w0 AS (SELECT y, CASE WHEN p >= (SELECT threshold FROM th WHERE model = 'prob_lstm') THEN 1 ELSE 0 END AS pred FROM long_predictions WHERE model = 'prob_lstm'), {_boot('w0', '', 100, TB)}")
def _(t):
    w = wide(t, "prob_lstm")
    return rounded(I.threshold_bootstrap(w, C.optimal_threshold(w, [], "youden").select("threshold").scalar()))
