"""Sequences, process mining and graph tables on the click and event views."""

from __future__ import annotations

from pyspark.sql import functions as F

from edlens.operators import events as E
from edlens.operators import graph as G
from edlens.operators import sequences as Q
from edlens.plans.registry import query
from edlens.plans.relational import rounded

UC = ["username", "course_id"]


@query("order_events", "actions", "SELECT username, course_id, event_id, row_number() OVER (PARTITION BY username, course_id ORDER BY seconds, event_id) AS pos FROM actions")
def _(t):
    return Q.order_events(t.actions.select(*UC, "seconds", "event_id"), UC, ["seconds", "event_id"]).select(*UC, "event_id", "pos")


@query("time_deltas", "actions", """SELECT event_id, greatest(coalesce(seconds - lag(seconds) OVER w, 0), 0)::DOUBLE AS dt,
 round(ln(1 + greatest(coalesce(seconds - lag(seconds) OVER w, 0), 0)), 6) AS log_dt FROM actions WINDOW w AS (PARTITION BY username, course_id ORDER BY seconds, event_id)""")
def _(t):
    return rounded(Q.time_deltas(t.actions, UC, ["seconds", "event_id"]).select("event_id", "dt", "log_dt"))


@query("cumulative_clicks", "clicks", """SELECT id_student, date, CAST(sum(c) OVER (PARTITION BY id_student ORDER BY date) AS BIGINT) AS cumulative_clicks
 FROM (SELECT id_student, date, sum(sum_click) AS c FROM clicks GROUP BY id_student, date)""")
def _(t):
    return Q.cumulative_clicks(t.clicks, ["id_student"]).select("id_student", "date", "cumulative_clicks")


@query("first_per_key", "clicks", "SELECT id_student, event_id, activity FROM (SELECT *, row_number() OVER (PARTITION BY id_student ORDER BY date, event_id) AS r FROM clicks) WHERE r = 1")
def _(t):
    return Q.first_per_key(t.clicks, ["id_student"], ["date", "event_id"]).select("id_student", "event_id", "activity")


@query("last_in_group", "clicks", "SELECT id_student, arg_max(sum_click, (date, event_id)) AS last_clicks FROM clicks GROUP BY id_student")
def _(t):
    return t.clicks.groupBy("id_student").agg(F.max_by("sum_click", F.struct("date", "event_id")).alias("last_clicks"))


@query("build_sequences", "actions", """WITH d AS (SELECT *, row_number() OVER w AS pos, ln(1 + greatest(coalesce(seconds - lag(seconds) OVER w, 0), 0)) AS log_dt FROM actions WINDOW w AS (PARTITION BY username, course_id ORDER BY seconds, event_id))
 SELECT username, course_id, (pos - 1) // 50 AS segment, count(*) AS length, string_agg(CAST(CAST(round(log_dt * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS gaps,
 string_agg(CAST(CAST(round(ln(1 + value) * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS log_values FROM d GROUP BY username, course_id, segment""")
def _(t):
    out = Q.build_sequences(t.actions, UC, ["seconds", "event_id"], ["value"], segment_steps=50)
    text = lambda f: F.array_join(F.transform("steps", lambda s: F.round(s[f] * 1000).cast("bigint").cast("string")), ",")
    return out.select(*UC, "segment", "length", text("log_dt").alias("gaps"), text("log_value").alias("log_values"))


@query("course_index", "actions", "SELECT course_id, dense_rank() OVER (ORDER BY course_id) - 1 AS course_idx FROM (SELECT DISTINCT course_id FROM actions)")
def _(t):
    return Q.course_index(t.actions).select("course_id", F.col("course_idx").cast("bigint").alias("course_idx"))


@query("click_sequences", "clicks registrations", """SELECT id_student, 0::BIGINT AS segment, string_agg(CAST(sum_click AS VARCHAR), ',' ORDER BY date, event_id) AS sequence, count(*) AS length,
 max(CASE WHEN final_result = 'Pass' THEN 1 ELSE 0 END) AS label_pass FROM clicks JOIN registrations USING (id_student) GROUP BY id_student""")
def _(t):
    out = Q.click_sequences(t.clicks, t.registrations, ["event_id"])
    return out.withColumn("sequence", F.array_join(F.transform("sequence", lambda x: x.cast("string")), ","))


@query("pad_sequences", "clicks", """WITH r AS (SELECT id_student, sum_click, row_number() OVER (PARTITION BY id_student ORDER BY date DESC, event_id DESC) AS back FROM clicks),
 g AS (SELECT s.id_student, n.n AS back, coalesce(r.sum_click, 0) AS v FROM (SELECT DISTINCT id_student FROM clicks) s CROSS JOIN (SELECT unnest(range(1, 91)) AS n) n LEFT JOIN r ON r.id_student = s.id_student AND r.back = n.n)
 SELECT id_student, string_agg(CAST(v AS VARCHAR), ',' ORDER BY back DESC) AS sequence FROM g GROUP BY id_student""")
def _(t):
    out = Q.pad_sequences(t.clicks, ["id_student"], ["date", "event_id"], "sum_click", 90)
    return out.select("id_student", F.array_join(F.transform("sequence", lambda x: x.cast("bigint").cast("string")), ",").alias("sequence"))


@query("truncate_prefix", "actions", "SELECT username, course_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY username, course_id ORDER BY seconds, event_id) AS r FROM actions) WHERE r <= 10")
def _(t):
    return Q.first_steps(t.actions, UC, ["seconds", "event_id"], 10).select(*UC, "event_id")


@query("grade_steps", "grades", "SELECT id, 1 AS step, G1 AS grade, studytime FROM grades UNION ALL SELECT id, 2, G2, studytime FROM grades")
def _(t):
    return Q.grade_steps(t.grades, "id", ["G1", "G2"], ["studytime"])


@query("standardize", "actions", """SELECT event_id, round((value - m) / s, 6) AS value, round((date - dm) / ds, 6) AS date FROM actions,
 (SELECT avg(value) AS m, sqrt(greatest(var_pop(value), 1e-8)) AS s, avg(date) AS dm, sqrt(greatest(var_pop(date), 1e-8)) AS ds FROM actions)""")
def _(t):
    a = t.actions.select("event_id", "value", "date")
    return rounded(Q.standardize(a, Q.standardizer(a, ["value", "date"]), ["value", "date"]))


@query("average_rank", "predictions", """SELECT id, rank() OVER (PARTITION BY grp ORDER BY prob_gru) + (count(*) OVER (PARTITION BY grp, prob_gru) - 1) / 2.0 AS rank FROM predictions""")
def _(t):
    return Q.average_rank(t.predictions.select("id", "grp", "prob_gru"), ["grp"], "prob_gru").select("id", "rank")


# ---- process mining
NEXT = "WITH s AS (SELECT case_id, activity, ts, lead(activity) OVER w AS nxt, lead(ts) OVER w AS nts, lag(activity) OVER w AS prv FROM event_log WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id))"


@query("prepare_event_log", "event_log", "SELECT activity, resource, count(*) AS n, count(ts) AS timed FROM event_log GROUP BY activity, resource")
def _(t):
    raw = t.event_log.select(F.col("case_id").alias("session_id"), F.col("activity").alias("event"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), "resource")
    return E.prepare_event_log(raw).groupBy("activity", "resource").agg(F.count(F.lit(1)).alias("n"), F.count("timestamp").alias("timed"))


@query("to_event_log", "event_log", """SELECT case_id AS "case:concept:name", activity AS "concept:name", ts AS "time:timestamp", resource AS "org:resource" FROM event_log""")
def _(t):
    return E.to_event_log(t.event_log.withColumn("timestamp", F.col("ts").cast("timestamp_ntz")))


@query("directly_follows", "event_log", NEXT + " SELECT activity AS source, nxt AS target, count(*) AS frequency FROM s WHERE nxt IS NOT NULL GROUP BY 1, 2")
def _(t):
    return E.directly_follows(t.event_log)


@query("start_end_activities", "event_log", NEXT + """ SELECT 'start' AS side, activity, count(*) AS cases FROM s WHERE prv IS NULL GROUP BY activity
 UNION ALL SELECT 'end', activity, count(*) FROM s WHERE nxt IS NULL GROUP BY activity""")
def _(t):
    return E.start_end_activities(t.event_log)


@query("activity_frequency", "event_log", "SELECT activity, count(*) AS frequency FROM event_log GROUP BY activity")
def _(t):
    return E.activity_frequency(t.event_log)


@query("trace_variants", "event_log", """WITH p AS (SELECT case_id, string_agg(activity, ' -> ' ORDER BY ts, event_id) AS variant, count(*) AS steps FROM event_log GROUP BY case_id)
 SELECT min(case_id) AS example_case, variant, 0::BIGINT AS segment, steps, count(*) AS frequency, round(count(*) * 100.0 / (SELECT count(*) FROM p), 6) AS percentage
 FROM p GROUP BY variant, steps ORDER BY frequency DESC, example_case LIMIT 10""")
def _(t):
    return rounded(E.trace_variants(t.event_log))


@query("throughput_stats", "event_log", """WITH c AS (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS h FROM event_log GROUP BY case_id HAVING count(*) > 1)
 SELECT round(avg(h), 6) AS mean_hours, round(stddev_pop(h), 6) AS std_hours, round(min(h), 6) AS min_hours, round(max(h), 6) AS max_hours, count(*) AS cases, round(median(h), 6) AS median_hours FROM c""")
def _(t):
    return rounded(E.throughput_stats(t.event_log))


@query("bottlenecks", "event_log", NEXT + """ SELECT activity AS from_activity, nxt AS to_activity, round(avg(m), 5) AS mean_waiting_minutes, round(max(m), 5) AS max_waiting_minutes, count(*) AS frequency, round(median(m), 5) AS median_waiting_minutes
 FROM (SELECT *, (epoch_us(nts) - epoch_us(ts)) / 6e7 AS m FROM s WHERE nxt IS NOT NULL) GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY median(m) DESC, 1, 2 LIMIT 10""")
def _(t):
    return rounded(E.bottlenecks(t.event_log), 5)


@query("case_arrival_gap", "event_log", """WITH c AS (SELECT min(epoch_us(ts)) AS t FROM event_log GROUP BY case_id), d AS (SELECT (t - lag(t) OVER (ORDER BY t)) / 6e7 AS g FROM c)
 SELECT round(avg(g), 6) AS mean_arrival_minutes, count(*) AS cases FROM d""")
def _(t):
    return rounded(E.case_arrival_gap(t.event_log))


@query("edge_conformance", "event_log", NEXT + """, e AS (SELECT case_id, coalesce(prv, '<start>') AS a, activity AS b FROM s UNION ALL SELECT case_id, activity, '<end>' FROM s WHERE nxt IS NULL),
 f AS (SELECT a, b, count(*) AS n FROM e GROUP BY a, b), m AS (SELECT a, b FROM f WHERE n > (SELECT avg(n) * 0.5 FROM f)),
 c AS (SELECT case_id, count(m.a) / count(*) AS fit FROM e LEFT JOIN m USING (a, b) GROUP BY case_id)
 SELECT round(avg(fit), 6) AS average_fitness, count(*) FILTER (WHERE fit = 1) AS conforming_cases, count(*) AS cases, round(count(*) FILTER (WHERE fit = 1) / count(*), 6) AS conformance_rate FROM c""")
def _(t):
    freq = E.trace_edges(t.event_log).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    floor = freq.agg(F.avg("n") * 0.5).scalar()
    return rounded(E.edge_conformance(t.event_log, freq.where(F.col("n") > floor)))


@query("log_summary", "event_log", NEXT + """ SELECT (SELECT count(*) FROM s) AS events, (SELECT count(DISTINCT case_id) FROM s) AS cases, (SELECT count(DISTINCT activity) FROM s) AS activities,
 (SELECT count(*) FROM (SELECT DISTINCT activity, nxt FROM s WHERE nxt IS NOT NULL)) AS edges""")
def _(t):
    return E.log_summary(t.event_log)


# ---- graph
@query("bipartite_edges", "clicks", "SELECT id_student, id_site, CAST(sum(sum_click) AS BIGINT) AS weight, min(date) AS time FROM clicks GROUP BY 1, 2")
def _(t):
    return G.bipartite_edges(t.clicks)


@query("node_features", "clicks", """SELECT 'id_student' AS kind, CAST(id_student AS VARCHAR) AS node, CAST(sum(sum_click) AS BIGINT) AS clicks FROM clicks GROUP BY 2
 UNION ALL SELECT 'id_site', CAST(id_site AS VARCHAR), CAST(sum(sum_click) AS BIGINT) FROM clicks GROUP BY 2""")
def _(t):
    return G.node_features(t.clicks)


@query("node_index", "clicks", "SELECT id_student, row_number() OVER (ORDER BY id_student) - 1 AS idx FROM (SELECT DISTINCT id_student FROM clicks)")
def _(t):
    return G.node_index(t.clicks, "id_student")
