"""Small literal tables with results known by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from edlens.functions import scalars as S
from edlens.operators import calibration as C
from edlens.operators import columns as Co
from edlens.operators import conformal as U
from edlens.operators import events as E
from edlens.operators import features as X
from edlens.operators import mapping as Mp
from edlens.operators import sequences as Q
from edlens.operators import splits as L
from edlens.operators import validation as V

KEY = ["id_student", "code_module", "code_presentation"]


@pytest.fixture(scope="module")
def course(spark):
    info = spark.createDataFrame(
        [(1, "AAA", "2013J", "M", "North", "HE Qualification", "10-20%", "35-55", "N"), (2, "AAA", "2013J", "F", "South", "A Level or Equivalent", "0-10%", "0-35", "N"),
         (3, "BBB", "2014B", "M", "East", "Lower Than A Level", "20-30%", "55<=", "Y")],
        "id_student long, code_module string, code_presentation string, gender string, region string, highest_education string, imd_band string, age_band string, disability string")
    reg = spark.createDataFrame(
        [(1, "AAA", "2013J", -30, 30, 0, "Pass"), (2, "AAA", "2013J", -25, 60, 1, "Fail"), (3, "BBB", "2014B", -20, 30, 0, "Withdrawn")],
        "id_student long, code_module string, code_presentation string, date_registration int, studied_credits int, num_of_prev_attempts int, final_result string")
    vle = spark.createDataFrame(
        [(1, "AAA", "2013J", 1, 1, 10), (1, "AAA", "2013J", 2, 5, 15), (2, "AAA", "2013J", 1, 2, 8), (2, "AAA", "2013J", 3, 10, 20), (3, "BBB", "2014B", 1, 3, 5)],
        "id_student long, code_module string, code_presentation string, id_site long, date int, sum_click long")
    sub = spark.createDataFrame([(1, 101, 30, 0, 85.0), (2, 101, 35, 0, 72.0), (3, 102, 40, 1, 90.0)], "id_student long, id_assessment long, date_submitted int, is_banked int, score double")
    assess = spark.createDataFrame([(101, "AAA", "2013J", "TMA", 30, 20.0), (102, "BBB", "2014B", "CMA", 45, 30.0)],
                                   "id_assessment long, code_module string, code_presentation string, assessment_type string, date int, weight double")
    return info, reg, vle, sub, assess


def test_click_features(course):
    rows = {r.id_student: r for r in X.click_features(course[2]).collect()}
    assert rows[1].vle_total_clicks == 25 and rows[1].vle_days_active == 2
    assert rows[1].vle_cumulative_clicks == 25 and rows[2].vle_max_clicks == 20


def test_labels_and_sex(course):
    rows = {r.id_student: r for r in X.derive_labels(course[0], course[1]).collect()}
    assert [rows[i].label_pass for i in (1, 2, 3)] == [1, 0, 0]
    assert [rows[i].label_fail_or_withdraw for i in (1, 2, 3)] == [0, 1, 1]
    assert rows[1].sex == "Male" and rows[2].sex == "Female" and rows[1].sex_x_age == "Male_x_35-55"


def test_on_time_rates_and_dataset(course):
    info, reg, vle, sub, assess = course
    feats = X.submission_features(X.attach_deadlines(sub, assess))
    assert {r.id_student: r.assessment_ontime_rate for r in feats.collect()} == {1: 1.0, 2: 0.0, 3: 1.0}
    built = X.assemble(X.derive_labels(info, reg), [X.click_features(vle), feats])
    assert built.count() == 3
    report = V.validation_report(V.check_structure(built, KEY + ["label_pass"]), V.check_identifiers(built, KEY), V.check_labels(built, ["label_pass"]))
    assert V.verdict(report).first()["passed"]


def test_missing_deadline_is_late(spark, course):
    bare = course[4].where("id_assessment = 102")
    late = X.attach_deadlines(course[3], bare)
    assert {r.id_student: r.on_time for r in late.collect()} == {1: 0, 2: 0, 3: 1}


def test_click_sequences_and_padding(spark):
    vle = spark.createDataFrame([(1, 11, 1, 5), (1, 12, 2, 6), (2, 11, 1, 0), (2, 12, 2, 1), (3, 11, 1, 3), (3, 12, 2, 4)], "id_student long, id_site long, date int, sum_click long")
    reg = spark.createDataFrame([(1, "Pass"), (2, "Fail"), (3, "Pass")], "id_student long, final_result string")
    seq = {r.id_student: (list(r.sequence), r.label_pass) for r in Q.click_sequences(vle, reg, ["id_site"]).collect()}
    assert seq == {1: ([5, 6], 1), 2: ([0, 1], 0), 3: ([3, 4], 1)}
    pad = {r.id_student: list(r.sequence) for r in Q.pad_sequences(vle, ["id_student"], ["date"], "sum_click", 3).collect()}
    assert pad == {1: [0, 5, 6], 2: [0, 0, 1], 3: [0, 3, 4]}


@pytest.fixture(scope="module")
def log(spark):
    t = lambda h: dt.datetime(2023, 1, 1, h)
    return spark.createDataFrame([(1, "start", t(0), "r1", 1), (1, "end", t(1), "r1", 2), (2, "start", t(2), "r2", 3)], "case_id long, activity string, ts timestamp, resource string, event_id long")


def test_event_log(log):
    assert [(r.source, r.target, r.frequency) for r in E.directly_follows(log).collect()] == [("start", "end", 1)]
    assert {(r.variant, r.frequency) for r in E.trace_variants(log).collect()} == {("start -> end", 1), ("start", 1)}
    t = E.throughput_stats(log).first()
    assert t.mean_hours == 1.0 and t.median_hours == 1.0 and t.cases == 1
    assert E.bottlenecks(log).count() == 0
    assert E.case_arrival_gap(log).first().mean_arrival_minutes == 120.0
    names = E.to_event_log(E.prepare_event_log(log.withColumnRenamed("ts", "time"))).columns
    assert names == ["case:concept:name", "concept:name", "time:timestamp", "org:resource"]


def test_full_conformance(log):
    c = E.edge_conformance(log, E.trace_edges(log).select("source", "target").distinct()).first()
    assert c.average_fitness == 1.0 and c.conforming_cases == 2


def test_concept_means(spark):
    df = spark.createDataFrame([(1, 0, 2, 2, 1, 3, 2, 1, 1, 3), (2, 1, 3, 4, 2, 4, 2, 2, 2, 5)],
                               "absences int, failures int, Medu int, Fedu int, traveltime int, studytime int, goout int, Dalc int, Walc int, freetime int")
    rows = df.select(*X.concept_means(df)).collect()
    assert [(r.attendance, round(r.socio_economic_status, 9), r.engagement) for r in rows] == [(0.5, round(5 / 3, 9), 2.0), (1.5, 3.0, 3.0)]


def test_canonical_mapping(spark):
    uci = spark.createDataFrame([("F", 18, 2, 12, 2, 14), ("M", 19, 3, 8, 1, 6), ("F", 20, 1, 15, 3, 16)], "sex string, age int, Medu int, G1 int, studytime int, G3 int")
    assert [r.label_pass for r in Mp.canonical_bridge(uci, "uci").collect()] == [1, 0, 1]
    ou = spark.createDataFrame([("F", "0-35", 20, 0, 60, 500, "Pass"), ("M", "35-55", 40, 1, 120, 1200, "Fail"), ("F", "0-35", 60, 0, 90, 300, "Distinction")],
                               "sex string, age_band string, imd_band int, prev_attempts int, studied_credits int, vle_total_clicks int, final_result string")
    rows = Mp.canonical_bridge(ou, "oulad").collect()
    assert [r.label_pass for r in rows] == [1, 0, 1] and [r.study_time for r in rows] == [1.0, 2.0, 1.0]
    assert rows[0].ses_index == pytest.approx(3.2)


def test_shared_features(spark):
    uci = spark.createDataFrame([("F", 18, 2, 5, 1, "yes", "no", 2, 12)], "sex string, age int, Medu int, absences int, studytime int, higher string, famsup string, goout int, G3 int")
    ou = spark.createDataFrame([("F", "0-35", "0-10%", 100, 1, "Yes", "No", 4, 1), ("M", "0-35", "10-20%", 200, 2, "No", "Yes", 2, 0)],
                               "sex string, age_band string, imd_band string, vle_total_clicks int, studytime int, higher string, famsup string, goout int, label_pass int")
    a, b = Mp.shared_features(ou, "oulad"), Mp.shared_features(uci, "uci")
    assert len(set(a.columns) & set(b.columns)) >= 8
    assert a.where("sex = 'F'").first().activities == "yes" and a.where("sex = 'F'").first().famrel == 2


def test_dataset_kind():
    assert Co.dataset_kind(["vle_total_clicks", "vle_days_active", "assessment_count", "noise"]) == "oulad"
    assert Co.dataset_kind(["studytime", "Dalc", "Walc", "famrel"]) == "uci"
    assert Co.dataset_kind(["x"]) == "generic"


def test_nonconformity_and_thresholds(spark):
    df = spark.createDataFrame([(0, 0.2), (1, 0.8), (0, 0.3), (1, 0.7)], "y int, p double")
    assert [round(r[0], 9) for r in df.select(U.nonconformity()).collect()] == [0.2, 0.2, 0.3, 0.3]
    sep = spark.createDataFrame(list(zip([0, 0, 0, 1, 1, 0, 1, 0, 1, 1], [0.1, 0.2, 0.3, 0.6, 0.7, 0.4, 0.8, 0.15, 0.9, 0.85])), "y int, p double")
    best = C.optimal_threshold(sep, [], "f1").first()
    assert best.threshold == 0.6 and best.score == pytest.approx(1.0, abs=1e-6)


def test_ece_orders_good_and_poor(spark):
    y = [0, 0, 1, 1, 1]
    ece = lambda p: C.calibration_error(spark.createDataFrame(list(zip(y, p)), "y int, p double"), [], n_bins=5).first().ece
    good, poor = ece([0.1, 0.2, 0.7, 0.8, 0.9]), ece([0.9, 0.8, 0.2, 0.1, 0.3])
    assert good < 0.3 < poor


@pytest.fixture(scope="module")
def twelve(spark):
    rows = [(i, "AAA" if i < 6 else "BBB", ["2013B", "2013J", "2014B", "2014J"][i % 4], i % 2, ["Female", "Male"][i % 2]) for i in range(12)]
    return spark.createDataFrame(rows, "id_student long, code_module string, code_presentation string, label_pass int, sex string")


def test_splits_are_disjoint_and_cover(twelve):
    for s in (L.stratified_random_split(twelve, strata=["label_pass", "sex"]), L.chronological_split(twelve, "code_presentation"),
              L.hold_out(L.holdout_split(twelve, "code_module", strata=["label_pass"]), "code_module", "AAA")):
        assert s.select("id_student").distinct().count() == 12 == s.count()
        assert sum(r.overlap for r in L.check_leakage(s, "id_student", ["train", "val", "test"]).collect()) == 0
    held = L.hold_out(L.holdout_split(twelve, "code_module"), "code_module", "AAA").where("split = 'test'")
    assert {r.id_student for r in held.collect()} == set(range(6))


def test_chronological(spark):
    df = spark.createDataFrame([(1, "2013B"), (2, "2013J"), (3, "2014B"), (4, "2014J")], "id_student long, code_presentation string")
    assert {r.id_student: r.split for r in L.chronological_split(df, "code_presentation").collect()} == {1: "train", 2: "train", 3: "val", 4: "test"}
    few = L.chronological_split(df.where("id_student < 3"), "code_presentation")
    assert {r.split for r in few.collect()} == {"train"}


def test_leakage_found(spark):
    df = spark.createDataFrame([(1, "train"), (1, "test"), (2, "val")], "id_student long, split string")
    got = {(r.a, r.b): r.overlap for r in L.check_leakage(df, "id_student", ["train", "val", "test"]).collect()}
    assert got == {("train", "val"): 0, ("train", "test"): 1, ("val", "test"): 0}
    assert L.check_leakage(L.resolve_overlap(df, "id_student", "train_excludes_test"), "id_student", ["train", "test"]).first().overlap == 0


def test_groups_never_span_folds(twelve):
    f = L.group_kfold(twelve.withColumn("g", L.group_key(twelve)), "g", 3)
    assert f.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0 and f.count() == 12


def test_null_keys_and_recodes(spark):
    df = spark.createDataFrame([("a",), (None,), ("z",)], "c string")
    assert [r[0] for r in df.select(S.map_values("c", {"a": "A"}, "?")).collect()] == ["A", "?", "?"]
    assert [r[0] for r in df.select(S.map_values("c", {"a": "A"})).collect()] == ["A", None, "z"]
    assert [r[0] for r in df.select(S.intersect_key("c", F.lit("x"))).collect()] == ["a_x_x", "Unknown_x_x", "z_x_x"]
    assert [r[0] for r in df.select(S.encode_label("c", "Z")).collect()] == [0, 0, 1]


def test_one_to_one_join_refuses_duplicates(spark):
    a = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k long, v double")
    with pytest.raises(Exception, match="left side repeats"):
        X.one_to_one_join(a, a.limit(1).withColumnRenamed("v", "w"), ["k"]).collect()


def test_last_steps_beyond_pushdown(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"))
    small = {r.t for r in Q.last_steps(df, ["k"], ["t"], 3).collect()}
    assert small == set(range(2994, 3000))
    big = Q.last_steps(df, ["k"], ["t"], 1200, max_group_rows=500)
    assert {r.t for r in big.collect()} == set(range(600, 3000))
    head = Q.first_steps(df, ["k"], ["t"], 1200, max_group_rows=500)
    assert {r.t for r in head.collect()} == set(range(2400))


def test_plain_aggregates_run_on_a_stream(spark, tmp_path):
    from edlens.operators.profile import risk_list

    src = spark.createDataFrame([("a", 0.2), ("a", 0.8), ("b", 0.1)], "user string, p double")
    src.write.parquet(f"{tmp_path}/in")
    stream = risk_list(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in"), ["user"], "p", 0.4)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("risk_stream").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(str, spark.table("risk_stream").collect())) == sorted(map(str, risk_list(src, ["user"], "p", 0.4).collect()))
