import pytest
from pyspark.sql import functions as F

from edlens.contracts import COURSE_TABLES, conform_columns
from edlens.operators import columns as Co
from edlens.operators import events as E
from edlens.sources import readers as R
from edlens.sources import synth as Sy
from edlens.sources import writers as W


def test_course_tables_round_trip(spark, tmp_path):
    tables = Sy.synth_course_tables(spark, 200)
    for n, df in tables.items():
        df.select(*[c for c in COURSE_TABLES[n].names if c in df.columns]).write.option("header", True).csv(f"{tmp_path}/{n}.csv")
    assert set(R.read_table_set(spark, str(tmp_path))) >= set()
    got = R.read_table_set(spark, str(tmp_path), {n: t for n, t in COURSE_TABLES.items() if n in ("studentVle", "courses")})
    assert set(got) == {"studentVle"} and got["studentVle"].count() == 4000
    with pytest.raises(FileNotFoundError):
        R.read_table_set(spark, str(tmp_path), {"vle": COURSE_TABLES["vle"]}, strict=True)


def test_synthetic_tables_are_seeded(spark):
    a, b = Sy.synth_mooc(spark, 300), Sy.synth_mooc(spark, 300).repartition(3)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert Sy.synth_mooc(spark, 300, seed=1).agg(F.sum("final_score")).first() != a.agg(F.sum("final_score")).first()
    lab = Co.mooc_labels(a).agg(F.avg("label_pass").alias("p"), F.max("final_score").alias("m")).first()
    assert 0 < lab.p < 1 and lab.m <= 100


def test_grades(spark, tmp_path):
    path = f"{tmp_path}/grades.csv"
    spark.createDataFrame([(5, 6, 9), (12, 11, 14), (9, 10, 10)], "G1 int, G2 int, G3 int").write.option("header", True).option("sep", ";").csv(path)
    g = R.read_grades(spark, path, sep=";")
    assert sorted(r.target for r in g.collect()) == [0, 1, 1] and "G3" not in g.columns
    assert R.read_grades(spark, path, sep=";", pass_threshold=12).agg(F.sum("target")).first()[0] == 1
    assert R.read_early(spark, path, sep=";").columns == ["G1", "target"]
    assert sorted(r.target for r in R.read_grades(spark, path, task="regression", sep=";").collect()) == [9, 10, 14]
    assert R.read_first_existing(spark, [f"{tmp_path}/no.csv", path]).count() == 3
    with pytest.raises(ValueError):
        R.read_any(spark, "x.txt")


def test_registry_backfills_label(spark):
    reg = R.DatasetRegistry()
    reg.register("a", lambda s: s.createDataFrame([("Pass",), ("Fail",)], "final_result string"))
    assert sorted(r.label_pass for r in reg.load(spark, "a").collect()) == [0, 1]
    with pytest.raises(KeyError):
        reg.load(spark, "b")


def test_write_dataset_and_results(spark, tmp_path):
    df = spark.createDataFrame([(i, "2013J" if i % 3 else "2014B", float(i)) for i in range(50)], "id long, code_presentation string, x double")
    W.write_dataset(df, str(tmp_path), side=df.groupBy("code_presentation").count(), summary=df.agg(F.count("*").alias("n")))
    back = spark.read.parquet(f"{tmp_path}/dataset.parquet")
    assert back.count() == 50 and back.where("code_presentation = '2014B'").count() == 17
    W.write_metrics_long(W.metrics_long(df.groupBy("code_presentation").agg(F.avg("x").alias("m")), "code_presentation", ["m"]), f"{tmp_path}/r1.csv")
    df.limit(2).select("id").write.option("header", True).csv(f"{tmp_path}/r2.csv")
    all_ = R.collect_results(spark, [f"{tmp_path}/r1.csv", f"{tmp_path}/r2.csv"])
    assert all_.count() == 4 and {"experiment", "id", "result_file"} <= set(all_.columns)


def test_write_event_log(spark, tmp_path):
    log = spark.createDataFrame([(1, "a", "2023-01-01 00:00:00"), (1, "b", "bad")], "session_id long, event string, time string")
    out = E.to_event_log(E.prepare_event_log(log))
    W.write_event_log(out, f"{tmp_path}/log")
    back = spark.read.parquet(f"{tmp_path}/log")
    assert back.count() == 2 and back.where("`time:timestamp` IS NULL").count() == 1


def test_conform_columns(spark):
    raw = spark.createDataFrame([(1, 2, "3", 0, 5, "x")], "id_assessment int, id_student int, date string, is_banked int, score int, extra string")
    got = conform_columns(raw, COURSE_TABLES["studentAssessment"], {"date": "date_submitted"})
    assert got.schema == COURSE_TABLES["studentAssessment"] or [f.dataType for f in got.schema] == [f.dataType for f in COURSE_TABLES["studentAssessment"]]
    with pytest.raises(ValueError):
        conform_columns(raw.drop("score"), COURSE_TABLES["studentAssessment"], {"date": "date_submitted"})
