"""Readers and writers over the given tables and files that Spark writes from them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from edlens.operators.columns import dataset_kind
from edlens.plans.registry import query
from edlens.plans.relational import rounded
from edlens.session import shared_folder
from edlens.sources import readers as R
from edlens.sources import writers as W


def scratch(t) -> str:
    """A fresh folder that driver and executors share."""
    return f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"


@query("read_any", "", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    return R.read_any(t.spark, f"{t.folder}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")


@query("read_table_set", "", """SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'orders', count(*) FROM orders""")
def _(t):
    tables = R.read_table_set(t.spark, t.folder, dict.fromkeys(("nation", "supplier", "absent", "orders")), suffix="parquet")
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("read_first_existing", "", "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey")
def _(t):
    found = R.read_first_existing(t.spark, [f"{t.folder}/absent.parquet", f"{t.folder}/supplier.parquet", f"{t.folder}/part.parquet"])
    return found.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("dataset_registry", "registrations", "SELECT (final_result IN ('Pass', 'Distinction'))::INTEGER AS label_pass, count(*) AS n FROM registrations GROUP BY 1")
def _(t):
    registry = R.DatasetRegistry()
    registry.register("course", lambda spark: t.registrations)
    return registry.load(t.spark, "course").groupBy("label_pass").agg(F.count(F.lit(1)).alias("n"))


@query("read_grades", "grades", "SELECT (G3 >= 10)::INTEGER AS target, count(*) AS n, sum(G1)::BIGINT AS first, sum(absences)::BIGINT AS absences FROM grades GROUP BY 1")
def _(t):
    path = f"{scratch(t)}/grades.csv"
    t.grades.write.option("header", True).option("sep", ";").csv(path)
    g = R.read_grades(t.spark, path, sep=";")
    return g.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.sum("G1").cast("bigint").alias("first"), F.sum("absences").cast("bigint").alias("absences"))


@query("read_early", "grades", "SELECT (G3 >= 12)::INTEGER AS target, G1, count(*) AS n, false AS later FROM grades GROUP BY 1, 2")
def _(t):
    path = f"{scratch(t)}/grades.csv"
    t.grades.write.option("header", True).csv(path)
    g = R.read_early(t.spark, path, pass_threshold=12)
    return g.groupBy("target", F.col("G1").cast("bigint").alias("G1")).agg(F.count(F.lit(1)).alias("n")).withColumn("later", F.lit("G2" in g.columns or "G3" in g.columns))


@query("write_dataset", "registrations", """SELECT code_presentation, count(*) AS n, sum(date_registration)::BIGINT AS days, (SELECT count(*) FROM registrations) AS total FROM registrations GROUP BY code_presentation""")
def _(t):
    folder = scratch(t)
    W.write_dataset(t.registrations, folder, side=t.registrations.groupBy("code_module").count(), summary=t.registrations.agg(F.count(F.lit(1)).alias("total")))
    back = t.spark.read.parquet(f"{folder}/dataset.parquet").groupBy("code_presentation").agg(F.count(F.lit(1)).alias("n"), F.sum("date_registration").cast("bigint").alias("days"))
    return back.withColumn("total", t.spark.read.schema("total long").json(f"{folder}/summary.json").scalar())


@query("collect_results", "predictions", """SELECT 'sex' AS run, sex AS experiment, 'mean' AS metric, round(avg(prob_gru), 6) AS value FROM predictions GROUP BY sex UNION ALL SELECT 'grp', grp, 'mean', round(avg(prob_gru), 6) FROM predictions GROUP BY grp""")
def _(t):
    folder = scratch(t)
    for c in ("sex", "grp"):
        W.write_metrics_long(W.metrics_long(t.predictions.groupBy(c).agg(F.avg("prob_gru").alias("mean")), c, ["mean"]), f"{folder}/{c}.csv")
    found = R.collect_results(t.spark, [f"{folder}/sex.csv", f"{folder}/grp.csv"])
    return rounded(found.select(F.regexp_extract("result_file", "([a-z]+)[.]csv", 1).alias("run"), "experiment", "metric", "value"))


@query("dataset_kind", "grades clicks", "SELECT 'grades' AS name, 'uci' AS kind, count(*) AS n FROM grades UNION ALL SELECT 'clicks', 'generic', count(*) FROM clicks")
def _(t):
    seen = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.lit(dataset_kind(df.columns)).alias("kind"), "n")
    return seen("grades", t.grades).union(seen("clicks", t.clicks))
