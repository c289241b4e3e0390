"""Seeded look-alike tables for tests: every value is a function of the row number and the seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edlens.functions.hashing import key_unit, poisson_draw
from edlens.functions.scalars import clip


def _choice(u: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def synth_course_tables(spark: SparkSession, n: int, seed: int = 42) -> dict[str, DataFrame]:
    u = lambda name: key_unit(["id_student"], f"{seed}-{name}")
    ids = spark.range(1, n + 1).select(F.col("id").alias("id_student"))
    keyed = ids.select(
        "id_student", _choice(u("module"), ["AAA", "BBB", "CCC"]).alias("code_module"),
        _choice(u("presentation"), ["2013B", "2013J", "2014B", "2014J"]).alias("code_presentation"),
    )
    info = keyed.select(
        "*", _choice(u("gender"), ["M", "F"]).alias("gender"), _choice(u("region"), ["North", "South", "East", "West"]).alias("region"),
        _choice(u("edu"), ["Lower Than A Level", "A Level or Equivalent", "HE Qualification"]).alias("highest_education"),
        _choice(u("imd"), ["0-10%", "10-20%", "20-30%", "30-40%", "40-50%"]).alias("imd_band"),
        _choice(u("age"), ["0-35", "35-55", "55<="]).alias("age_band"), _choice(u("dis"), ["N", "Y"]).alias("disability"),
        poisson_draw(["id_student"], f"{seed}-attempts", 0.5).cast("bigint").alias("num_of_prev_attempts"), (F.floor(u("credits") * 8) * 30 + 30).alias("studied_credits"),
    )
    reg = keyed.select("*", (-F.floor(u("reg") * 60)).cast("int").alias("date_registration"),
                       _choice(u("result"), ["Pass", "Fail", "Withdrawn", "Distinction"]).alias("final_result"))
    steps = keyed.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20))))
    s = lambda name: key_unit(["id_student", "k"], f"{seed}-{name}")
    vle = steps.select("id_student", "code_module", "code_presentation", F.floor(s("site") * 50).alias("id_site"),
                       F.floor(s("day") * 200 - 10).cast("int").alias("date"), (1 + F.floor(-10 * F.log(1 - s("clicks")))).alias("sum_click"))
    return {"studentInfo": info, "studentRegistration": reg, "studentVle": vle}


def synth_mooc(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """One row per learner with activity counts and an engagement-adjusted final score."""
    u = lambda name: key_unit(["user_id"], f"{seed}-{name}")
    df = spark.range(1, n + 1).select(F.col("id").alias("user_id")).select(
        "user_id", _choice(u("sex"), ["M", "F"]).alias("sex"), u("video").alias("video_completion_rate"),
        poisson_draw(["user_id"], f"{seed}-assign", 6.0).alias("assignments_submitted"), poisson_draw(["user_id"], f"{seed}-forum", 3.0).alias("forum_posts"),
        (1 + F.floor(u("days") * 60)).alias("days_active"), (-300 * F.log(1 - u("time"))).alias("total_video_time"),
    )
    raw = 40 + 60 * u("score")
    engaged = F.col("video_completion_rate") * 0.5 + clip(F.col("assignments_submitted") / 12, 0.0, 1.0) * 0.5
    return df.withColumn("final_score", clip(raw * 0.7 + engaged * 30, 0.0, 100.0))
