"""Ordered event sequences per group: gaps, running sums, arrays, padding, standardisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edlens.functions import scalars as S
from edlens.operators.ordered import MAX_GROUP_ROWS, in_order, null_safe_join

SEGMENT_STEPS = 10_000
LIMIT_PUSHDOWN = 1000  # Spark trims groups before the shuffle for row_number bounds below this


def order_events(df: DataFrame, keys: list[str], order: list[str], **kw) -> DataFrame:
    return in_order(df, keys, order, position="pos", **kw)


def time_deltas(df: DataFrame, keys: list[str], order: list[str], **kw) -> DataFrame:
    """Gap to the previous event: 0 for the first, never negative, and its log1p."""
    out = in_order(df, keys, order, position="pos", previous={"__before": order[0]}, **kw)
    gap = F.coalesce(F.greatest(F.col(order[0]) - F.col("__before"), F.lit(0.0)), F.lit(0.0))
    return out.select(*[c for c in out.columns if c != "__before"], gap.alias("dt"), F.log1p(gap).alias("log_dt"))


def cumulative_clicks(clicks: DataFrame, keys: list[str], day: str = "date", value: str = "sum_click", **kw) -> DataFrame:
    """Running total by day; days are summed first, so the ordered part sees one row per day."""
    daily = clicks.groupBy(*keys, day).agg(F.sum(value).alias("clicks"))
    return in_order(daily, keys, [day], running={"cumulative_clicks": "clicks"}, **kw)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key in the given order, as an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(row).select(*keys, "__row.*").select(*df.columns)


def last_steps(df: DataFrame, keys: list[str], order: list[str], n: int, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Last n rows per key."""
    if n < LIMIT_PUSHDOWN:
        w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
        return df.withColumn("__back", F.row_number().over(w)).where(F.col("__back") <= n).drop("__back")
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    placed = in_order(df, keys, order, position="__pos", max_group_rows=max_group_rows)
    placed = null_safe_join(placed, sizes, keys)
    return placed.where(F.col("__pos") > F.col("__size") - n).drop("__pos", "__size")


def first_steps(df: DataFrame, keys: list[str], order: list[str], n: int, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """First n rows per key (sequence prefix)."""
    if n < LIMIT_PUSHDOWN:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn("__at", F.row_number().over(w)).where(F.col("__at") <= n).drop("__at")
    return in_order(df, keys, order, position="__pos", max_group_rows=max_group_rows).where(F.col("__pos") <= n).drop("__pos")


def to_segments(df: DataFrame, keys: list[str], columns: list[str], pos: str = "pos", segment_steps: int = SEGMENT_STEPS) -> DataFrame:
    """Arrays of steps in order, cut into segments so that no row or task holds an unbounded group.

    ``segment`` counts from 0; a key of ordinary length has one segment. All rows are kept.
    """
    step = F.struct(F.col(pos).alias("pos"), *columns)
    segment = F.floor((F.col(pos) - 1) / segment_steps).cast("bigint").alias("segment")
    return df.groupBy(*keys, segment).agg(
        F.array_sort(F.collect_list(step)).alias("steps"), F.count(F.lit(1)).alias("length")
    )


def course_index(df: DataFrame, course: str = "course_id") -> DataFrame:
    """Index of each course by sorted name (a table with one row per course)."""
    names = df.select(F.col(course).cast("string").alias(course)).where(F.col(course).isNotNull()).distinct()
    return in_order(names, [], [course], position="idx").select(course, (F.col("idx") - 1).alias("course_idx"))


def build_sequences(df: DataFrame, keys: list[str], order: list[str], features: list[str], segment_steps: int = SEGMENT_STEPS, **kw) -> DataFrame:
    """Per key: ordered steps with log1p features and the log gap to the previous event."""
    numeric = df.select("*", *[F.log1p(S.number_or_zero(c)).alias(f"log_{c}") for c in features])
    timed = time_deltas(numeric, keys, order, **kw)
    return to_segments(timed, keys, [*[f"log_{c}" for c in features], "dt", "log_dt"], segment_steps=segment_steps)


def click_sequences(clicks: DataFrame, registrations: DataFrame, tiebreak: list[str], segment_steps: int = SEGMENT_STEPS, **kw) -> DataFrame:
    """Click counts per student in day order with the pass label of the registration."""
    label = registrations.groupBy("id_student").agg(F.max(S.pass_label("final_result")).alias("label_pass"))
    placed = in_order(clicks, ["id_student"], ["date", *tiebreak], position="pos", **kw)
    cut = to_segments(placed, ["id_student"], ["sum_click"], segment_steps=segment_steps)
    return cut.join(label, "id_student").select(
        "id_student", "segment", F.transform("steps", lambda s: s["sum_click"]).alias("sequence"), "length", "label_pass"
    )


def pad_sequences(df: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """Last n values per key, zeros on the left."""
    kept = last_steps(df, keys, order, n)
    arr = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("__v")))), lambda s: s["__v"])
    got = kept.groupBy(*keys).agg(arr.alias("__a"))
    padded = F.concat(F.array_repeat(F.lit(0.0), F.lit(n) - F.size("__a")), F.col("__a"))
    return got.select(*keys, padded.alias("sequence"), F.size("__a").alias("length"))


def grade_steps(df: DataFrame, key: str, grades: list[str], static: list[str]) -> DataFrame:
    """Wide grade columns to ordered (step, grade) rows with static values."""
    long = df.select(key, *static, *grades).unpivot([key, *static], grades, "exam", "grade")
    step = F.array_position(F.array(*map(F.lit, grades)), F.col("exam")).cast("int")
    return long.select(key, step.alias("step"), "grade", *static)


def standardizer(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: mean and population deviation per column, variance floored at 1e-8."""
    parts = [x for c in cols for x in (F.avg(c).alias(f"{c}_mean"), F.sqrt(F.greatest(F.var_pop(c), F.lit(1e-8))).alias(f"{c}_std"))]
    return df.agg(*parts)


def standardize(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    s = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, *[((F.col(c) - s[f"{c}_mean"]) / s[f"{c}_std"]).alias(c) for c in cols])


def average_rank(df: DataFrame, block: list[str], value: str, name: str = "rank", **kw) -> DataFrame:
    """Rank inside the block, ties sharing the mean rank; equal values are counted before ordering.

    A null value has no rank and does not count; a null block is a block like any other.
    """
    cells = df.where(F.col(value).isNotNull()).groupBy(*block, value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = in_order(cells, block, [value], running={"__upto": "__n"}, **kw)
    ranked = ranked.select(*block, value, (F.col("__upto") - (F.col("__n") - 1) / 2.0).alias(name))
    return null_safe_join(df, ranked, [*block, value], "left")
