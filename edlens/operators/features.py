"""Per-student features from click and submission tables, label building, and the joins around them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edlens.contracts import require
from edlens.functions import scalars as S

KEYS = ["id_student", "code_module", "code_presentation"]
EARLY_DAY = 28


def join_dimension(fact: DataFrame, dim: DataFrame, keys: list[str], how: str = "left", unique: bool = False) -> DataFrame:
    """Join metadata to a fact table after removing duplicate keys from the metadata (unless ``unique``).

    No count and no hint: adaptive execution broadcasts the dimension if its bytes allow it, and splits
    skewed partitions of a shuffled join.
    """
    rest = [c for c in dim.columns if c not in keys]
    if unique:
        pass
    elif rest:  # the smallest row per key: the same one on every attempt
        dim = dim.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__row")).select(*keys, "__row.*")
    else:
        dim = dim.distinct()
    return fact.join(dim, keys, how)


def derive_labels(students: DataFrame, registrations: DataFrame, how: str = "left", pass_values: tuple[str, ...] = S.PASS_VALUES) -> DataFrame:
    """Registration joined to student info, with pass / at-risk labels, sex and a combined group key.

    ``how='left'`` starts from registrations (their info may be missing); ``how='inner'`` keeps
    only students with both.
    """
    require(registrations, [*KEYS, "final_result"], "registrations")
    info = students.drop(*[c for c in students.columns if c in registrations.columns and c not in KEYS])
    both = registrations.join(info, KEYS, how)
    sex = S.map_values("gender", {"M": "Male", "F": "Female"})
    return both.select(
        "*",
        S.pass_label("final_result", pass_values).alias("label_pass"),
        S.at_risk_label("final_result").alias("label_fail_or_withdraw"),
        sex.alias("sex"),
        S.intersect_key(sex, "age_band").alias("sex_x_age"),
    )


def at_risk_rows(df: DataFrame, label: str = "y", p: str | None = None, threshold: float = 0.5) -> DataFrame:
    """Rows labelled as not passing or, with a probability column ``p`` of passing, scored below ``threshold``; nulls are no sign of risk."""
    low = F.coalesce(F.col(p) < threshold, F.lit(False)) if p else F.lit(False)
    return df.where(F.coalesce(F.col(label) == 0, F.lit(False)) | low)


def early_window(df: DataFrame, days: int = EARLY_DAY, on: str = "date") -> DataFrame:
    return df.where(F.col(on) <= days)


def click_features(
    clicks: DataFrame, keys: list[str] = KEYS, *, cutoff_day: int | None = None, course_length: str | None = None, last_days: int = 28
) -> DataFrame:
    """One pass over the click table.

    ``vle_last4_clicks`` counts days from -28 on, which is nearly everything; give
    ``course_length`` (a column) to get the true last four weeks beside it.
    """
    if cutoff_day is not None:
        clicks = early_window(clicks, cutoff_day)
    day, n = F.col("date"), F.col("sum_click")
    aggs = [
        F.sum(n).alias("vle_total_clicks"),
        F.avg(n).alias("vle_mean_clicks"),
        F.max(n).alias("vle_max_clicks"),
        F.coalesce(F.sum(F.when(day <= EARLY_DAY, n)), F.lit(0)).alias("vle_first4_clicks"),
        F.coalesce(F.sum(F.when(day >= -EARLY_DAY, n)), F.lit(0)).alias("vle_last4_clicks"),
        F.sum(n).alias("vle_cumulative_clicks"),
        F.count_distinct(day).alias("vle_days_active"),
    ]
    if course_length:
        late = day > F.col(course_length) - last_days
        aggs.append(F.coalesce(F.sum(F.when(late, n)), F.lit(0)).alias("vle_final_clicks"))
    return clicks.groupBy(*keys).agg(*aggs)


def click_features_ext(clicks: DataFrame, keys: list[str] = KEYS, *, cutoff_day: int | None = EARLY_DAY) -> DataFrame:
    """Clicks up to the cut-off with spread, span and distinct resources; missing spread is 0."""
    if cutoff_day is not None:
        clicks = early_window(clicks, cutoff_day)
    n = F.col("sum_click")
    return clicks.groupBy(*keys).agg(
        F.sum(n).alias("vle_total_clicks"),
        F.avg(n).alias("vle_mean_clicks"),
        F.coalesce(F.stddev_samp(n), F.lit(0.0)).alias("vle_std_clicks"),
        F.max(n).alias("vle_max_clicks"),
        F.min("date").alias("vle_first_access"),
        F.max("date").alias("vle_last_access"),
        F.count_distinct("date").alias("vle_days_active"),
        F.count_distinct("id_site").alias("vle_unique_resources"),
        (F.max("date") - F.min("date")).alias("vle_activity_duration"),
    )


def attach_deadlines(submissions: DataFrame, assessments: DataFrame) -> DataFrame:
    """Submissions with the deadline of their assessment; a missing deadline counts as late."""
    meta = assessments.withColumnRenamed("date", "deadline") if "date" in assessments.columns else assessments
    joined = join_dimension(submissions.drop("deadline"), meta, ["id_assessment"])
    return joined.withColumn("on_time", F.coalesce(F.col("date_submitted") <= F.col("deadline"), F.lit(False)).cast("int"))


def submission_features(subs: DataFrame, keys: list[str] = KEYS, tiebreak: list[str] | None = None, *, cutoff_day: int | None = None) -> DataFrame:
    """Count, mean, last score and on-time rate of submissions with their deadlines attached."""
    if cutoff_day is not None:
        subs = subs.where(F.col("date_submitted") <= cutoff_day)
    at = F.struct("date_submitted", *(tiebreak or ["id_assessment"]))
    return subs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("assessment_count"),
        F.avg("score").alias("assessment_mean_score"),
        F.max_by("score", at).alias("assessment_last_score"),
        F.avg("on_time").alias("assessment_ontime_rate"),
    )


def submission_features_ext(subs: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    s = F.col("score")
    return subs.groupBy(*keys).agg(
        F.count(s).alias("assessment_count"),
        F.avg(s).alias("assessment_mean_score"),
        F.max(s).alias("assessment_max_score"),
        F.min(s).alias("assessment_min_score"),
        F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("assessment_std_score"),
        F.min("date_submitted").alias("assessment_first_submit"),
        F.max("date_submitted").alias("assessment_last_submit"),
        F.sum("is_banked").alias("assessment_banked_count"),
        F.avg("on_time").alias("assessment_ontime_rate"),
    )


def assemble(base: DataFrame, parts: list[DataFrame], keys: list[str] = KEYS, fill_zero: bool = True) -> DataFrame:
    """Left-join feature tables that are already unique on the keys; features of absent rows are 0."""
    out = base
    for part in parts:
        new = [c for c in part.columns if c not in keys]
        out = out.join(part, keys, "left")
        if fill_zero:
            out = out.fillna(0, subset=new)
    return out


def drop_missing(df: DataFrame, subset: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all of ``subset`` present, and a one-row count of the rows left out."""
    absent = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in subset])
    return df.dropna(subset=subset), df.agg(F.count_if(absent).alias("dropped"), F.count(F.lit(1)).alias("total"))


def one_to_one_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails, when it runs, if either side repeats a key.

    Each side is one aggregate by key, whose shuffle the join reuses.
    """

    def once(side: str, df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        row = F.first(F.struct(*rest)) if rest else F.lit(None)
        got = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), row.alias("__row"))
        repeated = F.raise_error(F.lit(f"{side} side repeats {keys}")).cast(got.schema["__row"].dataType)
        got = got.withColumn("__row", F.when(F.col("__n") == 1, F.col("__row")).otherwise(repeated))
        return got.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])

    return once("left", left).join(once("right", right), keys)


def shared_keys(frames: list[DataFrame], defaults: list[str]) -> list[str]:
    return [k for k in defaults if all(k in f.columns for f in frames)]


def join_on_shared_keys(frames: list[DataFrame], defaults: list[str], value: str) -> DataFrame:
    """Join prediction tables on their shared keys.

    Rows that repeat a key are paired by their order of value inside the key, so a repeated key
    never multiplies rows. Values come out as ``value_0``, ``value_1``, ...
    """
    from edlens.operators.ordered import in_order

    keys = shared_keys(frames, defaults)
    if not keys:
        raise ValueError(f"no common keys among {defaults}")
    repeated = any(not f.groupBy(*keys).count().where(F.col("count") > 1).isEmpty() for f in frames)
    out, on = None, list(keys)
    for i, f in enumerate(frames):
        f = f.select(*keys, F.col(value).alias(f"{value}_{i}"))
        if repeated:
            f = in_order(f, keys, [f"{value}_{i}"], position="__nth")
        if out is None:
            out = f
            on = keys + (["__nth"] if repeated else [])
        else:
            out = out.join(f, on)
    return out.drop("__nth")


def lookup_with_default(df: DataFrame, dim: DataFrame, key: str, columns: list[str], default: float = 0.0) -> DataFrame:
    """Left lookup; columns the dimension lacks, and rows it does not know, get the default."""
    have = [c for c in columns if c in dim.columns]
    out = join_dimension(df, dim.select(key, *have), [key])
    return out.select(
        *[c for c in df.columns],
        *[(F.coalesce(F.col(c), F.lit(default)) if c in have else F.lit(default)).alias(c) for c in columns],
    )


def members(df: DataFrame, ids: DataFrame, keys: list[str], keep: bool = True) -> DataFrame:
    return df.join(ids.select(*keys), keys, "left_semi" if keep else "left_anti")


def before_after(pre: DataFrame, post: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Same table before and after a step, side by side with differences."""
    a = pre.select(*keys, *[F.col(m).alias(f"{m}_pre") for m in measures])
    b = post.select(*keys, *[F.col(m).alias(f"{m}_post") for m in measures])
    deltas = [(F.col(f"{m}_post") - F.col(f"{m}_pre")).alias(f"{m}_delta") for m in measures]
    return a.join(b, keys).select("*", *deltas)


def concept_means(df: DataFrame, concepts: dict[str, list[str]] = S.CONCEPTS) -> list[Column]:
    out = []
    for name, cols in concepts.items():
        present = [c for c in cols if c in df.columns]
        if present:
            out.append(S.row_mean(present).alias(name))
    return out
