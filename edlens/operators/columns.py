"""Whole-table column operators: scalings that need global statistics, inference of names and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edlens.functions import scalars as S
from edlens.operators.ordered import in_order

# Alternative names of the event-log columns, and accepted timestamp formats.
EVENT_NAMES = {
    "case_id": ["student_id", "session_id", "user_id", "id", "case"],
    "activity": ["action", "event", "activity_name", "task"],
    "timestamp": ["time", "datetime", "date", "created_at"],
}
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss"]
# Columns that point to one or the other kind of data set.
KIND_COLUMNS = {
    "oulad": [
        "vle_total_clicks", "vle_days_active", "assessment_mean_score", "vle_first4_clicks", "vle_last4_clicks", "assessment_count",
    ],
    "uci": [
        "studytime", "Dalc", "Walc", "famrel", "freetime", "goout", "health", "Medu", "Fedu", "school", "sex", "age",
    ],
}


def bounds(df: DataFrame, *cols: str) -> Column:
    """Scalar struct ``<col>_lo`` / ``<col>_hi``, computed once and used as a literal by the plan."""
    parts = [x for c in cols for x in (F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"))]
    return df.agg(F.struct(*parts).alias("b")).scalar()


def cut_equal_width(df: DataFrame, cols: list[str], k: int = 3) -> DataFrame:
    b = bounds(df, *cols)
    return df.select("*", *[S.equal_width_bin(c, b[f"{c}_lo"], b[f"{c}_hi"], k).alias(f"{c}_bin") for c in cols])


def minmax_scale(df: DataFrame, cols: list[str], inverted: tuple[str, ...] = ()) -> DataFrame:
    b = bounds(df, *cols, *inverted)
    return df.select(
        "*",
        *[S.minmax(c, b[f"{c}_lo"], b[f"{c}_hi"]).alias(f"{c}_scaled") for c in cols],
        *[S.inverted(c, b[f"{c}_hi"]).alias(f"{c}_inverted") for c in inverted],
    )


def engagement_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """Clipped intensity per column, row consistency, slope across the row and late / early ratio."""
    spread = df.agg(F.struct(*[F.stddev_pop(c).alias(c) for c in cols]).alias("s")).scalar()
    n, third = len(cols), max(1, len(cols) // 3)
    mean = sum((F.col(c) for c in cols[1:]), F.col(cols[0])) / n
    row_std = F.sqrt(sum((F.pow(F.col(c) - mean, F.lit(2)) for c in cols[1:]), F.pow(F.col(cols[0]) - mean, F.lit(2))) / (n - 1))
    early, late = S.row_mean(cols[:third]), S.row_mean(cols[-third:])
    return df.select(
        "*",
        *[S.clip(F.col(c) / (spread[c] + 1e-8), -3.0, 3.0).alias(f"{c}_intensity") for c in cols],
        S.clip(1 / (row_std + 1e-8), 0.0, 10.0).alias("engagement_consistency"),
        S.row_slope(cols).alias("performance_trend"),
        S.clip(late / (early + 1e-8), 0.0, 10.0).alias("early_late_engagement_ratio"),
    )


def frequency_codes(df: DataFrame, c: str) -> DataFrame:
    """Value table with 0 for the most frequent value; ties by value, null last."""
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    placed = in_order(counts.withColumn("__neg", -F.col("n")), [], ["__neg", c], position="code")
    return placed.select(c, "n", (F.col("code") - 1).alias("code"))


def transfer_indices(df: DataFrame, attendance: str, ses: str, internet: str, age: str, squares: list[str]) -> DataFrame:
    """Engagement x status index, digital access score, and squares of the leading columns."""
    return df.select(
        "*",
        (F.col(attendance) * (1 + F.col(ses))).alias("engagement_ses_index"),
        (F.col(internet) * (1 + 1 / (1 + F.col(age)))).alias("digital_access_score"),
        *[(F.col(c) * F.col(c)).alias(f"{c}_squared") for c in squares[:3]],
    )


def infer_columns(df: DataFrame, names: dict[str, list[str]] = EVENT_NAMES) -> DataFrame:
    """Fill missing target columns from the first alternative name that is present."""
    for target, options in names.items():
        if target not in df.columns:
            found = next((o for o in options if o in df.columns), None)
            if found:
                df = df.withColumn(target, F.col(found))
    return df


def parse_timestamp(c: str | Column, formats: list[str] = TIME_FORMATS) -> Column:
    """First format that reads the text; null when none does (no time is invented)."""
    x = S.col(c).cast("string")
    return F.coalesce(x.try_cast("timestamp"), *[F.try_to_timestamp(x, F.lit(f)) for f in formats])


def dataset_kind(columns: list[str]) -> str:
    hits = {kind: len(set(cols) & set(columns)) for kind, cols in KIND_COLUMNS.items()}
    best = max(hits, key=hits.get)
    return best if hits[best] and list(hits.values()).count(hits[best]) == 1 else "generic"


def mooc_labels(df: DataFrame) -> DataFrame:
    """Engagement score, pass / certificate / completion labels and daily video time."""
    top = df.agg(F.struct(*[F.max(c).alias(c) for c in ("assignments_submitted", "forum_posts", "days_active")]).alias("m")).scalar()
    score = (
        F.col("video_completion_rate") * 0.3
        + F.col("assignments_submitted") / top["assignments_submitted"] * 0.3
        + F.col("forum_posts") / top["forum_posts"] * 0.2
        + F.col("days_active") / top["days_active"] * 0.2
    )
    df = df.withColumn("engagement_score", score)
    return df.select(
        "*",
        (F.col("final_score") >= 60).cast("int").alias("label_pass"),
        (F.col("final_score") >= 80).cast("int").alias("label_certificate"),
        ((F.col("video_completion_rate") >= 0.8) & (F.col("assignments_submitted") >= 6)).cast("int").alias("label_complete"),
        (F.col("total_video_time") / (F.col("days_active") + 1)).alias("engagement_intensity"),
    )


def custom_groups(df: DataFrame, rules: dict[str, dict[str, str]]) -> DataFrame:
    """Named groups from SQL predicates; the first matching rule of an attribute wins."""
    out = []
    for name, cases in rules.items():
        c = None
        for label, predicate in cases.items():
            c = F.when(F.expr(predicate), label) if c is None else c.when(F.expr(predicate), label)
        out.append(c.alias(name))
    return df.select("*", *out)


# Advice shown to students at and below the risk cut.
SUPPORT = ["Schedule time with a tutor", "Join a study group", "Review class materials twice a week"]
ENRICHMENT = ["Keep up the good work!", "Explore enrichment activities"]


def recommend(df: DataFrame, risk: str, support: list[str] = SUPPORT, enrichment: list[str] = ENRICHMENT) -> DataFrame:
    lists = F.when(F.col(risk) > 0.5, F.array(*map(F.lit, support))).otherwise(F.array(*map(F.lit, enrichment)))
    return df.select("*", F.explode(lists).alias("recommendation"))
