"""Data checks as rows (check, level, item, value, passed); ``level`` is error or warning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edlens.contracts import columns_with_prefix, missing_columns
from edlens.operators.profile import WIDE_AGG, group_counts, numeric_columns

# Per canonical column the share of nulls allowed, the range and the default.
CANONICAL_RULES: dict[str, dict] = {
    "sex": {"allowed_missing": 0.05},
    "age_group": {"allowed_missing": 0.10},
    "ses_index": {"allowed_missing": 0.20, "default": 2.0},
    "family_support": {"allowed_missing": 0.30, "default": 2.0},
    "prior_performance": {"allowed_missing": 0.05, "range": (0.0, 1.0)},
    "study_load": {"allowed_missing": 0.10, "range": (0.0, 1.0)},
    "activity_level": {"allowed_missing": 0.25, "default": 0.5},
    "study_time": {"allowed_missing": 0.20, "default": 1.0},
}


def _row(check: str, level: str, item: str, value: Column, passed: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check"), F.lit(level).alias("level"), F.lit(item).alias("item"),
        value.cast("double").alias("value"), F.coalesce(passed, F.lit(False)).alias("passed"),
    )


def _rows(one: DataFrame, rows: list[Column]) -> DataFrame:
    return one.select(F.inline(F.array(*rows)))


def check_structure(df: DataFrame, needed: list[str]) -> DataFrame:
    gone = missing_columns(df, needed)
    one = df.limit(1).agg(F.count(F.lit(1)).alias("n"))
    rows = [_row("structure", "error", "not_empty", F.col("n"), F.col("n") > 0)]
    rows += [_row("structure", "error", c, F.lit(0 if c in gone else 1), F.lit(c not in gone)) for c in needed]
    return _rows(one, rows)


def check_identifiers(df: DataFrame, key: list[str]) -> DataFrame:
    """Null ids and duplicate keys; duplicates come from a count per key, not from one distinct set."""
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    absent = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    one = per.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum(F.when(absent, F.col("n"))), F.lit(0)).alias("nulls")
    )
    return _rows(one, [
        _row("identifiers", "error", "null_keys", F.col("nulls"), F.col("nulls") == 0),
        _row("identifiers", "error", "duplicate_keys", F.col("rows") - F.col("keys"), F.col("rows") == F.col("keys")),
        _row("identifiers", "info", "distinct_keys", F.col("keys"), F.lit(True)),
    ])


def check_labels(df: DataFrame, labels: list[str]) -> DataFrame:
    parts, rows = [], []
    for c in labels:
        parts += [F.count_if(F.col(c).isNull()).alias(f"n_{c}"), F.count_if(~F.col(c).isin(0, 1)).alias(f"o_{c}"), F.avg(c).alias(f"r_{c}")]
        rows += [
            _row("labels", "error", f"{c}_null", F.col(f"n_{c}"), F.col(f"n_{c}") == 0),
            _row("labels", "error", f"{c}_not_binary", F.col(f"o_{c}"), F.col(f"o_{c}") == 0),
            _row("labels", "warning", f"{c}_rate", F.col(f"r_{c}"), F.col(f"r_{c}").between(0.1, 0.9)),
        ]
    return _rows(df.agg(*parts), rows)


def check_features(df: DataFrame, cols: list[str] | None = None, max_missing: float = 0.8, prefixes: tuple[str, ...] = ("vle_", "assessment_")) -> DataFrame:
    """Infinite values and columns that are mostly missing, in slices of bounded width."""
    cols = cols or numeric_columns(df)
    out = None
    for at in range(0, len(cols), WIDE_AGG // 2):
        parts, rows = [F.count(F.lit(1)).alias("__rows")], []
        for c in cols[at : at + WIDE_AGG // 2]:
            x = F.col(c).cast("double")
            parts += [F.count_if(x.isin(float("inf"), float("-inf"))).alias(f"i_{c}"), F.count_if(x.isNull() | F.isnan(x)).alias(f"m_{c}")]
            share = F.col(f"m_{c}") / F.nullif(F.col("__rows"), F.lit(0))
            rows += [
                _row("features", "error", f"{c}_infinite", F.col(f"i_{c}"), F.col(f"i_{c}") == 0),
                _row("features", "warning", f"{c}_missing", share, share <= max_missing),
            ]
        piece = _rows(df.agg(*parts), rows)
        out = piece if out is None else out.unionByName(piece)
    counts = [_row("features", "warning", f"{p}columns", F.lit(len(columns_with_prefix(df, p))), F.lit(bool(columns_with_prefix(df, p)))) for p in prefixes]
    return out.unionByName(_rows(df.sparkSession.range(1), counts)) if counts else out


def check_sensitive(df: DataFrame, attributes: list[str], max_missing: float = 0.3, min_group: int = 30) -> DataFrame:
    """Missing share and smallest group per attribute."""
    total = df.agg(F.count(F.lit(1))).scalar()
    per = group_counts(df, attributes).groupBy("attribute").agg(F.max("missing").alias("missing"), F.min("n").alias("smallest"))
    share = F.col("missing") / total
    cell = lambda item, value, passed: F.struct(
        F.lit("sensitive").alias("check"), F.lit("warning").alias("level"), F.concat(F.col("attribute"), F.lit(item)).alias("item"),
        value.cast("double").alias("value"), passed.alias("passed"))
    return per.select(F.inline(F.array(cell("_missing", share, share <= max_missing), cell("_smallest_group", F.col("smallest"), F.col("smallest") >= min_group))))


def validation_report(*checks: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)


def verdict(report: DataFrame) -> DataFrame:
    failed = lambda level: F.count_if((F.col("level") == level) & ~F.col("passed"))
    return report.agg(failed("error").alias("errors"), failed("warning").alias("warnings"), (failed("error") == 0).alias("passed"))


def check_canonical(df: DataFrame, rules: dict[str, dict] = CANONICAL_RULES) -> DataFrame:
    parts, rows = [F.count(F.lit(1)).alias("__rows")], []
    for c, rule in rules.items():
        if c not in df.columns:
            continue
        parts.append(F.count_if(F.col(c).isNull()).alias(f"m_{c}"))
        share = F.col(f"m_{c}") / F.nullif(F.col("__rows"), F.lit(0))
        rows.append(_row("canonical", "warning", f"{c}_missing", share, share <= rule["allowed_missing"]))
        if "range" in rule:
            parts.append(F.count_if(~F.col(c).between(*rule["range"])).alias(f"r_{c}"))
            rows.append(_row("canonical", "error", f"{c}_out_of_range", F.col(f"r_{c}"), F.col(f"r_{c}") == 0))
    return _rows(df.agg(*parts), rows)


def fill_canonical(df: DataFrame, rules: dict[str, dict] = CANONICAL_RULES) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(r["default"])) for c, r in rules.items() if c in df.columns and "default" in r})
