"""Sinks for built datasets, metrics and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_dataset(df: DataFrame, folder: str, side: DataFrame | None = None, summary: DataFrame | None = None, partition_by: tuple[str, ...] = ("code_presentation",)) -> None:
    """Parquet main table partitioned by presentation, CSV side table, JSON summary.

    Rows are clustered by the partition columns with a hash salt on top, so one large presentation
    is written by several tasks and a small one does not scatter into many files.
    """
    cols = [c for c in partition_by if c in df.columns]
    out = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(16))).repartition(*cols, "__salt").drop("__salt") if cols else df
    out.write.mode("overwrite").partitionBy(*cols).parquet(f"{folder}/dataset.parquet")
    if side is not None:
        side.write.mode("overwrite").option("header", True).csv(f"{folder}/groups.csv")
    if summary is not None:
        summary.write.mode("overwrite").json(f"{folder}/summary.json")


def metrics_long(df: DataFrame, experiment: str, metrics: list[str], intervals: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Wide metric columns to experiment / metric / value / ci_lower / ci_upper rows."""
    rows = []
    for m in metrics:
        lo, hi = (intervals or {}).get(m, (None, None))
        rows.append(F.struct(
            F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"),
            (F.col(lo) if lo else F.lit(None)).cast("double").alias("ci_lower"), (F.col(hi) if hi else F.lit(None)).cast("double").alias("ci_upper"),
        ))
    return df.select(F.col(experiment).alias("experiment"), F.inline(F.array(*rows)))


def write_metrics_long(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_event_log(log: DataFrame, path: str) -> None:
    """Event log in standard names, files ordered by case and time."""
    log.repartitionByRange("`case:concept:name`", "`time:timestamp`").sortWithinPartitions(
        "`case:concept:name`", "`time:timestamp`"
    ).write.mode("overwrite").parquet(path)
