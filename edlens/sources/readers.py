"""Readers for the course tables, grade files and result files."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edlens.contracts import COURSE_TABLES, OPTIONAL_TABLES

log = logging.getLogger(__name__)


def read_any(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ",") -> DataFrame:
    """Read by suffix: parquet or csv."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if suffix == "parquet":
        return reader.parquet(path)
    if suffix == "csv":
        return reader.csv(path, header=True, sep=sep, inferSchema=schema is None, enforceSchema=False)
    raise ValueError(f"cannot read {path}: expected .parquet or .csv")


def read_table_set(
    spark: SparkSession, folder: str, contracts: dict[str, T.StructType] = COURSE_TABLES, *, suffix: str = "csv", strict: bool = False
) -> dict[str, DataFrame]:
    """The relational tables of a folder; a missing optional table (any, unless strict) is logged and skipped."""
    out = {}
    for name, contract in contracts.items():
        path = f"{folder.rstrip('/')}/{name}.{suffix}"
        try:
            out[name] = read_any(spark, path, contract if suffix == "csv" else None)
        except AnalysisException as e:
            if strict and name not in OPTIONAL_TABLES:
                raise FileNotFoundError(path) from e
            log.warning("table %s not found, skipped", path)
    return out


def read_grades(spark: SparkSession, path: str, *, task: str = "classification", pass_threshold: int = 10, sep: str = ",") -> DataFrame:
    """Features with ``target``: a pass label or the raw final grade."""
    df = read_any(spark, path, sep=sep)
    if task == "classification":
        target = (F.col("G3") >= pass_threshold).cast("int")
    elif task == "regression":
        target = F.col("G3")
    else:
        raise ValueError(f"unknown task {task}")
    return df.withColumn("target", target).drop("G3")


def read_early(spark: SparkSession, path: str, *, upto_grade: int = 1, pass_threshold: int = 10, sep: str = ",") -> DataFrame:
    """Same with later grades removed: only grades up to ``upto_grade`` stay."""
    later = [g for i, g in ((2, "G2"),) if i > upto_grade]
    return read_grades(spark, path, pass_threshold=pass_threshold, sep=sep).drop(*later)


def drop_leaky(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def read_first_existing(spark: SparkSession, paths: list[str]) -> DataFrame:
    for path in paths:
        try:
            return read_any(spark, path)
        except AnalysisException:
            continue
    raise FileNotFoundError(f"none of {paths}")


class DatasetRegistry:
    """Loaders by dataset name, with a label filled in from other columns where it is missing."""

    def __init__(self) -> None:
        self.loaders: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def register(self, name: str, loader: Callable[[SparkSession], DataFrame]) -> None:
        self.loaders[name] = loader

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.loaders:
            raise KeyError(f"unknown dataset {name}; known: {sorted(self.loaders)}")
        return with_label(self.loaders[name](spark))


def with_label(df: DataFrame) -> DataFrame:
    """Backfill ``label_pass`` from the result, the final grade or the final score."""
    if "label_pass" in df.columns:
        return df
    if "final_result" in df.columns:
        return df.withColumn("label_pass", F.col("final_result").isin("Pass", "Distinction").cast("int"))
    if "G3" in df.columns:
        return df.withColumn("label_pass", (F.col("G3") >= 10).cast("int"))
    if "final_score" in df.columns:
        return df.withColumn("label_pass", (F.col("final_score") >= 60).cast("int"))
    return df


def collect_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Result CSVs of many runs as one table with the file each row came from."""
    out = None
    for path in paths:
        df = spark.read.csv(path, header=True, inferSchema=True)
        df = df.select("*", F.col("_metadata.file_path").alias("result_file"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def table_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns per table and in total."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows", F.lit(len(df.columns)).alias("columns")) for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    total = out.agg(F.sum("rows").alias("rows"), F.sum("columns").cast("int").alias("columns"))
    return out.unionByName(total.select(F.lit("total").alias("table"), "rows", "columns"))


def dataset_info(df: DataFrame, label: str | None = None) -> DataFrame:
    """Shape, types, nulls and label shares as (item, name, text, n) rows, from one pass over the data."""
    aggs = [F.count(F.lit(1)).alias("__rows")] + [F.count_if(F.col(c).isNull()).alias(f"__null_{c}") for c in df.columns]
    one = df.agg(*aggs)
    row = lambda item, name, text, n: F.struct(
        F.lit(item).alias("item"), F.lit(name).alias("name"), F.lit(text).alias("text"), n.cast("bigint").alias("n"))
    rows = [row("rows", None, None, F.col("__rows")), row("columns", None, None, F.lit(len(df.columns)))]
    rows += [row("nulls", c, kind, F.col(f"__null_{c}")) for c, kind in df.dtypes]
    out = one.select(F.inline(F.array(*rows)))
    if label:
        shares = df.groupBy(F.col(label).cast("string").alias("text")).agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(shares.select(F.lit("label").alias("item"), F.lit(label).alias("name"), "text", "n"))
    return out
