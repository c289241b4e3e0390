"""Preparation of feature tables: types, imputation, encoding, scaling, selection."""

from __future__ import annotations

import re

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edlens.functions.scalars import map_values
from edlens.operators.columns import bounds
from edlens.operators.features import join_dimension
from edlens.operators.ordered import in_order
from edlens.operators.quantiles import quantiles
from edlens.operators.sequences import first_per_key
from edlens.session import materialise


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value as text, n) for several columns from one pass, combined before the shuffle."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def detect_feature_types(df: DataFrame, cols: list[str], rule: str = "sequential", max_levels: int = 10, max_share: float = 0.05) -> DataFrame:
    """Kind of each column: numeric, categorical or ordinal.

    ``sequential``: few consecutive integers are ordinal. ``share``: few values, or few in relation
    to the rows, are categorical.
    """
    counts = value_counts(df, cols)
    v = F.col("value").try_cast("double")
    per = counts.groupBy("column").agg(
        F.count("value").alias("distinct"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.sum("n").alias("rows"),
        F.min(v).alias("lo"), F.max(v).alias("hi"), F.bool_and(v == F.floor(v)).alias("whole"))
    text = [f.name for f in df.select(*cols).schema if not isinstance(f.dataType, T.NumericType)]
    is_text = F.col("column").isin(text) if text else F.lit(False)
    few = F.col("distinct") <= max_levels
    if rule == "sequential":
        kind = F.when(is_text, "categorical").when(few & F.col("whole") & (F.col("hi") - F.col("lo") + 1 == F.col("distinct")), "ordinal").otherwise("numeric")
    else:
        kind = F.when(is_text | few | (F.col("distinct") < max_share * F.col("rows")), "categorical").otherwise("numeric")
    return per.select("column", kind.alias("kind"), "distinct", "missing")


def modes(df: DataFrame, cols: list[str]) -> DataFrame:
    counts = value_counts(df, cols).where(F.col("value").isNotNull())
    return counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"))


def impute(df: DataFrame, cols: list[str], strategy: str = "median", constant: object = 0) -> DataFrame:
    """Fill nulls with the mean, median or most frequent value of the column, or a constant."""
    if strategy == "constant":
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(constant)) for c in cols})
    if strategy == "mean":
        s = df.agg(F.struct(*[F.avg(c).alias(c) for c in cols]).alias("s")).scalar()
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), s[c]) for c in cols})
    if strategy == "median":
        long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "value")
        got = {r["column"]: r["m"] for r in quantiles(long, ["column"], "value", {"m": 0.5}).collect()}  # one row per column
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(got.get(c))) for c in cols})
    if strategy == "mode":
        got = {r["column"]: r["mode"] for r in modes(df, cols).collect()}  # one row per column
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(got.get(c)).cast(df.schema[c].dataType)) for c in cols})
    raise ValueError(f"unknown strategy {strategy}")


def vocabulary(df: DataFrame, c: str, order: str = "value") -> DataFrame:
    """Codes of a column: by sorted value, or by falling frequency."""
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("__n"))
    by = [c] if order == "value" else ["__neg", c]
    placed = in_order(counts.withColumn("__neg", -F.col("__n")), [], by, position="code")
    return placed.select(c, (F.col("code") - 1).alias("code"))


def encode_labels(df: DataFrame, fitted_on: DataFrame, c: str, order: str = "value") -> DataFrame:
    """Replace a column by its code in ``fitted_on``; unseen and null values share the next code."""
    codes = vocabulary(fitted_on, c, order)
    size = codes.agg(F.count(F.lit(1))).scalar()
    return join_dimension(df, codes, [c], unique=True).withColumn(c, F.coalesce(F.col("code"), size).cast("int")).select(*df.columns)


def encode_ordinal(c: str, levels: list, unknown: int = -1) -> Column:
    return map_values(c, {v: i for i, v in enumerate(levels)}, unknown)


def levels_of(df: DataFrame, c: str, limit: int = 1000) -> list:
    """Sorted distinct values, for one-hot columns; fails beyond ``limit`` columns."""
    got = df.select(c).where(F.col(c).isNotNull()).distinct().limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"{c} has more than {limit} values; reduce it with top_levels first")
    return sorted(r[0] for r in got)


def one_hot(df: DataFrame, c: str, levels: list, *, drop_first: bool = False, prefix: str | None = None) -> DataFrame:
    prefix = c if prefix is None else prefix
    names: dict = {}
    for v in levels:  # values that differ in other characters only get numbered names
        name = re.sub(r"\W+", "_", str(v)).strip("_")
        while name in names.values():
            name += "_2"
        names[v] = name
    flags = [F.coalesce((F.col(c) == F.lit(v)), F.lit(False)).cast("int").alias(f"{prefix}_{names[v]}") for v in levels[int(drop_first) :]]
    return df.select(*[x for x in df.columns if x != c], *flags)


def one_hot_vectors(df: DataFrame, fitted_on: DataFrame, c: str, out: str, *, drop_base: bool = False) -> DataFrame:
    """A sparse vector with a one at the value's code in ``fitted_on``, for any number of values.

    Codes fall with frequency and are joined, never collected. Null and unseen values give the zero vector; with
    ``drop_base`` so does the rarest value.
    """
    codes = materialise(vocabulary(fitted_on, c, "frequency").withColumnRenamed("code", "__code"))
    rest = codes.count() - int(drop_base)
    last = max(rest, 1)  # the code without a place in the vector
    coded = join_dimension(df, codes, [c], unique=True).withColumn("__code", F.when(F.col("__code") < rest, F.col("__code")).otherwise(last).cast("double"))
    every = df.sparkSession.range(last + 1).select(F.col("id").cast("double").alias("__code"))
    return OneHotEncoder(inputCols=["__code"], outputCols=[out], dropLast=True).fit(every).transform(coded).drop("__code")


def top_levels(df: DataFrame, c: str, n: int, other: str = "other") -> DataFrame:
    """Keep the n most frequent values, the rest becomes ``other``."""
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("__n"))
    kept = counts.orderBy(F.desc("__n"), c).limit(n).select(c, F.lit(True).alias("__kept"))
    out = df.join(F.broadcast(kept), c, "left")
    return out.withColumn(c, F.when(F.col("__kept") | F.col(c).isNull(), F.col(c)).otherwise(other)).select(*df.columns)


def demographics(users: DataFrame, key: str, number: str, categories: list[str], order: list[str]) -> DataFrame:
    """One row per user: a median-filled number and ``demog_<column>_<value>`` flags."""
    one = first_per_key(users.select(key, number, *categories, *[o for o in order if o not in (key, number, *categories)]), [key], order)
    one = impute(one, [number], "median").select(key, F.col(number).alias(f"demog_{number}"), *categories)
    for c in categories:
        one = one_hot(one, c, levels_of(one, c), prefix=f"demog_{c}")
    return one


def scale(df: DataFrame, cols: list[str], kind: str = "standard", fitted_on: DataFrame | None = None) -> DataFrame:
    """Standard (population std), robust (median and IQR) or min-max scaling; constant columns become 0."""
    base = fitted_on if fitted_on is not None else df
    if kind == "minmax":
        b = bounds(base, *cols)
        spec = {c: (b[f"{c}_lo"], b[f"{c}_hi"] - b[f"{c}_lo"]) for c in cols}
    elif kind == "standard":
        s = base.agg(F.struct(*[x for c in cols for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))]).alias("s")).scalar()
        spec = {c: (s[f"{c}_m"], s[f"{c}_s"]) for c in cols}
    elif kind == "robust":
        long = base.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "value")
        q = {r["column"]: r for r in quantiles(long, ["column"], "value", {"a": 0.25, "m": 0.5, "b": 0.75}).collect()}
        spec = {c: (F.lit(q[c]["m"]), F.lit(q[c]["b"] - q[c]["a"])) for c in cols}
    else:
        raise ValueError(f"unknown scaling {kind}")
    return df.withColumns({c: F.when(w == 0, F.col(c) - m).otherwise((F.col(c) - m) / w) for c, (m, w) in spec.items()})


def f_scores(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """One-way F statistic of each numeric feature against the label."""
    long = df.select(F.col(label).alias("__y"), *[F.col(c).cast("double").alias(c) for c in features]).unpivot("__y", features, "feature", "x").where(F.col("x").isNotNull())
    g = long.groupBy("feature", "__y").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    grand = g.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("k"))
    j = g.join(grand, "feature").groupBy("feature").agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), F.lit(2))).alias("ssb"), F.sum(F.col("n") * F.col("v")).alias("ssw"), F.first("rows").alias("rows"), F.first("k").alias("k"))
    f = (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("rows") - F.col("k")))
    return j.select("feature", f.alias("score"))


def select_k_best(df: DataFrame, features: list[str], label: str, k: int, by: str = "f") -> DataFrame:
    """The k features with the highest F statistic or mutual information (features binned by decile)."""
    if by == "f":
        scores = f_scores(df, features, label)
    else:
        from edlens.operators.profile import mutual_information, quantile_bin

        scores = mutual_information(quantile_bin(df, features), features, label).select("feature", F.col("mutual_information").alias("score"))
    return scores.orderBy(F.desc("score"), "feature").limit(k)


def interaction_choice(df: DataFrame, features: list[str], lo: float = 0.1, hi: float = 0.8) -> list[tuple[str, str]]:
    """Feature pairs whose absolute correlation lies strictly between the bounds."""
    from edlens.operators.profile import corr_matrix

    hit = corr_matrix(df, features).where((F.abs("corr") > lo) & (F.abs("corr") < hi))
    return [(r["a"], r["b"]) for r in hit.collect()]  # one row per column pair


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """Weight of the positive class: negatives / positives, at least 1."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(F.greatest(neg / F.greatest(pos, F.lit(1)), F.lit(1.0)).alias("pos_weight"), pos.alias("positives"), neg.alias("negatives"))
