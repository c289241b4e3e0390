"""Deterministic, leakage-safe split and fold assignment.

Draws come from key hashes, so a split depends on the ids and the seed only. Positions inside a
stratum come from ``shuffled_position``, which spreads even a two-value stratum over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edlens.functions.hashing import key_unit
from edlens.operators.ordered import in_order, shuffled_position, null_safe_join
from edlens.operators.sequences import first_per_key



def check_leakage(assigned: DataFrame, key: str, splits: list[str], split: str = "split") -> DataFrame:
    """Number of ids shared by each pair of splits."""
    flags = assigned.groupBy(key).agg(*[F.max((F.col(split) == s).cast("int")).alias(f"in_{i}") for i, s in enumerate(splits)])
    pairs = list(combinations(range(len(splits)), 2))
    counts = flags.agg(*[F.count_if((F.col(f"in_{a}") == 1) & (F.col(f"in_{b}") == 1)).alias(f"c{n}") for n, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(splits[a]).alias("a"), F.lit(splits[b]).alias("b"), F.col(f"c{n}").alias("overlap")) for n, (a, b) in enumerate(pairs)]
    return counts.select(F.inline(F.array(*rows)))


def resolve_overlap(assigned: DataFrame, key: str, on_overlap: str = "report") -> DataFrame:
    """``report`` keeps rows as they are; ``train_excludes_test`` drops training rows of ids seen in val or test."""
    if on_overlap == "report":
        return assigned
    if on_overlap != "train_excludes_test":
        raise ValueError(f"unknown on_overlap {on_overlap}")
    held = assigned.where("split <> 'train'").select(key).distinct()
    return assigned.where("split = 'train'").join(held, key, "left_anti").unionByName(assigned.where("split <> 'train'"))


def chronological_split(df: DataFrame, period: str, key: str = "id_student", on_overlap: str = "report") -> DataFrame:
    """Last period is test, the one before it validation, earlier ones training; fewer than three: all training.

    Rows without a period belong to no late one: they are training rows.
    """
    order = df.select(period).where(F.col(period).isNotNull()).distinct()
    order = order.select(period, F.row_number().over(Window.orderBy(F.desc(period))).alias("__back"))
    n = order.agg(F.count(F.lit(1))).scalar()
    name = F.when(n < 3, "train").when(F.col("__back") == 1, "test").when(F.col("__back") == 2, "val").otherwise("train")
    placed = df.join(order.select(period, name.alias("split")), period, "left").withColumn("split", F.coalesce("split", F.lit("train")))
    return resolve_overlap(placed, key, on_overlap)


def by_share(pos: str | Column, size: str | Column, shares: list[tuple[str, float]]) -> Column:
    """Name of the share a position falls in; the last name takes the rest."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    size = F.col(size) if isinstance(size, str) else size
    out, upto = None, 0.0
    for name, share in shares[:-1]:
        upto += share
        hit = pos <= F.round(size * F.lit(round(upto, 12)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(shares[-1][0])


def stratified_random_split(
    df: DataFrame, key: str = "id_student", strata: list[str] | None = None, *, test: float = 0.1, val: float = 0.1, seed: int = 42,
    order: list[str] | None = None,
) -> DataFrame:
    """One row per id with its split, exact shares inside every stratum; no strata gives a plain random split."""
    strata = strata or []
    one = first_per_key(df.select(key, *{*strata, *(order or [])}), [key], order or strata or [key]) if strata or order else df.select(key).distinct()
    placed = shuffled_position(one, strata, [key], seed)
    return placed.select(key, *strata, by_share("__pos", "__size", [("test", test), ("val", val), ("train", 0.0)]).alias("split"))


def holdout_split(df: DataFrame, column: str, key: str = "id_student", strata: list[str] | None = None, *, val: float = 0.2, seed: int = 42) -> DataFrame:
    """Serve every value of ``column`` as a held-out test set from one assignment.

    Each row gets ``train`` or ``val`` with the share taken inside (column, stratum); whichever value
    is held out, the rest is then stratified as asked, and no row is copied per value.
    """
    placed = shuffled_position(df, [column, *(strata or [])], [key], seed)
    return placed.withColumn("split", by_share("__pos", "__size", [("val", val), ("train", 0.0)])).drop("__pos", "__size")


def hold_out(assigned: DataFrame, column: str, value: object) -> DataFrame:
    return assigned.withColumn("split", F.when(F.col(column) == F.lit(value), "test").otherwise(F.col("split")))


def holdout_sizes(assigned: DataFrame, column: str) -> DataFrame:
    """Split sizes for each held-out value."""
    per = assigned.groupBy(column).agg(
        F.count(F.lit(1)).alias("test"), F.count_if(F.col("split") == "train").alias("t"), F.count_if(F.col("split") == "val").alias("v")
    )
    total = per.agg(F.struct(F.sum("t").alias("t"), F.sum("v").alias("v"))).scalar()
    return per.select(column, (total["t"] - F.col("t")).alias("train"), (total["v"] - F.col("v")).alias("val"), "test")


def group_key(df: DataFrame, kind: str = "module_presentation") -> Column:
    if kind == "module_presentation":
        return F.concat_ws("_", "code_module", "code_presentation")
    if kind == "module":
        return F.col("code_module")
    if kind == "presentation":
        return F.col("code_presentation")
    raise ValueError(f"unknown group kind {kind}")


def deal(loads: list[int], size: int, m: int) -> list[int]:
    """Loads after ``m`` groups of ``size`` rows went one by one into the lightest fold (the first of several)."""
    low, high = 0, m
    while low < high:  # rounds for the lightest fold: the most that m groups allow
        mid = (low + high + 1) // 2
        level = min(loads) + mid * size
        low, high = (mid, high) if sum(max(0, -(-(level - x) // size)) for x in loads) <= m else (low, mid - 1)
    level = min(loads) + low * size
    out = [x + max(0, -(-(level - x) // size)) * size for x in loads]
    for _ in range(m - (sum(out) - sum(loads)) // size):  # fewer than one for each fold
        at = out.index(min(out))
        out[at] += size
    return out


def fold_of(loads: list[int], size: int, j: int) -> int:
    """Fold of the group that comes ``j``-th (from 0) among those of its size, which find the folds at ``loads``."""
    now = deal(loads, size, j)
    return now.index(min(now))


def group_kfold(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Fold per group, balanced by size: groups go by falling size (then by name) into the lightest fold so far.

    The deal runs over one row per different size, of which n rows have at most sqrt(2 n); groups of one size fill
    the folds in closed form, and each finds its fold from the loads its size met. A null group is a group.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    ranked = in_order(sizes, ["n"], [group], position="__p")
    met, loads = [], [0] * k
    for r in sizes.groupBy("n").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("n")).collect():  # one row per different size
        met.append((r["n"], loads))
        loads = deal(loads, r["n"], r["m"])
    known = df.sparkSession.createDataFrame(met, "n long, loads array<long>")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fold = [fold_of(list(x), int(n), int(p) - 1) for x, n, p in zip(pdf["loads"], pdf["n"], pdf["__p"])]
            yield pdf[[group]].assign(fold=fold)

    kind = df.schema[group].dataType.simpleString()
    folds = ranked.join(known, "n").select(group, "n", "__p", "loads").mapInPandas(find, f"`{group}` {kind}, fold int")
    return null_safe_join(df, folds, [group])


def stratified_kfold(df: DataFrame, key: list[str], strata: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """k folds with equal label shares."""
    placed = shuffled_position(df, strata, key, seed)
    return placed.withColumn("fold", ((F.col("__pos") - 1) % k).cast("int")).drop("__pos", "__size")


def fold_report(folds: DataFrame, key: str, label: str) -> DataFrame:
    """Sizes and positive rates of both sides of each fold, and ids that sit on both sides."""
    both = folds.groupBy(key).agg(F.min("fold").alias("lo"), F.max("fold").alias("hi"))
    shared = both.agg(F.count_if(F.col("lo") != F.col("hi"))).scalar()
    per = folds.groupBy("fold").agg(F.count(F.lit(1)).alias("val_size"), F.sum(label).alias("pos"))
    total = per.agg(F.struct(F.sum("val_size").alias("n"), F.sum("pos").alias("p"))).scalar()
    train = total["n"] - F.col("val_size")
    return per.select(
        "fold", "val_size", train.alias("train_size"), (F.col("pos") / F.col("val_size")).alias("val_positive_rate"),
        ((total["p"] - F.col("pos")) / train).alias("train_positive_rate"), shared.alias("ids_in_several_folds"),
    )


def sequence_split(df: DataFrame, keys: list[str], val: float = 0.1, seed: int = 42) -> DataFrame:
    """Random share of groups as validation; every row of a group gets the same side."""
    return df.withColumn("split", F.when(key_unit(keys, seed) < val, "val").otherwise("train"))
