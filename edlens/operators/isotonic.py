"""Isotonic regression: adjacent violators are pooled inside ranges of scores, then across their cuts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edlens.operators.ordered import in_order, null_safe_join
from edlens.session import materialise

#: Blocks that one task pools.
RANGE = 4096


def pool(blocks: pd.DataFrame) -> pd.DataFrame:
    """Adjacent blocks merged until their means rise; ``lo``, ``hi``, ``s`` (weighted sum), ``w``, sorted by ``lo``."""
    lo, hi, s, w = [], [], [], []
    for a, b, x, n in zip(*(blocks.sort_values("lo")[c].tolist() for c in ("lo", "hi", "s", "w"))):
        while s and s[-1] * n > x * w[-1]:
            a, x, n = lo.pop(), x + s.pop(), n + w.pop()
            hi.pop()
        lo.append(a)
        hi.append(b)
        s.append(x)
        w.append(n)
    return pd.DataFrame({"lo": lo, "hi": hi, "s": s, "w": w}, dtype=float)


def fit(df: DataFrame, y: str = "y", p: str = "p", weight: str | None = None, block_rows: int = RANGE) -> DataFrame:
    """The blocks of the least-squares fit that rises with ``p``: ``block`` (from 1), ``lo``, ``hi``, ``value``, ``weight``.

    Rows are summed per distinct score. Each pass pools in ranges of ``block_rows`` blocks; between two passes the cuts
    move by half a range, so what violates across a cut lies inside a range next time. Blocks only merge, and when no
    neighbour violates any more they are the fit of all rows. Rows without score or label take no part; no rows, no blocks.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    blocks = rows.groupBy(F.col(p).cast("double").alias("lo")).agg(F.sum(F.col(y).cast("double") * w).alias("s"), F.sum(w).alias("w")).where("w > 0").select("lo", F.col("lo").alias("hi"), "s", "w")
    shift = 0
    while True:
        placed = in_order(blocks, [], ["lo"], position="at").withColumn("part", F.expr(f"(at - 1 + {shift}) div {block_rows}"))
        blocks = materialise(placed.groupBy("part").applyInPandas(pool, "lo double, hi double, s double, w double"))
        ordered = in_order(blocks, [], ["lo"], position="block", previous={"ps": "s", "pw": "w"})
        if not ordered.where("ps * w > s * pw").take(1):
            return ordered.select("block", "lo", "hi", (F.col("s") / F.col("w")).alias("value"), F.col("w").alias("weight"))
        shift = block_rows // 2 - shift


def predict(df: DataFrame, blocks: DataFrame, p: str = "p", out: str = "calibrated") -> DataFrame:
    """``df`` with the fitted value: constant on a block, linear between two, the ends' values outside; null without a score.

    Distinct scores are merged with the blocks' beginnings in order, so each knows its block; nothing is broadcast by hand.
    """
    x = F.col(p).cast("double")
    asked = df.where(x.isNotNull()).select(x.alias("x")).distinct().select("x", F.lit(1).alias("kind"), F.lit(0).alias("starts"))
    starts = blocks.select(F.col("lo").alias("x"), F.lit(0).alias("kind"), F.lit(1).alias("starts"))
    found = in_order(starts.union(asked), [], ["x", "kind"], running={"block": "starts"}).where("kind = 1")
    found = found.select("x", F.greatest("block", F.lit(1)).cast("bigint").alias("block"))
    nxt = blocks.select((F.col("block") - 1).alias("block"), F.col("lo").alias("next_lo"), F.col("value").alias("next_value"))
    ends = blocks.select("block", "hi", "value").join(nxt, "block", "left")
    share = F.least((F.col("x") - F.col("hi")) / (F.col("next_lo") - F.col("hi")), F.lit(1.0))
    between = F.when((F.col("x") > F.col("hi")) & F.col("next_lo").isNotNull(), F.col("value") + share * (F.col("next_value") - F.col("value"))).otherwise(F.col("value"))
    values = found.join(ends, "block").select(F.col("x").alias("__x"), between.alias(out))
    return null_safe_join(df.withColumn("__x", x), values, ["__x"], "left").drop("__x")
