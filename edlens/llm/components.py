"""Connected components of an edge table by alternating star contractions, all in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edlens.llm.shared import forget, written

#: Edges that one task joins up by itself; more of them go through rounds of shuffles.
ONE_TASK = 200_000


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) of the undirected edges ``u``, ``v``.

    A large star ties each larger neighbour to the smallest one, a small star each smaller
    neighbour; both keep connectivity and end in stars, after a number of rounds that grows with
    the logarithm of the nodes. Minima are combined before the shuffle, each round is a written
    table, and only two sums per round reach the driver. Up to ONE_TASK edges need no rounds: one
    task joins them up. Loops and null ends are ignored.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")
    if now.count() <= ONE_TASK:
        old, now = now, written(now.coalesce(1).mapInArrow(forest, now.schema), "links")
        forget(old)
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    last = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        old, now = now, written(small, "links")
        forget(old)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of the edges with the smallest one it reaches; those that are the smallest themselves are left out."""
    above: dict = {}

    def top(x):
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(u), top(v)
            above[max(a, b)] = min(a, b)
    if kind is not None:
        ends = [(x, y) for x in list(above) if (y := top(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in ends], kind.field(i).type) for i in (0, 1)], schema=kind)
