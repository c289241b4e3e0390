"""Student - resource graph as vertex and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edlens.operators.ordered import in_order, shuffled_position


def bipartite_edges(clicks: DataFrame, left: str = "id_student", right: str = "id_site") -> DataFrame:
    return clicks.groupBy(left, right).agg(F.sum("sum_click").alias("weight"), F.min("date").alias("time"))


def node_features(clicks: DataFrame, left: str = "id_student", right: str = "id_site") -> DataFrame:
    parts = [
        clicks.groupBy(F.col(c).cast("string").alias("node")).agg(F.sum("sum_click").alias("clicks")).select(F.lit(c).alias("kind"), "node", "clicks")
        for c in (left, right)
    ]
    return parts[0].unionByName(parts[1])


def node_index(df: DataFrame, node: str, **kw) -> DataFrame:
    """Contiguous 0-based ids: in value order for numbers, in a fixed shuffled order for text."""
    nodes = df.select(node).where(F.col(node).isNotNull()).distinct()
    if isinstance(df.schema[node].dataType, T.StringType):
        placed = shuffled_position(nodes, [], [node], "nodes").withColumnRenamed("__pos", "pos")
    else:
        placed = in_order(nodes, [], [node], position="pos", **kw)
    return placed.select(node, (F.col("pos") - 1).alias("idx"))
