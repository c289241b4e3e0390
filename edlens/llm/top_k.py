"""Exact top-k inner products by an impact-ordered index, read score at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edlens.llm import shared as S

#: Vectors of an index block, on average, and queries that meet it in one task at most.
BLOCK, QUERIES = 8192, 65536
#: Impact levels of the components in a block, and the cuts (as shares of the highest contribution) at which reading pauses.
LEVELS, PAUSES = 64, (0.5, 0.25, 0.125, 0.0625, 0.0)
#: Sums of whole numbers in 64-bit floats are exact below this.
EXACT = float(2**53)


class Index:
    """Postings of one block: for each component the rows by falling value, cut into segments of equal quantised impact.

    A positive weight reads a component's segments from the front, a negative one from the back; both ways the
    contribution to the score falls from segment to segment.
    """

    def __init__(self, values: np.ndarray):
        self.values = values  # rows x components, whole numbers
        by_component = np.ascontiguousarray(values.T.astype(np.float64))
        self.order = np.argsort(-by_component, axis=1, kind="stable").astype(np.intp)  # component x place
        self.sorted = np.take_along_axis(by_component, self.order, axis=1)
        self.top = float(np.abs(values.astype(np.float64)).max(initial=0))
        step = max(1.0, 2 * self.top / LEVELS)
        self.edges = np.arange(-LEVELS // 2 - 1, LEVELS // 2 + 2) * step
        self.places, self.gains = np.empty(self.order.size, np.intp), np.empty(self.order.size)  # used again by each search
        # Per component and edge e: rows of a value of at least e, and rows of a value above -e.
        shape = (len(self.sorted), len(self.edges))
        self.front = np.array([np.searchsorted(-x, -self.edges, side="right") for x in self.sorted], np.int64).reshape(shape)
        self.back = np.array([np.searchsorted(-x, self.edges, side="left") for x in self.sorted], np.int64).reshape(shape)

    def search(self, query: np.ndarray, wanted: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows proven to hold the ``wanted`` best of a score of at least ``floor``, and their exact scores.

        Segments are read by falling contribution. A row's bound is its contributions so far plus, for each
        component not yet met, the best of that component's next segment. Reading ends once the rows whose bound
        reaches the threshold hold fewer components than there are postings left; only those are scored from their values.
        """
        n, weights = len(self.values), query.astype(np.float64)
        live = np.flatnonzero(weights)
        if n <= 4 * wanted or not len(live) or np.abs(weights).sum() * self.top >= EXACT:
            return np.arange(n), scored(self.values, query)
        w = weights[live]
        ahead = w > 0
        best = np.where(ahead, self.sorted[live, 0], self.sorted[live, -1]) * w
        if best.sum() < floor:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        # A first threshold from the highest postings of the heaviest components.
        heavy = live[np.argsort(-np.abs(w))[:4]]
        some = np.unique(np.concatenate([self.order[d, : 2 * wanted] if weights[d] > 0 else self.order[d, -2 * wanted :] for d in heavy]))
        floor = max(floor, float(np.sort(scored(self.values[some], query))[-wanted]))
        heights = np.outer(np.abs(w), self.edges)
        for cut in (*(best.max() * p for p in PAUSES if best.max() > 0), -np.inf):
            edge = np.maximum((heights < cut).sum(axis=1) - 1, 0)  # the highest edge below the cut: whole segments
            at = np.where(ahead, self.front[live, edge], self.back[live, edge])
            unread = np.where(ahead, at, at - 1)
            rest = np.where((unread >= 0) & (unread < n), self.sorted[live, unread.clip(0, n - 1)] * w, 0.0)
            if rest.sum() >= floor and cut > -np.inf:
                continue  # even a row met nowhere would reach the threshold
            size = 0
            for d, x, i, r in zip(live.tolist(), w.tolist(), at.tolist(), rest.tolist()):
                read = slice(0, i) if x > 0 else slice(i, n)
                to = slice(size, size + read.stop - read.start)
                self.places[to] = self.order[d, read]
                np.multiply(self.sorted[d, read], x, out=self.gains[to])
                self.gains[to] -= r
                size = to.stop
            bound = rest.sum() + np.bincount(self.places[:size], weights=self.gains[:size], minlength=n)
            first = np.argpartition(-bound, wanted - 1)[:wanted]
            floor = max(floor, float(scored(self.values[first], query).min()))
            rows = np.flatnonzero(bound >= floor)
            if len(rows) * len(live) <= n * len(live) - size:
                break
        return rows, scored(self.values[rows], query)


def scored(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers."""
    x, y = values.astype(np.float64), query.astype(np.float64)
    if np.abs(x).max(initial=0) * np.abs(y).sum() < EXACT:
        return (x @ y).astype(np.int64)
    return (values.astype(object) @ query.astype(object)).astype(np.int64)  # a score of more than 64 bits is an OverflowError


def rectangle(lists: pa.Array, width: int, kind: type) -> np.ndarray:
    """A column of lists as rows of ``width`` numbers; shorter lists are filled up with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), kind)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def unpacked(data: pa.Array, width: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(data.to_pylist()), kind).reshape(len(data), width)


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """One row per different vector: ``cls``, ``vector``, its k + 1 smallest ``ids``."""
    by_id = Window.partitionBy("vector").orderBy(F.col("id").asc_nulls_last())
    few = rows.distinct().withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    grouped = few.groupBy("vector").agg(F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("void"), "id"))).alias("ids"))
    return S.written(grouped.select(F.monotonically_increasing_id().alias("cls"), "vector", "ids"), "top-classes")


def numbers(df: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """``id``, ``vector`` of whole numbers; without vectors that are null or hold null, NaN or infinity."""
    x = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    return x.select("id", F.transform("v", lambda c: F.floor(c * F.lit(float(scale)))).alias("vector"))


def top_k(vectors: DataFrame, queries: str, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each row that meets the SQL condition ``queries`` on ``id`` the k
    other rows of highest inner product, over components floor(scale * x); ties go to the smaller id.

    Equal vectors form one class with its k + 1 smallest ids, which no query can exhaust. Classes are dealt into
    blocks, each with an impact-ordered index. Every query class first reads the block of its own vector, which gives
    a threshold that the other blocks start from; each block returns all it cannot rule out. The rows a block returns
    are its k + 1 best at most, so the last ranking holds k + 1 rows per query and block.

    Vectors that are null or hold null or non-finite components take no part; shorter vectors count as
    filled up with zeros, an empty one scores 0. Repeated rows (equal id and vector) count once; rows that share an
    id but not the vector are different rows, and each query excludes itself alone. A null id is a candidate
    after all others among ties. With fewer candidates than k, all. Empty table: no rows. Scores
    beyond 64 bits raise an error. Other columns are ignored.
    """
    rows = numbers(vectors, id_col, vector, scale)
    classes = classes_of(rows, k)
    n, width, top = classes.agg(F.count("*"), F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", F.abs)))).first()
    width, kind = width or 0, np.int16 if (top or 0) < 2**15 else np.int64
    n_blocks = max(1, -(-n // BLOCK))
    asked = rows.where(queries).distinct()
    keyed = asked.select(F.col("vector").alias("qv")).distinct()
    joined = classes.join(keyed, F.col("vector") == F.col("qv"), "left")
    joined = joined.select("cls", F.pmod(F.xxhash64("vector"), F.lit(n_blocks)).cast("int").alias("block"), "ids", F.col("qv").isNotNull().alias("asks"), "vector")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = pa.array([x.tobytes() for x in rectangle(batch.column(4), width, kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], data], ["cls", "block", "ids", "asks", "data"])

    ids = classes.schema["ids"].dataType.simpleString()
    table = S.written(joined.mapInArrow(pack, f"cls bigint, block int, ids {ids}, asks boolean, data binary"), "top-vectors")
    table = table.withColumn("low", F.col("ids")[0])

    def looked_up(asks: DataFrame, label: str) -> DataFrame:
        """The best classes of each block for its queries: ``q``, ``cls``, ``score``, from ``block``, ``q``, ``data``, ``floor``."""
        busiest = asks.groupBy("block").count().agg(F.max("count")).first()[0] or 0
        parts = max(1, -(-busiest // QUERIES))
        nothing = F.lit(None).cast(table.schema["low"].dataType)
        points = table.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), F.col("cls").alias("name"), "data", F.lit(None).cast("bigint").alias("floor"), "low")
        asks = asks.select("block", F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("q").alias("name"), "data", "floor", nothing.alias("low"))
        both = points.union(asks).repartition(max(S.wide(table), min(n_blocks * parts, 1 << 15)), "block", "part").sortWithinPartitions("block", "part", "kind")

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A block's vectors come first; its index then answers the queries batch by batch."""
            held, index, of = [], None, None
            for batch in batches:
                block, part, kinds = (batch.column(i).to_numpy() for i in range(3))
                ends = np.flatnonzero(np.diff(block) | np.diff(part) | np.diff(kinds)) + 1
                for i, j in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows]):
                    if i == j:
                        continue
                    if of != (key := (block[i], part[i])):
                        held, index, of = [], None, key
                    if not kinds[i]:
                        held.append(batch.slice(i, j - i))
                        continue
                    if index is None and held:
                        vectors = pa.Table.from_batches(held)
                        cls, lows = vectors["name"].to_numpy(), vectors["low"].to_pylist()
                        place = np.empty(len(cls), np.int64)
                        place[sorted(range(len(cls)), key=lambda x: (lows[x]["void"], 0 if lows[x]["void"] else lows[x]["id"], cls[x]))] = np.arange(len(cls))
                        index, held = Index(unpacked(vectors["data"], width, kind)), []
                    asked = batch.slice(i, j - i)
                    q, at, scores = [], [], []
                    for name, query, floor in zip(asked.column(3).to_pylist(), unpacked(asked.column(4), width, kind), asked.column(5).to_pylist()):
                        rows, got = index.search(query, min(k + 1, len(cls)), -np.inf if floor is None else floor)
                        best = np.lexsort((place[rows], -got))[: k + 1]
                        q.append(np.full(len(best), name, np.int64))
                        at.append(cls[rows[best]])
                        scores.append(got[best])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (q, at, scores)], ["q", "cls", "score"])

        return S.written(both.mapInArrow(find, "q bigint, cls bigint, score bigint"), label)

    own = table.where("asks").select(F.col("cls").alias("q"), "block", "data")
    found = looked_up(own.select("block", "q", "data", F.lit(None).cast("bigint").alias("floor")), "top-home")
    if n_blocks > 1:
        # The k + 1 best of a block are a threshold that the k + 1 best of all blocks reach.
        floors = found.groupBy("q").agg(F.when(F.count("*") > k, F.min("score")).alias("floor"))
        others = own.join(floors, "q").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).where("other <> block")
        found = found.union(looked_up(others.select(F.col("other").alias("block"), "q", "data", "floor"), "top-others"))
    by_class = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("low.void"), F.col("low.id"), "cls")
    best = found.join(table.select("cls", "ids", "low"), "cls").withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= k + 1)
    row = F.explode(F.transform("ids", lambda x: F.struct((-F.col("score")).alias("less"), x["void"].alias("void"), x["id"].alias("id"), F.col("cls").alias("cls"))))
    by_row = Window.partitionBy("q").orderBy("x.less", "x.void", "x.id", "x.cls")
    listed = best.select("q", row.alias("x")).withColumn("r", F.row_number().over(by_row)).where(F.col("r") <= k + 1)
    lists = S.written(listed.groupBy("q").agg(F.array_sort(F.collect_list("x")).alias("list")), "top-lists")
    named = classes.select(F.col("cls").alias("q"), "vector")
    askers = asked.join(named.withColumnRenamed("vector", "nv"), F.col("vector") == F.col("nv")).select("q", "id")
    answers = askers.join(lists, "q")
    others = F.slice(F.filter("list", lambda x: ~((x["cls"] == F.col("q")) & x["id"].eqNullSafe(F.col("id")))), 1, k)
    out = answers.select(F.col("id").alias("query_id"), F.posexplode(others).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.less")).alias("score"))
