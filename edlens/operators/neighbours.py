"""Exact k-nearest-neighbour join and what rests on it.

Reference vectors are placed in cells of a two-level pivot index whose size grows with the square root of their number. A
first pass finds each query's exact k-th distance inside its nearest cells; a second visits only the cells that the
triangle inequality cannot place beyond it. Neighbouring cells are packed into bins of bounded size, larger ones cut; a query is sent once to each bin
with a cell to visit, in lots of bounded size, and equal vectors count once, so neither a dense region nor a vector in a third
of all rows ends up in one task, and what a task holds does not grow with the tables. Distances are Euclidean;
rows whose vector is null or holds null or NaN take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edlens.functions.hashing import digest_unit, key_digest, key_unit
from edlens.operators.ordered import null_safe_join, shuffled_position
from edlens.session import fan_out, materialise

#: Least and most vectors in a bin and in a lot of queries that meet there; between them an eighth of the vectors.
SHARD_ROWS = (4096, 16_384)
#: Numbers in the blocks of one step (16 MB), pairs in those of a matrix product (1 MB).
BLOCK_VALUES, BLOCK_PAIRS = 2_000_000, 131_072


def _vectors(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in s])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between two small sets, by differences (no cancellation)."""
    out = np.empty((len(a), len(b)))
    rows = max(1, BLOCK_VALUES // max(1, b.size))
    for i in range(0, len(a), rows):
        d = a[i : i + rows, None, :] - b[None, :, :]
        out[i : i + rows] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def _first(i: np.ndarray, d: np.ndarray, low: np.ndarray, k: int) -> np.ndarray:
    """Which pairs are among the k first of their query ``i``, by distance and ``low``; in that order."""
    order = np.lexsort((low, d, i))
    i = i[order]
    begins = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    return order[np.arange(len(i)) - np.repeat(begins, np.diff(np.r_[begins, len(i)])) < k]


def _nearest(a: np.ndarray, b: np.ndarray, low: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of ``a``, row of ``b``, distance): the k nearest of each row of ``a`` that lie within its ``limit``.

    A matrix product finds everything within rounding of the limit, or of the k-th distance where that would be
    many; those few are then measured exactly and ordered by distance and ``low``. Both go in blocks of fixed size.
    """
    found, bb, turned = [], (b * b).sum(axis=1), np.ascontiguousarray(-2 * b.T)
    slack, k = 1e-9 * (1.0 + bb.max(initial=0.0)), min(k, len(b))
    rows, pairs = max(1, BLOCK_PAIRS // len(b)), max(1, BLOCK_VALUES // max(1, b.shape[1]))
    for start in range(0, len(a), rows):
        part = a[start : start + rows]
        aa = (part * part).sum(axis=1)
        rough = part @ turned
        rough += bb  # the squared distance without aa
        room = slack + 1e-9 * aa
        near = rough <= (limit[start : start + rows] ** 2 * (1 + 1e-9) + room - aa)[:, None]
        if near.sum() > 8 * k * len(part):
            near &= rough <= (np.partition(rough, k - 1, axis=1)[:, k - 1] + room)[:, None]
        i, j = np.nonzero(near)
        d = np.concatenate([np.empty(0), *(np.sqrt(((b[j[n : n + pairs]] - part[i[n : n + pairs]]) ** 2).sum(axis=1)) for n in range(0, len(i), pairs))])
        keep = _first(i, d, low[j], k) if len(i) else slice(0)
        found.append((i[keep] + start, j[keep], d[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def as_vector(cols: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in cols])


def _points(df: DataFrame, id_col: str, vector: str, keep: int) -> DataFrame:
    """Different vectors: ``pid``, ``v`` and the ``keep`` smallest ``ids`` that carry each."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and forall(v, x -> x is not null and not isnan(x))")
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= keep)
    return materialise(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.monotonically_increasing_id().alias("pid"), "v", "ids"))


class PivotIndex:
    """Fine pivots under coarse ones; for each the reference vectors' number and least and greatest distance.

    Holds two vectors and a few numbers for each pivot; there are about sqrt(n) of them for n reference vectors.
    """

    def __init__(self, pivots: np.ndarray):
        self.fine = pivots
        self.coarse = pivots[: math.ceil(len(pivots) ** 0.5)]
        self.home = np.concatenate([_distances(pivots[i : i + 512], self.coarse).argmin(axis=1) for i in range(0, len(pivots), 512)])
        self.members = [np.flatnonzero(self.home == c) for c in range(len(self.coarse))]

    def place(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each vector, the distance to its pivot and to the coarse pivot above."""
        d = _distances(v, self.coarse)
        at = d.argmin(axis=1)
        cell, far = np.empty(len(v), np.int64), np.empty(len(v))
        for c in np.unique(at):
            rows = np.flatnonzero(at == c)
            e = _distances(v[rows], self.fine[self.members[c]])
            best = e.argmin(axis=1)
            cell[rows], far[rows] = self.members[c][best], e[np.arange(len(rows)), best]
        return cell, far, d[np.arange(len(v)), at]

    def measure(self, stats: pd.DataFrame, shard_rows: int) -> None:
        """Keep what ``stats`` (one row per cell) says; cells without rows are never visited."""
        n = len(self.fine)
        self.rows, self.reach, self.inner = np.zeros(n, np.int64), np.full(n, -np.inf), np.full(n, np.inf)
        cell = stats["cell"].to_numpy()
        self.rows[cell], self.reach[cell], self.inner[cell] = stats["n"], stats["far"], stats["near"]
        self.members = [m[self.rows[m] > 0] for m in self.members]
        self.coarse_rows = np.array([self.rows[m].sum() for m in self.members])
        self._pack(shard_rows)
        self.coarse_reach = np.full(len(self.coarse), -np.inf)
        np.maximum.at(self.coarse_reach, self.home[cell], stats["above"].to_numpy())

    def _pack(self, shard_rows: int) -> None:
        """Bins of at most ``shard_rows`` vectors: cells in the order of their coarse pivots, larger ones in bins of their own."""
        self.bin, self.lots, self.bins = np.full(len(self.fine), -1, np.int64), np.ones(len(self.fine), np.int64), []
        room = 0
        for c in np.concatenate(self.members):
            n = int(self.rows[c])
            if n > shard_rows:
                self.lots[c], room = -(-n // shard_rows), 0
                self.bin[c] = len(self.bins)
                self.bins += [[c]] * int(self.lots[c])
                continue
            if n > room:
                self.bins.append([])
                room = shard_rows
            self.bin[c], room = len(self.bins) - 1, room - n
            self.bins[-1].append(c)
        self.bins = [np.array(b) for b in self.bins]

    def bins_of(self, cells: np.ndarray) -> np.ndarray:
        """The bins that hold vectors of ``cells``."""
        whole = self.lots[cells] == 1
        return np.unique(np.concatenate([self.bin[cells[whole]], *(self.bin[c] + np.arange(self.lots[c]) for c in cells[~whole])]))

    def first(self, v: np.ndarray, d: np.ndarray, need: int) -> np.ndarray:
        """The nearest cells that hold ``need`` vectors together; ``d``: distances to the coarse pivots."""
        order = d.argsort(kind="stable")
        enough = min(int(np.searchsorted(self.coarse_rows[order].cumsum(), need)), len(order) - 1) + 1
        cells = np.concatenate([self.members[c] for c in order[:enough]])
        cells = cells[_distances(v[None], self.fine[cells])[0].argsort(kind="stable")]
        return cells[: int(np.searchsorted(self.rows[cells].cumsum(), need)) + 1]

    def within(self, v: np.ndarray, limit: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Which of ``cells`` can hold a vector at a distance of at most ``limit`` from each row of ``v``."""
        slack = (limit * (1 + 1e-12) + 1e-12)[:, None]
        e = _distances(v, self.fine[cells])
        return (e - self.reach[cells] <= slack) & (self.inner[cells] - e <= slack)

    def rest(self, v: np.ndarray, d: np.ndarray, limit: float) -> np.ndarray:
        """All cells that ``within`` holds for one vector; ``d``: distances to the coarse pivots."""
        slack = limit * (1 + 1e-12) + 1e-12
        cells = np.concatenate([np.empty(0, np.int64), *(self.members[c] for c in np.flatnonzero(d - self.coarse_reach <= slack))])
        return cells[self.within(v[None], np.array([limit]), cells)[0]]


def _visited(index: PivotIndex, v: np.ndarray, limit: np.ndarray | None, own: list[np.ndarray], cells: np.ndarray) -> np.ndarray:
    """Queries x ``cells``: first pass (no ``limit``) the cells in ``own``; second pass those within the limit, without ``own``."""
    at = np.full(len(index.fine), -1)
    at[cells] = np.arange(len(cells))
    row, col = np.repeat(np.arange(len(own)), [len(x) for x in own]), at[np.concatenate(own)]
    seen = np.zeros((len(v), len(cells)), bool)
    seen[row[col >= 0], col[col >= 0]] = True
    return seen if limit is None else index.within(v, limit, cells) & ~seen


def _meet(index: PivotIndex, asked: DataFrame, placed: DataFrame, need: int, shard_rows: int) -> DataFrame:
    """``qp``, ``distance``, ``ids``: the nearest vectors of each visited bin."""
    ids = placed.schema["ids"].dataType.simpleString()
    second = "limit" in asked.columns
    asked = asked.withColumn("bin", F.explode("bins")).drop("bins")
    lots = asked.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("lots"))
    left = asked.join(lots, "bin").withColumn("lot", F.pmod(F.xxhash64("pid"), "lots").cast("int")).drop("lots")
    right = placed.select("bin", "cell", "v", "ids").join(lots, "bin").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"qp": a["pid"][:0], "distance": np.zeros(0), "ids": b["ids"][:0]})
        low = np.empty(len(b), np.int64)
        low[sorted(range(len(b)), key=[x[0] for x in b["ids"]].__getitem__)] = np.arange(len(b))
        q, v, home = _vectors(a["v"]), _vectors(b["v"]), b["cell"].to_numpy()
        cells = np.unique(home)
        limit = a["limit"].to_numpy() if second else None
        visits = _visited(index, q, limit, list(a["own"]), cells)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for n, c in enumerate(cells):
            rows, at = np.flatnonzero(visits[:, n]), np.flatnonzero(home == c)
            if len(rows):
                i, j, d = _nearest(q[rows], v[at], low[at], need, limit[rows] if second else np.full(len(rows), math.inf))
                found.append((rows[i], at[j], d))
            if len(found) > 16:  # no more than the need of each query is held
                found = [_best(found, low, need)]
        i, j, d = _best(found, low, need)
        return pd.DataFrame({"qp": a["pid"].to_numpy()[i], "distance": d, "ids": b["ids"].to_numpy()[j]})

    key = ["bin", "lot"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(nearest, f"qp bigint, distance double, ids {ids}")


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], low: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (query, reference, distance) of several cells, cut to the ``need`` nearest of each query."""
    i, j, d = (np.concatenate(x) for x in zip(*found))
    keep = _first(i, d, low[j], need) if len(i) else slice(0)
    return i[keep], j[keep], d[keep]


def _merged(found: DataFrame, need: int) -> DataFrame:
    """``qp``, ``near``: the ``need`` nearest (distance, id) of each query vector."""
    w = Window.partitionBy("qp").orderBy("distance", F.col("ids")[0])
    top = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= need)
    pairs = F.transform("ids", lambda i: F.struct(F.col("distance"), i.alias("rid")))
    return top.select("qp", pairs.alias("x")).groupBy("qp").agg(F.flatten(F.collect_list("x")).alias("x")).select("qp", F.slice(F.array_sort("x"), 1, need).alias("near"))


def _search(places: DataFrame, points: DataFrame, need: int, pivots: int | None, shard_rows: int | None) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Nearest lists of the query vectors, the reference vectors in their cells, and the visits of both passes."""
    n = points.count()
    if n == 0:
        raise ValueError("no reference rows")
    want = pivots or math.ceil(n**0.5)
    shard_rows = shard_rows or sorted((*SHARD_ROWS, n // 8))[1]
    index = PivotIndex(_vectors(pd.Series([x["v"] for x in points.select("v").orderBy(F.xxhash64("v"), "v").limit(want).collect()])))
    ids = points.schema["ids"].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cell, far, above = index.place(_vectors(pdf["v"]))
                yield pdf.assign(cell=cell, far=far, above=above)

    placed = materialise(fan_out(points, "pid").mapInPandas(assign, f"pid bigint, v array<double>, ids {ids}, cell bigint, far double, above double"))
    index.measure(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.min("far").alias("near"), F.max("above").alias("above")).toPandas(), shard_rows)  # one row per pivot

    def shelve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell = pdf["cell"].to_numpy()
            yield pdf.assign(bin=index.bin[cell] + pdf["deal"].to_numpy() % index.lots[cell])[["bin", "cell", "v", "ids"]]

    binned = placed.select("cell", "v", "ids", F.pmod(F.xxhash64("pid"), F.lit(2**31)).alias("deal")).mapInPandas(shelve, f"bin bigint, cell bigint, v array<double>, ids {ids}")

    def to_visit(pdf: pd.DataFrame) -> Iterator[np.ndarray]:
        """The cells each query visits: the nearest, or those that its limit leaves besides them."""
        v = _vectors(pdf["v"])
        d = _distances(v, index.coarse)
        if "limit" in pdf:
            return (np.setdiff1d(index.rest(v[i], d[i], x), pdf["own"].iloc[i], assume_unique=True) for i, x in enumerate(pdf["limit"]))
        return (index.first(v[i], d[i], need) for i in range(len(v)))

    def near_bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                own = list(to_visit(pdf))
                yield pdf.assign(own=own, bins=[index.bins_of(x) for x in own])

    def other_bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(bins=[index.bins_of(x) for x in to_visit(pdf)])

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                yield pd.DataFrame({"cell": np.concatenate(list(to_visit(pdf[i : i + 256])))})

    shape = "pid bigint, v array<double>, own array<bigint>, {}bins array<bigint>"
    first = materialise(fan_out(places, "pid").mapInPandas(near_bins, shape.format("")))
    found = materialise(_meet(index, first, binned, need, shard_rows))
    last = F.element_at("near", -1)["distance"]
    limits = _merged(found, need).select("qp", F.when(F.size("near") == need, last).otherwise(F.lit(math.inf)).alias("limit"))
    bound = first.join(limits, F.col("pid") == F.col("qp")).select("pid", "v", "own", "limit")
    second = materialise(fan_out(bound, "pid").mapInPandas(other_bins, shape.format("limit double, ")))
    visits = [x.drop("bins").mapInPandas(cells, "cell bigint") for x in (first.drop("own"), second)]
    return _merged(found.union(_meet(index, second, binned, need, shard_rows)), need), placed, visits


def _places(queries: DataFrame, query_id: str, vector: str) -> DataFrame:
    return _points(queries, query_id, vector, 1).select("pid", "v")


def knn_join(queries: DataFrame, refs: DataFrame, k: int, *, query_id: str = "qid", ref_id: str = "rid", vector: str = "v", exclude_same: bool = False, pivots: int | None = None, shard_rows: int | None = None) -> DataFrame:
    """(qid, rid, distance, rank) of the k nearest reference rows; equal distances rank by rid.

    Both tables hold an id and an array of doubles. ``exclude_same`` skips a row's own id. ``pivots``: cells of
    the index, by default the square root of the reference vectors; ``shard_rows``: vectors of either side in one task.
    """
    need = k + int(exclude_same)
    places = _places(queries, query_id, vector)
    near, _, _ = _search(places, _points(refs, ref_id, vector, need), need, pivots, shard_rows)
    lists = places.join(near, F.col("pid") == F.col("qp")).select(F.col("v").alias("pv"), "near")
    asked = queries.select(F.col(query_id).alias("qid"), F.col(vector).cast("array<double>").alias("v"))
    own = F.filter("near", lambda x: ~x["rid"].eqNullSafe(F.col("qid"))) if exclude_same else F.col("near")
    rows = asked.join(lists, F.col("v") == F.col("pv")).select("qid", F.posexplode(F.slice(own, 1, k)).alias("at", "x"))
    return rows.select("qid", "x.rid", "x.distance", (F.col("at") + 1).alias("rank"))


def knn_work(queries: DataFrame, refs: DataFrame, k: int, *, query_id: str = "qid", ref_id: str = "rid", vector: str = "v", pivots: int | None = None, shard_rows: int | None = None) -> DataFrame:
    """(pass, cell, queries, refs) that ``knn_join`` compares; their products are the pairs it measures."""
    _, placed, visits = _search(_places(queries, query_id, vector), _points(refs, ref_id, vector, k), k, pivots, shard_rows)
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("refs"))
    count = lambda df, i: df.groupBy("cell").agg(F.count(F.lit(1)).alias("queries")).select(F.lit(i).alias("pass"), "cell", "queries")
    return count(visits[0], 1).union(count(visits[1], 2)).join(sizes, "cell").select("pass", "cell", "queries", "refs")


def knn_predict(train: DataFrame, test: DataFrame, k: int, label: str = "label", **kw) -> DataFrame:
    """Share of positive neighbours of each test row."""
    near = knn_join(test, train, k, **kw)
    return near.join(train.select(F.col(kw.get("ref_id", "rid")).alias("rid"), F.col(label).alias("__y")), "rid").groupBy("qid").agg(F.avg("__y").alias("p"))


def nearest_distance_weights(source: DataFrame, target: DataFrame, **kw) -> DataFrame:
    """exp(-d / mean d) with d the distance to the nearest target row, scaled to mean 1."""
    near = knn_join(source, target, 1, **kw).select("qid", "distance")
    raw = near.withColumn("__w", F.exp(-F.col("distance") / near.agg(F.avg("distance")).scalar()))
    return raw.select("qid", (F.col("__w") / raw.agg(F.avg("__w")).scalar()).alias("weight"))


def smote(df: DataFrame, key: str, vector: str, label: str, k: int = 5, seed: int = 42, neighbours_from: DataFrame | None = None, target: DataFrame | None = None,
          intra_ratio: float = 0.7, domain_weight: float = 0.3) -> DataFrame:
    """Synthetic rows that raise each class to the size of the largest; a null label is a class.

    Each synthetic row lies between a row and one of its k nearest rows of the same class, or of
    ``neighbours_from`` (key, vector) when given. Returns (label, base key, n-th copy, vector).

    With ``target`` (key, vector), the rows of another domain, a share ``intra_ratio`` of the synthetic rows is made so
    (``kind`` intra); each other one (cross) is moved further by ``domain_weight`` of the way from its base to one
    of the base's k nearest target rows. An empty target leaves all rows intra.
    """
    numbers = lambda d: d.select(F.col(key).alias("qid"), F.col(vector).cast("array<double>").alias("v"))
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per class
    top = max((r["n"] for r in sizes), default=0)
    crossing = target is not None
    far = numbers(target) if crossing and target.take(1) else None
    out = None
    for cls, size in sorted(sizes, key=lambda r: (r[0] is None, r[0])):
        lack = top - size
        if lack == 0:
            continue
        own = numbers(df.where(F.col(label).isNull() if cls is None else F.col(label) == F.lit(cls)))
        name = F.lit(cls).cast(df.schema[label].dataType).alias(label)
        if size < 2 and neighbours_from is None:  # no neighbour: the row itself is repeated
            part = own.select(name, F.col("qid").alias(key), F.explode(F.sequence(F.lit(1), F.lit(lack))).alias("copy"), F.col("v").alias(vector), *([F.lit("intra").alias("kind")] if crossing else []))
            out = part if out is None else out.unionByName(part)
            continue
        pool = own if neighbours_from is None else numbers(neighbours_from)
        near = knn_join(own, pool, k, query_id="qid", ref_id="qid", exclude_same=neighbours_from is None)
        found = near.groupBy("qid").agg(F.count(F.lit(1)).alias("found"))  # fewer than k in a tiny class
        placed = shuffled_position(own, [], ["qid"], seed).join(found, "qid")
        copies = F.lit(lack // size) + (F.col("__pos") <= lack % size).cast("int")
        made = placed.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
        digest = key_digest(["qid", "copy"], seed)
        pick = lambda unit, of: F.least(F.floor(unit * F.col(of)) + 1, F.col(of)).cast("int")
        made = made.select("qid", "v", "copy", pick(digest_unit(digest), "found").alias("rank"), digest_unit(digest, 14).alias("alpha"))
        mixed = made.join(near.select("qid", "rank", "rid"), ["qid", "rank"]).join(pool.select(F.col("qid").alias("rid"), F.col("v").alias("nv")), "rid").drop("rid", "rank")
        between = F.transform(F.arrays_zip("v", "nv"), lambda s: s["v"] + F.col("alpha") * (s["nv"] - s["v"]))
        mixed = mixed.select("qid", "copy", "v", between.alias("made"))
        kind = F.lit("intra")
        if far is not None:
            aims = knn_join(own, far, k, query_id="qid", ref_id="qid").join(far.select(F.col("qid").alias("rid"), F.col("v").alias("tv")), "rid")
            lists = aims.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "tv"))).alias("aims"))  # at most k
            draw = key_digest(["qid", "copy"], f"{seed}-domain")
            mixed = mixed.join(lists, "qid").withColumn("n", F.size("aims"))
            aim = F.element_at("aims", pick(digest_unit(draw, 14), "n"))["tv"]
            kind = F.when(digest_unit(draw) < intra_ratio, "intra").otherwise("cross")
            mixed = mixed.select("qid", "copy", "v", "made", kind.alias("kind"), aim.alias("tv"))
            moved = F.transform(F.arrays_zip("made", "v", "tv"), lambda s: s["made"] + domain_weight * (s["tv"] - s["v"]))
            mixed, kind = mixed.withColumn("made", F.when(F.col("kind") == "cross", moved).otherwise(F.col("made"))), F.col("kind")
        part = mixed.select(name, F.col("qid").alias(key), "copy", F.col("made").alias(vector), *([kind.alias("kind")] if crossing else []))
        out = part if out is None else out.unionByName(part)
    if out is not None:
        return out
    return df.limit(0).select(label, key, F.lit(0).alias("copy"), F.col(vector).cast("array<double>").alias(vector), *([F.lit("intra").alias("kind")] if crossing else []))


def log_gamma_draw(ids: list, a: float, seed: int | str, tries: int = 10) -> Column:
    """Logarithm of a Gamma(a) draw on hashed uniforms, by Marsaglia and Tsang's squeeze of a normal.

    A try is accepted with a probability above 0.95, so all ten fail in fewer than one of 10^13 draws; the
    mode stands in then. Shapes below one are drawn one higher and scaled down.
    """
    shape = a if a >= 1 else a + 1
    d = shape - 1 / 3

    def attempt(t: Column) -> Column:
        u, w, x = (F.greatest(key_unit([*ids, t], f"{seed}-{n}"), F.lit(1e-300)) for n in "uwx")
        v = F.pow(1 + F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * w) / math.sqrt(9 * d), F.lit(3.0))
        z = (F.pow(v, F.lit(1 / 3)) - 1) * math.sqrt(9 * d)
        return F.when((v > 0) & (F.log(x) < z * z / 2 + d - d * v + d * F.log(v)), F.log(d * v))

    none = F.lit(None).cast("double")
    out = F.aggregate(F.sequence(F.lit(1), F.lit(tries)), none, lambda got, t: F.coalesce(got, attempt(t)), lambda got: F.coalesce(got, F.lit(math.log(d))))
    return out if a >= 1 else out + F.log(F.greatest(key_unit(ids, f"{seed}-low"), F.lit(1e-300))) / a


def beta_symmetric(ids: list, a: float, seed: int | str) -> Column:
    """Beta(a, a) draw: the share of one of two gamma draws, taken in logarithms."""
    return 1 / (1 + F.exp(log_gamma_draw(ids, a, f"{seed}-y") - log_gamma_draw(ids, a, f"{seed}-x")))


def mixup(df: DataFrame, key: str, vector: str, label: str, alpha: float = 0.2, seed: int = 42, same_class: bool = True) -> DataFrame:
    """Each row mixed with the next one of a random cyclic order, inside its class if asked; a null label is a class."""
    strata = [label] if same_class else []
    placed = shuffled_position(df.select(key, F.col(vector).cast("array<double>").alias("v"), label), strata, [key], seed)
    nxt = placed.select(*strata, (F.when(F.col("__pos") == 1, F.col("__size")).otherwise(F.col("__pos") - 1)).alias("__pos"), F.col(key).alias("partner"), F.col("v").alias("nv"), F.col(label).alias("__y2"))
    j = null_safe_join(placed, nxt, [*strata, "__pos"])
    lam = beta_symmetric([key], alpha, seed)
    j = j.withColumn("lam", lam)
    mixed = F.transform(F.arrays_zip("v", "nv"), lambda s: F.col("lam") * s["v"] + (1 - F.col("lam")) * s["nv"])
    y = F.col("lam") * F.col(label) + (1 - F.col("lam")) * F.col("__y2")
    return j.select(key, "partner", "lam", mixed.alias(vector), y.alias("soft_label"))


def mixup_domains(source: DataFrame, target: DataFrame, key: str, vector: str, label: str, alpha: float = 0.2, cross_ratio: float = 0.3, seed: int = 42) -> DataFrame:
    """Mixtures of two rows, within the source or across to the target: half as many draws as the smaller side has rows.

    A draw is cross with probability ``cross_ratio`` and kept if both rows have one class (null being one); else it
    mixes two different source rows, and where their classes differ takes the first one's with probability ``lam``.
    A target without the label column gives no cross draws. Returns (draw, kind, key, partner, lam, vector, label).
    """
    labelled = label in target.columns
    rows = lambda df: shuffled_position(df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), (F.col(label) if label in df.columns else F.lit(None).cast(source.schema[label].dataType)).alias("y")), [], ["k"], f"{seed}-order")
    own, other = rows(source), rows(target)
    n_source, n_target = source.count(), target.count()
    kind, mate = key_digest(["draw"], f"{seed}-kind"), key_digest(["draw"], f"{seed}-partner")
    draws = source.sparkSession.range(1, min(n_source, n_target) // 2 + 1).select(F.col("id").alias("draw"))
    draws = draws.withColumn("cross", (digest_unit(kind) < cross_ratio) & F.lit(labelled)).select(
        "draw", "cross", (F.floor(digest_unit(kind, 14) * n_source) + 1).alias("one"), (F.floor(digest_unit(mate) * F.when(F.col("cross"), n_target).otherwise(n_source)) + 1).alias("two"), digest_unit(mate, 14).alias("u"))
    first = own.select(F.col("__pos").alias("one"), F.col("k").alias(key), F.col("v").alias("v1"), F.col("y").alias("y1"))
    second = own.withColumn("cross", F.lit(False)).unionByName(other.withColumn("cross", F.lit(True))).select("cross", F.col("__pos").alias("two"), F.col("k").alias("partner"), F.col("v").alias("v2"), F.col("y").alias("y2"))
    same = F.col("y1").eqNullSafe(F.col("y2"))
    pairs = draws.join(first, "one").join(second, ["cross", "two"]).where(F.when(F.col("cross"), same).otherwise(F.col("one") != F.col("two")))
    pairs = pairs.withColumn("lam", beta_symmetric(["draw"], alpha, seed))
    mixed = F.transform(F.arrays_zip("v1", "v2"), lambda s: F.col("lam") * s["v1"] + (1 - F.col("lam")) * s["v2"])
    y = F.when(same | (F.col("u") < F.col("lam")), F.col("y1")).otherwise(F.col("y2"))
    return pairs.select("draw", F.when(F.col("cross"), "cross").otherwise("intra").alias("kind"), key, "partner", "lam", mixed.alias(vector), y.alias(label))
