"""Nearest neighbours and resampled ranking metrics against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edlens.operators import inference as I
from edlens.operators import metrics
from edlens.operators import neighbours as N


def brute(queries, refs, k, exclude_same=False):
    out = []
    for q, v in queries:
        near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), r) for r, w in refs if w is not None and not (exclude_same and r == q))
        out += [(q, r, i + 1) for i, (_, r) in enumerate(near[:k])]
    return sorted(out)


def clustered(seed, n, d, centres):
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(0).normal(0, 50, (centres, d))
    return middle[rng.integers(0, centres, n)] + rng.normal(0, 0.4, (n, d))


@pytest.mark.parametrize(("pivots", "shard_rows"), [(None, 4096), (1, 7), (40, 5)])
def test_knn_join(spark, pivots, shard_rows):
    """Ties, a vector in a third of all rows, text ids, any number of cells and shards."""
    rng = random.Random(2)
    point = lambda: [float(rng.randint(-3, 3)) for _ in range(3)]
    refs = [(f"r{i:03}", [1.0, 1.0, 1.0] if i % 3 == 0 else point()) for i in range(240)]
    queries = [(f"r{i:03}", point() if i % 2 else [1.0, 1.0, 1.0]) for i in range(60)]
    q, r = spark.createDataFrame(queries, "a string, x array<double>"), spark.createDataFrame([*refs, ("none", None), ("nan", [math.nan] * 3)], "b string, x array<double>")
    for same in (False, True):
        got = N.knn_join(q, r, 4, query_id="a", ref_id="b", vector="x", exclude_same=same, pivots=pivots, shard_rows=shard_rows).collect()
        assert sorted((x.qid, x.rid, x["rank"]) for x in got) == brute(queries, refs, 4, same)


def test_fewer_references_than_neighbours(spark):
    q = spark.createDataFrame([(1, [0.0]), (2, [5.0])], "qid long, v array<double>")
    r = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "rid long, v array<double>")
    assert sorted((x.qid, x.rid, x["rank"], x.distance) for x in N.knn_join(q, r, 5).collect()) == [(1, 1, 1, 1.0), (1, 2, 2, 1.0), (2, 1, 1, 4.0), (2, 2, 2, 4.0)]
    with pytest.raises(ValueError, match="no reference"):
        N.knn_join(q, r.limit(0), 1)


def test_work_grows_below_the_square(spark):
    """On clustered vectors five times the rows on both sides are far fewer than 25 times the pairs; each cell is visited once per query."""
    pairs = {}
    for n in (1000, 5000):
        x = clustered(n, n, 8, 20)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
        work = N.knn_work(df, df, 3, query_id="id", ref_id="id").agg(F.sum(F.col("queries") * F.col("refs")).alias("pairs")).first()
        pairs[n] = work.pairs
        assert work.pairs < 0.2 * n * n
    assert pairs[5000] < 17 * pairs[1000]


def test_rows_between_tasks_stay_few(spark, monkeypatch):
    """Where no cell can be left out a query still goes once to each bin, not to each cell; a bin holds no more than asked."""
    sent, n = [], 400
    write = N.materialise
    monkeypatch.setattr(N, "materialise", lambda df: sent.append(write(df)) or sent[-1])
    x = np.random.default_rng(4).normal(0, 1, (n, 24)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = N.knn_join(df, df, 3, query_id="id", ref_id="id", exclude_same=True, shard_rows=150).collect()
    assert sorted((r.qid, r.rid, r["rank"]) for r in got) == brute(rows, rows, 3, True)
    assert max(d.count() for d in sent) < 6 * n  # k + 1 candidates of each query, in one bin or two; there are 20 cells
    index = N.PivotIndex(x[:20])
    cell, far, above = index.place(x)
    index.measure(spark.createDataFrame([(int(c), float(f), float(a)) for c, f, a in zip(cell, far, above)], "cell long, far double, above double").groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.min("far").alias("near"), F.max("above").alias("above")).toPandas(), 60)
    held = [sum(-(-index.rows[c] // index.lots[c]) for c in b) for b in index.bins]
    assert max(held) <= 60 and sorted({int(c) for b in index.bins for c in b}) == sorted(set(cell.tolist()))
    assert all(c in index.bins[b] for c in set(cell.tolist()) for b in index.bins_of(np.array([c])))


def plain_replicates(cells, draws):
    """Metrics of one resample: cells (score, positives, negatives), drawn counts in the same order."""
    tp = fp = area = ap = 0.0
    for (s, _, _), (a, b) in sorted(zip(cells, draws), key=lambda x: -x[0][0]):
        area += b * (tp + a / 2)
        tp, fp = tp + a, fp + b
        ap += a * tp / (tp + fp) if tp + fp else 0.0
    return (area / (tp * fp) if tp * fp else 0.5), (ap / tp if tp else 0.0)


def test_score_metrics_of_drawn_cells(spark, monkeypatch):
    """Ranges of two scores carry their sums into the next one; groups may be null."""
    monkeypatch.setattr(I, "SCORE_RANGE", 2)
    rng = random.Random(3)
    cells = {g: [(i / 10, [float(rng.choice([0, 0, 1, 4])) for _ in range(6)], [float(rng.choice([0, 1, 3])) for _ in range(6)]) for i in range(9)] for g in ("a", None)}
    df = spark.createDataFrame([(g, *c) for g, cs in cells.items() for c in cs], "g string, score double, wp array<double>, wn array<double>")
    got = I._score_metrics(I._ranges(df, ["g"]), ["g"], 0.45).collect()
    assert len(got) == 12
    for r in got:
        draws = [(c[1][r.rep - 1], c[2][r.rep - 1]) for c in cells[r.g]]
        auc, ap = plain_replicates(cells[r.g], draws)
        hit, false = (sum(d[i] for c, d in zip(cells[r.g], draws) if c[0] >= 0.45) for i in (0, 1))
        pos, neg = (sum(d[i] for d in draws) for i in (0, 1))
        assert (r.roc_auc, r.average_precision) == pytest.approx((auc, ap))
        assert (r.accuracy, r.recall) == pytest.approx(((hit + neg - false) / (pos + neg), hit / pos if pos else 0.0))


def test_bootstrap_scores_surround_the_metric(spark):
    rng = random.Random(5)
    rows = [(i % 40, y, round(min(1.0, max(0.0, rng.gauss(0.4 + 0.25 * y, 0.2))), 2), [None, "x"][i % 2]) for i in range(1500) for y in [int(rng.random() < 0.3)]]
    df = spark.createDataFrame(rows, "c long, y int, p double, g string")
    truth = {r.g: r for r in metrics.ranking_metrics(df, ["g"]).collect()}
    for r in I.bootstrap_scores(df, ["g"], reps=200).where("metric in ('roc_auc', 'average_precision')").collect():
        want = truth[r.g][r.metric]
        assert r.ci_lower < want < r.ci_upper and r["mean"] == pytest.approx(want, abs=0.02) and 0.01 < r["std"] < 0.06
    whole = metrics.ranking_metrics(df, []).first()
    for multiplicity in (False, True):
        got = {r.metric: r for r in I.cluster_bootstrap_scores(df, "c", reps=100, with_multiplicity=multiplicity).collect()}
        assert got["roc_auc"].ci_lower < whole.roc_auc < got["roc_auc"].ci_upper and len(got) == 6
