"""Exact top-k search against all inner products."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from edlens.llm import top_k as K
from edlens.llm.shared import importable

SCHEMA = "vec_id long, embedding array<float>, label int, id long, vector string, cls int, block int, data string, score string"


def plain(rows, k, wanted, scale=256):
    """Rows counted once; sorted by falling score, then id with null last."""
    kept = set()
    for i, v, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.add((i, tuple(math.floor(scale * float(np.float32(x))) for x in v)))
    out = []
    for i, q in kept:
        if i is not None and wanted(i):
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j is None, j or 0) for j, v in kept if (j, v) != (i, q))
            out += [(i, r + 1, None if void else j, -s) for r, (s, void, j) in enumerate(scores[:k])]
    return sorted(out, key=str)


def make(seed, n, d):
    rng = random.Random(seed)
    common = [rng.gauss(0, 0.125) for _ in range(d)]
    def vector():
        kind = rng.random()
        if kind < 0.35:
            return common
        if kind < 0.4:
            return rng.choice([None, [], [0.0] * d, [None] * d, [float("nan")] * d, [math.inf] + [0.0] * (d - 1), common[: d // 2], [x * 2 for x in common]])
        return [rng.gauss(0, 0.125) if rng.random() < 0.8 else 0.0 for _ in range(d)]
    rows = [(i, vector(), 1, 2, "v", 3, 4, "d", "s") for i in range(n)]
    return rows + rows[:3] + [(None, common, 1, 2, "v", 3, 4, "d", "s"), (None, vector(), 1, 2, "v", 3, 4, "d", "s"), (50, [x / 2 for x in common], 1, 2, "v", 3, 4, "d", "s")]


@pytest.mark.parametrize(("seed", "n", "d", "block"), [(1, 400, 16, 8192), (2, 700, 8, 60), (3, 30, 3, 4)])
def test_all_queries(spark, monkeypatch, seed, n, d, block):
    importable(spark)
    monkeypatch.setattr(K, "BLOCK", block)
    rows = make(seed, n, d)
    got = K.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), "id % 10 = 0").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, 5, lambda i: i % 10 == 0)


def test_many_queries_per_block(spark, monkeypatch):
    """More queries than one task takes: a block is read by several."""
    importable(spark)
    monkeypatch.setattr(K, "BLOCK", 64)
    monkeypatch.setattr(K, "QUERIES", 16)
    rows = make(4, 300, 6)
    got = K.top_k(spark.createDataFrame(rows, SCHEMA), "true", k=3).collect()
    assert sorted((tuple(r) for r in got if r.query_id is not None), key=str) == plain(rows, 3, lambda i: True)


def test_few_and_none(spark):
    importable(spark)
    assert K.top_k(spark.createDataFrame([], SCHEMA), "id % 50 = 0").count() == 0
    one = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<double>")
    assert K.top_k(one, "id % 50 = 0").count() == 0
    two = spark.createDataFrame([(50, [1.0, -0.001]), (7, [2.0, 3.0e6])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in K.top_k(two, "id % 50 = 0").collect()] == [(50, 1, 7, 256 * 512 - 768_000_000)]


@pytest.mark.parametrize("kind", ["normal", "sparse", "equal", "clusters", "huge"])
def test_index_proves_what_it_leaves_out(kind):
    rng = np.random.default_rng(3)
    values = {"normal": rng.normal(0, 40, (900, 24)), "sparse": rng.normal(0, 40, (900, 24)) * (rng.random((900, 24)) < 0.1), "equal": np.full((900, 24), 7.0),
              "clusters": rng.normal(0, 60, (6, 24))[rng.integers(0, 6, 900)] + rng.normal(0, 3, (900, 24)), "huge": rng.normal(0, 1e14, (900, 24))}[kind].astype(np.int64)
    index, left_out = K.Index(values), 0
    for q in [*values[::90], np.zeros(24, np.int64), -values[3]]:
        exact = (values.astype(object) @ q.astype(object)) if kind != "huge" else None
        if kind == "huge":
            q = np.sign(q)
            exact = values.astype(object) @ q.astype(object)
        sixth = sorted(exact)[-6]
        for floor in (-np.inf, float(sixth), float(sorted(exact)[-3])):
            rows, got = index.search(q, 6, floor)
            assert list(got) == [exact[i] for i in rows]
            assert {i for i in range(900) if exact[i] >= max(sixth, floor)} <= set(rows.tolist())
            left_out += 900 - len(rows)
    assert left_out > 0 or kind in ("equal", "huge")
