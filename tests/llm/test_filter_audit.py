"""The filter audit against a plain walk through every order."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from edlens.llm import filter_audit
from edlens.llm.shared import importable

SCHEMA = "doc_id long, text string, source string, id long, mark string, part string, bits int, rows string, words string"
LABELS = "doc_id long, quality int, toxic int, id long"


def rows_of(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "Beta", "GAMMA", "d#", "e$e", "f", "g"]) + str(rng.randint(0, rng.choice([3, 5000])))
    texts = [None, "", " \n", "A" * 40, "copy me " * 120, "long " + "x" * 200_000] + [" ".join(word() for _ in range(rng.choice([5, 150, 199, 200, 260]))) for _ in range(12)]
    ids = [None, None, *range(n)]
    rows = [(rng.choice(ids), rng.choice(texts + [texts[4]] * 9), rng.choice([None, "", "s1", "s1", "s2"]), 1, "m", "p", 3, "r", "w") for _ in range(n)]
    rows += rows[:4]
    labels = [(rng.choice(ids), rng.choice([None, 0, 1]), rng.choice([None, 0, 1]), 9) for _ in range(n)]
    return rows, labels


def plain(rows, labels):
    good = {i for i, q, *_ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t, _ in labels if t == 1 and i is not None}
    first = {}
    for r in rows:
        t = r[1] or ""
        if r[0] is not None:
            first[t] = min(first.get(t, r[0]), r[0])
    docs = []
    for i, t, s, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        docs.append((s or "", i, {x for x, f in fails.items() if f}))
    out, shares = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, x in enumerate(order, 1):
                removed = [d for d in left if x in d[2]]
                redundant = sum(x in d[2] for d in gone)
                left = [d for d in left if x not in d[2]]
                gone += removed
                shares[part, x] += len(removed)
                unique = sum(d[2] == {x} for d in docs if d[0] == part)
                out[part, "".join(order), step] = [len(left), len(removed), redundant, unique, sum(d[1] in good for d in removed), sum(d[1] in toxic for d in removed)]
    return {(p, o, s): (*v, shares[p, o[s - 1]]) for (p, o, s), v in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_every_order(spark, seed):
    importable(spark)
    rows, labels = rows_of(seed, 80)
    got = filter_audit.audit(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len({(r.part, r.filter_order, r.step) for r in got})
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == plain(rows, labels)


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(none, labels).count() == 0
    rows, _ = rows_of(3, 10)
    got = filter_audit.audit(spark.createDataFrame(rows, SCHEMA), labels).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == plain(rows, [])


def test_other_rules(spark):
    """Any number of conditions: two rules and copies give 3! orders; columns may have other names."""
    rows = [(i, t, "s") for i, t in enumerate(["a", "a", "bb", "", None, "bb cc dd"])]
    docs = spark.createDataFrame(rows, "key long, body string, site string")
    got = filter_audit.audit(docs, spark.createDataFrame([], LABELS), "key", "body", "site", {"S": "size(words) < 1", "L": "length(text) < 2"}).collect()
    assert len(got) == 18
    by = {(r.filter_order, r.step): r for r in got}
    assert (by["SLE", 1].removed, by["SLE", 2].removed, by["SLE", 3].removed, by["SLE", 3].kept) == (2, 2, 0, 2)
    assert (by["ELS", 1].removed, by["ELS", 2].removed, by["ELS", 2].redundant, by["ELS", 1].unique_fails) == (2, 2, 2, 0)
