"""The paths for very large groups must give what the plain paths give."""

import random

import pytest
from pyspark.sql import functions as F

from edlens.operators import drift as D
from edlens.operators import events as E
from edlens.operators import metrics as M
from edlens.operators import sequences as Q
from edlens.operators.ordered import MAX_GROUP_ROWS, cut_large_groups, in_order, shuffled_position
from edlens.operators.quantiles import quantiles


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds most rows; there are null keys, null values, null and repeated order values."""
    rnd = random.Random(3)
    rows = []
    for i in range(4000):
        key = None if i % 97 == 0 else ("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(40)}")
        rows.append((key, None if i % 211 == 0 else float(rnd.randrange(500)), i, None if i % 13 == 0 else rnd.randrange(9)))
    return spark.createDataFrame(rows, "k string, t double, id long, v long").repartition(7)


@pytest.mark.parametrize("limit", [50, 400])
def test_in_order_matches_plain(hot, limit):
    args = dict(position="pos", previous={"pv": "v", "pid": "id"}, following={"nv": "v"}, running={"rv": "v"})
    plain = in_order(hot, ["k"], ["t", "id"], **args)
    cut = in_order(hot, ["k"], ["t", "id"], **args, max_group_rows=limit)
    assert cut_large_groups(hot, ["k"], ["t", "id"], limit) is not None
    assert cut.columns == plain.columns
    assert sorted(map(str, cut.collect())) == sorted(map(str, plain.collect()))


def test_in_order_without_keys(hot):
    plain = in_order(hot.select("id"), [], ["id"], position="pos")
    cut = in_order(hot.select("id"), [], ["id"], position="pos", max_group_rows=100)
    assert sorted(plain.collect()) == sorted(cut.collect())


def test_cut_ranges_are_bounded(hot):
    sizes = cut_large_groups(hot.where("t IS NOT NULL"), ["k"], ["t", "id"], 200).groupBy("k", "__range").count().agg(F.max("count")).first()[0]
    assert sizes <= 200


def test_frequent_order_values_are_cut_further(hot):
    """Three days hold everything: the second ordering column has to share the load."""
    days = hot.where("t IS NOT NULL").select("k", (F.col("t") % 3).cast("int").alias("day"), "id", "v")
    sizes = cut_large_groups(days, ["k"], ["day", "id"], 200).groupBy("k", "__range").count().agg(F.max("count")).first()[0]
    assert sizes <= 200
    args = dict(position="pos", previous={"pid": "id"}, following={"nid": "id"}, running={"rv": "v"})
    plain, cut = in_order(days, ["k"], ["day", "id"], **args), in_order(days, ["k"], ["day", "id"], **args, max_group_rows=200)
    assert sorted(map(str, cut.collect())) == sorted(map(str, plain.collect()))


def test_text_order(hot):
    words = hot.select("k", F.concat(F.lit("w"), F.col("id").cast("string")).alias("w"))
    plain, cut = in_order(words, ["k"], ["w"], position="pos"), in_order(words, ["k"], ["w"], position="pos", max_group_rows=150)
    assert sorted(map(str, cut.collect())) == sorted(map(str, plain.collect()))


def test_in_order_same_after_repartition(hot):
    run = lambda df: sorted(map(str, in_order(df, ["k"], ["t", "id"], position="pos", running={"r": "v"}, max_group_rows=150).collect()))
    assert run(hot) == run(hot.repartition(3, "id"))


def test_quantiles_by_counting(hot):
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.975, "e": 1.0}
    exact = {r.k: r for r in quantiles(hot, ["k"], "t", probs).collect()}
    counted = {r.k: r for r in quantiles(hot, ["k"], "t", probs, max_distinct=20).collect()}
    assert set(counted) == set(exact) and None in counted
    for k, row in counted.items():
        assert [round(row[p], 9) for p in probs] == [round(exact[k][p], 9) for p in probs]
    one = quantiles(hot, [], "t", probs, max_distinct=20).first()
    ref = quantiles(hot, [], "t", probs).first()
    assert [round(one[p], 9) for p in probs] == [round(ref[p], 9) for p in probs]


def test_shuffled_position_is_a_permutation(hot):
    p = shuffled_position(hot, ["k"], ["id"], 1)
    bad = p.groupBy("k").agg(F.count_distinct("__pos").alias("d"), F.max("__pos").alias("m"), F.max("__size").alias("s"), F.count(F.lit(1)).alias("n")).where("d <> n OR m <> n OR s <> n")
    assert bad.count() == 0 and p.count() == 4000
    again = shuffled_position(hot.repartition(2), ["k"], ["id"], 1)
    assert sorted(map(str, p.collect())) == sorted(map(str, again.collect()))


@pytest.fixture(scope="module")
def log(spark):
    rnd = random.Random(5)
    rows = [("big" if rnd.random() < 0.6 else f"c{rnd.randrange(60)}", rnd.choice("abc"), i) for i in range(1500)]
    return spark.createDataFrame(rows, "case_id string, activity string, event_id long").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 60))


def test_process_mining_on_a_huge_case(log):
    small = dict(max_group_rows=100)
    for f in (E.directly_follows, E.log_summary, E.bottlenecks):
        assert sorted(map(str, f(log).collect())) == sorted(map(str, f(log, **small).collect()))
    whole = {r.example_case: (r.variant, r.frequency) for r in E.trace_variants(log, top=100).collect()}
    parts = {}
    for r in sorted(E.trace_variants(log, top=100, path_steps=64, **small).collect(), key=lambda r: r.segment):
        parts.setdefault(r.example_case, []).append(r.variant)
    assert {k: " -> ".join(v) for k, v in parts.items()} == {k: v[0] for k, v in whole.items()}


def test_sequences_in_segments_keep_all_rows(log):
    placed = Q.order_events(log, ["case_id"], ["ts", "event_id"], max_group_rows=100)
    seg = Q.to_segments(placed, ["case_id"], ["activity"], segment_steps=50)
    assert seg.agg(F.sum("length")).first()[0] == 1500 and seg.agg(F.max("length")).first()[0] == 50


def test_score_curve_and_ks_in_ranges(hot):
    df = hot.select("k", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") * 7919 % 1009 / 1009).alias("p")).where("k IS NOT NULL")
    a, b = M.ranking_metrics(df, ["k"]), M.ranking_metrics(df, ["k"], max_group_rows=50)
    key = lambda rows: sorted((r.k, round(r.roc_auc, 9), round(r.average_precision, 9)) for r in rows)
    assert key(a.collect()) == key(b.collect())
    d = hot.select((F.col("id") % 3 == 0).cast("int").alias("domain"), "t", "v")
    ks = lambda **kw: sorted((r.feature, round(r.ks, 9)) for r in D.ks_two_sample(d, ["t", "v"], p_value=False, **kw).collect())
    assert ks() == ks(max_group_rows=40)


def test_average_rank_with_ties(hot):
    got = {r.id: r.rank for r in Q.average_rank(hot.select("k", "v", "id"), ["k"], "v", max_group_rows=3).collect()}
    ref = {r.id: r.rank for r in Q.average_rank(hot.select("k", "v", "id"), ["k"], "v").collect()}
    assert got == ref


def test_nan_and_boolean_order_in_both_branches(spark):
    rows = [(k, float("nan") if i % 5 == 0 else None if i % 7 == 0 else i * 37 % 11 / 2.0, i % 2 == 0, i) for k in ("a", None) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, v double, b boolean, id long")
    for order in (["v", "id"], ["b", "id"]):
        small, large = ({(r.k, r.id): r.p for r in in_order(df, ["k"], order, position="p", max_group_rows=n).collect()} for n in (1000, 10))
        assert small == large
    text = spark.createDataFrame([([1], 1)], "a array<int>, id long")
    for n in (1000, 0):
        with pytest.raises(TypeError):
            in_order(text, [], ["a"], position="p", max_group_rows=n)


def test_null_keys_of_last_steps(spark):
    df = spark.createDataFrame([(k, i) for k in ("a", None) for i in range(5)], "k string, i int")
    assert Q.last_steps(df, ["k"], ["i"], 3).count() == Q.last_steps(df, ["k"], ["i"], 1500).count() - 4 == 6


def test_no_window_holds_a_million_rows(spark):
    """A continuous column of 1.2 million values is cut with the settings as they are."""
    df = spark.range(1_200_000).select(F.lit("f").alias("feature"), F.col("id").cast("double").alias("value"))
    cut = cut_large_groups(df, ["feature"], ["value"], MAX_GROUP_ROWS)
    assert cut is not None and cut.groupBy("feature", "__range").count().agg(F.max("count")).first()[0] < 600_000
