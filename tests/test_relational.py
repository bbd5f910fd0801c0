"""Joins, unions, groups and aggregates against naive versions."""

import itertools
import math
import random

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline import dataset as W
from weftline.errors import InvalidRequest, StateLimitExceeded
from weftline.operators import aggregates as A
from weftline.operators import groups, joins, ranking
from weftline.operators.components import connected_components

LEFT = [{"k": 1, "v": "a"}, {"k": 1, "v": "b"}, {"k": 2, "v": "c"}, {"k": None, "v": None}]
RIGHT = [{"k": 1, "v": "x"}, {"k": 1, "v": "y"}, {"k": None, "v": "n"}]


def naive_join(left, right, how):
    out = []
    for a in left:
        hits = [b for b in right if a["k"] is not None and a["k"] == b["k"]]
        if how == "inner":
            out += [{**a, "v_right": b["v"]} for b in hits]
        elif how == "left":
            out += [{**a, "v_right": b["v"]} for b in hits] or [{**a, "v_right": None}]
        elif (how == "semi") == bool(hits):
            out.append(a)
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "semi", "anti"])
def test_join_small(spark, how):
    a, b = W.from_items(LEFT, "k long, v string", spark), W.from_items(RIGHT, "k long, v string", spark)
    assert rows(a.join(b, "k", how=how).df) == naive_join(LEFT, RIGHT, how)


@pytest.mark.parametrize("how", ["inner", "left", "semi", "anti"])
def test_join_random(spark, how):
    rng = random.Random(917)
    keys = [None, *range(6)]
    left = [{"k": rng.choice(keys), "v": f"l{i}"} for i in range(60)]
    right = [{"k": rng.choice(keys), "v": f"r{i}"} for i in range(55)]
    a, b = W.from_items(left, "k long, v string", spark), W.from_items(right, "k long, v string", spark)
    assert rows(a.join(b, "k", how=how).df) == naive_join(left, right, how)


def test_keys_of_two_families_never_match(spark):
    a, b = W.from_items([{"k": 1}], "k long", spark), W.from_items([{"k": "1"}], "k string", spark)
    assert a.join(b, "k").count() == 0 and a.join(b, "k", how="anti").count() == 1
    assert a.join(W.from_items([{"k": 1}], "k int", spark), "k").count() == 1
    assert a.join(W.from_items([{"k": 1.0}], "k double", spark), "k").count() == 0
    with pytest.raises(InvalidRequest):
        a.join(b, "k", strict=True)


def test_map_and_nested_keys(spark):
    a = spark.sql("SELECT map('x', 1, 'y', 2) k, array(null, 1) l")
    b = spark.sql("SELECT map('y', 2, 'x', 1) k, array(null, 1) l")
    assert joins.join(a, b, ["k", "l"]).count() == 1


def test_suffix_clash_is_an_error(spark):
    a = W.from_items([{"k": 1, "x": 1, "x_right": 2}], spark=spark)
    b = W.from_items([{"k": 1, "x": 3}], spark=spark)
    with pytest.raises(InvalidRequest):
        a.join(b, "k")


def test_right_on_keeps_both_and_presence(spark):
    a, b = W.from_items([{"k": 1}, {"k": 5}], spark=spark), W.from_items([{"j": 1, "z": None}], "j long, z string", spark)
    got = rows(a.join(b, "k", right_on="j", how="left", presence="hit").df)
    assert got == sorted([{"k": 1, "j": 1, "z": None, "hit": True}, {"k": 5, "j": None, "z": None, "hit": False}], key=repr)


def test_union_prepend_exclude(spark):
    a, b = W.from_items([{"k": 1}], spark=spark), W.from_items([{"k": 2, "z": "q"}], spark=spark)
    assert rows(a.union(b).df) == sorted([{"k": 1, "z": None}, {"k": 2, "z": "q"}], key=repr)
    with pytest.raises(InvalidRequest):
        a.union(W.from_items([{"k": "1"}], spark=spark))
    with pytest.raises(InvalidRequest):
        a.prepend(W.range(5, spark).rename_columns(["k"]), 3)
    left = W.from_items(LEFT, "k long, v string", spark)
    assert rows(left.exclude_keys(W.from_items(RIGHT, "k long, v string", spark), "k").df) == sorted([{"k": 2, "v": "c"}, {"k": None, "v": None}], key=repr)


def test_fold_order_and_dropped_groups(spark):
    data = W.from_items([{"k": 2, "v": "a", "o": 1}, {"k": 1, "v": "b", "o": 2}, {"k": 2, "v": "c", "o": 3}, {"k": 3, "v": "-", "o": 4}], spark=spark)

    def step(s, r):
        return None if r["v"] == "-" else {"k": r["k"], "v": (s["v"] if s else "") + r["v"]}

    assert rows(data.reduce_by_key("k", step, "k long, v string", order=["o"]).df) == [{"k": 1, "v": "b"}, {"k": 2, "v": "ac"}]


def test_fold_in_pieces_equals_fold_in_one(spark):
    df = spark.range(500).withColumn("k", F.col("id") % 3)
    step = lambda s, r: {"k": r["k"], "n": (s["n"] if s else 0) + r["id"]}
    one = groups.reduce_by_key(df, "k", step, "k long, n long")
    many = groups.reduce_by_key(df, "k", step, "k long, n long", combine=lambda a, b: {"k": a["k"], "n": a["n"] + b["n"]}, parts=7)
    assert rows(one) == rows(many)


def test_group_batches(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("a"), F.lit(7).alias("b"), F.col("id").alias("n"))
    got = groups.group_batches(df, ["a", "b"], 7, ["n"]).collect()
    for key in (0, 1):
        mine = sorted((r for r in got if r.a == key), key=lambda r: r.group_index)
        assert [len(r["items"]) for r in mine] == [7] * 7 + [1]
        assert [x.n for r in mine for x in r["items"]] == list(range(key, 100, 2))
        assert [r.group_last for r in mine] == [False] * 7 + [True]
    with pytest.raises(InvalidRequest):
        groups.group_batches(df, "a", 7, output="group_index")


def test_ordered_rank_hot_key_and_nulls(spark):
    df = spark.range(200).select(F.when(F.col("id") < 150, F.lit("hot")).when(F.col("id") < 170, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"), "id")
    got = {(r.k, r.id): (r["rank"], r.n) for r in ranking.ordered_rank(df, ["k"], ["id"], "rank", total="n").collect()}
    assert len(got) == 200
    for i in range(150):
        assert got[("hot", i)] == (i + 1, 150)
    assert [got[(None, i)][0] for i in range(150, 170)] == list(range(1, 21))


values = st.lists(st.one_of(st.none(), st.just(float("nan")), st.floats(-1e6, 1e6)), min_size=1, max_size=12)


@settings(max_examples=8, deadline=None)
@given(values)
def test_aggregates_treat_nan_as_null(spark, data):
    df = spark.createDataFrame([(v,) for v in data], "v double")
    good = [v for v in data if v is not None and not math.isnan(v)]
    got = A.aggregate(df, A.Count("v"), A.Count("v", ignore_nulls=True, alias="n"), A.Sum("v"), A.Min("v"), A.Max("v"), A.Mean("v"), A.AbsMax("v"), A.Sum("v", ignore_nulls=False, alias="strict"), A.Std("v"))
    assert got["count(v)"] == len(data) and got["n"] == len(good)
    if good:
        assert got["sum(v)"] == pytest.approx(sum(good), abs=1e-6) and got["min(v)"] == min(good) and got["max(v)"] == max(good)
        assert got["abs_max(v)"] == max(map(abs, good))
        if len(good) > 1:
            m = sum(good) / len(good)
            assert got["std(v)"] == pytest.approx(math.sqrt(sum((x - m) ** 2 for x in good) / (len(good) - 1)), rel=1e-6, abs=1e-6)
        else:
            assert math.isnan(got["std(v)"])
    else:
        assert got["sum(v)"] is None
    assert (got["strict"] is None) == (len(good) < len(data))


def test_aggregate_over_nothing_is_none(spark):
    assert A.aggregate(spark.range(0), A.Count()) is None
    assert W.Dataset(spark.range(0)).sum("id") is None
    assert W.range(4, spark).sum("id") == 6 and W.range(4, spark).std("id", ddof=4) != W.range(4, spark).std("id", ddof=4)


def test_own_aggregate_and_its_limit(spark):
    total = A.AggregateFn("total", lambda: 0, lambda s, b: s + b.num_rows, lambda a, b: a + b, lambda s: s * 10)
    assert A.aggregate(spark.range(37), total, A.Max("id")) == {"total": 370, "max(id)": 36}
    big = A.AggregateFn("big", lambda: b"", lambda s, b: b"x" * (A.STATE_LIMIT + 1), lambda a, b: a)
    with pytest.raises(Exception, match=StateLimitExceeded.__name__):
        A.aggregate(spark.range(3), big)


def test_components_against_naive(spark):
    rng = random.Random(4)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 260)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    want = {x: find(x) for x in parent}
    got = connected_components(spark.createDataFrame([*links, (None, 3)], "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_names_are_checked(spark):
    d = W.from_items(LEFT, "k long, v string", spark)
    with pytest.raises(KeyError):
        d.select_columns(["nope"])
    with pytest.raises(KeyError):
        d.drop_columns("nope")
    with pytest.raises(InvalidRequest):
        d.rename_columns({"k": "v"})
    with pytest.raises(InvalidRequest):
        d.rename_columns(["a"])
    assert d.rename_columns({"k": "q", "other": "z"}).columns() == ["q", "v"]
    assert d.select_columns(["v", "k"]).columns() == ["v", "k"]


def test_sort_limit_take_and_blocks(spark):
    d = W.range(20, spark)
    assert [r["id"] for r in d.sort("id", descending=True).take(3)] == [19, 18, 17]
    with pytest.raises(InvalidRequest):
        d.take_all(limit=5)
    assert len(d.take_all(limit=20)) == 20
    assert sorted(r["id"] for r in d.randomize_block_order(3).take_all()) == list(range(20))
    assert sorted(r["id"] for r in d.random_shuffle(3).take_all()) == list(range(20))
    assert d.repartition(rows_per_block=5).df.rdd.getNumPartitions() == 4
    assert [t.num_rows for t in d.iter_batches(8)] == [8, 8, 4] and [t.num_rows for t in d.iter_batches(8, drop_last=True)] == [8, 8]
    with d.materialize() as m:
        assert m.count() == 20 and m.num_blocks() >= 1
    assert d.size_bytes() > 0 and "Range" in d.stats()
    assert len(list(itertools.islice(d.iter_rows(), 3))) == 3
