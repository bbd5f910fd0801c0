import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.tables import DOC, documents, empty, read, with_clashes
from pyspark.sql import functions as F

from weftline.llm import mixing as M, packing as K, tokens as T


def naive(sizes, capacity, limit):
    """Bounded-space best fit over a plain list of open containers: sizes of all containers."""
    open_, done = [], []
    for s in sizes:
        while s > capacity:
            done.append([capacity])
            s -= capacity
        fit = [b for b in open_ if sum(b) + s <= capacity]
        if fit:
            b = max(fit, key=sum)
        else:
            if len(open_) >= limit:
                b = max(open_, key=sum)
                open_.remove(b)
                done.append(b)
            b = []
            open_.append(b)
        b.append(s)
        if sum(b) == capacity and len([x for x in open_ if x is b]) and fit:
            open_ = [x for x in open_ if x is not b]
            done.append(b)
    return done + open_


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 130), max_size=120), st.integers(1, 6))
def test_every_item_once_and_never_over(sizes, limit):
    capacity = 50
    bins = list(K.pack(enumerate(sizes), capacity, limit))
    pieces = {}
    for used, items in bins:
        assert used == sum(t for *_, t in items) <= capacity
        for key, piece, start, t in items:
            pieces.setdefault(key, []).append((start, t, piece))
    assert set(pieces) == set(range(len(sizes)))
    for key, p in pieces.items():
        p.sort()
        assert sum(t for _, t, _ in p) == sizes[key] and [x[2] for x in p] == list(range(len(p)))
        assert [x[0] for x in p] == [50 * i for i in range(len(p))] and (len(p) == 1 or sizes[key] > capacity)


def test_fill_equals_naive_best_fit():
    rng = np.random.default_rng(3)
    for limit in (1, 4, 32):
        sizes = rng.integers(1, 60, 400).tolist()
        got = list(K.pack(enumerate(sizes), 64, limit))
        assert abs(len(got) - len(naive(sizes, 64, limit))) <= 2
    assert len(list(K.pack(enumerate(sizes), 64, 32))) <= 1.15 * sum(sizes) / 64


def test_containers_over_tables(spark, small):
    docs, specs = read(spark, small, "documents"), read(spark, small, "pack_specs")
    got = K.containers(docs, specs, group_tokens=20_000)
    sizes = {r.doc_id: r.tokens for r in T.token_sizes(docs).collect() if r.tokens}
    for spec, cap in ((r.spec_id, r.capacity_tokens) for r in specs.collect()):
        seen = {}
        for r in got.where(F.col("spec_id") == spec).collect():
            assert r.used_tokens == sum(x.tokens for x in r["items"]) <= cap and r.fill == r.used_tokens / cap
            for x in r["items"]:
                seen[x.doc_id] = seen.get(x.doc_id, 0) + x.tokens
        assert seen == sizes
    assert got.groupBy("container_id").count().where("count > 1").count() == 0
    assert {r.spec_id for r in K.fill_report(got).collect()} == {1, 2, 3, 4}


def test_packing_dirt(spark):
    docs = documents(spark, [{"doc_id": 1, "text": "a b c"}, {"doc_id": 1, "text": "a b c"}, {"doc_id": None, "text": "x"}, {"doc_id": 2, "text": None}, {"doc_id": 3, "text": ""}, {"doc_id": 4, "text": "word " * 3000}])
    specs = spark.createDataFrame([(1, 10), (1, 10), (2, None), (3, 0), (4, -5)], "spec_id int, capacity_tokens int")
    for d, s in ((docs, specs), (with_clashes(docs), with_clashes(specs))):
        got = K.containers(d, s).collect()
        items = [x for r in got for x in r["items"]]
        assert {r.spec_id for r in got} == {1} and sorted((x.doc_id for x in items if x.doc_id != 4), key=repr) == [1, 1, None]
        assert sum(x.tokens for x in items if x.doc_id == 4) >= 3000
    assert K.containers(empty(spark, DOC), specs).count() == 0 and K.containers(docs, specs.limit(0)).count() == 0


def test_token_counts():
    enc = T.encoder(T.vocabulary())
    text = "Entre Brinigre et Ment, 896 maçons\n\n  ont réparé\n石楼 ж " * 40
    assert T.count_tokens(enc, text) == len(enc.encode_ordinary(text)) == T.count_tokens(enc, text, piece=97)
    assert T.count_tokens(enc, "") == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 80), st.floats(0.02, 0.98))
def test_flight_keeps_both_totals(seed, n, p):
    rng = np.random.default_rng(seed)
    size = rng.integers(1, 500, n).astype(float)
    q = M.flight(np.full(n, p), size, rng)
    assert ((q > M.EPS) & (q < 1 - M.EPS)).sum() <= 2 and (q >= 0).all() and (q <= 1).all()
    assert q.sum() == pytest.approx(n * p, abs=1e-5) and (q * size).sum() == pytest.approx(p * size.sum(), rel=1e-6, abs=1e-3)
    r = M.land(q, size)
    assert set(np.unique(np.round(r, 9))) <= {0.0, 1.0}


def test_flight_is_unbiased():
    size = np.array([5.0, 9.0, 1.0, 30.0, 2.0, 7.0, 7.0, 4.0])
    mean = np.mean([M.flight(np.full(8, 0.3), size, np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.allclose(mean, 0.3, atol=0.03)


def test_plan():
    uses = M.plan([("a", 0.5, 1), ("b", 0.3, 2), ("none", 0.2, 4), ("bad", None, 1)], {"a": (10, 1000), "b": (5, 200), "bad": (1, 5)})
    assert set(uses) == {"a", "b"} and uses["b"] == pytest.approx(2.0) and uses["a"] * 1000 / (uses["b"] * 200) == pytest.approx(5 / 3)
    assert M.plan([("a", 1.0, 1)], {}) == {}


@pytest.mark.parametrize("block", [50_000, 40])
def test_mixture_shares(spark, small, block):
    docs, targets = read(spark, small, "documents"), read(spark, small, "mix_targets")
    got = M.mixture(docs, targets, block=block)
    rows = got.collect()
    cap = {r.source_id: r.max_repeats for r in targets.collect()}
    assert len({r.doc_id for r in rows}) == len(rows) and all(1 <= r.repeats <= cap[r.source_id] for r in rows)
    s = {r.source_id: r for r in M.shares(got, targets).collect()}
    present = [x for x in s.values() if x.n_texts]
    assert s["feed-unopened"].n_tokens == 0
    total = sum(x.target_share for x in present)
    largest = max(r.tokens for r in rows) / sum(r.tokens * r.repeats for r in rows)
    for x in present:
        assert abs(x.actual_share - x.target_share / total) <= max(0.02, largest)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, M.mixture(docs, targets, block=block).collect()), key=repr)


def test_each_source_goes_by_its_own_size(spark):
    """A source of one block is flown and landed alike, whether another source has many blocks or not."""
    few = [{"doc_id": i, "id": f"d{i}", "text": "word " * (i % 17 + 1), "source_id": "few"} for i in range(40)]
    more = [{"doc_id": 100 + i, "id": f"e{i}", "text": "word " * (i % 13 + 1), "source_id": "many"} for i in range(150)]
    got = []
    for rows, block in ((few + more, 1000), (few + more, 50)):
        targets = spark.createDataFrame([("few", 0.1, 1), ("many", 0.9, 1)], "source_id string, weight double, max_repeats int")
        found = M.mixture(documents(spark, rows), targets, block=block)
        got.append(sorted(tuple(r) for r in found.where("source_id = 'few'").collect()))
        share = found.groupBy("source_id").sum("tokens").collect()
        totals = {r[0]: r[1] for r in share}
        assert abs(totals["few"] / sum(totals.values()) - 0.1) < 0.01
    assert got[0] == got[1] and got[0]


def test_mixing_dirt(spark):
    docs = documents(spark, [{"doc_id": i, "text": "word " * (3 + i % 7), "source_id": "ab"[i % 2]} for i in range(40)] + [{"doc_id": 99, "text": "x", "source_id": None}, {"doc_id": 98, "text": "x", "source_id": "zz"}, {"doc_id": 97, "text": None, "source_id": "a"}])
    targets = spark.createDataFrame([("a", 0.7, 2), ("a", 0.7, 2), ("b", 0.3, 1), ("c", 0.5, 3), (None, 0.1, 1), ("d", None, None)], "source_id string, weight double, max_repeats int")
    for d, t in ((docs, targets), (with_clashes(docs), with_clashes(targets))):
        got = M.mixture(d, t).collect()
        tokens = {s: sum(r.tokens * r.repeats for r in got if r.source_id == s) for s in "ab"}
        assert {r.source_id for r in got} == {"a", "b"} and tokens["a"] / sum(tokens.values()) == pytest.approx(0.7, abs=0.03)
    assert M.mixture(empty(spark, DOC), targets).count() == 0 and M.mixture(docs, targets.limit(0)).count() == 0
    assert M.shares(M.mixture(docs, targets.limit(0)), targets).count() >= 4


def test_queries_are_registered(spark, small):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"p{i}_found" for i in (1, 2, 3, 4, 5, 8)} | {"p6_containers", "p7_mixture"} <= names
    for n in ("p1_found", "p2_found", "p3_found", "p5_found", "p8_found"):
        assert __spark_entry__.queries()[n](spark, small).count() > 0
