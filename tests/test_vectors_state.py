"""Vector search, first arrivals, quotas, lookups and streams."""

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from weftline import dataset as W
from weftline.errors import InvalidRequest, StallError
from weftline.operators import stateful, vectors
from weftline.snapshot.table import VersionedTable
from weftline.streaming import ledger, streams


def exact(q, v, metric):
    if metric == "l2":
        return float(((q - v) ** 2).sum())
    d = float(q @ v)
    return 1 - d if metric == "dot" else 1 - d / (np.linalg.norm(q) * np.linalg.norm(v))


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_search_against_brute_force(spark, metric, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 5)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 16)
    rng = np.random.default_rng(7)
    data = rng.normal(size=(64, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(data)] + [(99, None, 1)], "id long, v array<float>, g int")
    got = vectors.search(df.where("id < 12"), df, "id", "v", "id", "v", 4, metric, where="id <> 5", same=("g", "g"), skip_self=True)
    have = {}
    for r in got.orderBy("query_id", "rank").collect():
        have.setdefault(r.query_id, []).append(r.match_id)
    for i in range(12):
        want = sorted((exact(data[i].astype(float), data[j].astype(float), metric), j) for j in range(64) if j not in (i, 5) and j % 3 == i % 3)[:4]
        assert have[i] == [j for _, j in want]


def test_index_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 16)) * 4
    data = (centres[rng.integers(0, 10, 400)] + rng.normal(size=(400, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, v array<float>")
    indexed, c = vectors.index_vectors(df, "id", "v", 10)
    assert indexed.count() == 400
    asked = df.where("id % 20 = 0")
    near = {(r.query_id, r.match_id) for r in vectors.search_index(asked, indexed, c, "id", "v", "id", "v", 10, probes=4).collect()}
    truth = {(r.query_id, r.match_id) for r in vectors.search(asked, df, "id", "v", "id", "v", 10).collect()}
    assert len(near & truth) / len(truth) >= 0.9


@pytest.mark.parametrize("bad", [None, [], [1.0], [float("nan"), 1.0], [1e300, 1.0], [True, 1.0], "ab", ["a", "b"], [0.0, 0.0]])
def test_bad_queries(bad):
    with pytest.raises((InvalidRequest, OverflowError)):
        vectors.check_vector(bad, 2, "cosine")


def test_embeddings_are_checked(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [float("nan"), 1.0])], "id int, v array<float>")
    got = {r.id: (r.error, r.v) for r in vectors.check_embeddings(df, "v", 2).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5)] == [None, "zero", "dimension", "null", "not finite"]
    assert got[1][1] == pytest.approx([0.6, 0.8]) and got[2][1] is None


def test_search_column_keeps_queries_without_hits(spark, tmp_path):
    W.from_items([{"vid": 1, "v": [1.0, 0.0], "t": "a"}], "vid long, v array<float>, t string", spark).write_table(str(tmp_path / "t"))
    q = W.from_items([{"id": 1, "q": [1.0, 0.0]}, {"id": 2, "q": None}], "id long, q array<float>", spark)
    got = {r["id"]: r["matches"] for r in q.search_vectors("id", "q", str(tmp_path / "t"), "vid", "v", ["t"], 3).take_all()}
    assert [m["t"] for m in got[1]] == ["a"] and got[2] == []


def test_first_arrivals_replay(spark, tmp_path):
    a = W.from_items([{"i": "a", "s": "x", "o": 1}, {"i": "b", "s": "x", "o": 2}, {"i": "c", "s": None, "o": 3}, {"i": "d", "s": None, "o": 4}], "i string, s string, o long", spark)
    once = a.deduplicate("s", "o", path=str(tmp_path / "w"), row_key="i")
    assert {r["i"] for r in once.take_all()} == {"a", "c"}
    back = W.from_items([{"i": "b", "s": "x", "o": 1}, {"i": "a", "s": "x", "o": 9}, {"i": "e", "s": "y", "o": 1}], "i string, s string, o long", spark)
    assert {r["i"] for r in back.deduplicate("s", "o", path=str(tmp_path / "w"), row_key="i").take_all()} == {"a", "e"}
    kept = stateful.first_arrivals(a.df, ["s"], "o", when=F.col("i") != "a")
    assert {(r.i, r.status) for r in kept.collect()} == {("a", "skipped"), ("b", "admitted"), ("c", "admitted"), ("d", "duplicate")}


def test_quotas_against_a_loop(spark):
    rng = random.Random(5)
    data = [{"id": i, "g": rng.randrange(4), "h": rng.randrange(3), "u": rng.randrange(60)} for i in range(150)]
    seen, used, want = set(), {}, []
    for r in data:
        full = next((q for q, n in (("g", 12), ("h", 20)) if used.get((q, r[q]), 0) >= n), None)
        if r["u"] in seen:
            want.append((r["id"], "duplicate"))
        elif full:
            want.append((r["id"], "limited"))
        else:
            seen.add(r["u"])
            for q in "gh":
                used[(q, r[q])] = used.get((q, r[q]), 0) + 1
            want.append((r["id"], "admitted"))
    d = W.from_items(data, spark=spark)
    got = d.admit_rows(["u"], {"g": 12, "h": 20}, ["id"]).take_all()
    assert sorted((r["id"], r["status"]) for r in got) == want
    one = {r["id"]: r["status"] for r in d.admit_rows(None, {"g": 5}, ["id"]).take_all()}
    for g in range(4):
        mine = [r["id"] for r in data if r["g"] == g]
        assert [one[i] for i in mine] == ["admitted"] * min(5, len(mine)) + ["limited"] * max(0, len(mine) - 5)


def test_lookup_list_limit(spark, tmp_path):
    W.from_items([{"k": "x' OR TRUE --", "t": "a"}, {"k": "y", "t": "b"}, {"k": "y", "t": "c"}], spark=spark).write_table(str(tmp_path / "t"))
    q = W.from_items([{"q": "x' OR TRUE --"}, {"q": None}, {"q": "y"}], "q string", spark)
    got = {r["q"]: [m["t"] for m in r["m"]] for r in q.lookup_table(str(tmp_path / "t"), {"q": "k"}, ["t"], "m", 2).take_all()}
    assert got == {"x' OR TRUE --": ["a"], None: [], "y": ["b", "c"]}
    with pytest.raises(Exception, match="more than 1 matches"):
        q.lookup_table(str(tmp_path / "t"), {"q": "k"}, ["t"], "m", 1).take_all()


def test_cached_map_calls_once(spark, tmp_path):
    log = tmp_path / "log"
    log.write_text("")

    def call(k):
        with open(log, "a") as f:
            f.write(f"{k}\n")
        return str(k)

    d = W.from_items([{"k": 1}, {"k": 1}, {"k": 2}], spark=spark)
    for _ in range(2):
        assert sorted(r["s"] for r in d.map_cached(call, ["k"], "s", "string", str(tmp_path / "c"), "1").take_all()) == ["1", "1", "2"]
    assert sorted(log.read_text().split()) == ["1", "2"]


def test_stream_sink_is_idempotent(spark, tmp_path):
    for part in range(2):
        spark.range(part * 10, part * 10 + 10).withColumn("k", F.col("id") % 4).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = W.Dataset(streams.read_stream(spark, str(tmp_path / "in"), per_batch=1))
    seen = []
    stats = src.save_table(str(tmp_path / "out"), str(tmp_path / "cp"), on_progress=seen.append)
    t = VersionedTable(spark, str(tmp_path / "out"))
    assert stats.rows_in == 20 and t.read().count() == 20 and t.head() == 2 and seen
    sink = streams.save_batches(t, "save")
    sink(spark.range(5).withColumn("k", F.lit(0)), 0)  # a batch that is there already
    assert t.head() == 2
    assert W.Dataset(src.df).deduplicate("k").save_table(str(tmp_path / "o2"), str(tmp_path / "cp2")).rows_in == 20
    assert VersionedTable(spark, str(tmp_path / "o2")).read().count() == 4


def test_stream_groups_and_stall(spark, tmp_path):
    spark.range(30).withColumn("k", F.col("id") % 2).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = W.Dataset(streams.read_stream(spark, str(tmp_path / "in")))
    src.group_batches("k", 4).save_table(str(tmp_path / "out"), str(tmp_path / "cp"), stall_timeout=60)
    got = VersionedTable(spark, str(tmp_path / "out")).read()
    assert rows(got.select("k", F.size("items").alias("n")).groupBy("k", "n").count()) == [{"k": 0, "n": 4, "count": 3}, {"k": 1, "n": 4, "count": 3}]
    with pytest.raises(StallError):
        streams.run_stream(src.df, lambda b, n: None, str(tmp_path / "cp3"), follow=True, stall_timeout=4)


def test_queue(spark, tmp_path):
    d = W.from_items([{"t": "a", "v": "1"}, {"t": "b", "v": "2"}], spark=spark)
    uri = str(tmp_path / "q")
    assert d.enqueue(uri, "t", "v") == 2 and d.enqueue(uri, "t", "v") == 2
    W.from_items([{"t": "c", "v": "3"}], spark=spark).enqueue(uri, "t", "v")
    W.from_items([{"t": "a", "v": "done"}], spark=spark).ack_queue(uri, "t", "v")
    got = W.read_queue(uri, through=2, results=True, spark=spark).take_all()
    assert [(r["sequence"], r["task_id"], r["result"]) for r in got] == [(1, "a", "done"), (2, "b", None)]


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_scan_and_blocks_agree(spark, monkeypatch, metric):
    """Few queries are sent to the vectors, many meet them in blocks: the same neighbours, with ties, nulls and kinds."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 6)), 1)
    rows = [(i, [float(y) for y in x[i % 250]], ["a", "b", None][i % 3]) for i in range(300)] + [(900, None, "a")]
    df = spark.createDataFrame(rows, "id long, v array<float>, kind string")
    asked = df.where("id % 7 = 0")
    for same, skip in ((None, True), (("kind", "kind"), False)):
        got = []
        for most in (2000, 0):
            monkeypatch.setattr(vectors, "SCAN_QUERIES", most)
            found = vectors.search(asked, df, "id", "v", "id", "v", 4, metric, same=same, skip_self=skip)
            got.append({(r.query_id, r.rank, r.match_id) for r in found.collect()})
        assert got[0] == got[1] and len(got[0]) > 100
    assert vectors.search(asked.limit(0), df, "id", "v", "id", "v", 4).count() == 0


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    from weftline import session

    class Context:
        master = "spark://host:7077"

    class Cluster:
        conf, sparkContext = spark.conf, Context()

    before = spark.conf.get("spark.checkpoint.dir", None)
    if before is None:
        with pytest.raises(InvalidRequest):
            session.scratch_root(Cluster())
    assert session.scratch_root(spark)


def test_ledger_goes_on_where_it_was_stopped(spark, tmp_path):
    table, log = VersionedTable(spark, str(tmp_path / "l")), tmp_path / "log"
    log.write_text("")

    def call(r):
        with open(log, "a") as f:
            f.write(f"{r['k']}\n")
        if r["k"] % 5 == 0:
            raise ValueError("no fives")
        return {"twice": 2 * r["k"]}

    df = spark.createDataFrame([(k, "x") for k in range(1, 21)] + [(None, "y")], "k long, note string")
    turns = iter([False, False, True])
    first = ledger.map_ledger(df, "k", call, "twice long", table, parts=4, stop=lambda: next(turns))
    some = first.count()
    assert 0 < some < 16 and table.head() == 2
    for run in range(3):
        got = ledger.map_ledger(df, "k", call, "twice long", table, parts=4)
        assert rows(got) == [{"k": k, "twice": 2 * k} for k in sorted(range(1, 21), key=lambda k: repr({"k": k, "twice": 2 * k})) if k % 5]
    asked = [int(x) for x in log.read_text().split()]
    assert all(asked.count(k) == (3 if k % 5 == 0 else 1) for k in range(1, 21))
    seen = {r.k: (r.state, r.attempts) for r in ledger.states(table, "k").collect()}
    assert seen[5] == ("failed", 3) and seen[4] == ("completed", 0)
    assert ledger.map_ledger(df.limit(0), "k", call, "twice long", VersionedTable(spark, str(tmp_path / "e"))).count() == 0
    with pytest.raises(InvalidRequest):
        ledger.map_ledger(df, "k", call, "state string", table)


def test_several_sinks_of_one_stream(spark, tmp_path):
    a, b = (VersionedTable(spark, str(tmp_path / n)) for n in "ab")
    broken = [True]

    def second(batch, number):
        if broken[0]:
            raise OSError("the second sink is away")
        streams.save_batches(b, "b")(batch, number)

    save = streams.save_to_all(streams.save_batches(a, "a"), second)
    df = spark.range(5).select("id")
    with pytest.raises(OSError):
        save(df, 0)
    broken[0] = False
    save(df, 0)
    save(df, 0)
    assert (a.head(), b.head()) == (1, 1) and rows(a.read()) == rows(b.read())


def test_claims_and_leases(spark, tmp_path):
    q = streams.MessageQueue(spark, str(tmp_path / "q"))
    q.enqueue(spark.createDataFrame([(f"t{i}", str(i)) for i in range(5)], "id string, v string"), "id", "v")
    assert [r.task_id for r in q.claim("w1", 2, 10, now=100.0).collect()] == ["t0", "t1"]
    assert [r.task_id for r in q.claim("w2", 2, 10, now=101.0).collect()] == ["t2", "t3"]
    q.ack(spark.createDataFrame([("t0", "done")], "id string, v string"), "id", "v")
    assert [(r.task_id, r.attempt) for r in q.claim("w3", 5, 10, now=110.5).collect()] == [("t1", 2), ("t4", 1)]
    assert q.claim("w4", 5, 10, attempts=2, now=130.0).count() == 3 and q.claim("w4", 5, 10, attempts=2, now=131.0).count() == 0
    assert sorted(r.task_id for r in q.dead_tasks(2, now=200.0).collect()) == ["t1", "t2", "t3", "t4"]
    assert q.dead_tasks(2, now=135.0).count() == 1
