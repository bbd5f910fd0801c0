"""Versioned tables, digests, catalogues, checkpoints, sinks and readers."""

import gzip
import sqlite3

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from weftline import dataset as W
from weftline.errors import CatalogConflict, InvalidRequest, ReleaseConflict, WriteConflict
from weftline.snapshot.catalog import Catalog, Releases, pin
from weftline.snapshot.digests import row_digest, table_digest
from weftline.snapshot.table import VersionedTable
from weftline.sources import readers, sinks
from weftline.streaming import streams

BASE = [{"id": 1, "value": "a", "other": "p"}, {"id": 2, "value": "b", "other": "q"}]
KIND = "id long, value string, other string"


def frame(spark, data, kind=KIND):
    return readers.from_items(data, kind, spark)


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.head() == 0
    assert t.commit(frame(spark, BASE), "create").version == 1
    with pytest.raises(WriteConflict):
        t.commit(frame(spark, BASE), "create")
    assert t.commit(frame(spark, [{"id": 3, "value": None, "other": "r"}]), "append", expected_version=1).version == 2
    with pytest.raises(WriteConflict):
        t.commit(frame(spark, BASE), "append", expected_version=1)
    with pytest.raises(InvalidRequest):
        t.commit(frame(spark, [{"id": 3}], "id int"), "append")
    t.commit(frame(spark, []), "overwrite")
    assert [t.read(v).count() for v in (1, 2, 3)] == [2, 3, 0]
    assert t.read(2, where="id > 1", projection={"n": "id + 1"}).agg(F.sum("n")).first()[0] == 7
    with pytest.raises(InvalidRequest):
        t.read(2, columns=["id"], projection={"n": "id"})
    with pytest.raises(InvalidRequest):
        t.manifest(9)
    op = t.manifest(2).operation_id
    assert t.find(op).version == 2 and t.find("nobody") is None
    assert t.clone(str(tmp_path / "copy"), 2).rows == 3
    assert t.retire(keep=1) == 2 and t.read().count() == 0


def test_lost_race_leaves_one_winner(spark, tmp_path):
    a, b = (VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    a.commit(frame(spark, BASE), "create")
    head = b.manifest()
    a.commit(frame(spark, BASE), "append")
    with pytest.raises(WriteConflict):
        b._publish(head.__class__(**{**head.__dict__, "version": 2}))
    assert a.head() == 2


class Stop(Exception):
    pass


@pytest.mark.parametrize("step", range(6))
def test_a_writer_that_stops_between_two_steps_leaves_a_table_to_go_on_with(spark, tmp_path, monkeypatch, step):
    """Stopped before or after each of the small files that a commit names: the next commit works, and rows are those of whole commits."""
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.commit(frame(spark, BASE), "create")
    real, calls = VersionedTable._name_once, []

    def stops(self, aside, target, overwrite):
        calls.append(1)
        if len(calls) == step // 2 + 1:
            if step % 2:
                real(self, aside, target, overwrite)
            raise Stop
        return real(self, aside, target, overwrite)

    monkeypatch.setattr(VersionedTable, "_name_once", stops)
    try:
        t.commit(frame(spark, BASE), "append", operation_id="lost", keys={"batch": "b1"})
        done = True
    except Stop:
        done = t.head() == 2
    monkeypatch.setattr(VersionedTable, "_name_once", real)
    again = VersionedTable(spark, str(tmp_path / "t"))
    assert (again.find("lost") is not None) == (again.find_key("batch", "b1") is not None) == done
    if not done:
        again.commit(frame(spark, BASE), "append", operation_id="lost", keys={"batch": "b1"})
    again.commit(frame(spark, BASE), "append")
    assert again.head() == 3 and again.read().count() == 6 and again.find("lost").version == 2


def test_another_writer_takes_the_version_of_a_mark(spark, tmp_path):
    """A mark that was written before its version lost the race proves nothing, also when that version is retired."""
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.commit(frame(spark, BASE), "create")
    stale = t.manifest().__class__(**{**t.manifest().__dict__, "version": 2, "operation_id": "loser"})
    t.commit(frame(spark, BASE), "append", operation_id="winner")
    with pytest.raises(WriteConflict):
        t._publish(stale)
    assert t.find("loser") is None and t.find("winner").version == 2
    t.commit(frame(spark, BASE), "append")
    t.retire(keep=1)
    assert t.find("loser") is None and t.find("winner").version == 2


def test_readers_after_retirement(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    save = streams.save_batches(t, "s")
    for i in range(20):
        save(frame(spark, [{"id": i, "value": "v", "other": None}]), i)
    assert t.head() == 20 and t.manifest().rows == 20 and len(t.manifest().files) == len(set(t.manifest().files))
    assert t.retire(keep=2) == 18 and [m.version for m in t.history()] == [19, 20]
    assert t.read().count() == 20 and t.read(19).count() == 19
    with pytest.raises(InvalidRequest):
        t.read(3)
    save(frame(spark, BASE), 7)  # a batch of a retired version is known
    assert t.head() == 20 and t.find("s:7").version == 8
    save(frame(spark, BASE), 20)
    assert t.read().count() == 22 and t.retire(keep=1) == 2 and t.read().count() == 22


def test_a_merge_rewrites_only_the_files_it_touches(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    for i in range(3):
        t.commit(frame(spark, [{"id": 10 * i + k, "value": "v", "other": "o"} for k in range(4)]).coalesce(1), "append")
    before = t.manifest().files
    t.merge(frame(spark, [{"id": 12, "value": None}, {"id": 99, "value": "n"}], "id long, value string"), "id", when_not_matched="insert")
    after = t.manifest().files
    assert len(set(before) & set(after)) == 2 and t.manifest().rows == t.read().count() == 13
    assert {r.id: r.value for r in t.read().where("id IN (11, 12, 99)").collect()} == {11: "v", 12: None, 99: "n"}
    assert t.merge(frame(spark, [{"id": 11, "value": "v"}], "id long, value string"), "id").status == "unchanged"


@pytest.mark.parametrize("unmatched", ["error", "ignore", "insert"])
def test_merge(spark, tmp_path, unmatched):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.commit(frame(spark, BASE), "create")
    patch = frame(spark, [{"id": 2, "value": None}, {"id": 9, "value": "n"}], "id long, value string")
    if unmatched == "error":
        with pytest.raises(InvalidRequest):
            t.merge(patch, "id")
        assert t.head() == 1
        return
    got = t.merge(patch, "id", when_not_matched=unmatched)
    assert got.stats["updated"] == 1 and got.stats["ignored"] == (unmatched == "ignore")
    want = [{"id": 1, "value": "a", "other": "p"}, {"id": 2, "value": None, "other": "q"}]
    want += [{"id": 9, "value": "n", "other": None}] if unmatched == "insert" else []
    assert rows(t.read()) == sorted(want, key=repr)
    assert t.merge(patch.limit(0), "id", when_not_matched=unmatched).status == "unchanged" and t.head() == 2


def test_merge_refuses_bad_keys_and_columns(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.commit(frame(spark, BASE), "create")
    for data, kind in (([{"id": 1, "value": "x"}] * 2, "id long, value string"), ([{"id": None, "value": "x"}], "id long, value string"), ([{"id": 1, "z": 1}], "id long, z int"), ([{"id": 1, "value": 3}], "id long, value int")):
        with pytest.raises(InvalidRequest):
            t.merge(frame(spark, data, kind), "id", when_not_matched="insert")


def test_add_columns(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.commit(frame(spark, BASE), "create")
    t.add_columns("score double", expected_version=1)
    assert t.read(columns=["score"]).where("score IS NULL").count() == 2
    with pytest.raises(InvalidRequest):
        t.add_columns("score int")
    t.commit(t.read().withColumn("score", F.lit(1.0)), "append")
    assert t.read().agg(F.sum("score")).first()[0] == 2.0


def test_digests_tell_types_apart(spark):
    kinds = ["true", "false", "0", "1", "1D", "'1'", "X'31'", "array(1)", "map('1', 1)", "named_struct('1', 1)", "CAST(NULL AS INT)"]
    seen = {row_digest(spark.sql(f"SELECT {k} AS v")).first()["digest"] for k in kinds}
    assert len(seen) == len(kinds) - 1  # a map and a struct of the same entries are the same object
    a = spark.sql("SELECT 1 AS x, 'q' AS y")
    assert row_digest(a).first()["digest"] == row_digest(a.select("y", "x")).first()["digest"]
    with pytest.raises(Exception, match="NaN"):
        row_digest(spark.sql("SELECT double('NaN') AS v")).collect()
    d = spark.range(50)
    assert table_digest(d) == table_digest(d.orderBy(F.desc("id")).repartition(7)) != table_digest(d.where("id > 0"))


def test_catalog_and_releases(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.commit(frame(spark, BASE), "create")
    ref = pin(spark, "t", str(tmp_path / "t"))
    cat = Catalog(spark, str(tmp_path / "cat"))
    assert cat.register(ref) == cat.register(ref) == 1 and cat.get("t") == ref and cat.get("no") is None
    t.commit(frame(spark, BASE), "append")
    with pytest.raises(CatalogConflict):
        cat.register(pin(spark, "t", str(tmp_path / "t")))
    rel = Releases(spark, str(tmp_path / "rel"))
    assert rel.register("r1", [ref]) == rel.register("r1", [ref]) == 1 and rel.open("r1") == {"t": ref}
    with pytest.raises(ReleaseConflict):
        rel.register("r1", [])
    with pytest.raises(ReleaseConflict):
        rel.open("none")


def test_checkpoints(spark, tmp_path):
    d = W.range(5, spark)
    assert d.checkpoint(str(tmp_path / "c"), "1").count() == 5
    assert W.range(9, spark).checkpoint(str(tmp_path / "c"), "1").count() == 5
    with pytest.raises(InvalidRequest):
        d.checkpoint(str(tmp_path / "c"), "2")
    d.checkpoint_async(str(tmp_path / "c2"), "1").join()
    assert d.checkpoint(str(tmp_path / "c2"), "1").count() == 5
    assert d.checkpoint_table(str(tmp_path / "c3")).count() == d.checkpoint_table(str(tmp_path / "c3")).count() == 5


def test_own_sink_fails_as_a_whole(spark):
    calls = []

    class Sink(sinks.Sink):
        def on_write_start(self):
            calls.append("start")

        def write(self, blocks, partition):
            for b in blocks:
                if 7 in b.column(0).to_pylist():
                    raise RuntimeError("seven")
            return partition

        def on_write_complete(self, results):
            calls.append("complete")
            return sum(r.rows for r in results)

        def on_write_failed(self, error):
            calls.append("failed")

    assert W.range(5, spark).write_datasink(Sink()) == 5
    with pytest.raises(Exception, match="seven"):
        W.range(9, spark).write_datasink(Sink())
    assert calls == ["start", "complete", "start", "failed"]


def test_key_values(spark, tmp_path):
    kv = sinks.KeyValueSink(VersionedTable(spark, str(tmp_path / "kv")))
    kv.put(frame(spark, [{"key": "a", "value": "1"}], "key string, value string"))
    kv.put(frame(spark, [{"key": "a", "value": "2"}, {"key": "b", "value": "3"}], "key string, value string"))
    got = W.from_items([{"k": "a"}, {"k": "z"}, {"k": None}], "k string", spark).lookup(W.Dataset(kv.table.read()), "k", "f").take_all()
    assert sorted(((r["k"], r["f"]["hit"], r["f"]["value"]) for r in got), key=repr) == sorted([("a", True, "2"), ("z", False, None), (None, False, None)], key=repr)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,description\nQ1,"a, ""b""\nc"\nQ2,\n', encoding="utf-8-sig")
    assert rows(readers.read_csv(str(tmp_path / "a.csv"), spark=spark)) == [{"id": "Q1", "description": 'a, "b"\nc'}, {"id": "Q2", "description": ""}]
    (tmp_path / "a.txt").write_text("x\n\ny\n")
    assert readers.read_text(str(tmp_path / "a.txt"), spark=spark).count() == 2
    assert readers.read_text(str(tmp_path / "a.txt"), drop_empty_lines=False, spark=spark).count() == 3
    (tmp_path / "l.txt").write_bytes("é\n".encode("latin-1"))
    assert readers.read_text(str(tmp_path / "l.txt"), encoding="ISO-8859-1", spark=spark).first().text == "é"
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.read_json(str(tmp_path / "a.json"), lines=False, spark=spark).count() == 2
    got = readers.read_binary_files(str(tmp_path / "a.txt"), include_paths=True, spark=spark).first()
    assert bytes(got.bytes) == b"x\n\ny\n" and got.path.endswith("a.txt")
    d = spark.createDataFrame([(1, float("nan"))], "a int, b double")
    with pytest.raises(Exception, match="NaN"):
        sinks.write_json(d, str(tmp_path / "out"))


def test_located_records(spark, tmp_path):
    body = b'{"id":1}\ninvalid\n\xff\n{"id":4}\n'
    (tmp_path / "a.jsonl").write_bytes(body)
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress(body))
    for name in ("a.jsonl", "b.jsonl.gz"):
        got = readers.read_records(str(tmp_path / name), schema="id long", spark=spark).orderBy("row").collect()
        assert [r.row for r in got] == [1, 2, 3, 4]
        assert [r.value and r.value.id for r in got] == [1, None, None, 4]
        assert [r.error is None for r in got] == [True, False, False, True] and bytes(got[2].raw) == b"\xff"


def test_memory_sources(spark, tmp_path):
    assert rows(W.from_numpy(np.array([[1, 2], [3, 4]]), spark).df) == [{"data": [1, 2]}, {"data": [3, 4]}]
    assert W.from_pandas([pd.DataFrame({"a": [1]}), pd.DataFrame({"a": [2]})], spark).sum("a") == 3
    assert W.from_iter(lambda: ({"a": i} for i in range(3000)), "a long", spark).count() == 3000
    with pytest.raises(InvalidRequest):
        W.from_items(iter([]), spark=spark)
    con = sqlite3.connect(tmp_path / "db")
    con.execute("CREATE TABLE receipts (document_id TEXT, receipt TEXT)")
    con.execute("INSERT INTO receipts VALUES ('d', '{}')")
    con.commit()
    con.close()
    path = str(tmp_path / "db")
    assert readers.read_sql("SELECT document_id FROM receipts WHERE document_id = ?", lambda: sqlite3.connect(path), "document_id string", ("d",), spark).count() == 1
    import hashlib

    digest = hashlib.sha256((tmp_path / "db").read_bytes()).hexdigest()
    assert readers.read_receipts(path, digest, spark=spark).count() == 1
    with pytest.raises(InvalidRequest):
        readers.read_receipts(path, "00", spark=spark)
