"""Callbacks over rows and batches."""

import pyarrow as pa
import pytest

from weftline import dataset as W
from weftline.errors import InvalidRequest


class Doubler:
    def __init__(self, by=2):
        self.by = by

    def __call__(self, row):
        return {"id": row["id"] * self.by}


def test_map_with_functions_classes_and_inference(spark):
    d = W.range(4, spark)
    assert sorted(r["id"] for r in d.map(Doubler, "id long", kwargs={"by": 3}).take_all()) == [0, 3, 6, 9]
    assert sorted(r["x"] for r in d.map(lambda r: {"x": str(r["id"])}).take_all()) == ["0", "1", "2", "3"]
    assert len(d.map(lambda r: {"x": 1 // r["id"]}, "x long", catch=(ZeroDivisionError,)).take_all()) == 3
    with pytest.raises(Exception, match="outside the schema"):
        d.map(lambda r: {"y": 1}, "x long").take_all()


def test_bound_maps(spark):
    d = W.from_items([{"a": 1, "b": "x"}], spark=spark)
    assert d.map(lambda a, b: f"{a}{b}", inputs=["a", "b"], output="c").take_all() == [{"a": 1, "b": "x", "c": "1x"}]
    assert d.map(lambda a: {"p": a, "b": "new"}, inputs=["a"], outputs=["p", "b"], returns="struct<p:long,b:string>").take_all() == [{"a": 1, "p": 1, "b": "new"}]
    assert d.map(lambda a: None, inputs=["a"]).count() == 1
    with pytest.raises(InvalidRequest):
        d.map(lambda *a: 1, inputs=["a"], output="c")
    with pytest.raises(InvalidRequest):
        d.map(lambda row: 1, inputs=["a"], output="c")
    with pytest.raises(KeyError):
        d.map(lambda z: 1, inputs=["z"], output="c")


def test_flat_map_and_filter(spark):
    d = W.range(4, spark)
    assert d.flat_map(lambda r: [{"z": r["id"]}] * r["id"], "z long").count() == 6
    with pytest.raises(Exception, match="several mappings"):
        d.flat_map(lambda r: {"z": 1}, "z long").take_all()
    assert d.filter(lambda r: r["id"] % 2).count() == 2 and d.filter("id > 2").count() == 1


def test_batches_have_the_asked_size(spark):
    d = W.range(31, spark)
    sizes = d.map_batches(lambda b: {"n": [len(b["id"])]}, "n long", 5, whole=True).take_all()
    assert sorted(r["n"] for r in sizes) == [1, 5, 5, 5, 5, 5, 5]

    def several(t):
        yield t
        yield t.slice(0, 1)

    assert d.map_batches(several, "id long", None, "pyarrow", whole=True).count() >= 32
    assert d.map_batches(lambda f: f.assign(id=f.id + 1), "id long", 7, "pandas").sum("id") == sum(range(32))
    with pytest.raises(InvalidRequest):
        d.map_batches(lambda b: b, "id long", batch_format="csv")


def test_add_column_and_failed_batches(spark):
    d = W.range(3, spark)
    assert [r["id"] for r in d.add_column("id", lambda f: f.id * 10, "long").sort("id").take_all()] == [0, 10, 20]
    with pytest.raises(Exception, match="values for"):
        d.add_column("x", lambda f: [1, 2, 3, 4, 5, 6, 7]).take_all()

    def fails(b):
        raise ValueError("no")

    got = d.batch_map(fails, "id long", failed="why").take_all()
    assert got and all(r["why"] == "ValueError: no" and r["id"] is None for r in got)


def test_async_rows_and_lifecycle(spark):
    class Actor:
        async def astart(self):
            self.add = 100

        async def __call__(self, row):
            return [{"id": row["id"] + self.add}] * (row["id"] % 2)

    assert sorted(r["id"] for r in W.range(5, spark).map_async(Actor, "id long").take_all()) == [101, 103]
    assert W.range(5, spark).map_async(lambda r: {"id": 1} if r["id"] else None, "id long").count() == 4


def test_arrow_in_and_out(spark):
    assert W.from_arrow(pa.table({"a": [1, 2]}), spark).sum("a") == 3
    assert W.Dataset(spark.range(3)).take_batch(2, "pyarrow").num_rows == 2


def test_dropped_rows_are_counted(spark):
    missed = spark.sparkContext.accumulator(0)
    got = W.from_items([{"k": k} for k in range(20)], "k long", spark).map(lambda r: {"share": 10 // (r["k"] % 4)}, "share long", catch=(ZeroDivisionError,), missed=missed)
    assert got.count() == 15 and missed.value == 5


def test_least_and_greatest_of_nothing(spark):
    from weftline.operators import aggregates as A

    none = W.from_items([{"v": None}], "v double", spark)
    assert none.aggregate(A.Min("v", alias="a", zero=lambda: 0.0), A.Max("v", alias="b")) == {"a": 0.0, "b": None}
    one = W.from_items([{"v": 3.0}], "v double", spark)
    assert one.aggregate(A.Min("v", alias="a", zero=lambda: 0.0), A.Max("v", alias="b", zero=lambda: 9.0)) == {"a": 3.0, "b": 3.0}
