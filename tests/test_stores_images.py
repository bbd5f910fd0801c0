import struct

from weftline import dataset as W
from weftline.functions import images
from weftline.session import execution, materialize, release
from weftline.snapshot.stores import Library, append_new
from weftline.snapshot.table import VersionedTable

PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 40, 30)
GIF = b"GIF89a" + struct.pack("<HH", 7, 9) + b"\0" * 8
BMP = b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6) + b"\0" * 4
JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 6) + b"abcd" + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 12, 34) + b"\0" * 12
WEBP = b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")


def test_probe(spark):
    want = [("png", 40, 30), ("gif", 7, 9), ("bmp", 5, 6), ("jpeg", 34, 12), ("webp", 100, 50)]
    assert [images.probe(x) for x in (PNG, GIF, BMP, JPEG, WEBP)] == want
    assert images.probe(None) is images.probe(b"x" * 40) is images.probe(b"\xff\xd8\xff") is None
    df = images.image_sizes(spark.createDataFrame([(PNG,), (GIF,), (None,)], "b binary"), "b")
    assert [r.r for r in df.select(images.size_reason("image", min_side=8).alias("r")).collect()] == [None, "min_side", "not_an_image"]


def test_append_new_and_library(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    d = W.from_items([{"k": "a", "v": 1}, {"k": "a", "v": 1}, {"k": None, "v": 2}], "k string, v long", spark).df
    assert append_new(t, d, "k").rows == 1 and append_new(t, d, "k") is None and t.head() == 1
    lib = Library(spark, str(tmp_path / "lib"))
    urls = spark.createDataFrame([("HTTP://A.test", "d1"), ("http://a.test/", "d2"), ("ftp://x", "d3")], "url string, document_id string")
    lib.register(spark.createDataFrame([("d1", "x")], "id string, t string"), urls)
    red = spark.createDataFrame([("http://old.test/", "http://a.test/#top")], "url string, target_url string")
    asked = spark.createDataFrame([("http://a.test",), ("http://old.test/",), ("http://no.test/",), (None,)], "url string")
    got = {r.url: r.document_id for r in lib.resolve(asked, red).collect()}
    assert got["http://a.test"] == got["http://old.test/"] and got["http://a.test"] in ("d1", "d2") and got["http://no.test/"] is got[None] is None


def test_execution_settings_come_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with execution(spark, 3):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_intermediate_tables_are_released(spark):
    release(spark)
    d = materialize(spark.range(5), "t")
    e = materialize(spark.range(0).selectExpr("id", "cast(null as array<string>) a"), "t")
    assert d.count() == 5 and e.count() == 0 and e.columns == ["id", "a"]
    assert release(spark) == 2 and release(spark) == 0


def test_bitmaps_of_both_headers():
    import struct

    from weftline.functions.images import probe

    assert probe(b"BM" + b"\0" * 12 + struct.pack("<IHHHH", 12, 7, 9, 1, 24)) == ("bmp", 7, 9)
    assert probe(b"BM" + b"\0" * 12 + struct.pack("<IiiHH", 40, 7, -9, 1, 24)) == ("bmp", 7, 9)
