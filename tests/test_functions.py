"""Text, URL, page, prompt and schema functions."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from weftline import dataset as W
from weftline.errors import InvalidRequest, UnsupportedSource
from weftline.functions import embeddings, html, jsonschema, prompts, text, urls


def test_terms(spark):
    df = spark.createDataFrame([("Ab cd_1 x 中文字",), (None,), ("",)], "t string")
    got = [set(r[0]) for r in df.select(text.terms(F.col("t"))).collect()]
    assert got == [{"ab", "cd_1", "中文字", "中文", "文字"}, set(), set()]


def test_urls(spark):
    cases = {
        "HTTP://Ex.TEST:80/a?b#c": "http://ex.test:80/a?b", "https://a.test": "https://a.test/", "http://u:p@x.test/": None, "ftp://x.test/": None, "http://": None, "http://x.test:99999/": None,
        "http://x.test/\x01": None, "not a url": None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.n for r in df.select("u", urls.normalize_url(F.col("u")).alias("n")).collect()} == cases
    policy = urls.url_policy(F.col("u"), ["bad.test"], [{"name": "ok", "action": "allow", "path_pattern": "^/ok"}, {"name": "no", "action": "exclude", "path_pattern": "/", "domains": ["x.test"]}])
    got = spark.createDataFrame([("http://s.bad.test/ok",), ("http://x.test/ok1",), ("http://a.x.test/z",), ("http://y.test/z",), (None,)], "u string").select(policy.alias("p")).collect()
    assert [r.p for r in got] == ["blocked_domain:bad.test", None, "url_rule:no", None, "invalid_url"]
    with pytest.raises(ValueError):
        urls.url_policy(F.col("u"), rules=[{"name": "x", "action": "deny", "path_pattern": "a"}])
    sites = spark.createDataFrame([("http://WWW.a.B.test:8080/x",), ("https://localhost/",), ("http://b.test./",)], "u string").select(urls.site_of(F.col("u")).alias("s"))
    assert [r.s for r in sites.collect()] == ["b.test", "localhost", "b.test"]


def test_pages():
    page = b"""<html><head><title>T</title></head><body><nav><p>no</p></nav><p>outside</p>
    <main><h1>A</h1><p>x <b>y</b><h2>B</h2><ul><li>1<li>2 <p>in</p></ul><table><tr><th>a<td>b</tr><tr><td>c</table>
    <figure><figcaption>cap</figcaption></figure><pre>l1
l2</pre></main><footer>no</footer></body></html>"""
    blocks, error = html.parse_page(page)
    assert error is None
    assert [(b["kind"], b["text"]) for b in blocks] == [
        ("heading", "A"), ("paragraph", "x y"), ("heading", "B"), ("list_item", "1"), ("list_item", "2 in"), ("table", "a | b\nc"), ("caption", "cap"), ("paragraph", "l1\nl2"),
    ]
    assert blocks[3]["headings"] == ["A", "B"] and [b["position"] for b in blocks] == list(range(8))
    assert html.parse_page(b"a\n\n b\nc", "text/plain")[0][1]["text"] == "b\nc"
    assert html.parse_page(None)[1] == "empty_body" and html.parse_page(b"<p></p>")[1] == "empty_body"
    assert html.parse_page(b"x", "application/pdf")[1].startswith("unsupported_media_type")
    assert html.parse_page(b"x", "text/html; charset=nope")[1] == "unsupported_charset"
    assert html.parse_page(b"<h1>Sign in</h1><input type=password>")[1] == "login_required"
    assert html.parse_page("<p>ж</p>".encode("cp1251"), "text/html; charset=windows-1251")[0][0]["text"] == "ж"


def test_encodings_as_browsers_tell_them():
    word = "żółw"
    cases = [
        (b"\xef\xbb\xbf" + word.encode(), "text/html; charset=latin1", "utf-8"), (b"\xff\xfe", "text/html", "utf-16-le"), (b"", 'text/html; charset="ISO-8859-1"', "cp1252"),
        (b"<html><head><meta charset='windows-1250'>", "text/html", "cp1250"), (b"<meta http-equiv='content-type' content='text/html; charset=koi8-r'>", "text/html", "koi8-r"),
        (b"<!-- <meta charset=koi8-r> -->", "text/html", "utf-8"), (b"<body><meta charset=koi8-r>", "text/html", "utf-8"), (b"<meta charset=utf-16>", "text/html", "utf-8"), (b"<meta charset=koi8-r>", "text/plain", "utf-8"),
    ]
    for body, kind, want in cases:
        assert html.encoding_of(body, kind).replace("_", "-") == want, (body, kind)
    head = b"<head>" + b"<style>p {}</style>" * 3000 + b"<meta charset=cp1250></head>"
    assert html.parse_page(head + f"<p>{word}</p>".encode("cp1250"))[0][0]["text"] == word
    for kind in ("text/html; charset=base64", "text/html; charset=rot13", "text/html; charset=none such"):
        assert html.parse_page(b"<p>x</p>", kind)[1] == "unsupported_charset"
    assert html.parse_page(b"<p>" + b"\xff" * 40 + b"</p>", "text/html; charset=utf-8")[1] == "damaged_text_encoding"
    assert html.parse_page(b"<p>" + b"\xff" * 3 + b"</p>", "text/html; charset=utf-8")[1] is None


def test_bodies_of_pages():
    def texts(page):
        return [b["text"] for b in html.parse_page(page)[0]]

    assert texts("<div class='sidebar'><p>a</p></div><div class='has-sidebar'><p>b</p></div><div class='Cookie-Notice x'>c</div>") == ["b"]
    assert texts("<div class='widget-area'><main><p>kept</p></main></div>") == ["kept"]
    assert texts("<article><p>short</p></article><article><p>a longer one</p></article>") == ["a longer one"]
    assert texts("<article><p>much longer than the body</p></article><div itemprop=articleBody><p>body</p></div>") == ["body"]
    assert texts("<div class='entry-content'></div><div role=main><p>m</p></div><p>out</p>") == ["m"]
    assert texts("<p>one<p>two<ul><li>a<ul><li>b</ul><li>c</ul><dl><dt>d<dd>e</dl>") == ["one", "two", "a b", "c", "d", "e"]
    assert texts("<table><tr><td>a<table><tr><td>b</table><tr><th>c<td>d</table>")[0].startswith("a b")
    assert texts("no blocks<br>at all") == ["no blocks", "at all"]
    assert texts("<head><p>in the head</p></head>") == ["in the head"] and texts("<template><p>x</p></template><p>y") == ["y"]
    page = html.parse_document("<title> A  b</title><meta property=author content=Me><meta name='article:published_time' content=2020><p>x</p>")
    assert (page["title"], page["author"], page["published_at"]) == ("A b", "Me", "2020")
    assert html.parse_page("<aside><input type=password></aside><div>x</div>")[1] is None and html.parse_page("<div id=captcha-box>x</div>")[1] == "captcha"
    assert len(texts("<div>" * 3000 + "<p>deep</p>")) == 1


def test_template_pieces():
    assert prompts.parse_template("a {{ x }}{{y|JSON}} b") == [("a ", "x", "text"), ("", "y", "json"), (" b", None, "text")]
    for bad in ("a }} b", "{{x}} }}", "{{ x y }}", "{{x|}}", "{{é}}", "{{}}", "{{x{{y}}", "{{1a}}", "{{x|json|text}}"):
        with pytest.raises(InvalidRequest):
            prompts.parse_template(bad)


def test_schemas_are_closed():
    closed = {"type": "object", "properties": {"a": {"type": ["number", "null"], "exclusiveMinimum": 0, "exclusiveMaximum": 5}, "d": {"type": "string", "format": "date"}, "t": {"type": "string", "format": "date-time"}}}
    jsonschema.check_schema(closed)
    assert jsonschema.errors_of({"a": None, "d": "2020-02-29", "t": "2020-01-01T00:00:00Z"}, closed) == []
    assert len(jsonschema.errors_of({"a": 5, "d": "2020-02-30", "t": "noon", "x": 1}, closed)) == 4
    assert jsonschema.errors_of({"x": 1}, closed | {"additionalProperties": True}) == []
    bad = [{"type": "array", "items": {}}, {"properties": {}}, {"type": "object", "required": ["a"]}, {"type": "object", "properties": {"a": {"type": ["string", "number"]}}}, {"type": "object", "properties": {"a": {"minLength": -1}}}, {"type": "object", "properties": {"a": {"enum": []}}}, {"type": "object", "properties": {"a": {"format": "time"}}}, {"type": "object", "properties": {"a": {"minimum": 3, "maximum": 2}}}, {"type": "object", "properties": {"a": {"type": "array"}}}, {"type": "object", "additionalProperties": {"type": "string"}}, []]
    for schema in bad:
        with pytest.raises(InvalidRequest):
            jsonschema.check_schema(schema)


def test_sections_and_ranges(spark):
    kinds = [("h", "heading", 1), ("a", "paragraph", None), ("i", "heading", 2), ("b", "paragraph", None), ("j", "heading", 1), ("c", "paragraph", None)]
    df = spark.createDataFrame([("d", b, i, k, [], t, lv) for i, (b, k, lv) in enumerate(kinds) for t in ["x"]], "document_id string, block_id string, position int, kind string, headings array<string>, text string, heading_level int")
    got = text.section_blocks(df, spark.createDataFrame([("d", "h"), ("d", "i")], "document_id string, block_id string"))
    assert {s: [r.block_id for r in got.where(F.col("section_id") == s).orderBy("position").collect()] for s in "hi"} == {"h": list("haib"), "i": list("ib")}
    p = text.position_ranges(spark.createDataFrame([("d", i) for i in (4, 1, 2, 2)], "d string, p int"), "d", "p").first()
    assert p.ranges == ["b000001..b000002", "b000004..b000004"]


def test_block_budget(spark):
    b = W.from_items([{"document_id": d, "position": p, "kind": "paragraph", "headings": [], "text": t} for d, p, t in (("x", 0, "copper bridge " * 5), ("x", 1, "copper bridge"), ("y", 0, "copper"), ("y", 1, "none"))], "document_id string, position int, kind string, headings array<string>, text string", spark)
    q = W.from_items([{"question_id": 1, "text": "copper bridge"}], spark=spark)
    got = b.read_documents(q, budget=20).take_all()
    assert {(r["document_id"], r["position"]) for r in got if r["admitted"]} == {("x", 1), ("y", 0)}
    assert sum(r["cost"] for r in got if r["admitted"]) <= 20


def test_templates(spark):
    df = W.from_items([{"a": "x", "n": 3, "l": [1, 2]}], spark=spark).df
    assert df.select(prompts.render(df, "A={{ a }} N={{n|json}} L={{l|json}}").alias("p")).first().p == "A=x N=3 L=[1,2]"
    for bad in ("", "{{a", "{{a|html}}", "{{a}} {{a|json}}", "{{l}}"):
        with pytest.raises(InvalidRequest):
            prompts.render(df, bad)
    with pytest.raises(InvalidRequest):
        prompts.render(df, "{{a}}", {"b": F.col("a")})


def test_prompts_retry_and_journal(spark, tmp_path):
    log = tmp_path / "log"
    log.write_text("")

    def client(request):
        with open(log, "a") as f:
            f.write(request + "\n")
        return json.dumps({"n": len(request)}) if "x" in request else "broken"

    d = W.from_items([{"a": "x"}, {"a": "x"}, {"a": "y"}], spark=spark)
    schema = {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}}
    for _ in range(2):
        got = d.map_prompt("say {{a}}", client, schema=schema, journal=str(tmp_path / "j")).take_all()
        assert sorted((r["a"], r["answer"], bool(r["error"])) for r in got if r["a"] == "x") == [("x", '{"n": 5}', False)] * 2
        assert [r["error"][:8] for r in got if r["a"] == "y"] == ["not JSON"]
    assert sorted(log.read_text().split("\n")) == ["", "say x"] + ["say y"] * 4  # what failed is asked again on the next run


def test_schema_subset():
    s = jsonschema.check_schema({"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "array", "items": {"type": "integer", "minimum": 1}, "maxItems": 2}, "b": {"anyOf": [{"type": "null"}, {"type": "string", "pattern": "^x"}]}}})
    assert jsonschema.errors_of({"a": [1, 2], "b": "xy"}, s) == []
    assert len(jsonschema.errors_of({"a": [0, True, 3], "b": "y", "c": 1}, s)) == 5
    assert jsonschema.errors_of([], s) == ["$: not object"]
    with pytest.raises(InvalidRequest):
        jsonschema.check_schema({"$ref": "#"})
    deep = {"type": "integer"}
    for _ in range(13):
        deep = {"type": "array", "items": deep}
    with pytest.raises(InvalidRequest):
        jsonschema.check_schema(deep)


def test_embeddings_and_objects(spark):
    d = W.from_items([{"t": "a b"}, {"t": " "}, {"t": None}], "t string", spark)
    got = d.map_embeddings("t", embeddings.HashEncoder(8), 8).take_all()
    assert sum(x * x for x in got[0]["embedding"]) == pytest.approx(1, abs=1e-5) and [r["error"] for r in got] == [None, "no text", "no text"]
    s = embeddings.document_spans(W.from_items([{"t": " ".join(map(str, range(10)))}], spark=spark).df, "t", 4, 1)
    assert [r.span for r in s.orderBy("span_index").collect()] == ["0 1 2 3", "3 4 5 6", "6 7 8 9"]
    o = spark.createDataFrame([(b"a", "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"), (b"b", "00"), (None, "00"), (b"x" * 20, "00")], "c binary, h string")
    assert [r.status for r in embeddings.verify_objects(o, "c", "h", 10).collect()] == ["ok", "sha256_mismatch", "missing", "too_large"]
    pre = embeddings.image_preflight("s", "m", "w", "h", 100, ["image/png"], 10, 200)
    i = spark.createDataFrame([(1, "image/PNG", 20, 20), (200, None, 1, 1), (1, "image/gif", 20, 20), (1, None, 5, 50), (1, None, 10, 10)], "s int, m string, w int, h int")
    assert [r.p for r in i.select(pre.alias("p")).collect()] == [None, "declared_size", "mime", "min_side", "min_pixels"]


def test_network_nodes_need_a_client(spark):
    with pytest.raises(UnsupportedSource):
        W.range(1, spark).map_client(None, "id long")
    assert rows(W.range(2, spark).map_client(lambda r: r, "id long").df) == [{"id": 0}, {"id": 1}]
