import re
from collections import defaultdict

import pytest
from llm.tables import BLOCK, DOC, URL, blocks, documents, empty, read, with_clashes

from weftline.llm import site_lines as S
from weftline.llm.oracles import ORACLES


def site(url):
    m = re.match(r"\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)", url or "")
    return ".".join(m.group(1).lower().split(".")[-2:]) if m and m.group(1) else None


def brute(docs, urls, blks, least=6):
    ids, sites = {d["id"]: d["doc_id"] for d in docs}, {}
    for u in urls:
        s = site(u["url"])
        if s and u["document_id"] in ids:
            sites[u["document_id"]] = min(s, sites.get(u["document_id"], s))
    seen, at = defaultdict(set), defaultdict(set)
    for b in blks:
        d = b["document_id"]
        if d in sites and b["text"] is not None:
            for i, line in enumerate(b["text"].split("\n")):
                n = "".join(c for c in line.lower() if c.isalpha())
                if len(n) >= 4:
                    seen[(sites[d], n)].add(d)
                    at[(sites[d], n)].add((ids[d], b["position"], i))
    return {x for k, v in at.items() if len(seen[k]) >= least for x in v}


def test_against_brute_force(spark, small):
    tables = [read(spark, small, n) for n in ("documents", "urls", "blocks")]
    got = {tuple(r) for r in S.repeated_lines(*tables).collect()}
    assert got == brute(*[[r.asDict() for r in t.collect()] for t in tables]) and got


def toy(spark):
    docs = documents(spark, [{"doc_id": i, "id": f"d{i}", "observed": 86400.0 * i} for i in range(8)] + [{"doc_id": 50, "id": "none", "observed": None}])
    urls = spark.createDataFrame([(f"http://W{i}.Site.test:80/x", f"d{i}") for i in range(8)] + [("http://a.test/", "gone"), (None, "d1"), ("no url", "d2"), ("http://z.test", None)], URL)
    rows = [{"document_id": f"d{i}", "position": 0, "text": f"Share THIS, page {i}!\nabc\nown line number {'abcdefgh'[i] * 5}"} for i in range(6)]
    rows += [rows[0], {"document_id": "d6", "position": 1, "text": None}, {"document_id": None, "position": 1, "text": "share this page"}, {"document_id": "gone", "position": 0, "text": "share this page"}]
    rows += [{"document_id": "d7", "position": None, "text": ""}]
    return docs, urls, blocks(spark, rows)


def test_threshold_case_marks_and_doubles(spark):
    docs, urls, blks = toy(spark)
    assert {tuple(r) for r in S.repeated_lines(docs, urls, blks).collect()} == {(i, 0, 0) for i in range(6)}
    assert S.repeated_lines(docs, urls, blks, min_documents=7).count() == 0
    got = {r.doc_id: r.text for r in S.without_lines(docs, blks, S.repeated_lines(docs, urls, blks)).collect()}
    assert got[0] == "abc\nown line number aaaaa" and got[7] == "" and got[50] == "" and len(got) == 9


def test_copies_are_one_cluster(spark):
    docs, urls, _ = toy(spark)
    same = blocks(spark, [{"document_id": f"d{i}", "position": 0, "text": "the same article published again"} for i in range(7)])
    assert S.repeated_lines(docs, urls, same, min_clusters=1, min_days=0).count() == 7
    assert S.repeated_lines(docs, urls, same, min_clusters=2).count() == S.repeated_lines(docs, urls, same).count() == 0
    lines = S.document_lines(docs, urls, same)
    row = S.line_counts(lines).first()
    assert (row.n_docs, row.n_clusters, row.n_days) == (7, 1, 1)


def test_one_hot_line(spark):
    n = 3000
    docs = documents(spark, [{"doc_id": i, "id": f"d{i}"} for i in range(n)])
    urls = spark.createDataFrame([("http://x.one.test/", f"d{i}") for i in range(n)], URL)
    blks = blocks(spark, [{"document_id": f"d{i}", "position": 0, "text": "everywhere the same line"} for i in range(n)])
    assert S.repeated_lines(docs, urls, blks, min_clusters=1, min_days=0).count() == n
    own = blks.unionByName(blocks(spark, [{"document_id": f"d{i}", "position": 1, "text": "own " + "abcdefghij"[i % 10] * (i // 10 + 3)} for i in range(n)]))
    assert S.repeated_lines(docs, urls, own).count() == n


def test_an_article_published_again_is_kept(spark):
    """Six snapshots of one article among other pages: its lines stay, the share line of all pages goes."""
    docs = documents(spark, [{"doc_id": i, "id": f"d{i}", "observed": 86400.0 * i} for i in range(14)])
    urls = spark.createDataFrame([(f"http://w.site.test/{i}", f"d{i}") for i in range(14)], URL)
    article = "The copper bridge was moved in spring\nNobody knows why"
    rows = [{"document_id": f"d{i}", "position": 0, "text": f"Share this page\n{article}"} for i in range(7)]
    rows += [{"document_id": f"d{i}", "position": 0, "text": f"Share this page\nanother line {'abcdefghijklmn'[i] * 4}"} for i in range(7, 14)]
    blks = blocks(spark, rows)
    found = S.repeated_lines(docs, urls, blks)
    assert {tuple(r) for r in found.collect()} == {(i, 0, 0) for i in range(14)}
    assert {r.doc_id: r.text for r in S.without_lines(docs, blks, found).collect()}[3] == article
    assert S.repeated_lines(docs, urls, blks, min_clusters=1, min_days=0).count() == 28
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name, df in (("documents", docs), ("urls", urls), ("blocks", blks)):
        con.register(name, df.toArrow())
    assert set(con.sql(ORACLES["p1_found"]).fetchall()) == {(i, 0, 0) for i in range(14)}
    assert dict(con.sql(ORACLES["p1_clean"]).fetchall())[3] == article


def test_empty_and_clashing(spark):
    docs, urls, blks = toy(spark)
    assert S.repeated_lines(empty(spark, DOC), empty(spark, URL), empty(spark, BLOCK)).count() == 0
    assert S.repeated_lines(docs, empty(spark, URL), blks).count() == 0
    a, b, c = with_clashes(docs), with_clashes(urls), with_clashes(blks)
    found = S.repeated_lines(a, b, c)
    assert found.count() == 6 and S.without_lines(a, c, found).count() == 9
