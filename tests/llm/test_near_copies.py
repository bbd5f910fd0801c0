import random
import re

import numpy as np
from llm.tables import BLOCK, DOC, blocks, documents, empty, read, with_clashes
from pyspark.sql import functions as F

from weftline.llm import near_copies as N, page_tree as P

WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")


def sequences(texts):
    out = set()
    for t in texts:
        w = WORD.findall(t.lower())
        out |= {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    return out


def test_words_and_sequences_against_regex():
    texts = ["Ab c-d 12x ÉCOLE, ж9", "中文ab字 x", "", "one", "a_b c__d", "x " * 3000]
    s, own, word_own, _ = N.shingles(texts, np.arange(len(texts)))
    for i, t in enumerate(texts):
        assert (own == i).sum() == len(sequences([t])) and (word_own == i).sum() == len(WORD.findall(t.lower()))


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(1)
    for share in (0.1, 0.5, 0.8):
        errors = []
        for _ in range(20):
            both = rng.integers(0, 1 << 63, int(400 * share), dtype=np.uint64)
            a = np.concatenate((both, rng.integers(0, 1 << 63, 400 - len(both), dtype=np.uint64)))
            b = np.concatenate((both, rng.integers(0, 1 << 63, 300, dtype=np.uint64)))
            ra, rb, ru = (N.sketch(np.sort(x), np.array([0])) for x in (a, b, np.union1d(a, b)))
            assert (np.maximum(ra, rb) == ru).all()
            j = len(both) / len(np.union1d(a, b))
            errors.append(N.likelihood_similarity(ra, rb, np.array([len(a)]), np.array([len(b)]))[0] - j)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06
    big = np.sort(rng.integers(0, 1 << 63, 40000, dtype=np.uint64))
    assert (N.sketch(big, np.array([0])) == np.maximum(N.sketch(big[:20000], np.array([0])), N.sketch(big[20000:], np.array([0])))).all()


def brute(docs, found):
    """Pairs by definition, from the blocks outside ``found``."""
    sets = {d: sequences(t) for d, t in docs.items() if sum(len(WORD.findall(x.lower())) for x in t) >= 40}
    out, ids = set(), sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.5 * len(sets[a] | sets[b]):
                out.add((a, b))
    return out


def test_against_all_pairs(spark, small):
    docs, blks = read(spark, small, "documents"), read(spark, small, "blocks")
    model = P.fit_pages(docs, blks)
    gone = {(r.doc_id, r.position) for r in P.page_furniture(docs, blks, model).collect()}
    texts, ids = {}, {r.id: r.doc_id for r in docs.collect()}
    for r in blks.dropDuplicates(["document_id", "position"]).collect():
        if r.document_id in ids and (ids[r.document_id], r.position) not in gone:
            texts.setdefault(ids[r.document_id], []).append(r.text)
    pairs, members = N.near_copies(docs, blks, model=model)
    assert {tuple(r) for r in N.all_pairs(pairs, members).collect()} == brute(texts, gone)


def made(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(120)]
    edits = [base[:], base[:], base[:60] + ["new"] + base[60:], base[:50] + base[55:], base[60:] + base[:60], [rng.choice(words) for _ in range(120)], base[:39], base[:40], base[:40]]
    docs = documents(spark, [{"doc_id": i, "id": f"d{i}"} for i in range(len(edits))] + [{"doc_id": 90, "id": "n"}, {"doc_id": None, "id": "z"}])
    rows = [{"document_id": f"d{i}", "position": 0, "text": " ".join(e) + "."} for i, e in enumerate(edits)]
    rows += [rows[0], {"document_id": "n", "position": 0, "text": None}, {"document_id": "gone", "position": 0, "text": rows[0]["text"]}, {"document_id": None, "position": 0, "text": "x"}]
    texts = {i: [" ".join(e)] for i, e in enumerate(edits)}
    return docs, blocks(spark, rows), texts


def test_made_copies_groups_and_clashes(spark, small):
    model = P.fit_pages(read(spark, small, "documents"), read(spark, small, "blocks"))
    docs, blks, texts = made(spark)
    want = brute(texts, set())
    for d, b in ((docs, blks), (with_clashes(docs), with_clashes(blks))):
        pairs, members = N.near_copies(d, b, model=model)
        assert {tuple(r) for r in N.all_pairs(pairs, members).collect()} == want
        groups = {r.doc_id: r.group_id for r in N.groups(pairs, members).collect()}
        assert {k for k, v in groups.items() if v == 0} == {0, 1, 2, 3, 4} and groups[7] == groups[8] == 7 and groups[5] == 5 and 6 not in groups


def test_third_of_all_rows_are_copies(spark, small):
    model = P.fit_pages(read(spark, small, "documents"), read(spark, small, "blocks"))
    text = " ".join(f"word{i} copper bridge" for i in range(40)) + "."
    n = 150
    docs = documents(spark, [{"doc_id": i, "id": f"d{i}"} for i in range(n)])
    blks = blocks(spark, [{"document_id": f"d{i}", "position": 0, "text": text if i % 3 == 0 else f"{text} " + " ".join(f"own{i}x{k}" for k in range(300))} for i in range(n)])
    pairs, members = N.near_copies(docs, blks, model=model)
    assert pairs.count() == 0 and N.all_pairs(pairs, members).count() == 50 * 49 // 2


def test_hot_keys_meet_in_blocks(spark):
    rng = random.Random(3)
    rows = [(k, d) for d in range(60) for k in {rng.randrange(12), 99}]  # every document has key 99
    band = spark.createDataFrame(rows, "key long, doc_id long")
    want = {(a, b) for k, a in rows for q, b in rows if k == q and a < b}
    for block in (4, 1000):
        got = [tuple(r) for r in N.candidates(band, block).collect()]
        assert set(got) == want and len(got) == len(want)


def test_marks_keep_every_partner(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"))
    pairs = spark.createDataFrame([(i, i + 7) for i in range(0, 4000, 40)], "a long, b long")
    ends = {x for i in range(0, 4000, 40) for x in (i, i + 7)}
    got = {r.doc_id for r in N.marked(docs, pairs).collect()}
    assert ends <= got and len(got) < len(ends) + 20
    assert N.marked(docs, pairs.limit(0)).count() == 0


def test_pairs_at_the_threshold_are_met():
    """The share of pairs at similarity 0.5 that have a band in common."""
    rng = np.random.default_rng(8)
    met = 0
    for _ in range(150):
        both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (300, 150, 150))
        ra, rb = (N.sketch(np.sort(np.concatenate((both, x))), np.array([0])) for x in (a, b))
        met += (N.band_keys(ra) == N.band_keys(rb)).any()
    assert met >= 148


def test_empty(spark):
    pairs, members = N.near_copies(empty(spark, DOC), empty(spark, BLOCK))
    assert N.all_pairs(pairs, members).count() == 0 and N.groups(pairs, members).count() == 0
