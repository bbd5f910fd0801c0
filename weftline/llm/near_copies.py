"""Problem 4: documents that are edited copies or snapshots of one another.

Method: the article of a document (see ``page_tree``) is the set of its
sequences of three successive words.  SetSketch registers - per register the
least exponential variate over the set, on an exponential scale with base
``BASE``, truncated to 16 bits - are mergeable by maximum and agree with
probability close to the similarity.  ``BANDS`` fixed groups of ``ROWS``
registers are the keys under which documents meet; the similarity of a pair is
then estimated by maximum likelihood from the registers of both and their two
cardinalities, and pairs near the threshold or above are verified on the
sets themselves.

Documents with equal sets form one class and only its least id takes part;
found pairs are expanded to all members at the end.  A band key that many
representatives share is split: its members fall into blocks of about ``BLOCK``,
and each pair of blocks is a join key of its own, so no task sees more than
``BLOCK`` squared pairs and no partner is left out.

With 256 bands of five out of 256 registers a pair at similarity 0.5 is met with
probability 0.998, at 0.6 with 0.99999; at 0.07, the similarity of unrelated
documents with much phrasing in common, with 0.0004.

Plan: registers and word sequences are fetched only for documents that have a
candidate or a close partner: the ids of these are marked in a bitmap of fixed
size (``MARKS`` bits), which filters the sketches before they are shuffled; where
it is full it lets all pass, and nothing is lost.

Defined results: as in ``page_tree``; documents with fewer than ``MIN_WORDS``
words in the article take no part; similarity equal to the threshold counts;
several addresses of a document do not matter.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.page_tree import PageModel, Pages, map_pages
from weftline.operators.components import connected_components
from weftline.session import materialize, ship

THRESHOLD = 0.5
MIN_WORDS = 40
WIDTH = 3
REGISTERS = 256
BASE = 1.001
BANDS = 256
ROWS = 5
#: A pair is verified unless its estimate lies this far below the threshold (over four standard errors).
SLACK = 0.14
BLOCK = 512
#: Bits of the map of documents with partners: 64 rows of 4 kB.
MARKS = 1 << 21

_WORD: list[np.ndarray] = []


def _word_table() -> np.ndarray:
    """Code point -> lower-case letter or digit (0: neither); Chinese characters have the top bit set."""
    if not _WORD:
        t = np.zeros(0x110000, dtype=np.uint32)
        for c in range(sys.maxunicode + 1):
            ch = chr(c)
            if ch.isalnum():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        for a, b in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x2FA20), (0x30000, 0x323B0)):
            t[a:b] = np.arange(a, b, dtype=np.uint32) | np.uint32(1 << 31)
        _WORD.append(t)
    return _WORD[0]


_POWER = np.power(np.uint64(0x9E3779B97F4A7C15), np.arange(1, 1025, dtype=np.uint64), dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of every text in order, and the index of its text."""
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    c = _word_table()[raw]
    single = c >> np.uint32(31) == 1
    inside = c > 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | single[1:] | single[:-1]
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    i = np.arange(len(c))
    place = i - np.maximum.accumulate(np.where(begins, i, 0))
    value = np.where(inside, _mix(c.astype(np.uint64) + np.uint64(1)) * _POWER[place % len(_POWER)], np.uint64(0))
    return _mix(np.add.reduceat(value, at)), np.searchsorted(ends, at)


def shingles(texts: list[str], owner: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word sequences of each owner: hashes and owners, sorted by both; and words of each text, by owner of the word."""
    h, text = word_hashes(texts)
    own = owner[text] if len(h) else np.zeros(0, np.int64)
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), own, text
    s = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k]
    ok = text[:n] == text[width - 1 :]
    s, o = _mix(s)[ok], own[:n][ok]
    order = np.lexsort((s, o))
    s, o = s[order], o[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    return s[new], o[new], own, text


def sketch(s: np.ndarray, starts: np.ndarray, m: int = REGISTERS, base: float = BASE) -> np.ndarray:
    """SetSketch registers (uint16) of consecutive non-empty sets; the maximum of two rows is the row of the union."""
    rng = np.random.default_rng(20)
    mul = rng.integers(0, 1 << 32, m, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, m, dtype=np.uint32)
    low = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    ends = np.append(starts[1:], len(s))
    out = np.empty((len(starts), m), dtype=np.uint32)
    a = 0
    while a < len(starts):  # about 8,000 elements at a time stay in the cache
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + 8000, side="right")))
        lo, hi = starts[a], ends[b - 1]
        if b == a + 1 and hi - lo > 16000:  # one very large set: merge the minima of its parts
            best = np.full(m, 0xFFFFFFFF, dtype=np.uint32)
            for p in range(lo, hi, 8000):
                best = np.minimum(best, _variates(low[p : min(hi, p + 8000)], mul, add).min(axis=0))
            out[a] = best
        else:
            out[a:b] = np.minimum.reduceat(_variates(low[lo:hi], mul, add), starts[a:b] - lo, axis=0)
        a = b
    h = -np.log1p(-(out + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(h) / np.log(base)), 0, 65535).astype(np.uint16)


def _variates(x: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    v = x[:, None] * mul
    v += add
    v ^= v >> np.uint32(15)
    v *= np.uint32(0x2C1B3C6D)
    v ^= v >> np.uint32(13)
    return v


def band_keys(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 32-bit key a band: a band is a fixed random group of registers. A key holds within its band only."""
    rng = np.random.default_rng(31)
    out = np.empty((len(registers), bands), dtype=np.int32)
    for j in range(bands):
        pick = rng.choice(registers.shape[1], rows, replace=False)
        h = np.full(len(registers), j + 1, dtype=np.uint64)
        for p in pick:
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + registers[:, p])
        out[:, j] = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def likelihood_similarity(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from two register arrays and both cardinalities (base close to 1)."""
    m = ra.shape[1]
    up, down = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
    same = m - up - down
    u, v = na / (na + nb), nb / (na + nb)
    a = u * u * (same + down) + v * v * (same + up)
    return np.clip((a - np.sqrt(np.maximum(a * a - 4 * u * u * v * v * m * same, 0))) / (2 * u * v * m), 0, 1)


SKETCHED = "doc_id long, n int, mark long, mark_b long, registers binary, keys array<int>, shingles array<long>"


def article_sketches(documents: DataFrame, blocks: DataFrame, model: PageModel | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """One row a document with enough words: size, fingerprint, registers, band keys and word sequences of its article."""

    def one(pages: Pages, p: np.ndarray, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        inside = np.flatnonzero(p <= 0.5)
        s, own, word_own, _ = shingles([pages.text[i] for i in inside], pages.page[inside])
        many = np.bincount(word_own, minlength=rows.num_rows) >= min_words
        keep = many[own]
        s, own = s[keep], own[keep]
        if not len(s):
            return
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        n = np.diff(np.append(starts, len(s)))
        r = sketch(s, starts)
        keys = band_keys(r)
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id").take(pa.array(own[starts])),
                pa.array(n, pa.int32()),
                pa.array(np.bitwise_xor.reduceat(s, starts).view(np.int64)),
                pa.array(np.add.reduceat(_mix(s), starts).view(np.int64)),
                pa.array([x.tobytes() for x in r], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel())),
                pa.ListArray.from_arrays(pa.array(np.append(starts, len(s)), pa.int32()), pa.array(s.view(np.int64))),
            ],
            names=["doc_id", "n", "mark", "mark_b", "registers", "keys", "shingles"],
        )

    return map_pages(documents, blocks, one, SKETCHED, model=model)


def _estimated(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint16).reshape(b.num_rows, -1) for c in ("ra", "rb"))
            j = likelihood_similarity(ra, rb, b.column("na").to_numpy().astype(float), b.column("nb").to_numpy().astype(float))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(j)], names=["a", "b", "estimate"])

    return pairs.mapInArrow(run, "a long, b long, estimate double")


def _bit(id_: str) -> tuple[Column, Column, Column]:
    """Bucket, byte and bit of an id in a bitmap of ``MARKS`` bits."""
    h = F.pmod(F.xxhash64(id_), F.lit(MARKS))
    place = F.bitmap_bit_position(h)
    return F.bitmap_bucket_number(h), (F.floor(place / 8) + 1).cast("int"), F.pmod(place, F.lit(8)).cast("int")


def marked(df: DataFrame, pairs: DataFrame, id_: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose id may be an end of ``pairs``: all that are, and few others."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("end"))
    h = F.pmod(F.xxhash64("end"), F.lit(MARKS))
    bits = ends.groupBy(F.bitmap_bucket_number(h).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("__bits"))  # MARKS / 2**15 rows at most
    bucket, byte, bit = _bit(id_)
    held = F.conv(F.hex(F.substring(F.col("__bits"), byte, F.lit(1))), 16, 10).cast("int")
    return df.join(F.broadcast(bits), bucket == F.col("__bucket")).where(held.bitwiseAND(F.pow(F.lit(2), bit).cast("int")) != 0).drop("__bucket", "__bits")


def candidates(band: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: documents that share a key, each pair once. ``band`` holds doc_id and the columns of the key, and is read several times."""
    on = [c for c in band.columns if c != "doc_id"]
    shared = band.groupBy(*on).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(*on, F.ceil(F.col("k") / block).cast("int").alias("parts"))
    held = materialize(band.join(shared, on).withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("parts")).cast("int")), "bands")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    a = held.select(*on, F.col("own").alias("i"), every.alias("j"), F.col("doc_id").alias("a"))
    b = held.select(*on, F.col("own").alias("j"), every.alias("i"), F.col("doc_id").alias("b"))
    return a.join(b, [*on, "i", "j"]).where("a < b").select("a", "b").distinct()


def class_pairs(sketched: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity): verified pairs of class representatives, a < b. ``sketched`` is read several times: pass a written table."""
    ship(sketched.sparkSession)
    reps = sketched.groupBy("mark", "mark_b", "n").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    band = sketched.select("doc_id", "keys").join(reps, "doc_id", "left_semi").select(F.posexplode("keys").alias("band", "part"), "doc_id")
    band = band.select((F.shiftleft(F.col("band").cast("long"), 32) + F.col("part").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"), "doc_id")  # five bytes that vary
    met = materialize(candidates(band), "met")
    own = marked(sketched.select("doc_id", "n", "registers"), met)
    left = own.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    right = own.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    close = materialize(_estimated(met.join(left, "a").join(right, "b")).where(F.col("estimate") >= threshold - SLACK).select("a", "b"), "near")
    sets = marked(sketched.select("doc_id", "shingles"), close)
    sa = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    sb = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        close.join(sa, "a")
        .join(sb, "b")
        .select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
        .select("a", "b", (F.col("i") / (F.col("t") - F.col("i"))).alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )


def classes(sketched: DataFrame) -> DataFrame:
    """(doc_id, rep): the class of every document, named by its least id."""
    reps = sketched.groupBy("mark", "mark_b", "n").agg(F.min("doc_id").alias("rep"))
    return sketched.select("doc_id", "mark", "mark_b", "n").join(reps, ["mark", "mark_b", "n"]).select("doc_id", "rep")


def near_copies(documents: DataFrame, blocks: DataFrame, threshold: float = THRESHOLD, model: PageModel | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of class representatives (a, b, similarity), and the classes (doc_id, rep); both written tables."""
    sketched = materialize(article_sketches(documents, blocks, model), "sketches")
    return materialize(class_pairs(sketched, threshold), "class-pairs"), materialize(classes(sketched), "classes")


def all_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b): pairs of classes and of members of one class, expanded to documents, doc_id_a < doc_id_b."""
    one, two = members.select(F.col("doc_id").alias("x"), F.col("rep").alias("a")), members.select(F.col("doc_id").alias("y"), F.col("rep").alias("b"))
    between = pairs.join(one, "a").join(two, "b").select("x", "y")
    within = one.join(two, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, group_id, n_links): every document that takes part, the least id of its group, and its links to other texts."""
    part = connected_components(pairs)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    return (
        members.join(part.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .join(ends, "rep", "left")
        .select("doc_id", F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )
