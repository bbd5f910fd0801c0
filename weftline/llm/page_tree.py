"""Problem 2: the article of a page and the furniture around it.

Method: the blocks of a page form a tree - page, headings by level, the blocks
below them, and runs of list items below the block that introduces them.  Each
block has a unary potential (a sparse linear model on hashed character
n-grams and the block's form); each edge a potential of its kind, counted on
labelled pages.  Sum-product messages pass upward and then downward; a block
whose marginal says so is furniture.  The labelled pages are a bounded sample
(``SAMPLE_PAGES``), labelled by what recurs over its pages and where
(``page_labels``).

Plan: one shuffle brings the blocks of a document into one row; everything
else happens within that row, vectorised over a whole batch of pages.  The
model (2**17 x 3 floats and a few 2 x 2 tables) does not grow with the data.

Defined results
  * blocks doubled exactly count once; null text is empty text and belongs to
    the article; null position sorts first and is returned as null; a null
    kind is a paragraph; a heading without level has level 2;
  * blocks of documents that are not in ``documents`` are left out; documents
    without blocks have no rows (an empty body);
  * no labelled sample (empty tables): empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import page_labels
from weftline.llm.grams import LinearModel, fold, train
from weftline.llm.notices import notice_examples, slot_examples
from weftline.llm.slots import has_slot, repeats
from weftline.session import ship

#: The sample: about so many pages (twice as many at most); of a page the blocks before this position that are no longer than this.
SAMPLE_PAGES = 2000
SAMPLE_BLOCKS = 300
SAMPLE_CHARS = 4000
SAMPLE_COPIES = 8
SAMPLE_LONG = 6000
CHUNK_BYTES = 1_500_000
KINDS = ("heading", "paragraph", "list_item", "table", "caption")
_ROOT, _RUN = len(KINDS), len(KINDS) + 1
_TYPES = _RUN + 1
ITEM = "array<struct<position:int,kind:string,text:string,level:int>>"


@dataclass
class Pages:
    """Blocks of a batch of pages in reading order."""

    page: np.ndarray
    position: np.ndarray  #: -1 for null
    kind: np.ndarray  #: index into KINDS
    level: np.ndarray
    text: list[str]
    html: np.ndarray  #: of each page
    label: np.ndarray | None = None  #: of a sample: whether each block is furniture
    bare: np.ndarray | None = None  #: of a sample: whether each page lacks prose of its own


@dataclass
class PageModel:
    blocks: LinearModel
    edges: np.ndarray  #: log potential [parent type, child type, parent label, child label]


def _form(pages: Pages) -> list[str]:
    """Marks (private code points) for the form of each block; they take part as n-grams."""
    n = len(pages.text)
    size = np.fromiter(map(len, pages.text), np.int64, n)
    lines = np.fromiter((t.count("\n") for t in pages.text), np.int64, n)
    first = np.ones(n, dtype=bool)
    first[1:] = pages.page[1:] != pages.page[:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    titled = np.cumsum(pages.kind == 0)
    before_title = titled - (pages.kind == 0) - (titled - (pages.kind == 0))[start] == 0
    length = np.minimum(np.log2(size + 1).astype(int), 11)
    out = []
    for t, k, z, li, b, h in zip(pages.text, pages.kind, length, np.minimum(lines, 5), before_title, pages.html[pages.page]):
        s = t.rstrip(" \xa0\n»!]•—")
        end = 1 if s.endswith((".", "。")) else 2 if s.endswith(("?", "？", "!", "！")) else 3 if s.endswith(":") else 0
        mark = (1 if " — " in t else 0) + (2 if " > " in t else 0) + (4 if " | " in t or " · " in t else 0)
        out.append(chr(0xE500 + 8 * int(k) + mark) + chr(0xE000 + k) + chr(0xE100 + z) + chr(0xE200 + end * 8 + k) + chr(0xE300 + li) + chr(0xE400 + 2 * int(b) + int(h)))
    return out


def _texts(pages: Pages) -> list[str]:
    return [t.replace("\n", " ") + "  " + f for t, f in zip(pages.text, _form(pages))]


def tree(pages: Pages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parent, type and label owner of every node: the blocks, then the runs, then the pages (roots have parent -1).

    The third array gives, for each block, its run (or -1).
    """
    n = len(pages.text)
    pages_n = len(pages.html)
    i = np.arange(n)
    first = np.ones(n, dtype=bool)
    first[1:] = pages.page[1:] != pages.page[:-1]
    start = np.maximum.accumulate(np.where(first, i, 0)) if n else i
    last = []
    for lev in range(1, 7):  # the latest heading of each level up to and including a block
        at = np.where((pages.kind == 0) & (pages.level == lev), i, -1)
        at = np.maximum.accumulate(at) if n else at
        last.append(np.where(at >= start, at, -1))
    parent = np.full(n, -1)
    for lev in range(1, 7):
        before = np.full(n, -1)
        before[1:] = last[lev - 1][:-1]
        before = np.where(before >= start, before, -1)
        usable = (pages.kind != 0) | (pages.level > lev)
        parent = np.where(usable, np.maximum(parent, before), parent)
    item = pages.kind == 2
    opens = item & (first | ~np.roll(item, 1))
    run_of = np.where(item, np.cumsum(opens) - 1, -1)
    heads = np.flatnonzero(opens)
    run_parent = np.where(first[heads], -1, heads - 1)
    roots = n + len(heads) + np.arange(pages_n)
    parent = np.where(parent < 0, roots[pages.page], parent) if n else parent
    parent = np.where(item, n + run_of, parent)
    run_parent = np.where(run_parent < 0, roots[pages.page[heads]], run_parent)
    whole = np.concatenate((parent, run_parent, np.full(pages_n, -1))).astype(np.int64)
    types = np.concatenate((pages.kind, np.full(len(heads), _RUN), np.full(pages_n, _ROOT))).astype(np.int64)
    return whole, types, run_of


def marginals(parent: np.ndarray, types: np.ndarray, unary: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Probability of label 1 at each node of a forest, by one upward and one downward pass."""
    depth = np.full(len(parent), -1)
    level = np.flatnonzero(parent < 0)
    depth[level] = 0
    layers = [level]
    while True:
        todo = np.flatnonzero((depth < 0) & (depth[parent] == len(layers) - 1))
        if not len(todo):
            break
        depth[todo] = len(layers)
        layers.append(todo)
    belief = unary.astype(np.float64).copy()
    up = np.zeros_like(belief)
    for nodes in reversed(layers[1:]):
        psi = edges[types[parent[nodes]], types[nodes]]  # [node, parent label, own label]
        up[nodes] = np.logaddexp.reduce(psi + belief[nodes][:, None, :], axis=2)
        for y in (0, 1):
            belief[:, y] += np.bincount(parent[nodes], weights=up[nodes, y], minlength=len(parent))
    for nodes in layers[1:]:
        psi = edges[types[parent[nodes]], types[nodes]]
        rest = belief[parent[nodes]] - up[nodes]
        belief[nodes] += np.logaddexp.reduce(psi + rest[:, :, None], axis=1)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50)))


def block_marginals(model: PageModel, pages: Pages) -> np.ndarray:
    """Probability that each block is furniture."""
    n = len(pages.text)
    if not n:
        return np.zeros(0)
    parent, types, _ = tree(pages)
    unary = np.zeros((len(parent), 2))
    unary[:n] = model.blocks.scores(fold(_texts(pages), keep_marks=True, split=False))
    roots = parent < 0
    unary[roots, 1] = -8.0  # a page as such is content
    blank = np.fromiter((not t.strip() for t in pages.text), bool, n)
    unary[:n][blank] = (8.0, -8.0)
    p = marginals(parent, types, unary, model.edges)[:n]
    p[blank] = 0.0
    return p


def fit_edges(samples: list[tuple[Pages, np.ndarray]], weight: float = 0.7) -> np.ndarray:
    """Log potentials from counts of labelled edges: the mutual information of the two labels, by types of the nodes."""
    counts = np.full((_TYPES, _TYPES, 2, 2), 0.0)
    for pages, label in samples:
        parent, types, run_of = tree(pages)
        n = len(label)
        own = np.zeros(len(parent), dtype=int)
        own[:n] = label
        runs = types == _RUN
        if runs.any():
            k = int(runs.sum())
            in_run = run_of >= 0
            share = np.bincount(run_of[in_run], weights=label[in_run], minlength=k) / np.maximum(np.bincount(run_of[in_run], minlength=k), 1)
            own[runs] = share > 0.5
        child = np.flatnonzero(parent >= 0)
        np.add.at(counts, (types[parent[child]], types[child], own[parent[child]], own[child]), 1)
    total = counts.sum(axis=(2, 3), keepdims=True)
    joint = (counts + 0.5) / (total + 2)
    pmi = np.log(joint) - np.log(joint.sum(axis=3, keepdims=True)) - np.log(joint.sum(axis=2, keepdims=True))
    return np.clip(weight * pmi, -3, 3)


def to_pages(items: pa.ListArray, html: np.ndarray) -> Pages:
    """Blocks of a batch in reading order, exact doubles dropped. ``items``: one list of blocks a page."""
    flat = items.flatten()
    size = pc.fill_null(pc.list_value_length(items), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    page = np.repeat(np.arange(len(size)), size)
    position = pc.fill_null(flat.field("position"), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    level = pc.fill_null(flat.field("level"), 2).to_numpy(zero_copy_only=False).astype(np.int64)
    kind = pc.fill_null(pc.index_in(flat.field("kind"), pa.array(KINDS)), 1).to_numpy(zero_copy_only=False).astype(np.int64)
    text = pc.fill_null(flat.field("text"), "")
    order = np.lexsort((kind, position, page))
    page, position, level, kind = page[order], position[order], np.clip(level[order], 1, 6), kind[order]
    words = text.take(pa.array(order)).to_pylist()
    keep = np.ones(len(words), dtype=bool)
    same = np.flatnonzero((page[1:] == page[:-1]) & (position[1:] == position[:-1])) + 1
    seen: set[tuple] = set()
    for j in same:  # few: rows that share a place
        seen.add((page[j - 1], position[j - 1], kind[j - 1], words[j - 1]))
        key = (page[j], position[j], kind[j], words[j])
        keep[j] = key not in seen
        seen.add(key)
    if not keep.all():
        page, position, level, kind = page[keep], position[keep], level[keep], kind[keep]
        words = [w for w, k in zip(words, keep) if k]
    return Pages(page, position, kind, level, words, html)


def pages_of(documents: DataFrame, blocks: DataFrame, *columns: str) -> DataFrame:
    """One row a document with blocks: doc_id, html, items, and further columns of ``documents``."""
    media = F.lower(F.coalesce(F.get_json_object("receipt", "$.content_type"), F.lit("text/html")))
    known = documents.select(F.col("id").alias("document_id"), "doc_id", media.contains("html").alias("html"), *columns)
    item = F.struct(F.col("position").cast("int").alias("position"), "kind", "text", F.col("heading_level").cast("int").alias("level"))
    return (
        blocks.select("document_id", item.alias("item"))
        .join(known, "document_id")
        .groupBy("document_id", "doc_id", "html", *columns)
        .agg(F.collect_list("item").alias("items"))
        .select("doc_id", "html", *columns, F.col("items").cast(ITEM).alias("items"))
    )


def sample_of(documents: DataFrame, blocks: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Pages | None:
    """At most ``2 * sample_pages`` pages with their labels, chosen by the hash of their id: the same on every run."""
    n = documents.count()
    if not n:
        return None
    bound = int((1 << 20) * min(1.0, sample_pages / n)) + 1
    some = documents.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < bound).orderBy(F.xxhash64("id"), "id", "doc_id").limit(2 * sample_pages)
    short = (F.coalesce("position", F.lit(0)) < SAMPLE_BLOCKS) & (F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    cut = blocks.where(F.pmod(F.xxhash64("document_id"), F.lit(1 << 20)) < bound).where(short)
    rows = pages_of(some, cut, "source").select("doc_id", "html", "source", "items").toArrow().sort_by([("doc_id", "ascending"), ("source", "ascending")]).combine_chunks()
    if not rows.num_rows:
        return None
    pages = to_pages(_list(rows.column("items")), rows.column("html").to_numpy(zero_copy_only=False).astype(bool))
    names = [page_labels.site_name(x) for x in rows.column("source").to_pylist()]
    page, kind = pages.page.tolist(), pages.kind.tolist()
    label = page_labels.sample_labels(page, kind, pages.level.tolist(), pages.text, names, lambda t: has_slot(t) or repeats(t))
    pages.label = np.array(label, dtype=int)
    pages.bare = np.zeros(len(pages.html), dtype=bool)
    pages.bare[list(page_labels.bare_pages(page, kind, pages.text, label))] = True
    return pages


def fit_pages(documents: DataFrame, blocks: DataFrame, sample_pages: int = SAMPLE_PAGES) -> PageModel | None:
    """The page model, from the labelled sample; None without pages."""
    return fit_sample(sample_of(documents, blocks, sample_pages))


def fit_sample(pages: Pages | None) -> PageModel | None:
    if pages is None:
        return None
    label = pages.label
    texts = _texts(pages)
    pick: list[int] = []
    seen: dict[str, int] = {}
    long = 0
    for i, t in enumerate(texts):  # of a text that recurs, a few copies; of long article blocks, a part
        seen[t] = seen.get(t, 0) + 1
        if seen[t] > SAMPLE_COPIES:
            continue
        if not label[i] and pages.kind[i] == 1 and len(t) > 120:
            long += 1
            if long > SAMPLE_LONG:
                continue
        elif not label[i] and pages.bare[pages.page[i]]:
            pick += [i, i, i]  # what stands in place of an article is rare
        elif not label[i] and pages.kind[i] == 1:
            pick.append(i)  # short paragraphs of articles are few: notes, bylines
        pick.append(i)
    extra = _examples()
    words = [texts[i] for i in pick] + extra
    target = np.concatenate((label[pick], np.zeros(len(extra), dtype=int)))
    model = train(words, target, ["article", "furniture"], orders=(1, 2, 4), bits=17, keep_marks=True, epochs=2, alpha=0.7, batch=64)
    return PageModel(model, fit_edges([(pages, label)]))


def _examples() -> list[str]:
    """Notices and unfilled fields as blocks of an article: what a sample of pages may hold too rarely."""
    notices, slots = notice_examples(2), slot_examples(400)
    kind = [(1, 1, 1, 0)[i % 4] for i in range(len(notices))] + [(1, 4, 0, 2)[i % 4] for i in range(len(slots))]
    n = len(kind)
    return _texts(Pages(np.arange(n) // 2, np.zeros(n), np.array(kind), np.full(n, 2), notices + slots, np.ones(n // 2 + 1, dtype=bool)))


def _list(column: pa.ChunkedArray | pa.Array) -> pa.ListArray:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _chunks(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Whole pages of a batch, about ``most`` bytes of text at a time."""
    items = batch.column("items")
    size = pc.fill_null(pc.binary_length(items.flatten().field("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    n = pc.fill_null(pc.list_value_length(items), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(n)))]
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def map_pages(
    documents: DataFrame,
    blocks: DataFrame,
    fn: Callable[[Pages, np.ndarray, pa.RecordBatch], Iterator[pa.RecordBatch]],
    schema: str,
    *columns: str,
    model: PageModel | None = None,
    chunk: int = CHUNK_BYTES,
) -> DataFrame:
    """Run ``fn(pages, furniture marginals, rows)`` over all pages; ``rows`` holds doc_id and the further columns."""
    spark = ship(documents.sparkSession)
    model = model or fit_pages(documents, blocks)
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, chunk):
                html = part.column("html").to_numpy(zero_copy_only=False).astype(bool)
                pages = to_pages(part.column("items"), html)
                yield from fn(pages, block_marginals(shared.value, pages), part)

    return pages_of(documents, blocks, *columns).mapInArrow(run, schema)


def first_at_place(pages: Pages, blocks: np.ndarray) -> np.ndarray:
    """Of the given blocks, the first at each position of a page (rows of one position can differ)."""
    if not len(blocks):
        return blocks
    _, first = np.unique(np.stack((pages.page[blocks], pages.position[blocks]), axis=1), axis=0, return_index=True)
    return blocks[np.sort(first)]


def page_furniture(documents: DataFrame, blocks: DataFrame, model: PageModel | None = None) -> DataFrame:
    """(doc_id, position, p): the places of furniture, with the marginal probability; one row a place."""

    def found(pages: Pages, p: np.ndarray, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hit = first_at_place(pages, np.flatnonzero(p > 0.5))
        at = pa.array(pages.position[hit], pa.int32(), mask=pages.position[hit] < 0)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(pages.page[hit], pa.int64())), at, pa.array(p[hit])], names=["doc_id", "position", "p"])

    return map_pages(documents, blocks, found, "doc_id long, position int, p double", model=model)


def page_bodies(documents: DataFrame, blocks: DataFrame, model: PageModel | None = None) -> DataFrame:
    """(doc_id, body, n_blocks): the article of every page with blocks."""

    def bodies(pages: Pages, p: np.ndarray, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        parts: list[list[str]] = [[] for _ in range(rows.num_rows)]
        for i in np.flatnonzero(p <= 0.5):
            parts[pages.page[i]].append(pages.text[i])
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(["\n".join(x) for x in parts]), pa.array([len(x) for x in parts], pa.int32())], names=["doc_id", "body", "n_blocks"])

    return map_pages(documents, blocks, bodies, "doc_id long, body string, n_blocks int", model=model)
