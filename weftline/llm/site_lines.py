"""Problem 1: lines repeated across the documents of one site.

Method: documents of a site that hold the same set of normalised lines are
first collapsed into one cluster; each line is then counted over distinct
clusters and distinct days, so that a text published again and again is not
mistaken for boilerplate: a line is repeated if ``MIN_CLUSTERS`` clusters of
``MIN_DAYS`` days hold it.  A cluster carries the number of documents that it
stands for, which makes the plain count of documents exact as well, while the
lines of a copied document are exploded only once.

Plan: one shuffle of (document, position, line keys) by document joins the
site and builds one row a document, which is written once to the shared
folder.  The counts are two partial aggregations over the clusters.  The
occurrences are joined with the lines that reach the threshold; a hot line
cannot gather in one task, since aggregation combines before the shuffle and
the join is split by adaptive execution.

Defined results
  * null text, null document id: no lines; blocks or addresses of documents
    that are not in ``documents``: left out; documents without an address: no
    site, hence left out of the counts and returned whole by the cleaner.
  * blocks doubled exactly count once; a line is counted once a document.
  * empty tables give empty results; other columns are never read.
  * a cluster has the day of its first document; one without a date counts as a day of its own;
  * lines are keyed by 96 bits (a hash of 64 and one of 32) of the normalised line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.urls import site_of
from weftline.session import materialize

MIN_DOCUMENTS = 6
MIN_CLUSTERS = 6
MIN_DAYS = 2
MIN_LETTERS = 4


def normal_line(line: Column) -> Column:
    """Letters of the line in lower case; everything else is dropped."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def line_keys(text: Column, min_letters: int = MIN_LETTERS) -> Column:
    """One key a line of ``text``, in order; null where a line has too few letters."""

    def key(line: Column) -> Column:
        n = normal_line(line)
        return F.when(F.length(n) >= min_letters, F.struct(F.xxhash64(n).alias("a"), F.hash(n).alias("b")))

    return F.transform(F.split(text, "\n", -1), key)


def document_sites(urls: DataFrame) -> DataFrame:
    """(document_id, site): the least site among the addresses of a document."""
    return (
        urls.select("document_id", site_of(F.col("url")).alias("site"))
        .where("document_id IS NOT NULL AND site <> ''")
        .groupBy("document_id")
        .agg(F.min("site").alias("site"))
    )


def document_lines(documents: DataFrame, urls: DataFrame, blocks: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """One row a document: document_id, doc_id, site, day, items (position and line keys of its blocks)."""
    day = F.floor(F.col("observed") / 86400)
    known = documents.select(F.col("id").alias("document_id"), "doc_id", day.alias("day")).join(document_sites(urls), "document_id")
    lines = blocks.select("document_id", "position", line_keys(F.col("text"), min_letters).alias("keys")).where(F.exists("keys", lambda k: k.isNotNull()))
    return (
        lines.join(known, "document_id")
        .groupBy("document_id", "doc_id", "site", "day")
        .agg(F.array_distinct(F.collect_list(F.struct("position", "keys"))).alias("items"))
        .select("doc_id", "site", "day", "items")
    )


def clusters_of(lines: DataFrame) -> DataFrame:
    """Documents of one site with the same set of lines, collapsed: site, keys, n_docs, day (the first)."""
    every = F.filter(F.flatten(F.col("items.keys")), lambda k: k.isNotNull())
    return (
        lines.select("site", "day", F.array_sort(F.array_distinct(every)).alias("keys"))
        .groupBy("site", F.xxhash64("keys").alias("mark"), F.hash("keys").alias("mark_b"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min("day").alias("day"), F.first("keys").alias("keys"))
        .select("site", "keys", "n_docs", "day")
    )


def line_counts(lines: DataFrame) -> DataFrame:
    """For each line of a site: n_docs, n_clusters and n_days. ``lines`` is the result of :func:`document_lines`."""
    return (
        clusters_of(lines)
        .select("site", "n_docs", "day", F.explode("keys").alias("key"))
        .groupBy("site", "key", "day")
        .agg(F.sum("n_docs").alias("n_docs"), F.count(F.lit(1)).alias("n_clusters"))
        .groupBy("site", "key")
        .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_clusters").alias("n_clusters"), F.sum(F.when(F.col("day").isNull(), F.col("n_clusters")).otherwise(1)).alias("n_days"))
    )


def repeated_lines(
    documents: DataFrame,
    urls: DataFrame,
    blocks: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    min_clusters: int = MIN_CLUSTERS,
    min_days: int = MIN_DAYS,
    min_letters: int = MIN_LETTERS,
) -> DataFrame:
    """Occurrences (doc_id, position, line_no) of the lines that recur on their site.

    A line is repeated if it reaches all three thresholds: documents, clusters
    of equal documents, and days.  With one cluster and no day it is the plain
    count of documents, which takes an article published again for boilerplate.
    """
    lines = materialize(document_lines(documents, urls, blocks, min_letters), "site-lines")
    often = line_counts(lines).where((F.col("n_docs") >= min_documents) & (F.col("n_clusters") >= min_clusters) & (F.col("n_days") >= min_days)).select("site", "key")
    each = (
        lines.select("doc_id", "site", F.explode("items").alias("item"))
        .select("doc_id", "site", F.col("item.position").alias("position"), F.posexplode("item.keys").alias("line_no", "key"))
        .where("key IS NOT NULL")
    )
    return each.join(often, ["site", "key"]).select("doc_id", "position", "line_no").distinct()


def without_lines(documents: DataFrame, blocks: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text): every document from its blocks in order, without the lines in ``found``.

    A block that loses all its lines is dropped; a document without blocks, or
    with no line left, has an empty text.
    """
    ids = documents.select(F.col("id").alias("document_id"), "doc_id")
    gone = found.groupBy("doc_id", "position").agg(F.collect_set("line_no").alias("gone"))
    lines = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    kept = (
        blocks.select("document_id", "position", "text")
        .where("text IS NOT NULL")
        .join(ids, "document_id")
        .dropDuplicates(["document_id", "position", "text"])
        .join(gone, ["doc_id", "position"], "left")
        .select("doc_id", "position", lines.alias("lines"))
        .where(F.size("lines") > 0)
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("position", F.array_join("lines", "\n").alias("text")))).alias("parts"))
        .select("doc_id", F.array_join(F.col("parts.text"), "\n").alias("text"))
    )
    return ids.select("doc_id").join(kept, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
