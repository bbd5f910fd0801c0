"""Stores on versioned tables: content-addressed records, and the library of documents with their addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.urls import normalize_url
from weftline.snapshot.table import Receipt, VersionedTable


def append_new(table: VersionedTable, df: DataFrame, key: str) -> Receipt | None:
    """Append the rows whose key the table does not hold yet, one a key; None if there are none."""
    fresh = df.where(F.col(key).isNotNull()).dropDuplicates([key])
    if table.head():
        fresh = fresh.join(table.read(columns=[key]), key, "left_anti").select(*table.read().columns)
    got = table.commit(fresh, "append", expected_version=table.head(), skip_empty=table.head() > 0)
    return got if got.rows else None


class Library:
    """Documents by id, and every address that leads to one: its own, aliases and redirects."""

    def __init__(self, spark, uri: str):
        self.documents = VersionedTable(spark, f"{uri.rstrip('/')}/documents")
        self.aliases = VersionedTable(spark, f"{uri.rstrip('/')}/aliases")

    def register(self, documents: DataFrame, aliases: DataFrame) -> None:
        """New documents (id, ...) and addresses (url, document_id); what is there already stays."""
        append_new(self.documents, documents, "id")
        append_new(self.aliases, aliases.select(normalize_url(F.col("url")).alias("url"), "document_id"), "url")

    def resolve(self, urls: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
        """(url, document_id): the document of each address, through one redirect if need be; null if unknown."""
        asked = urls.select("url", normalize_url(F.col("url")).alias("__u"))
        known = self.aliases.read().select(F.col("url").alias("__a"), "document_id")
        if redirects is not None:
            step = redirects.select(normalize_url(F.col("url")).alias("__f"), normalize_url(F.col("target_url")).alias("__t")).dropDuplicates(["__f"])
            asked = asked.join(step, F.col("__u") == F.col("__f"), "left").withColumn("__u", F.coalesce("__t", "__u"))
        return asked.join(known, F.col("__u") == F.col("__a"), "left").select("url", "document_id")
