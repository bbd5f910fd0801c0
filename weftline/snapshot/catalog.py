"""Registers of versioned tables and of releases, themselves versioned tables.

Registering the same content again does nothing; other content under the same
name is a conflict.  A release lists tables with version, schema digest and
row count, and is checked against them when it is opened.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftline.errors import CatalogConflict, ReleaseConflict
from weftline.snapshot.digests import schema_digest
from weftline.snapshot.table import VersionedTable


@dataclass(frozen=True)
class TableRef:
    """A pinned table."""

    id: str
    uri: str
    version: int
    schema_hash: str
    rows: int


def pin(spark: SparkSession, id: str, uri: str, version: int | None = None) -> TableRef:
    t = VersionedTable(spark, uri)
    m = t.manifest(version)
    return TableRef(id, uri, m.version, schema_digest(t.read(m.version)), m.rows)


class Catalog:
    """References by id."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.table = spark, VersionedTable(spark, uri)

    def get(self, id: str) -> TableRef | None:
        if not self.table.head():
            return None
        row = self.table.read(where=F.col("id") == id).first()
        return TableRef(**row.asDict()) if row else None

    def register(self, ref: TableRef) -> int:
        """The catalogue's version after this."""
        held = self.get(ref.id)
        if held == ref:
            return self.table.head()
        if held is not None:
            raise CatalogConflict(f"{ref.id} is registered as version {held.version} of {held.uri}")
        row = self.spark.createDataFrame([(ref.id, ref.uri, ref.version, ref.schema_hash, ref.rows)], "id string, uri string, version long, schema_hash string, rows long")
        return self.table.commit(row, "append", expected_version=self.table.head()).version


class Releases:
    """Named sets of pinned tables."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.table = spark, VersionedTable(spark, uri)

    def register(self, name: str, refs: list[TableRef]) -> int:
        content = json.dumps(sorted([r.__dict__ for r in refs], key=lambda r: r["id"]), sort_keys=True)
        held = self.table.read(where=F.col("name") == name).first() if self.table.head() else None
        if held is not None:
            if held["content"] == content:
                return self.table.head()
            raise ReleaseConflict(f"{name} is registered with other tables")
        row = self.spark.createDataFrame([(name, content)], "name string, content string")
        return self.table.commit(row, "append", expected_version=self.table.head()).version

    def open(self, name: str) -> dict[str, TableRef]:
        """The tables of a release, each checked against its pin."""
        row = self.table.read(where=F.col("name") == name).first() if self.table.head() else None
        if row is None:
            raise ReleaseConflict(f"no release {name}")
        refs = [TableRef(**r) for r in json.loads(row["content"])]
        for r in refs:
            if pin(self.spark, r.id, r.uri, r.version) != r:
                raise ReleaseConflict(f"{r.id} is not what {name} pinned")
        return {r.id: r for r in refs}
