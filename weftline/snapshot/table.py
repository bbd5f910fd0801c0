"""Versioned tables: immutable Parquet files and a log of manifests.

Layout: ``data/<id>/*.parquet``, ``_versions/<number>.json`` and ``_marks``.  A
commit writes its files first, then its manifest aside, and then gives that file
the name of the next number without overwriting: one atomic step, so of two
writers one loses with ``WriteConflict``, and a writer that dies before or after
it leaves nothing in the way of the next.  Readers take a version's file list,
and filters and projections reach the Parquet scan as usual.

A manifest of an append names its own files and the version that it adds to;
every ``FULL``-th names all files, so a manifest stays small and few are read.
Marks (operation id, stream batch, fingerprint) lead to their version by name:
a look-up costs the same whatever the number of versions.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import InvalidRequest, WriteConflict, WriteError
from weftline.operators.keys import check_columns
from weftline.session import materialize

MODES = ("create", "append", "overwrite", "merge")
FULL = 16


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: dict
    files: list[str]
    rows: int
    operation_id: str
    mode: str
    parent: int = 0
    when: float = 0.0
    keys: dict = field(default_factory=dict)  #: fingerprint, stream batch and the like
    base: int = 0  #: the version whose files this one adds to; 0 where ``files`` are all of them (in the log only)
    depth: int = 0  #: manifests below this one in the log


@dataclass(frozen=True)
class Receipt:
    """What a write did; ``status`` is committed, unchanged or indeterminate."""

    uri: str
    version: int
    operation_id: str
    status: str
    rows: int
    stats: dict


class VersionedTable:
    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.uri).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- the log

    def _name(self, version: int) -> str:
        return f"{self.uri}/_versions/{version:020d}.json"

    def head(self) -> int:
        """The latest version; 0 where there is no table."""
        folder = self._path(f"{self.uri}/_versions")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit()), default=0)

    def versions(self) -> list[int]:
        """The versions that can be read, in order."""
        folder = self._path(f"{self.uri}/_versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit())

    def _load(self, path: str) -> dict | None:
        at = self._path(path)
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _store(self, path: str, value: dict, overwrite: bool = False) -> bool:
        """Write a small file as a whole or not at all; False where it is there and must not be replaced."""
        folder, _, name = path.rpartition("/")
        aside = self._path(f"{folder}/.{name}-{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        try:
            return self._name_once(aside, self._path(path), overwrite)
        finally:
            self._fs.delete(aside, False)

    def _name_once(self, aside, target, overwrite: bool) -> bool:
        if self._fs.getScheme() == "file":  # a rename would replace the target on local disks; a link does not
            source, end = aside.toUri().getPath(), target.toUri().getPath()
            if overwrite:
                os.replace(source, end)
                return True
            try:
                os.link(source, end)
            except FileExistsError:
                return False
            return True
        jvm = self.spark._jvm
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE if overwrite else kind.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(aside, target, how)
        except Exception:
            if self._fs.exists(target):
                return False
            raise
        return True

    def _raw(self, version: int) -> Manifest | None:
        found = self._load(self._name(version))
        return Manifest(**found) if found else None

    def manifest(self, version: int | None = None) -> Manifest:
        """The manifest of a version with all its files."""
        version = self.head() if version is None else version
        m = self._raw(version) if version else None
        if m is None:
            raise InvalidRequest(f"{self.uri} has no version {version}")
        files, at = [m.files], m
        while at.base:
            whole = self._load(self._files_name(at.version))
            if whole:  # what lay below it was retired
                files[-1] = whole["files"]
                break
            at = self._raw(at.base)
            files.append(at.files)
        return replace(m, files=[f for part in reversed(files) for f in part], base=0)

    def _files_name(self, version: int) -> str:
        return f"{self.uri}/_versions/{version:020d}.files"

    def history(self) -> list[Manifest]:
        """The manifests of all versions that are not retired."""
        return [self.manifest(v) for v in self.versions()]

    def _publish(self, m: Manifest, base: Manifest | None = None) -> None:
        """Make ``m`` a version; with ``base`` its files are those of ``base`` and ``m.files``."""
        if base is not None:
            m = replace(m, base=base.version, depth=base.depth + 1) if base.depth + 1 < FULL else replace(m, files=base.files + m.files)
        for name, value in (("operation", m.operation_id), *m.keys.items()):
            held = self._load(self._mark(name, value))
            if not (held and held.get("sure")):
                # before the version: a mark alone proves nothing, see _marked
                self._store(self._mark(name, value), {"version": m.version, "operation_id": m.operation_id, "rows": m.rows}, overwrite=True)
        if not self._store(self._name(m.version), asdict(m)):
            raise WriteConflict(f"version {m.version} of {self.uri} exists")

    def _mark(self, name: str, value) -> str:
        return f"{self.uri}/_marks/{hashlib.sha256(json.dumps([name, value], sort_keys=True).encode()).hexdigest()}.json"

    def _marked(self, name: str, value) -> Receipt | None:
        """The version that a mark leads to, if that version was published by the operation of the mark (or is known to have been)."""
        held = self._load(self._mark(name, value))
        if held is None:
            return None
        if not held.get("sure"):
            m = self._raw(held["version"])
            if m is None or m.operation_id != held["operation_id"]:
                return None
        return Receipt(self.uri, held["version"], held["operation_id"], "committed", held["rows"], {})

    # -- reading

    def schema(self, version: int | None = None) -> T.StructType:
        return T.StructType.fromJson(self.manifest(version).schema)

    def read(self, version: int | None = None, columns: list[str] | None = None, where: str | Column | None = None, projection: dict[str, str] | None = None, limit: int | None = None) -> DataFrame:
        """One version; ``columns`` or ``projection`` (name -> SQL), not both.  The head is pinned at this moment."""
        if columns and projection:
            raise InvalidRequest("columns or projection, not both")
        m = self.manifest(version)
        schema = T.StructType.fromJson(m.schema)
        df = self.spark.read.schema(schema).parquet(*[f"{self.uri}/{f}" for f in m.files]) if m.files else self.spark.createDataFrame([], schema)
        if where is not None:
            df = df.where(where)
        if columns:
            df = df.select(*check_columns(df, columns))
        if projection:
            df = df.selectExpr(*[f"{e} AS `{n}`" for n, e in projection.items()])
        return df if limit is None else df.limit(limit)

    def inspect(self, version: int | None = None) -> dict:
        m = self.manifest(version)
        return {"uri": self.uri, "version": m.version, "rows": m.rows, "files": len(m.files), "fields": [f["name"] for f in m.schema["fields"]]}

    # -- writing

    def _files(self, df: DataFrame, count: bool = True) -> tuple[list[str], int]:
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.uri}/{folder}")
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.uri}/{folder}"))]
        files = [f"{folder}/{n}" for n in sorted(found) if n.endswith(".parquet")]
        rows = self.spark.read.schema(df.schema).parquet(f"{self.uri}/{folder}").count() if files and count else 0  # from the footers
        return files, rows

    def commit(self, df: DataFrame, mode: str = "create", expected_version: int | None = None, on=None, update_columns: list[str] | None = None, when_not_matched: str = "error", keys: dict | None = None, operation_id: str | None = None, skip_empty: bool = False) -> Receipt:
        """Create, append to, overwrite or merge into the table, as one version.

        ``append`` creates a missing table and wants the same names and types;
        ``merge`` is described at :meth:`merge`.  ``expected_version`` is checked
        before the input is read and again when the version is published.  With ``skip_empty`` no rows make no version.
        """
        if mode not in MODES:
            raise InvalidRequest(f"mode must be one of {MODES}")
        if mode == "merge":
            return self.merge(df, on, update_columns, when_not_matched, expected_version, operation_id)
        head = self.head()
        if expected_version is not None and head != expected_version:
            raise WriteConflict(f"head is {head}, not {expected_version}")
        if mode == "create" and head:
            raise WriteConflict(f"{self.uri} exists")
        plain = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
        old: Manifest | None = self.manifest(head) if head and mode == "append" else None
        if old is not None and _shape(T.StructType.fromJson(old.schema)) != _shape(plain):
            raise InvalidRequest(f"another schema: {_shape(plain)}, the table has {_shape(T.StructType.fromJson(old.schema))}")
        files, rows = self._files(df)
        if skip_empty and not rows:
            return Receipt(self.uri, head, operation_id or "", "unchanged", 0, {})
        m = Manifest(head + 1, json.loads(plain.json()), files, (old.rows if old else 0) + rows, operation_id or uuid.uuid4().hex, mode, head, time.time(), keys or {})
        self._publish(m, old)
        return Receipt(self.uri, m.version, m.operation_id, "committed", rows, {"inserted": rows})

    def merge(self, patch: DataFrame, on, update_columns: list[str] | None = None, when_not_matched: str = "error", expected_version: int | None = None, operation_id: str | None = None) -> Receipt:
        """Set columns of matching rows from ``patch``.

        Keys must be unique and not null on both sides, and whole numbers,
        strings or bytes.  A null in the patch clears; columns that it lacks stay.
        Patch rows without a match are an error, ignored or inserted.  A merge
        that changes nothing keeps the version.  The keys of both sides meet in
        one aggregation; only files that hold a row to change are written again.
        """
        if when_not_matched not in ("error", "ignore", "insert"):
            raise InvalidRequest("when_not_matched must be error, ignore or insert")
        head = self.head()
        if expected_version is not None and head != expected_version:
            raise WriteConflict(f"head is {head}, not {expected_version}")
        target = self.read(head)
        keys = check_columns(patch, on, "keys")
        check_columns(target, keys, "keys")
        for k in keys:
            if not isinstance(target.schema[k].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.BinaryType)):
                raise InvalidRequest(f"{k} is no key type: {target.schema[k].dataType.simpleString()}")
        unknown = [c for c in patch.columns if c not in target.columns]
        if unknown:
            raise InvalidRequest(f"unknown columns: {unknown}")
        for c in patch.columns:
            if _kind(patch.schema[c].dataType) != _kind(target.schema[c].dataType):
                raise InvalidRequest(f"{c} is {target.schema[c].dataType.simpleString()}, not {patch.schema[c].dataType.simpleString()}")
        changes = [c for c in (update_columns or patch.columns) if c not in keys]
        old = self.manifest(head)
        # one pass over the keys of both sides: what each patch row meets, and in which file
        mine = target.select(*keys, F.struct(*changes).alias("__old") if changes else F.lit(None).cast("struct<x:int>").alias("__old"), (F.col("_metadata.file_path") if old.files else F.lit(None).cast("string")).alias("__file"))
        theirs = patch.select(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in keys], F.struct(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in patch.columns]).alias("__new"))
        met = mine.unionByName(theirs, allowMissingColumns=True).groupBy(*keys).agg(
            F.count("__file").alias("__t"), F.count("__new").alias("__p"), F.max("__file").alias("__file"), F.first("__old", ignorenulls=True).alias("__old"), F.first("__new", ignorenulls=True).alias("__new")
        )
        differs = F.lit(False)
        for c in changes:
            differs = differs | ~F.col(f"__old.{c}").eqNullSafe(F.col(f"__new.{c}"))
        bad = (F.col("__t") > 1) | (F.col("__p") > 1) | F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
        kind = F.when(bad, "bad").when(F.col("__t") == 0, "new").when(differs, "changed").otherwise("same")
        seen = met.where((F.col("__p") > 0) | bad).select(*keys, "__file", "__new", kind.alias("__kind"))
        seen = materialize(seen.where("__kind <> 'same'"), "merge")
        count: dict[str, int] = {}
        touched: set[str] = set()
        for r in seen.groupBy("__kind", "__file").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a file
            count[r["__kind"]] = count.get(r["__kind"], 0) + r["n"]
            if r["__kind"] == "changed":
                touched.add(r["__file"])
        if count.get("bad"):
            raise InvalidRequest("null or repeated keys in the target or the patch")
        updated, unmatched = count.get("changed", 0), count.get("new", 0)
        if unmatched and when_not_matched == "error":
            raise InvalidRequest(f"{unmatched} rows of the patch match nothing")
        inserted = unmatched if when_not_matched == "insert" else 0
        done = {"updated": updated, "inserted": inserted, "ignored": unmatched - inserted}
        if not updated and not inserted:
            return Receipt(self.uri, head, operation_id or "", "unchanged", 0, done)
        names = {"/".join(f.rsplit("/", 3)[1:]) for f in touched}
        stale = [f for f in old.files if f in names]
        parts = []
        if stale:
            news = seen.where("__kind = 'changed'").select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__new"))
            same = F.lit(True)
            for k in keys:
                same = same & (F.col(k) == F.col(f"__k_{k}"))
            held = self.spark.read.schema(target.schema).parquet(*[f"{self.uri}/{f}" for f in stale])
            cols = [F.when(F.col("__new").isNotNull(), F.col(f"__new.{f.name}")).otherwise(F.col(f.name)).alias(f.name) if f.name in changes else F.col(f.name) for f in target.schema.fields]
            parts.append(held.join(news, same, "left").select(*cols))
        if inserted:
            parts.append(seen.where("__kind = 'new'").select(*[(F.col(f"__new.{f.name}") if f.name in patch.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in target.schema.fields]))
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        files, _ = self._files(out, count=False)
        gone = set(stale)
        m = Manifest(head + 1, old.schema, [f for f in old.files if f not in gone] + files, old.rows + inserted, operation_id or uuid.uuid4().hex, "merge", head, time.time(), keys={"batch": operation_id} if operation_id else {})
        self._publish(m)
        return Receipt(self.uri, m.version, m.operation_id, "committed", updated + inserted, done)

    def add_columns(self, schema: str | T.StructType, expected_version: int | None = None) -> Receipt:
        """New top-level columns, null in all rows; only the manifest changes."""
        head = self.head()
        if expected_version is not None and head != expected_version:
            raise WriteConflict(f"head is {head}, not {expected_version}")
        old = self.manifest(head)
        now = T.StructType.fromJson(old.schema)
        new = self.spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
        clash = [f.name for f in new.fields if f.name in now.names]
        if clash or any(not f.nullable for f in new.fields):
            raise InvalidRequest(f"columns must be new and nullable: {clash}")
        m = Manifest(head + 1, json.loads(T.StructType([*now.fields, *new.fields]).json()), old.files, old.rows, uuid.uuid4().hex, "add_columns", head, time.time())
        self._publish(m)
        return Receipt(self.uri, m.version, m.operation_id, "committed", 0, {})

    def find(self, operation_id: str) -> Receipt | None:
        """The commit of an operation whose answer was lost; None if it never became a version."""
        found = self._marked("operation", operation_id)
        m = self._raw(found.version) if found else None
        lost = [f for f in m.files if not self._fs.exists(self._path(f"{self.uri}/{f}"))] if m and m.operation_id == operation_id else []
        if lost:
            raise WriteError(f"version {m.version} lacks files: {lost[:3]}")
        return found

    def find_key(self, name: str, value) -> Receipt | None:
        """The latest commit with this value under a manifest key (a stream's batch, a checkpoint's fingerprint)."""
        return self._marked(name, value)

    def consolidate(self, files: int = 1) -> Receipt:
        """The same rows in fewer files, as a new version."""
        return self.commit(self.read().coalesce(files), "overwrite")

    def clone(self, uri: str, version: int | None = None) -> Receipt:
        """A copy of one version as a table of its own."""
        return VersionedTable(self.spark, uri).commit(self.read(version), "create")

    def retire(self, keep: int = 1) -> int:
        """Delete the manifests before the last ``keep`` versions, and data files that no kept version names; the number of versions gone.

        Operations and batches of the versions that go are still found.  Every step leaves a table that can be read,
        and a second call goes on where one was stopped.
        """
        every = self.versions()
        gone, kept = every[:-keep] if keep else every[:0], every[-keep:] if keep else every
        held = {v: self.manifest(v) for v in kept}
        for v in kept:
            if self._raw(v).base in gone:
                self._store(self._files_name(v), {"files": held[v].files}, overwrite=True)
        folders = {f.split("/")[1] for m in held.values() for f in m.files}
        for v in gone:
            m = self._raw(v)
            for name, value in (("operation", m.operation_id), *m.keys.items()):
                now = self._load(self._mark(name, value))
                if now and now["version"] == v:
                    self._store(self._mark(name, value), {**now, "sure": True}, overwrite=True)
        for d in {f.split("/")[1] for v in gone for f in self._raw(v).files} - folders:
            self._fs.delete(self._path(f"{self.uri}/data/{d}"), True)
        for v in gone:
            self._fs.delete(self._path(self._files_name(v)), False)
            self._fs.delete(self._path(self._name(v)), False)
        return len(gone)


def _kind(kind: T.DataType) -> str:
    return json.dumps(_loose(kind.jsonValue()), sort_keys=True)


def _loose(v):
    if isinstance(v, dict):
        return {k: _loose(x) for k, x in v.items() if k not in ("nullable", "containsNull", "valueContainsNull", "metadata")}
    return [_loose(x) for x in v] if isinstance(v, list) else v


def _shape(s: T.StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in s.fields]
