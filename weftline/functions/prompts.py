"""Prompt templates compiled to expressions, a model node with an exchangeable client, and its journal."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.errors import InvalidRequest
from weftline.functions.jsonschema import check_schema, errors_of
from weftline.session import ship
from weftline.snapshot.table import VersionedTable

FORMS = ("text", "json")


def _name(text: str, what: str) -> str:
    if not (text.isascii() and text.isidentifier()):
        raise InvalidRequest(f"{text!r} is no {what}")
    return text


def parse_template(template: str) -> list[tuple[str, str | None, str]]:
    """(literal, field, form) pieces; an error for stray braces, unknown forms and one field in two forms.

    The text is split at the opening braces: what precedes the first is literal, and each later part is a field up
    to its closing braces and the literal after them.
    """
    if not isinstance(template, str) or not template.strip():
        raise InvalidRequest("a template is a text that is not blank")
    literal, *rest = template.split("{{")
    pieces: list[tuple[str, str | None, str]] = []
    for part in rest:
        inner, closed, after = part.partition("}}")
        if not closed or "}}" in literal:
            raise InvalidRequest("stray braces in the template")
        name, barred, form = (x.strip() for x in inner.partition("|"))
        form = _name(form, "form").lower() if barred else FORMS[0]
        if form not in FORMS:
            raise InvalidRequest(f"unknown form {form!r}; known: {FORMS}")
        pieces.append((literal, _name(name, "field"), form))
        literal = after
    if "}}" in literal:
        raise InvalidRequest("stray braces in the template")
    used = {(n, f) for _, n, f in pieces}
    if len(used) > len({n for n, _ in used}):
        raise InvalidRequest("a field in two forms")
    return [*pieces, (literal, None, FORMS[0])]


def render(df: DataFrame, template: str, bindings: dict[str, Column] | None = None) -> Column:
    """The template as one string expression over columns; fields and arguments must cover each other."""
    pieces = parse_template(template)
    names = {n for _, n, _ in pieces if n}
    if bindings is not None and set(bindings) != names:
        raise InvalidRequest(f"missing {sorted(names - set(bindings))}, not used {sorted(set(bindings) - names)}")
    parts: list[Column] = []
    for literal, name, form in pieces:
        if literal:
            parts.append(F.lit(literal))
        if name:
            c = bindings[name] if bindings else F.col(name)
            kind = df.select(c.alias("x")).schema["x"].dataType
            if form == "json":
                parts.append(_as_json(c, kind))
            elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.BinaryType)):
                raise InvalidRequest(f"{name!r} is no scalar; use the json form")
            else:
                parts.append(c.cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def _as_json(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.coalesce(F.to_json(c, {"ignoreNullFields": "false"}), F.lit("null"))
    return F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"^\{\"x\":(.*)\}$", 1), F.lit("null"))


class EchoClient:
    """An offline client: a deterministic answer from the request alone."""

    def __call__(self, request: str) -> str:
        return json.dumps({"answer": hashlib.sha256(request.encode()).hexdigest()[:16]})


def _latest(journal: VersionedTable) -> DataFrame:
    """One entry a request: its answer, else the error of its last try."""
    latest = F.max_by(F.struct("__answer", "__error"), F.struct(F.col("__error").isNull(), "__at"))
    return journal.read().groupBy("__key").agg(latest.alias("it")).select("__key", "it.__answer", "it.__error")


def map_prompt(df: DataFrame, template: str, client: Callable[[str], str], output: str = "answer", schema: dict | None = None, retries: int = 1, journal: VersionedTable | None = None, version: str = "1") -> DataFrame:
    """Render, ask, check against a schema (asking again up to ``retries`` times) and add ``output`` (JSON text) and ``error``.

    With a ``journal`` equal requests are asked once: answers are kept under the
    hash of version and request, and reused on later runs.  Requests that failed
    are kept with their error and asked again on the next run; the latest entry
    of a request counts.
    """
    ship(df.sparkSession)
    schema = check_schema(schema) if schema else None
    asked = df.withColumn("__request", render(df, template)).withColumn("__key", F.sha2(F.concat(F.lit(version + "\x00"), "__request"), 256))
    result = "`__key` string, `__answer` string, `__error` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, requests = b.column(0).to_pylist(), b.column(1).to_pylist()
            answers, problems = [], []
            for r in requests:
                text, problem = None, "no request"
                for _ in range(retries + 1 if r is not None else 0):
                    text = client(r)
                    try:
                        found = errors_of(json.loads(text), schema) if schema else json.loads(text) and []
                        problem = "; ".join(found) if found else None
                    except ValueError as e:
                        problem = f"not JSON: {e}"
                    if problem is None:
                        break
                answers.append(text if problem is None else None)
                problems.append(problem)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(answers, pa.string()), pa.array(problems, pa.string())], names=["__key", "__answer", "__error"])

    distinct = asked.groupBy("__key").agg(F.first("__request").alias("__request"))
    if journal is None:
        known = distinct.mapInArrow(run, result)
    else:
        empty = df.sparkSession.createDataFrame([], result)
        held = journal.read() if journal.head() else empty
        fresh = distinct.join(held.where("`__error` IS NULL"), "__key", "left_anti")
        if not fresh.isEmpty():
            journal.commit(fresh.mapInArrow(run, result).withColumn("__at", F.current_timestamp()), "append", expected_version=journal.head())
        known = _latest(journal) if journal.head() else empty
    return asked.join(known, "__key", "left").withColumnRenamed("__answer", output).withColumnRenamed("__error", "error").drop("__request", "__key")
