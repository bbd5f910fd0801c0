"""A closed subset of JSON Schema: object, array, string, number, integer, boolean, null, enum, const, anyOf, formats of dates, and bounds.

Objects are closed: a property that ``properties`` does not name is an error
unless ``additionalProperties`` is true.  The root is an object.
"""

from __future__ import annotations

import re
from datetime import date, datetime
from typing import Any

from weftline.errors import InvalidRequest

MAX_DEPTH, MAX_NODES = 12, 512
_KNOWN = {
    "type", "properties", "required", "additionalProperties", "items", "enum", "const", "anyOf", "format", "minLength", "maxLength", "pattern", "minimum", "maximum",
    "exclusiveMinimum", "exclusiveMaximum", "minItems", "maxItems", "uniqueItems", "description", "title", "default",
}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
_KINDS = {*_TYPES, "number", "integer"}
_SIZES, _BOUNDS = ("minLength", "maxLength", "minItems", "maxItems"), ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum")
_FORMATS = {"date": date.fromisoformat, "date-time": datetime.fromisoformat}


def _is(value: Any, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES[kind]) and (kind == "boolean" or not isinstance(value, bool) or kind == "null")


def _faults(s: dict, place: str) -> list[str]:
    """What is wrong with one node of a schema, apart from the nodes below it."""
    out = [f"{place}.{k}: unknown" for k in sorted(set(s) - _KNOWN)]
    kinds = s["type"] if isinstance(s.get("type"), list) else [s.get("type")] if "type" in s else []
    if any(not isinstance(k, str) or k not in _KINDS for k in kinds) or len(kinds) > 1 and (len(set(kinds)) != 2 or len(kinds) != 2 or "null" not in kinds):
        return [*out, f"{place}.type: one of {sorted(_KINDS)}, or one of them and null"]
    out += [f"{place}.{k}: no whole number from 0 on" for k in _SIZES if k in s and not (_is(s[k], "integer") and s[k] >= 0)]
    out += [f"{place}.{k}: no number" for k in _BOUNDS if k in s and not _is(s[k], "number")]
    for low, high in (("minLength", "maxLength"), ("minItems", "maxItems"), ("minimum", "maximum")):
        if _is(s.get(low), "number") and _is(s.get(high), "number") and s[low] > s[high]:
            out.append(f"{place}.{low}: above {high}")
    if "enum" in s and not (isinstance(s["enum"], list) and s["enum"]):
        out.append(f"{place}.enum: no list of values")
    if "format" in s and s["format"] not in _FORMATS:
        out.append(f"{place}.format: one of {sorted(_FORMATS)}")
    if not isinstance(s.get("properties") or {}, dict):
        return [*out, f"{place}.properties: no object"]
    named = s.get("required") or []
    if not isinstance(named, list) or any(not isinstance(x, str) for x in named) or len(set(named)) != len(named) or not set(named) <= set(s.get("properties") or {}):
        out.append(f"{place}.required: no list of properties, each once")
    if not isinstance(s.get("additionalProperties", False), bool):
        out.append(f"{place}.additionalProperties: no truth value")
    if "array" in kinds and not isinstance(s.get("items"), dict):
        out.append(f"{place}.items: missing")
    return out


def faults_of(schema: Any) -> list[str]:
    """All faults of a schema, each with its place; empty if it is within the subset and its limits."""
    out: list[str] = []
    todo: list[tuple[Any, str, int]] = [(schema, "$", 0)]
    seen = 0
    while todo:
        s, place, depth = todo.pop()
        seen += 1
        if depth > MAX_DEPTH or seen > MAX_NODES:
            return [*out, f"{place}: the schema is too deep or too large"]
        if not isinstance(s, dict):
            out.append(f"{place}: no schema")
            continue
        own = _faults(s, place)
        out += own
        if not any(x.startswith(f"{place}.properties:") for x in own):
            todo += [(sub, f"{place}.{name}", depth + 1) for name, sub in (s.get("properties") or {}).items()]
        todo += [(sub, f"{place}.anyOf[{i}]", depth + 1) for i, sub in enumerate(s.get("anyOf") or [])]
        if isinstance(s.get("items"), dict):
            todo.append((s["items"], f"{place}[]", depth + 1))
    if isinstance(schema, dict) and schema.get("type") != "object":
        out.append("$.type: the root is no object")
    return out


def check_schema(schema: Any) -> dict:
    """The schema, if it is within the subset and its limits; else an error with all its faults."""
    if found := faults_of(schema):
        raise InvalidRequest("; ".join(found))
    return schema


def _of_format(value: str, name: str) -> bool:
    try:
        _FORMATS[name](value)
    except ValueError:
        return False
    return True


def errors_of(value: Any, schema: dict, path: str = "$") -> list[str]:
    """All violations, each with its place; empty if the value is valid."""
    out: list[str] = []
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(_is(value, k) for k in kinds):
            return [f"{path}: not {' or '.join(kinds)}"]
    if "const" in schema and value != schema["const"]:
        out.append(f"{path}: not {schema['const']!r}")
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not one of {schema['enum']!r}")
    if "anyOf" in schema and all(errors_of(value, s, path) for s in schema["anyOf"]):
        out.append(f"{path}: fits none of the alternatives")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            out.append(f"{path}: length {len(value)}")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{path}: does not match {schema['pattern']!r}")
        if "format" in schema and not _of_format(value, schema["format"]):
            out.append(f"{path}: no {schema['format']}")
    if _is(value, "number"):
        low, high = schema.get("exclusiveMinimum"), schema.get("exclusiveMaximum")
        if value < schema.get("minimum", value) or value > schema.get("maximum", value) or low is not None and value <= low or high is not None and value >= high:
            out.append(f"{path}: {value} out of range")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", len(value)):
            out.append(f"{path}: {len(value)} items")
        if schema.get("uniqueItems") and len({repr(v) for v in value}) != len(value):
            out.append(f"{path}: items repeat")
        for i, v in enumerate(value):
            out += errors_of(v, schema.get("items") or {}, f"{path}[{i}]")
    if isinstance(value, dict) and (kinds is not None or "properties" in schema):
        props = schema.get("properties") or {}
        out += [f"{path}.{k}: missing" for k in schema.get("required") or [] if k not in value]
        for k, v in value.items():
            if k in props:
                out += errors_of(v, props[k], f"{path}.{k}")
            elif not schema.get("additionalProperties", False):
                out.append(f"{path}.{k}: not allowed")
    return out
