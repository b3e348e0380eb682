"""Documents held against a JSON schema: the first place that does not fit, by a table of keywords.

Supported are the keywords of KEYWORDS and HOLDERS, local references, anyOf and
types; a schema with any other keyword that could refuse something is an error
when the check is made, not when rows are read.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .evidence import _json_error

_NUMBER = lambda v: isinstance(v, int | float) and not isinstance(v, bool)
TYPES = {
    "null": lambda v: v is None, "boolean": lambda v: isinstance(v, bool), "integer": lambda v: isinstance(v, int) and not isinstance(v, bool), "number": _NUMBER,
    "string": lambda v: isinstance(v, str), "array": lambda v: isinstance(v, list), "object": lambda v: isinstance(v, dict),
}


def _is_time(text: str) -> bool:
    try:
        return datetime.datetime.fromisoformat(text.replace("Z", "+00:00")).tzinfo is not None
    except ValueError:
        return False


def _distinct(items: list) -> bool:
    return len({json.dumps(i, sort_keys=True) for i in items}) == len(items)


#: keyword: (the types it is about, whether a value fits)
KEYWORDS = {
    "const": (TYPES, lambda v, want: v == want),
    "enum": (TYPES, lambda v, want: v in want),
    "type": (TYPES, lambda v, want: any(TYPES[t](v) for t in ([want] if isinstance(want, str) else want))),
    "minLength": (("string",), lambda v, n: len(v) >= n),
    "maxLength": (("string",), lambda v, n: len(v) <= n),
    "pattern": (("string",), lambda v, p: re.search(p, v) is not None),
    "format": (("string",), lambda v, name: name != "date-time" or _is_time(v)),
    "minimum": (("number",), lambda v, n: v >= n),
    "maximum": (("number",), lambda v, n: v <= n),
    "minItems": (("array",), lambda v, n: len(v) >= n),
    "maxItems": (("array",), lambda v, n: len(v) <= n),
    "uniqueItems": (("array",), lambda v, on: not on or _distinct(v)),
    "required": (("object",), lambda v, keys: set(keys) <= set(v)),
}
#: Keywords whose values are schemas, and notes that refuse nothing.
HOLDERS = ("$ref", "anyOf", "items", "properties", "additionalProperties", "$defs", "definitions")
NOTES = ("$schema", "$id", "$comment", "title", "description", "default", "examples")


def _children(value, schema: dict) -> Iterator[tuple[str, object, dict | bool]]:
    """(step, value, schema) of what a value holds: false is the schema that nothing fits."""
    if isinstance(value, list) and "items" in schema:
        yield from ((f"[{i}]", v, schema["items"]) for i, v in enumerate(value))
    if isinstance(value, dict):
        own, others = schema.get("properties", {}), schema.get("additionalProperties", True)
        yield from ((f".{k}", v, own.get(k, others)) for k, v in value.items())


def misfit(value, schema: dict | bool, root: dict, at: str = "$") -> str | None:
    """``place: keyword`` of the first thing that does not fit, or None."""
    if isinstance(schema, bool):
        return None if schema else f"{at}: additionalProperties"
    if "$ref" in schema:
        target = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            target = target[part]
        return misfit(value, target, root, at)
    if "anyOf" in schema and all(misfit(value, one, root, at) for one in schema["anyOf"]):
        return f"{at}: anyOf"
    for word, (about, fits) in KEYWORDS.items():
        if word in schema and (about is TYPES or TYPES[about[0]](value)) and not fits(value, schema[word]):
            return f"{at}: {word}"
    return next((bad for step, v, s in _children(value, schema) if (bad := misfit(v, s, root, at + step))), None)


def unknown_keywords(schema) -> set[str]:
    """Keywords of a schema that nothing here tests."""
    if not isinstance(schema, dict):
        return set()
    inner = [schema.get("items"), schema.get("additionalProperties"), *schema.get("anyOf", [])]
    for name in ("properties", "$defs", "definitions"):
        inner += schema.get(name, {}).values()
    return set(schema) - set(KEYWORDS) - set(HOLDERS) - set(NOTES) | set().union(*map(unknown_keywords, inner))


def schema_errors(schema: dict, *, max_bytes: int = 1 << 20, max_depth: int = 64, max_nodes: int = 100_000):
    """A function of a text column: why the text is refused as strict JSON, or where it misses the schema, or null."""
    if unknown := unknown_keywords(schema):
        raise ValueError(f"unsupported keywords: {sorted(unknown)}")

    def one(text):
        return _json_error(text, max_bytes, max_depth, max_nodes) or misfit(json.loads(text), schema, schema)

    @F.pandas_udf(T.StringType())
    def check(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return check
