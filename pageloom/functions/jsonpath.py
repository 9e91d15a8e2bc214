"""JSON in text: cut it out of a body and read simple paths.

Paths are ``$.a.b[2]`` with ``[*]`` steps. Recursive descent and filters are
refused at plan time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import blank_to_null, empty_strings

_STEP = re.compile(r"\.([A-Za-z_][\w-]*|\*)|\[(\d+|\*|'[^']*'|\"[^\"]*\")\]")


def cut_json(body: Column, container: str = "object") -> Column:
    """From the first ``{`` or ``[`` to the last matching bracket; null if there is none."""
    pattern = {"object": r"(?s)(\{.*\})", "list": r"(?s)(\[.*\])"}[container]
    return blank_to_null(F.regexp_extract(body, pattern, 1))


def path_parts(path: str) -> list[str]:
    """Split a path at its wildcards: ``$.a[*].b`` -> ``['$.a', '$.b']``."""
    if not path.startswith("$"):
        raise ValueError(f"a JSON path starts with '$': {path!r}")
    parts, current, end = [], "$", 1
    if path == "$[]":  # the whole document
        return ["$"]
    for m in _STEP.finditer(path, 1):
        if m.start() != end:
            break
        end = m.end()
        if "*" in (m[1], m[2]):
            parts.append(current)
            current = "$"
        elif m[1] is not None:
            current += f".{m[1]}"
        else:
            current += f"[{m[2]}]"
    if end != len(path):
        raise ValueError(f"unsupported JSON path {path!r}: only names, indexes and [*]")
    return parts + [current]


def variant_values(document: Column, path: str) -> Column:
    """Matches of ``path`` in a variant, as ``array<variant>``; nulls dropped."""
    first, *rest = path_parts(path)
    if not rest:
        hit = F.try_variant_get(document, first, "variant")
        return F.when(hit.isNotNull(), F.array(hit)).otherwise(F.array().cast("array<variant>"))
    out = _elements(document, first)
    for part in rest[:-1]:
        out = _flat_elements(out, part)
    if rest[-1] != "$":
        out = F.transform(out, lambda v: F.try_variant_get(v, rest[-1], "variant"))
    return F.filter(out, lambda v: v.isNotNull())


def _flat_elements(documents: Column, path: str) -> Column:
    return F.flatten(F.transform(documents, lambda v: _elements(v, path)))


def _elements(document: Column, path: str) -> Column:
    hit = F.try_variant_get(document, path, "array<variant>")
    return F.coalesce(hit, F.array().cast("array<variant>"))


def json_values(body: Column, path: str) -> Column:
    """Matches of ``path`` in JSON text as text; broken JSON gives none."""
    if len(path_parts(path)) == 1:  # no wildcard: the built-in reader is enough
        value = F.get_json_object(body, path_parts(path)[0])
        return F.when(value.isNotNull(), F.array(value)).otherwise(empty_strings())
    values = variant_values(F.try_parse_json(body), path)
    return F.filter(F.transform(values, variant_text), lambda x: x.isNotNull())


def variant_text(value: Column) -> Column:
    """A value as text; JSON null is no value."""
    text = F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))
    return F.when(~F.is_variant_null(value), text)
