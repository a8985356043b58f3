"""Deterministic JSON text and digests over it.

Keys in byte order, no blanks, integers only, NULLs kept, and the shortest
string escapes.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, functions as F

# Short escapes; every other control character is \u00xx.
SHORT_ESCAPES = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def text(value: Column) -> Column:
    """A string as a JSON string."""
    base = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    controls = {chr(i): SHORT_ESCAPES.get(chr(i), f"\\u{i:04x}") for i in range(32)}
    escaped = reduce(lambda acc, c: F.replace(acc, F.lit(c), F.lit(controls[c])), controls, base)
    body = F.when(value.rlike("[\\x00-\\x1f]"), escaped).otherwise(base)
    return F.coalesce(F.concat(F.lit('"'), body, F.lit('"')), F.lit("null"))


def integer(value: Column) -> Column:
    return F.coalesce(value.cast("bigint").cast("string"), F.lit("null"))


def boolean(value: Column) -> Column:
    return F.coalesce(value.cast("boolean").cast("string"), F.lit("null"))


def obj(fields: Mapping[str, Column]) -> Column:
    """An object from already rendered values; ASCII keys."""
    if not all(k.isascii() for k in fields):
        raise ValueError("object keys must be ASCII")
    parts = []
    for i, key in enumerate(sorted(fields)):
        parts += [F.lit(("," if i else "") + f'"{key}":'), fields[key]]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def array(items: Column) -> Column:
    """An array from an ARRAY of already rendered values."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def fingerprint(data: Column, as_of: Column) -> Column:
    """SHA-256 over data followed by its as-of record, as 0x hex."""
    return F.concat(F.lit("0x"), F.sha2(F.concat(data, as_of), 256))
