"""Typed access to decoded payloads kept as JSON text.

A payload is parsed once to VARIANT; each getter gives NULL where the field is
missing or has another JSON type, and :func:`field_error` says which.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logtide.functions import hexes, numbers


def parse(json_text: Column) -> Column:
    return F.try_parse_json(json_text)


def _json_type(payload: Column, field: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(payload, f"$.{field}", "variant"))


def get_string(payload: Column, field: str) -> Column:
    text = F.try_variant_get(payload, f"$.{field}", "string")
    return F.when(_json_type(payload, field) == "STRING", text)


def field_error(payload: Column, field: str) -> Column:
    """NULL for a JSON string, else ``missing`` or ``not_string``."""
    found = _json_type(payload, field)
    return F.when(found.isNull(), F.lit("missing")).when(found != "STRING", F.lit("not_string"))


def get_bytes32(payload: Column, field: str) -> Column:
    return hexes.parse_fixed(get_string(payload, field), 32)


def get_bytes(payload: Column, field: str) -> Column:
    return hexes.parse_bytes(get_string(payload, field))


def get_uint64(payload: Column, field: str) -> Column:
    return numbers.parse_uint64(get_string(payload, field))


def get_uint8(payload: Column, field: str) -> Column:
    """A JSON integer from 0 to 255; JSON text is rejected."""
    value = F.try_variant_get(payload, f"$.{field}", "bigint")
    return F.when((_json_type(payload, field) == "BIGINT") & value.between(0, 255),
                  value.cast("short"))


def get_bytes32_array(payload: Column, field: str) -> Column:
    items = F.try_variant_get(payload, f"$.{field}", "array<variant>")
    texts = F.transform(
        items,
        lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return hexes.parse_bytes32_array(texts)


