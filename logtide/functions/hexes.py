"""Bytes and hex text. Parsers give NULL for input they reject."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EMPTY = b""
ZERO32 = bytes(32)


def hex0x(value: Column) -> Column:
    """Bytes as 0x-prefixed lowercase hex."""
    return F.concat(F.lit("0x"), F.lower(F.hex(value)))


def word(number: Column, size: int = 32) -> Column:
    """A non-negative integer as big-endian bytes of a fixed size."""
    return F.unhex(F.lpad(F.hex(number), 2 * size, "0"))


def _digits(text: Column, any_case_prefix: bool) -> Column:
    """Hex text without its prefix; no pattern, as this runs on all text of a log."""
    prefixed = text.startswith("0x")
    if any_case_prefix:
        prefixed |= text.startswith("0X")
    return F.when(prefixed, F.substring(text, 3, 2**31 - 1)).otherwise(text)


def parse_bytes(text: Column, any_case_prefix: bool = False) -> Column:
    """Hex text, prefix optional, to bytes; ``0x`` alone is empty bytes."""
    return F.when(F.octet_length(text) % 2 == 0, F.unhex(_digits(text, any_case_prefix)))  # a prefix has two


def parse_fixed(text: Column, size: int, any_case_prefix: bool = False) -> Column:
    """As :func:`parse_bytes`, but only exactly ``size`` bytes pass."""
    digits = _digits(text, any_case_prefix)
    return F.when(F.octet_length(digits) == 2 * size, F.unhex(digits))


def parse_bytes32_array(texts: Column) -> Column:
    """Array of hex text to array of 32-byte values; one bad element rejects all."""
    parsed = F.transform(texts, lambda t: parse_fixed(t, 32))
    return F.when(F.forall(parsed, lambda b: b.isNotNull()), parsed)


def text_or_hex(raw: Column) -> Column:
    """Bytes as UTF-8 text, or as 0x hex where they are not valid UTF-8."""
    as_text = raw.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(hex0x(raw))


def hex_field_as_text(text: Column) -> Column:
    """A JSON bytes field read as text: unprefixed text passes through unchanged."""
    raw = parse_bytes(text, any_case_prefix=True)
    return F.when(text.rlike("^0[xX]"), text_or_hex(raw)).otherwise(text)
