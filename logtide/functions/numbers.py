"""Integer parsing and wide-word arithmetic. Parsers give NULL on rejection."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

UINT64_MAX = Decimal(2**64 - 1)
INT64_MAX = Decimal(2**63 - 1)
LIMB = 2**32        # a 256-bit word is read as eight limbs of this size
GROUP = 10**9       # decimal digits are kept in groups of nine


def parse_uint64(text: Column) -> Column:
    """Decimal text to an unsigned 64-bit value, held as DECIMAL(20,0)."""
    value = text.try_cast("decimal(20,0)")
    return F.when(text.rlike(r"^\+?[0-9]+$") & (value <= F.lit(UINT64_MAX)), value)


def narrow_int64(value: Column) -> Column:
    """Unsigned value to LONG; anything past the signed range is rejected."""
    return F.when(value <= F.lit(INT64_MAX), value.cast("long"))


def parse_uint_as_int64(text: Column) -> Column:
    """Hex (0x…) or decimal text, blanks trimmed, to LONG; the plain hex that nodes send takes one pattern."""
    plain = text.rlike(r"\A0x[0-9a-fA-F]{1,15}\z")
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    digits = F.regexp_extract(trimmed, r"^0[xX]\+?0*([0-9a-fA-F]*)$", 1)
    # 16 digits are the most conv can take; beyond that the value cannot fit anyway
    from_hex = F.when(F.length(digits) <= 16,
                      F.conv(F.concat(F.lit("0"), digits), 16, 10).cast("decimal(20,0)"))
    return (
        F.when(plain, F.conv(F.substring(text, 3, 15), 16, 10).cast("long"))
        .when(trimmed.rlike(r"^0[xX]\+?[0-9a-fA-F]+$"), narrow_int64(from_hex))
        .when(trimmed.rlike(r"^\+?[0-9]+$"), trimmed.try_cast("long"))
    )


def word_tail(raw: Column, size: int) -> Column:
    """The last ``size`` (at most 8) bytes of a 32-byte word as decimal text."""
    return F.conv(F.hex(F.substring(raw, 33 - size, size)), 16, 10)


def _add_limb(groups: Column, limb: Column) -> Column:
    """groups * LIMB + limb, least significant group first, in 64-bit arithmetic."""
    start = F.struct(F.array().cast("array<bigint>").alias("done"), limb.alias("carry"))

    def step(state: Column, group: Column) -> Column:
        total = group * F.lit(LIMB) + state["carry"]
        return F.struct(
            F.concat(state["done"], F.array(total % GROUP)).alias("done"),
            F.call_function("div", total, F.lit(GROUP)).alias("carry"),
        )

    return F.aggregate(groups, start, step)["done"]


def uint256_text(raw: Column) -> Column:
    """A 32-byte word as decimal text at its full width.

    Values under 2^64 take one ``conv``; wider ones fold eight 32-bit limbs
    into nine-digit groups, still inside the JVM.
    """
    zeros = F.array_repeat(F.lit(0).cast("long"), 9)
    limbs = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.conv(F.hex(F.substring(raw, i * 4 + 1, F.lit(4))), 16, 10).cast("long"),
    )
    groups = F.aggregate(limbs, zeros, _add_limb)
    digits = F.array_join(
        F.transform(F.reverse(groups), lambda g: F.lpad(g.cast("string"), 9, "0")), "")
    wide = F.regexp_replace(digits, "^0+(?=.)", "")
    return (
        F.when(F.substring(raw, 1, 24) == F.lit(bytes(24)), word_tail(raw, 8))
        .otherwise(wide)
    )
