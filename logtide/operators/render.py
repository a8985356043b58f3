"""Read results in text form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from logtide.functions.hexes import hex0x


def as_hex(rows: DataFrame) -> DataFrame:
    """Every BINARY column (and array of BINARY) as 0x hex."""
    columns = []
    for field in rows.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.BinaryType):
            column = hex0x(column)
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.BinaryType):
            column = F.transform(column, hex0x)
        columns.append(column.alias(field.name))
    return rows.select(*columns)
