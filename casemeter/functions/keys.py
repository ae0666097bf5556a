"""Digests, canonical records and deterministic draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DateType, StructType, TimestampNTZType, TimestampType

UNIT_SEPARATOR = "\u001f"
NULL_MARK = "␀"


def input_key(*cols: str | Column) -> Column:
    """Null-safe composite key of the model input: string casts joined by the unit separator."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(NULL_MARK)) for c in cols]
    return F.concat_ws(UNIT_SEPARATOR, *parts)


def digest(col: str | Column) -> Column:
    return F.sha2(col, 256)


def canonical_json(schema: StructType, cols: Sequence[str]) -> Column:
    """Compact JSON record with sorted keys and explicit nulls; timestamps at second grain."""
    fields = []
    for name in sorted(cols):
        value = F.col(name)
        if isinstance(schema[name].dataType, (TimestampType, TimestampNTZType)):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(schema[name].dataType, DateType):
            value = F.date_format(value, "yyyy-MM-dd")
        fields.append(value.alias(name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def draw(seed: int | str | Column, case_id: str | Column) -> Column:
    """Uniform hexadecimal draw of a case; the sampling order of every split."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    case_id = F.col(case_id) if isinstance(case_id, str) else case_id
    return F.sha2(F.concat_ws("|", seed.cast("string"), case_id.cast("string")), 256)


def draw_index(n: Column, *parts: Column) -> Column:
    """Integer in [0, n) from the first 52 bits of the digest of ``parts``."""
    hexed = F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 13)
    return F.conv(hexed, 16, 10).cast("bigint") % n
