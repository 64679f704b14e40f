"""Reproducible random draws that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*parts: Column | str | int) -> Column:
    """A number from 0 to 2**32 - 1 that depends on ``parts`` alone."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def draw_sql(*parts: str) -> str:
    """The same in DuckDB's SQL; ``parts`` are SQL expressions."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::BIGINT"
