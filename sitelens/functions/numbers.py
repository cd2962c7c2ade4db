"""Rounding that comes out the same in every engine: half up, in double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int = 0) -> Column:
    scale = 10.0**digits
    return F.floor(value * scale + 0.5).cast("double") / scale


def half_up_sql(value: str, digits: int = 0) -> str:
    scale = f"{10**digits}.0"
    return f"(CAST(floor(({value}) * {scale} + 0.5) AS DOUBLE) / {scale})"
