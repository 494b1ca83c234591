"""Casting, rounding and reproducible hash order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.sql import named, quoted


def to_double(df: DataFrame, key: str, cols: Sequence[str] | None = None, lenient: bool = False) -> DataFrame:
    """Cast the columns to double.  Text that is no number raises, or becomes NULL when ``lenient``."""
    cols = [c for c in df.columns if c != key] if cols is None else cols
    chosen, cast = set(cols), "TRY_CAST" if lenient else "CAST"
    return df.selectExpr(
        *[named(f"{cast}({quoted(c)} AS DOUBLE)", c) if c in chosen else quoted(c) for c in df.columns]
    )


def round_half_even(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Round to whole numbers, halves to the even neighbour."""
    chosen = set(cols)
    # Adding zero turns a negative zero into zero.
    return df.selectExpr(
        *[named(f"rint({quoted(c)}) + 0.0D", c) if c in chosen else quoted(c) for c in df.columns]
    )


def hash_order(key: str, seed: int) -> Column:
    """Seeded pseudo-random order: hexadecimal md5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def hash_number(text: Column, digits: int = 8) -> Column:
    """Leading hexadecimal digits of md5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")
