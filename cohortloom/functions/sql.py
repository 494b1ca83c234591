"""SQL text for wide projections.

A frame with hundreds of columns is described in one call instead of several
calls per column, which keeps planning time small.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def named(expression: str, name: str) -> str:
    return f"{expression} AS {quoted(name)}"


def number(value: float) -> str:
    """A double literal, safe next to a minus sign."""
    return f"({float(value)!r}D)"


def double_array(cols: Iterable[str]) -> Column:
    """The columns as one array of doubles."""
    return F.expr(f"array({', '.join(f'CAST({quoted(c)} AS DOUBLE)' for c in cols)})")


def is_floating(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType))


def present(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """Per column, the condition that its value is neither NULL nor NaN."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return {
        c: f"({quoted(c)} IS NOT NULL AND NOT isnan({quoted(c)}))" if c in floating else f"{quoted(c)} IS NOT NULL"
        for c in cols
    }
