"""Standard scaling with the population standard deviation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.sql import double_array, named, number, quoted


def vector_moments(df: DataFrame, cols: Sequence[str]) -> tuple[int, dict[str, tuple[float, float]]]:
    """Row count, and mean and population standard deviation per column of complete rows.

    One vector summary instead of two aggregates per column keeps the plan small for hundreds of columns.
    """
    vector = array_to_vector(double_array(cols))
    summary = Summarizer.metrics("count", "mean", "variance").summary(F.col("x"))
    # A constant group yields no row for an empty frame, where a plain aggregate would fail.
    row = df.select(vector.alias("x")).groupBy(F.lit("all")).agg(summary.alias("s")).first()
    if row is None:
        return 0, {c: (0.0, 0.0) for c in cols}
    s, n = row["s"], row["s"]["count"]
    mean, scale = s["mean"].toArray(), np.sqrt(s["variance"].toArray() * (n - 1) / n)
    return n, {c: (float(m), float(d)) for c, m, d in zip(cols, mean, scale)}


def scaler_moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and scale per column; a constant column gets scale 1."""
    return {c: (m, d or 1.0) for c, (m, d) in vector_moments(df, cols)[1].items()}


def apply_scaler(df: DataFrame, moments: dict[str, tuple[float, float]]) -> DataFrame:
    return df.selectExpr(
        *[
            named(f"({quoted(c)} - {number(moments[c][0])}) / {number(moments[c][1])}", c) if c in moments else quoted(c)
            for c in df.columns
        ]
    )


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Centre and divide by the population standard deviation."""
    return apply_scaler(df, scaler_moments(df, cols))
