"""Missing-value profiles, column kinds, counts and report matrices."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.sql import named, present, quoted
from cohortloom.operators.frame import bit_of, mask_columns
from cohortloom.session import ship_package


def missing_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column, n_rows, n_missing, missing_share`` from a single pass.

    One count per column in one wide aggregate: no row is copied per column and
    each task ships one row.  Only the single result row is turned to long form.
    """
    there = present(df, cols)
    counts = df.selectExpr("count(1) AS n_rows", *[named(f"count_if({there[c]})", c) for c in cols])
    return counts.unpivot(["n_rows"], list(cols), "column", "n_present").selectExpr(
        "column",
        "n_rows",
        "n_rows - n_present AS n_missing",
        "try_divide(n_rows - n_present, n_rows) AS missing_share",
    )


def prune_missing(df: DataFrame, cols: Sequence[str], threshold: float = 0.1) -> tuple[DataFrame, list[str]]:
    """Drop columns whose missing share is not strictly below the threshold; other columns stay."""
    kept_rows = missing_profile(df, cols).filter(F.col("missing_share") < threshold).select("column").collect()
    kept = {r["column"] for r in kept_rows}
    keep = [c for c in cols if c in kept]
    dropped = set(cols) - kept
    return df.select(*[c for c in df.columns if c not in dropped]), keep


def kept_by_threshold(df: DataFrame, cols: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """How many columns each missing-share threshold keeps."""
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    return (
        missing_profile(df, cols)
        .select("column", "missing_share", levels)
        .groupBy("threshold")
        .agg(F.count_if(F.col("missing_share") < F.col("threshold")).alias("n_kept"))
    )


KIND_SCHEMA = "position int, column string, kind string, n_levels int, levels array<double>"
# Stands for "too many values"; present values are never NaN.
OVERFLOW = float("nan")


class _FewValues:
    """Distinct values per column position, given up once there are more than ``keep``."""

    def __init__(self, keep: int):
        self.keep, self.values = keep, {}

    def add(self, position: int, values: np.ndarray) -> None:
        known = self.values.get(position, np.empty(0))
        if known is None:
            return
        merged = np.unique(np.concatenate([known, values]))
        too_many = len(merged) > self.keep or np.isnan(merged).any()
        self.values[position] = None if too_many else merged

    def open(self, position: int) -> bool:
        return self.values.get(position, ()) is not None

    def batch(self) -> pa.RecordBatch:
        pairs = [(i, v) for i, values in self.values.items() for v in ([OVERFLOW] if values is None else values)]
        return pa.RecordBatch.from_pydict(
            {"position": pa.array([i for i, _ in pairs], pa.int32()), "value": pa.array([v for _, v in pairs], pa.float64())}
        )


def column_kinds(df: DataFrame, cols: Sequence[str], max_levels: int = 10) -> DataFrame:
    """``column, kind, n_levels, levels`` with kind binary, categorical or continuous.

    Binary means every present value is 0 or 1 (also a column without values);
    categorical means at most ``max_levels`` distinct values.  ``n_levels`` and
    the sorted ``levels`` are NULL for continuous columns.

    One exact scan: a task keeps at most ``max_levels`` distinct values of a
    column and stops looking at it once there are more, so a column ships
    a handful of rows per task, and the driver gets a handful per column.
    """
    spark = df.sparkSession
    ship_package(spark)
    keep = max(max_levels, 2)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        few = _FewValues(keep)
        for b in batches:
            for i in range(b.num_columns):
                if few.open(i):
                    values = b.column(i).drop_null().to_numpy(zero_copy_only=False)
                    few.add(i, values[~np.isnan(values)])
        yield few.batch()

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        few = _FewValues(keep)
        for b in batches:
            positions, values = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for i in np.unique(positions):
                few.add(int(i), values[positions == i])
        yield few.batch()

    schema = "position int, value double"
    cells = df.selectExpr(*[named(f"CAST({quoted(c)} AS DOUBLE)", c) for c in cols])
    found: dict[int, list[float]] = {}
    for r in cells.mapInArrow(scan, schema).repartition("position").mapInArrow(merge, schema).collect():
        found.setdefault(r["position"], []).append(r["value"])
    rows = []
    for i, c in enumerate(cols):
        levels = sorted(found.get(i, []))
        if any(math.isnan(v) for v in levels):
            rows.append((i, c, "continuous", None, None))
        elif set(levels) <= {0.0, 1.0}:
            rows.append((i, c, "binary", 2, levels))
        elif len(levels) <= max_levels:
            rows.append((i, c, "categorical", len(levels), levels))
        else:
            rows.append((i, c, "continuous", None, None))
    return spark.createDataFrame(rows, KIND_SCHEMA)


def split_by_kind(kinds: DataFrame) -> dict[str, list[str]]:
    """Column names per kind, in frame order."""
    out: dict[str, list[str]] = {"binary": [], "categorical": [], "continuous": []}
    for r in kinds.orderBy("position").select("column", "kind").collect():
        out[r["kind"]].append(r["column"])
    return out


def frame_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def cohort_summary(df: DataFrame, group: str, n_features: int) -> DataFrame:
    """Subjects per group with their share, and the feature count."""
    counted = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_subjects"))
    return _with_share(counted, "n_subjects").withColumn("n_features", F.lit(n_features))


def _with_share(counted: DataFrame, count_col: str) -> DataFrame:
    total = counted.agg(F.sum(count_col)).scalar()
    return counted.withColumn("share", F.col(count_col) / total)


def class_shares(df: DataFrame, label: str) -> DataFrame:
    """Size and share of every class of a partition."""
    return _with_share(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), "n")


def overlap_share(ids: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Share of the ids found in another id set."""
    hits = other.select(key).distinct().withColumn("hit", F.lit(1))
    return (
        ids.select(key)
        .distinct()
        .join(hits, key, "left")
        .agg(
            F.count(F.lit(1)).alias("n_ids"),
            F.count("hit").alias("n_found"),
            (F.count("hit") / F.count(F.lit(1))).alias("share_found"),
        )
    )


def pair_counts(memberships: Mapping[str, DataFrame], key: str, targets: Mapping[str, DataFrame]) -> DataFrame:
    """Subjects held by both sides of every ordered pair.

    ``memberships`` maps a question instrument to its complete subjects and
    ``targets`` a score instrument to its scored subjects.  Each subject becomes
    bit masks first, so one aggregation serves every pair.
    """
    n = max(len(memberships), len(targets))
    sides = [(f, i, None) for i, f in enumerate(memberships.values())] + [(f, None, i) for i, f in enumerate(targets.values())]
    tagged = [f.select(key, *mask_columns("_q", n, q), *mask_columns("_s", n, s)) for f, q, s in sides]
    masks = [c for c in tagged[0].columns if c != key]
    per_key = functools.reduce(DataFrame.unionAll, tagged).groupBy(key).agg(*[F.bit_or(m).alias(m) for m in masks])
    seen = per_key.groupBy(*masks).agg(F.count(F.lit(1)).alias("_n"))
    both = []
    for i, x in enumerate(memberships):
        for j, y in enumerate(targets):
            if x != y:
                (qw, qb), (sw, sb) = bit_of(i), bit_of(j)
                held = f"(_q{qw} & {qb}L) <> 0 AND (_s{sw} & {sb}L) <> 0"
                both.append(F.struct(F.lit(x).alias("question_inst"), F.lit(y).alias("score_inst"), F.expr(f"IF({held}, _n, 0L)").alias("n")))
    exploded = seen.select(F.inline(F.array(*both)))
    return exploded.groupBy("question_inst", "score_inst").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def matrix(df: DataFrame, rows: Sequence[str], column: str, codes: Sequence[str], value: str) -> DataFrame:
    """Wide matrix from tidy results; absent cells are 0, as on the diagonal."""
    wide = df.groupBy(*rows).pivot(column, list(codes)).agg(F.first(value, ignorenulls=True))
    return wide.na.fill(0, list(codes))
