"""Relational building blocks: projections, filters, keyed joins, unions."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.catalog import Feature
from cohortloom.functions.sql import named, present, quoted

JOIN_KINDS = ("outer", "inner", "left", "right")


def project(df: DataFrame, key: str, cols: Sequence[str], names: Mapping[str, str] | None = None) -> DataFrame:
    """Key plus the named columns, renamed in the same projection."""
    names = names or {}
    return df.selectExpr(quoted(key), *[named(quoted(c), names.get(c, c)) for c in cols if c != key])


def prefix_columns(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Prefix every column but the key."""
    return df.selectExpr(quoted(key), *[named(quoted(c), prefix + c) for c in df.columns if c != key])


def group_by_instrument(features: Iterable[Feature]) -> dict[str, list[Feature]]:
    """Features per instrument in first-seen order, each feature once."""
    groups: dict[str, list[Feature]] = {}
    for f in features:
        group = groups.setdefault(f.inst_code, [])
        if f not in group:
            group.append(f)
    return groups


def within(df: DataFrame, ranges: Mapping[str, tuple[float, float]], below: Mapping[str, float] | None = None) -> DataFrame:
    """Rows inside every closed range and strictly below every limit; missing never passes."""
    below = below or {}
    there = present(df, [*ranges, *below])
    conditions = [f"{there[c]} AND {quoted(c)} BETWEEN {lo} AND {hi}" for c, (lo, hi) in ranges.items()]
    conditions += [f"{there[c]} AND {quoted(c)} < {limit}" for c, limit in below.items()]
    return df.filter(" AND ".join(conditions)) if conditions else df


def complete_cases(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows without a missing value.

    One ``IS NOT NULL`` per column rather than ``na.drop``: only the former is
    pushed to the scans and lets Catalyst drop the padding side of outer joins.
    """
    cols = df.columns if cols is None else cols
    return df.filter(" AND ".join(present(df, cols).values())) if cols else df


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed.  Spark broadcasts the list only when its measured size allows."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def union_common(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL over the columns all frames share, in the order of the first."""
    common = [c for c in frames[0].columns if all(c in f.columns for f in frames[1:])]
    if not common:
        raise ValueError("the frames share no column")
    return functools.reduce(DataFrame.unionByName, [f.select(*common) for f in frames])


def _null_columns(df: DataFrame, cols: Iterable[str]) -> list[str]:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [named(f"CAST(NULL AS {types[c]})", c) for c in cols]


def _payload(df: DataFrame, key: str) -> list[str]:
    return [c for c in df.columns if c != key]


# Bits of a mask column that are used.
MASK_BITS = 62


def bit_of(i: int) -> tuple[int, int]:
    """Mask column and bit of the i-th frame."""
    return i // MASK_BITS, 1 << (i % MASK_BITS)


def mask_columns(prefix: str, n: int, i: int | None = None) -> list[Column]:
    """Mask columns for n frames, with the bit of frame ``i`` set."""
    word, bit = bit_of(i) if i is not None else (-1, 0)
    return [F.lit(bit if w == word else 0).cast("long").alias(f"{prefix}{w}") for w in range(-(-n // MASK_BITS))]


def _membership(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """One row per key with bit masks of the frames that hold it.

    Only the key column is scanned, and the masks are combined on the map side,
    so a key that repeats millions of times ships one row per task.
    """
    tagged = [f.select(key, *mask_columns("_mask", len(frames), i)).filter(F.col(key).isNotNull()) for i, f in enumerate(frames)]
    masks = [c for c in tagged[0].columns if c != key]
    return functools.reduce(DataFrame.unionAll, tagged).groupBy(key).agg(*[F.bit_or(m).alias(m) for m in masks])


def _padded_join(frames: Sequence[DataFrame], key: str, required: Sequence[int]) -> DataFrame:
    """Outer (``required`` empty) or left (``required=[0]``) join as a chain of inner joins.

    A chain of full outer joins shuffles the growing wide frame again at every
    step, and Spark cannot split a skewed partition of one.  Here every frame is
    first padded with null rows for the keys it lacks; inner joins then shuffle
    each frame once on the same key, keep that partitioning, and stay eligible
    for skew splitting on both sides.  A null-rejecting filter above makes
    Catalyst delete the padding and leaves the plain inner joins.
    """
    members = _membership(frames, key)
    there = [f"_mask{w} & {bit}L <> 0" for w, bit in map(bit_of, required)]
    joined = None
    for i, f in enumerate(frames):
        word, bit = bit_of(i)
        absent = " AND ".join([f"_mask{word} & {bit}L = 0", *there])
        cols = _payload(f, key)
        side = f
        if i not in required:
            padding = members.filter(absent).selectExpr(quoted(key), *_null_columns(f, cols))
            side = f.select(key, *cols).unionAll(padding)
        joined = side if joined is None else joined.join(side, key)
    # NULL keys equal nothing, so their rows pass through unmatched.
    keep_null_keys = required or range(len(frames))
    for i in keep_null_keys:
        cols = [
            quoted(c) if j == i else null
            for j, f in enumerate(frames)
            for c, null in zip(_payload(f, key), _null_columns(f, _payload(f, key)))
        ]
        joined = joined.unionAll(frames[i].filter(F.col(key).isNull()).selectExpr(quoted(key), *cols))
    return joined


def keyed_join(frames: Sequence[DataFrame], key: str, how: str = "outer") -> DataFrame:
    """Join frames on one key; duplicate keys fan out as in any equi-join."""
    if not frames:
        raise ValueError("nothing to join: the feature list is empty")
    if how not in JOIN_KINDS:
        raise ValueError(f"unsupported join kind {how!r}; use one of {', '.join(JOIN_KINDS)}")
    names = [c for f in frames for c in _payload(f, key)]
    clashes = sorted({c for c in names if names.count(c) > 1})
    if clashes:
        raise ValueError(f"columns occur in more than one table: {', '.join(clashes)}")
    if len(frames) == 1:
        return frames[0]
    if how == "outer":
        return _padded_join(frames, key, [])
    if how == "left":
        return _padded_join(frames, key, [0])
    return functools.reduce(lambda a, b: a.join(b, key, how), frames)


def join_features(
    tables: Mapping[str, DataFrame],
    features: Sequence[Feature],
    key: str,
    how: str = "outer",
    rename: bool = True,
) -> DataFrame:
    """Wide frame of the requested features, one join input per instrument."""
    frames = []
    for code, group in group_by_instrument(features).items():
        if code not in tables:
            raise ValueError(f"instrument {code!r} is not loaded; loaded: {', '.join(tables)}")
        names = {f.source_col: f.col for f in group} if rename else {}
        frames.append(project(tables[code], key, [f.source_col for f in group], names))
    return keyed_join(frames, key, how)
