"""Exact-size sampling, folds, bootstrap and repeated trials, all seeded by hashes."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.functions.numeric import hash_number, hash_order
from cohortloom.functions.sql import quoted
from cohortloom.sources.store import checkpointed

# 16^4 hash buckets: the most rows ever collected or broadcast here, whatever the size of the data.
BUCKET_DIGITS = 4
# md5 of the key (32) followed by the row digest (16).
HASH_DIGITS = 48
# Longest prefix that starts the buckets of the folds.
MOST_BUCKET_DIGITS = 8
# A bucket with more rows is refined by further digits of the same order; the rows chosen and their folds do not depend on it.
HOT_BUCKET_ROWS = 100_000
# Rows a bucket may hold before a longer prefix is used.
BUCKET_ROWS = 20_000
# Copies of one row written per task when identical rows are restored.
COPIES_PER_TASK = 100_000


def _row_digest(df: DataFrame) -> Column:
    """Sixteen hexadecimal digits that depend on every column."""
    return F.expr(f"lpad(hex(xxhash64({', '.join(map(quoted, df.columns))})), 16, '0')")


def _bucket_counts(df: DataFrame, bucket: Column) -> list[tuple[str, int]]:
    table = df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    return sorted(zip(table["b"].to_pylist(), table["n"].to_pylist()))


def exact_sample(df: DataFrame, key: str, frac: float, seed: int = 1) -> DataFrame:
    """Sample without replacement of exactly round(frac * n) rows: those first in hash order.

    No global sort and no single-task limit.  Counts per hash prefix locate the
    prefix at which the sample ends; prefixes below it are kept by a filter, and
    only the bucket at the cut is refined with further digits.
    """
    if not 0.0 <= frac <= 1.0:
        raise ValueError("frac must lie between 0 and 1")
    hashed = df.withColumn("_h", F.concat(hash_order(key, seed), _row_digest(df)))
    remaining = None
    inside = hashed
    for digits in range(BUCKET_DIGITS, HASH_DIGITS + 1, BUCKET_DIGITS):
        counts = _bucket_counts(inside, F.substring("_h", 1, digits))
        if remaining is None:
            remaining = round(frac * sum(n for _, n in counts))
        cut, cut_size = None, 0
        for bucket, n in counts:
            if n > remaining:
                cut, cut_size = bucket, n
                break
            remaining -= n
        if cut is None:
            return df
        below = hashed.filter(F.col("_h") < F.lit(cut))
        if remaining == 0:
            return below.drop("_h")
        inside = hashed.filter(F.col("_h").startswith(cut))
        if cut_size <= HOT_BUCKET_ROWS and digits < HASH_DIGITS:
            ranked = inside.withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_h")))
            tail = ranked.filter(F.col("_r") <= remaining).drop("_r")
            return below.unionByName(tail).drop("_h")
    # All rows left at the cut are identical, so any of them stands for the others.
    copies = repeat_rows(inside.limit(1).withColumn("_n", F.lit(remaining).cast("long")), "_n")
    return below.unionByName(copies).drop("_h")


def repeat_rows(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its count says, written by many tasks."""
    step = F.lit(COPIES_PER_TASK).cast("long")
    chunks = df.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, step)))
    spread = chunks.repartition(F.col("_from"))
    upto = F.least(F.col("_from") + step, F.col(times)) - 1
    return spread.withColumn("_i", F.explode(F.sequence(F.col("_from"), upto))).drop("_i", "_from", times)


def _prefix(digits: int) -> Column:
    return F.substring("_s", 1, digits)


def _bucket_tree(hashed: DataFrame, digits: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their bucket, and the leaves of the tree of buckets: ``_bucket, _n, _alike``.

    A bucket is a prefix of the order ``_s``. Those with more than ``HOT_BUCKET_ROWS`` rows are split by further digits, level by level;
    a table of them is joined, so neither the driver nor the plan grows with their number. Rows alike in all digits stay together.
    """
    rows = hashed.withColumn("_bucket", _prefix(digits))
    nodes = checkpointed(rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")))
    leaves = None
    while True:
        hot = F.col("_n") > HOT_BUCKET_ROWS
        if digits >= HASH_DIGITS or not nodes.where(hot).limit(1).count():
            nodes = nodes.withColumn("_alike", hot)
            return rows, nodes if leaves is None else leaves.unionAll(nodes)
        cold = nodes.where(~hot).withColumn("_alike", F.lit(False))
        leaves = cold if leaves is None else leaves.unionAll(cold)
        digits = min(HASH_DIGITS, digits + BUCKET_DIGITS)
        rows = rows.join(nodes.where(hot).select("_bucket", F.lit(True).alias("_hot")), "_bucket", "left")
        rows = rows.withColumn("_bucket", F.when(F.col("_hot"), _prefix(digits)).otherwise(F.col("_bucket")))
        nodes = checkpointed(rows.where("_hot").groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")))
        rows = rows.drop("_hot")


def _offsets(leaves: DataFrame, digits: int) -> DataFrame:
    """Leaves with the number of rows in all leaves before them: a prefix sum inside groups of leaves, and one over the few groups."""
    grouped = leaves.withColumn("_group", F.substring("_bucket", 1, max(1, digits // 2)))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("_group").agg(F.sum("_n").alias("_sum")).select("_group", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = grouped.withColumn("_offset", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(groups, "_group")
    return placed.select("_bucket", "_n", "_alike", (F.col("_base") + F.col("_offset")).alias("_offset"))


def _folds_of_buckets(df: DataFrame, key: str, k: int, seed: int, fold_col: str, sizes: dict[str, int]) -> DataFrame:
    """Folds where the sizes of all buckets are known and none is hot: their offsets are a table of bounded size, joined to the ranked rows."""
    buckets = sorted(sizes)
    ends = list(itertools.accumulate(sizes[b] for b in buckets))
    offsets = df.sparkSession.createDataFrame(pa.table({"_bucket": buckets, "_offset": [e - sizes[b] for b, e in zip(buckets, ends)]}))
    # Bytes sort as their hexadecimal digits do, at half the size.
    placed = df.withColumn("_h", hash_order(key, seed)).withColumn("_s", F.unhex(F.concat("_h", _row_digest(df))))
    placed = placed.withColumn("_bucket", F.substring("_h", 1, len(buckets[0]))).drop("_h")
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy("_s")) - 1)
    fold = F.pmod(F.col("_offset") + F.col("_rank"), F.lit(k)).cast("int").alias(fold_col)
    return ranked.join(F.broadcast(offsets), "_bucket").select(*df.columns, fold)


def assign_folds(df: DataFrame, key: str, k: int = 5, seed: int = 1, fold_col: str = "fold") -> DataFrame:
    """Shuffled k folds whose sizes differ by at most one: rank in hash order modulo k.

    The order is that of the key's hash, then of the row's digest; rows alike in both are interchangeable.  The rank is the offset
    of a bucket (a prefix of that order) plus the position inside it, so no sort spans more than a bucket; rows alike in the whole order
    are numbered by arithmetic.
    """
    if k < 2:
        raise ValueError("k-fold needs at least two folds")
    # One pass gives the number of rows and the sizes of all buckets of a short prefix.
    counts = _bucket_counts(df, F.substring(hash_order(key, seed), 1, BUCKET_DIGITS))
    total = sum(n for _, n in counts)
    if total < k:
        raise ValueError(f"cannot cut {total} rows into {k} folds")
    # The shortest prefix whose buckets stay small enough for one task.
    digits = next((d for d in range(1, MOST_BUCKET_DIGITS) if total <= BUCKET_ROWS * 16**d), MOST_BUCKET_DIGITS)
    if digits <= BUCKET_DIGITS:
        sizes: dict[str, int] = {}
        for bucket, n in counts:
            sizes[bucket[:digits]] = sizes.get(bucket[:digits], 0) + n
        if max(sizes.values()) <= HOT_BUCKET_ROWS:
            return _folds_of_buckets(df, key, k, seed, fold_col, sizes)
    hashed = df.withColumn("_s", F.concat(hash_order(key, seed), _row_digest(df)))
    rows, leaves = _bucket_tree(hashed, digits)
    offsets = checkpointed(_offsets(leaves, digits))
    alike = offsets.where("_alike").limit(1).count()
    single = offsets.where("NOT _alike") if alike else offsets
    ranked = rows.join(single.select("_bucket", "_offset"), "_bucket")
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy("_bucket").orderBy("_s")) - 1)
    fold = F.pmod(F.col("_offset") + F.col("_rank"), F.lit(k)).cast("int").alias(fold_col)
    out = ranked.select(*df.columns, fold)
    if not alike:
        return out
    names = [f"_c{i}" for i in range(len(df.columns))]
    hot = offsets.where("_alike").select("_bucket", "_offset", "_n")
    firsts = rows.join(hot.select("_bucket"), "_bucket", "left_semi").groupBy("_bucket").agg(*[F.first(quoted(c)).alias(n) for c, n in zip(df.columns, names)])
    one = firsts.join(hot, "_bucket")
    # Every fold gets its share of the rows that are alike.
    shares = one.withColumn("_rank", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("_copies", F.expr(f"(_n - _rank + {k - 1}) div {k}")).filter("_copies > 0")
    copies = repeat_rows(shares.select("_copies", *[F.col(n).alias(c) for c, n in zip(df.columns, names)], fold), "_copies")
    return out.unionByName(copies)


def hash_folds(df: DataFrame, key: str, k: int = 5, seed: int = 1, fold_col: str = "fold") -> DataFrame:
    """Folds by hash modulo: no shuffle, sizes equal in expectation only."""
    return df.withColumn(
        fold_col,
        F.pmod(hash_number(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.lit(k)).cast("int"),
    )


def bootstrap_means(
    scores: DataFrame, groups: Sequence[str], order: str, value: str, reps: int = 1000, seed: int = 1
) -> DataFrame:
    """Means of ``reps`` resamples with replacement, one row per group and repetition.

    A group is the handful of fold scores of one model and pair.
    """
    per_group = scores.groupBy(*groups).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("_s")
    )
    reps_df = per_group.select(
        *groups, "_s", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")
    )

    def draw(i: Column) -> Column:
        text = F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), i.cast("string"))
        index = F.pmod(hash_number(text), F.size("_s")).cast("int")
        return F.get(F.col("_s"), index)

    picks = F.transform(F.sequence(F.lit(0), F.size("_s") - 1), draw)
    total = F.aggregate(picks, F.lit(0.0), lambda a, x: a + x)
    return reps_df.select(*groups, "rep", (total / F.size("_s")).alias("boot_mean"))


def bootstrap_interval(
    scores: DataFrame,
    groups: Sequence[str],
    order: str,
    value: str,
    reps: int = 1000,
    seed: int = 1,
    level: float = 0.95,
) -> DataFrame:
    """Mean of the fold scores with the percentile interval of the bootstrap means."""
    tail = (1.0 - level) / 2.0
    boot = bootstrap_means(scores, groups, order, value, reps, seed)
    bounds = boot.groupBy(*groups).agg(
        F.percentile("boot_mean", F.lit(tail)).alias("ci_low"),
        F.percentile("boot_mean", F.lit(1.0 - tail)).alias("ci_high"),
    )
    means = scores.groupBy(*groups).agg(F.avg(value).alias("mean"))
    return means.join(bounds, list(groups))


def t_interval(scores: DataFrame, groups: Sequence[str], value: str, quantile: float = 2.776445) -> DataFrame:
    """Student-t interval of the fold mean; the default quantile is that of 4 degrees of freedom at 95 %."""
    half = F.lit(quantile) * F.stddev_samp(value) / F.sqrt(F.count(value))
    return scores.groupBy(*groups).agg(
        F.avg(value).alias("mean"),
        (F.avg(value) - half).alias("ci_low"),
        (F.avg(value) + half).alias("ci_high"),
    )


def mean_std(trials: DataFrame, by: str, metrics: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation of every metric over repeats."""
    return trials.groupBy(by).agg(
        *[F.avg(m).alias(f"mean_{m}") for m in metrics],
        *[F.stddev_pop(m).alias(f"std_{m}") for m in metrics],
    )


def run_trials(
    spark: SparkSession, tasks: Iterable[tuple], work: Callable[..., Any], parallelism: int = 4
) -> list[Any]:
    """Run independent distributed fits from a small driver thread pool, results in task order."""
    tasks = list(tasks)
    if parallelism <= 1 or len(tasks) <= 1:
        return [work(*t) for t in tasks]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        runner = inheritable_thread_target(spark)(work)
        return list(pool.map(lambda t: runner(*t), tasks))
