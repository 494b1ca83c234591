"""Quality selection by importance resampling.

Two hashed byte n-gram models are estimated: one of the target (texts labelled good), one of all raw text. The log of their ratio is a
document's importance; adding Gumbel noise and taking the k largest keys draws k documents without replacement in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.tokens import slices
from cohortloom.llm.words import text_bytes
from cohortloom.session import ship_package
from cohortloom.sources.store import checkpointed

ORDERS = (2, 4)
BUCKETS = 1 << 16
# At most so many labelled rows stand for the target.
SAMPLE_ROWS = 20_000


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram that starts at each byte, and whether it lies within one text."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    h = np.zeros(n, np.uint32)
    for k in range(order):
        h = h * np.uint32(0x01000193) + data[k : n + k]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    inside = np.ones(n, bool)
    for k in range(1, order):
        starts = offsets[1:-1] - k
        inside[starts[(starts >= 0) & (starts < n)]] = False
    return (h >> np.uint32(16)).astype(np.int64), inside


def _counts(texts: DataFrame) -> np.ndarray:
    """Counts of all buckets over all texts: each task gives one row for each order and block of buckets, Spark adds them up."""
    block = 1 << 10

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(ORDERS), BUCKETS), np.int64)
        for part in slices(b.select([0, 0]) for b in batches):
            data, offsets = text_bytes(part.column(0))
            for i, order in enumerate(ORDERS):
                h, inside = grams(data, offsets, order)
                total[i] += np.bincount(h[inside], minlength=BUCKETS)
        flat = total.reshape(-1)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["bucket", "n"])

    counts = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = counts.groupBy(F.expr(f"bucket div {block}").alias("block")).agg(F.collect_list(F.struct("bucket", "n")).alias("own")).collect()
    total = np.zeros(len(ORDERS) * BUCKETS)
    for r in rows:
        for bucket, n in r["own"]:
            total[bucket] = n
    return total.reshape(len(ORDERS), BUCKETS)


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of the smoothed target over the smoothed raw model, by order and bucket; the raw model is the prior of the target."""
    p = (raw + 0.5) / (raw + 0.5).sum(axis=1, keepdims=True)
    strength = 0.02 * np.maximum(target.sum(axis=1, keepdims=True), 1.0)
    q = (target + strength * p) / (target + strength * p).sum(axis=1, keepdims=True)
    return np.log(q) - np.log(p)


def weigh(docs: DataFrame, table: np.ndarray, key: str, text: str) -> DataFrame:
    """``key``, log_weight: the sum of the log ratios of all n-grams of the whole text (0 for an empty one)."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offsets = text_bytes(part.column(1))
            total = np.zeros(part.num_rows)
            for i, order in enumerate(ORDERS):
                h, inside = grams(data, offsets, order)
                sums = np.concatenate([[0.0], np.cumsum(np.where(inside, shared.value[i][h], 0.0))])
                total += sums[np.minimum(offsets[1:], len(h))] - sums[np.minimum(offsets[:-1], len(h))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total)], names=[key, "log_weight"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, log_weight double")


def kth_largest(rows: DataFrame, column: str, k: int, buckets: int = 1024, few: int = 4096) -> float | None:
    """The exact k-th largest value by repeated histograms: no sort, and at most ``few`` values reach the driver."""
    found = rows.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count(column).alias("n")).first()
    if k <= 0 or not found["n"]:
        return None
    low, high, k = found["low"], found["high"], min(k, found["n"])
    while True:
        own = rows.where(F.col(column).between(F.lit(low), F.lit(high)))
        width = (high - low) / buckets
        if width <= 0 or low + width == low or high - width == high:
            values = [(r[0], r["n"]) for r in own.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc(column)).limit(few).collect()]
            break
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(buckets - 1))
        cells = own.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for cell in sorted(cells.collect(), key=lambda r: -r["at"]):
            if cell["n"] >= k:
                low, high, n = cell["low"], cell["high"], cell["n"]
                break
            k -= cell["n"]
        if n <= few:
            values = [(r[0], 1) for r in rows.where(F.col(column).between(F.lit(low), F.lit(high))).select(column).collect()]
            break
    for value, n in sorted(values, reverse=True):
        k -= n
        if k <= 0:
            break
    return value


def resample(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    share: float | None = None,
    seed: int = 1,
) -> DataFrame:
    """The drawn documents: ``key``, log_weight, gumbel_key, kept (always true).

    ``share`` of all rows is drawn (rounded), by default the share of good rows among the labelled ones, so the sample has
    the size of the target part. The target is estimated from at most ``SAMPLE_ROWS`` good rows (smallest key hashes), the raw
    model and the weights from all rows. The noise comes from a hash of key and seed, so a row draws the same on any cluster; rows tied
    with the last one drawn all stay (repeated rows). Empty and null texts weigh 0. Without good labels, or on an empty
    table, nothing is drawn.
    """
    ship_package(docs.sparkSession)
    known = labels.where(f"`{label}` IN (0, 1)")
    if share is None:
        share = known.agg(F.avg(label)).first()[0] or 0.0
    good = known.where(f"`{label}` = 1").select(F.col(key).alias("good")).distinct().orderBy(F.xxhash64("good"), "good").limit(SAMPLE_ROWS)
    texts = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    target = _counts(texts.join(F.broadcast(good), F.col(key) == F.col("good")).select("text"))
    raw = _counts(texts.select("text"))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11).cast("double") + 0.5) / float(1 << 53)
    noisy = weigh(docs, log_ratio(target, raw), key, text).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))
    noisy = checkpointed(noisy)
    least = kth_largest(noisy, "gumbel_key", round(share * noisy.count()))
    chosen = noisy.where(F.col("gumbel_key") >= least) if least is not None else noisy.limit(0)
    return chosen.withColumn("kept", F.lit(True))
