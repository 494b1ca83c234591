"""One scan that sums model-sized statistics for many fits at once.

Iterative fits share their scans: every task adds up its rows for all fits that are still running and ships one flat vector, cut into
chunks of ``CHUNK`` numbers. Chunks meet by their number and are added as they arrive, so the rows that are shuffled are tasks times
chunks however many numbers the models have, and nothing but the running sums is held. The driver receives as many numbers as the models
have parameters, however large the data is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cohortloom.functions.sql import double_array, named, quoted
from cohortloom.session import ship_package

# Most statistics of one scan (32 MB of doubles per task); more fits than that take several scans.
MAX_STATISTICS = 4_000_000
# Numbers of one shuffled row.
CHUNK = 8192
# Numbers of one partition of spread rows (32 MB of doubles).
PARTITION_VALUES = 4_000_000
# Partial sums of all tasks together that may meet on the driver instead of in a further stage (8 MB of doubles).
DRIVER_STATISTICS = 1_000_000

_SUMS = "chunk int, places binary, sums binary"


def doubles(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.selectExpr(*[named(f"CAST({quoted(c)} AS DOUBLE)", c) for c in cols])


def points(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The columns as one array column ``x``: a narrow frame that is cheap to plan and scan repeatedly."""
    return df.select(double_array(cols).alias("x"))


def partitions_for(spark: SparkSession, n_rows: int, width: int) -> int:
    """Partitions that give every core as many of them in each scan and hold a bounded number of values."""
    cores = spark.sparkContext.defaultParallelism
    return cores * max(1, -(-n_rows * width // (PARTITION_VALUES * cores)))


def spread(frame: DataFrame, n_rows: int, width: int) -> DataFrame:
    """Rows dealt evenly over the cores. A table of few files or row groups would leave most cores idle in every scan."""
    return frame.repartition(partitions_for(frame.sparkSession, n_rows, width))


def columns_of(batch: pa.RecordBatch) -> np.ndarray:
    """Rows x columns matrix of an Arrow batch of doubles, or of one array column without nulls."""
    first = batch.column(0)
    if batch.num_columns == 1 and pa.types.is_list(first.type):
        return first.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])


def batched_by_size(items: Sequence[Any], sizes: Sequence[int], limit: int = MAX_STATISTICS) -> Iterator[list[int]]:
    """Index groups whose statistics fit one scan together."""
    group: list[int] = []
    used = 0
    for i in range(len(items)):
        if group and used + sizes[i] > limit:
            yield group
            group, used = [], 0
        group.append(i)
        used += sizes[i]
    if group:
        yield group


def chunked(flat: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[int, bytes | None, bytes]]:
    """(number, places, values) of the chunks of a vector that are not all zero; places only where most of a chunk is zero."""
    for number, low in enumerate(range(0, len(flat), chunk)):
        part = flat[low : low + chunk]
        places = np.flatnonzero(part)
        if 2 * len(places) < len(part):
            if len(places):
                yield number, places.astype(np.int32).tobytes(), part[places].tobytes()
        else:
            yield number, None, part.tobytes()


# Chunks of one Arrow batch (4 MB of doubles).
_TOGETHER = 64


def _batches(rows: Iterable[tuple[int, bytes | None, bytes]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, bytes | None, bytes]] = []
    for row in rows:
        held.append(row)
        if len(held) == _TOGETHER:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple[int, bytes | None, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["chunk", "places", "sums"])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes | None, bytes]]:
    yield from zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the chunks of a partition, added as they arrive."""
    acc: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, places, values in _rows(batch):
            into = acc.setdefault(number, np.zeros(0))
            at = np.frombuffer(places, np.int32) if places is not None else slice(0, len(values) // 8)
            size = (int(at.max()) + 1 if len(at) else 0) if places is not None else len(values) // 8
            if size > len(into):
                into = acc[number] = np.concatenate([into, np.zeros(size - len(into))])
            into[at] += np.frombuffer(values)
    yield from _batches((number, None, total.tobytes()) for number, total in acc.items())


def sum_statistics(
    frame: DataFrame,
    state: Any,
    statistics: Callable[[pa.RecordBatch, Any], list[np.ndarray]],
    sizes: Sequence[int],
    tasks: int | None = None,
) -> list[np.ndarray]:
    """Sum the flat vectors that ``statistics`` returns per batch, one vector per fit.

    ``frame`` comes from ``doubles`` or ``points`` and is best persisted for repeated passes. ``state`` holds the parameters of the fits and
    is broadcast: its size is that of the models. Where the number of ``tasks`` is known and their partial sums are small together,
    they are added on the driver, which saves a stage of many short passes.
    """
    ship_package(frame.sparkSession)
    shared = frame.sparkSession.sparkContext.broadcast(state)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        totals: list[np.ndarray] | None = None
        for b in batches:
            if b.num_rows == 0:
                continue
            part = statistics(b, shared.value)
            if totals is None:
                totals = [np.array(p, float) for p in part]
            else:
                for t, p in zip(totals, part, strict=True):
                    t += p
        if totals:
            yield from _batches(chunked(np.concatenate([t.ravel() for t in totals])))

    summed = frame.mapInArrow(partial, _SUMS)
    if tasks is None or tasks * sum(sizes) > DRIVER_STATISTICS:
        summed = summed.repartition("chunk").mapInArrow(_added, _SUMS)
    flat = np.zeros(sum(sizes))
    for batch in summed.toArrow().to_batches():
        for number, places, values in _rows(batch):
            own = np.frombuffer(values)
            low = number * CHUNK
            at = low + np.frombuffer(places, np.int32) if places is not None else slice(low, low + len(own))
            flat[at] += own
    shared.unpersist()
    return np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []
