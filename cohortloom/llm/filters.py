"""Keeping or removing rows by a table of keys or of texts, with a broadcast only behind a check of its size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.sources.store import checkpointed

BROADCAST_ROWS = 500_000


def without(docs: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``docs`` whose keys are not in ``gone`` (null keys equal each other). Columns of ``gone`` are its keys in order.

    ``gone`` is broadcast up to ``BROADCAST_ROWS`` fixed-width rows; beyond that both sides are shuffled and the result is the same.
    """
    names = [f"_gone_{i}" for i in range(len(keys))]
    gone = checkpointed(gone.toDF(*names).distinct())
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    same = F.lit(True)
    for key, name in zip(keys, names, strict=True):
        same = same & F.col(key).eqNullSafe(F.col(name))
    return docs.join(side, same, "left_anti")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, behind as many underscores as it takes not to be a column."""
    while name in df.columns:
        name = f"_{name}"
    return name


def without_texts(docs: DataFrame, text: str, gone: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """Rows whose text is not among those that ``gone`` finds, with all their columns.

    ``gone`` gets the texts as a frame with the names of its key and text columns, and returns a frame of keys. The key is a 128-bit digest of
    the text, so what becomes of a row depends on its text alone: null and repeated keys of ``docs`` do not matter.
    """
    mark = free_name(docs, "text_digest")
    marked = docs.withColumn(mark, F.md5(F.col(text).cast("binary")))
    return without(marked, gone(marked.select(mark, F.col(text).cast("string").alias("text")), mark, "text"), [mark]).drop(mark)
