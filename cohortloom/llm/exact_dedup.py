"""Exact duplicates by a tree-merge of digest runs, in DataFrame operations only.

Every input partition is a run. Within a run, rows of equal digest shrink to one entry with the best row and a count
(map side, before any shuffle). In each round ``fan_in`` neighbouring runs exchange their entries and merge, until one
run is left; the results then travel down the same tree. No key of any round ever has more than ``fan_in`` entries,
so a group with a third of all rows costs no task more than its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.filters import without
from cohortloom.sources.store import checkpointed

WHITE_SPACE = " \t\n\x0b\x0c\r"
_KEY = ["digest", "check", "size"]


def normalized(text: Column) -> Column:
    """Text without the six ASCII white-space characters; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def _merged(runs: DataFrame, keys: list[str], fan_in: int) -> DataFrame:
    return runs.groupBy(*keys, F.expr(f"run div {fan_in}").alias("run")).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def merge_runs(rows: DataFrame, keys: list[str], best: Column, fan_in: int = 8) -> DataFrame:
    """``rows`` with the least ``best`` of all rows of equal keys, and their number n.

    ``rows`` must be a written or checkpointed table with a column ``run`` from 0 on.
    """
    levels = [checkpointed(rows.groupBy(*keys, "run").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n")))]
    last = rows.agg(F.max("run")).first()[0] or 0
    while last > 0:
        levels.append(checkpointed(_merged(levels[-1], keys, fan_in)))
        last //= fan_in
    top = levels.pop()
    while levels:
        above = top.select(*keys, F.col("run").alias("above"), "best", "n")
        below = levels.pop().select(*keys, "run", F.expr(f"run div {fan_in}").alias("above"))
        top = below.join(above, [*keys, "above"]).drop("above")
    return rows.join(top, [*keys, "run"])


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", fan_in: int = 8) -> DataFrame:
    """One row per input row: ``key``, keep_id, group_size, kept, text_sha256, text_hash.

    Rows are equal when their texts without white space are: SHA-256, byte length and an independent 64-bit hash must all
    agree at every merge. The row with the most code points in its original text stays, then the smallest key (a null key
    comes last), then one of the rows that repeat it entirely, so exactly one row of a group is kept. Null texts count as
    empty; all empty texts form one group. Other columns are ignored. An empty table gives an empty result. ``text_hash``
    is the xxhash64 of the original text.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    whole = F.coalesce(F.col(text), F.lit(""))
    norm = normalized(F.col(text))
    rows = checkpointed(
        docs.select(
            F.col(key).alias("id"),
            F.char_length(whole).cast("long").alias("chars"),
            F.xxhash64(whole).alias("text_hash"),
            F.unhex(F.sha2(norm, 256)).alias("digest"),
            F.xxhash64(norm).alias("check"),
            F.octet_length(norm).cast("long").alias("size"),
            F.spark_partition_id().cast("long").alias("run"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    best = F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row").alias("row"))
    found = merge_runs(rows, _KEY, best, fan_in)
    return found.select(
        F.col("id").alias(key),
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "text_hash",
    )


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; a row repeated entirely (key and text) stays once."""
    mark = "text_hash"
    while mark in docs.columns:
        mark = f"_{mark}"
    found = exact_duplicates(docs, key, text)
    texts = checkpointed(found.groupBy(key, "text_hash").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rest = without(marked, texts.where(~F.col("kept")).select(key, "text_hash"), [key, mark])
    if texts.where("kept AND n > 1").limit(1).count():
        rest = rest.dropDuplicates([key, mark])
    return rest.drop(mark)
