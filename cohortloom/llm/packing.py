"""Packing by power-of-two decomposition: no sequence holds tokens of two documents and nothing is padded.

A document of n tokens becomes floor(n / longest) pieces of the longest length and then one piece for each binary digit of the
rest. Every piece is a sequence; sequences of equal length stand together (their ids are consecutive), so batches are formed
per length bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.tokens import VOCABULARY, encoder, slices
from cohortloom.llm.tokens import pieces as text_pieces
from cohortloom.session import ship_package
from cohortloom.sources.store import checkpointed


def binary_lengths(n: int, longest: int) -> Iterator[int]:
    """Lengths of the pieces of n tokens, longest first; all are powers of two."""
    for _ in range(n // longest):
        yield longest
    n %= longest
    while n:
        bit = 1 << (n.bit_length() - 1)
        yield bit
        n -= bit


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    longest: int = 2048,
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if wanted).

    A document is its token ids and then ``end_id``, so a null or empty text is one piece of one token. Each id lies in exactly one
    piece. Sequence ids are gapless from 0, shortest bucket first; repeated rows are packed each; other columns are
    ignored; an empty table gives an empty result.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    ship_package(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    named = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int64()), ("place", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, placed = encoder(vocabulary), TaskContext.get().partitionId(), {}
        for piece in slices(batches):
            owner, rows, ids = [], [], []
            for i, t in enumerate(piece.column(1).to_pylist()):
                own = [x for p in text_pieces(t) for x in coder.encode(p)] if t else []
                own.append(end_id)
                doc, start = np.array(own, dtype="<u4"), 0
                for n in binary_lengths(len(doc), longest):
                    here = doc[start : start + n]
                    place = placed[n] = placed.get(n, -1) + 1
                    rows.append((start, n, zlib.crc32(here), len(doc), part, place))
                    owner.append(i)
                    if with_ids:
                        ids.append(here.astype("i4"))
                    start += n
            columns = [piece.column(0).take(pa.array(owner, pa.int32())), *(pa.array(c, f.type) for c, f in zip(np.array(rows, "i8").reshape(-1, 6).T, named, strict=True))]
            names = [key, *named.names]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, part long, place long" + ", ids array<int>" * with_ids
    found = checkpointed(docs.select(F.col(key), F.col(text).cast("string").alias("text")).mapInArrow(cut, schema))

    # A row per length and task: their running sums give every task its first sequence id in each bucket.
    counts = found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("length").agg(F.sum("n").alias("all"))
    first = totals.alias("a").join(F.broadcast(totals.alias("b")), F.col("b.length") < F.col("a.length"), "left")
    first = first.groupBy(F.col("a.length").alias("length")).agg(F.coalesce(F.sum("b.all"), F.lit(0)).alias("first"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(first), "length")
    offsets = offsets.select("length", "part", (F.col("first") + F.col("before")).alias("first"))
    return found.join(offsets, ["length", "part"]).select(
        key, "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.col("place")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
