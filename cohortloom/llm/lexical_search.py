"""Ranked lexical search over hashed max-sketches.

The impact of a term in a document is its whole share of a score. Every document folds the impacts of its terms into a sketch of
``COORDINATES`` numbers: a term's hash names its coordinate, and of the terms that meet there the greatest impact stays. A query that
adds up the coordinates of its own terms therefore never gets less than the true score. Bounds of a batch of documents for all queries
are one matrix product, as narrow as the sketch however large the vocabulary is; then each query scores documents exactly by
descending bound until the bound falls below its k-th best score so far.

Only terms that some query holds have impacts: no other can raise a score, and folding it in would only loosen the bounds. The queries
travel in blocks of bounded size; a block costs two scans of the documents (statistics, search), and k rows per query leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cohortloom.llm.terms import terms
from cohortloom.llm.tokens import slices
from cohortloom.session import ship_package
from cohortloom.sources.store import checkpointed

COORDINATES = 2048
BLOCK_CHARS = 2_000_000
# Rows of a sketch matrix, documents rescored at once, and parts in which a query's best rows meet before they meet at last.
SKETCH_ROWS = 1024
STEP = 64
PARTS = 256


@dataclass
class Vocabulary:
    """Distinct terms of a block of queries: sorted hashes, and the places of each query's terms in them."""

    hashes: np.ndarray
    first: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Vocabulary:
        pairs = list(terms(pa.array(texts, pa.string())))
        h = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.uint64)
        row = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
        hashes, place = np.unique(h, return_inverse=True)
        own = np.unique(row * max(1, len(hashes)) + place)
        row, place = own // max(1, len(hashes)), own % max(1, len(hashes))
        return cls(hashes, np.searchsorted(row, np.arange(len(texts) + 1)), place)

    def filter(self) -> np.ndarray:
        """Which low bits of a hash occur at all: most terms of a document are settled by one look."""
        seen = np.zeros(1 << 20, bool)
        seen[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return seen

    def find(self, h: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the hashes that are in the vocabulary, and their places there."""
        likely = np.flatnonzero(seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = np.searchsorted(self.hashes, h[likely])
        place[place == len(self.hashes)] = 0
        sure = self.hashes[place] == h[likely] if len(self.hashes) else np.zeros(len(likely), bool)
        return likely[sure], place[sure]


@dataclass
class Queries:
    """A block of queries with all that scores need: term weights, the size of the corpus, sketch coordinates."""

    ids: list
    vocabulary: Vocabulary
    weight: np.ndarray
    documents: int
    tokens: int
    coordinates: int
    best: int


def postings(column: pa.Array, vocabulary: Vocabulary, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms per row with repeats, and (row, place in the vocabulary, occurrences) of the vocabulary's terms, by row and place."""
    n, width = np.zeros(len(column), np.int64), max(1, len(vocabulary.hashes))
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for h, row in terms(column):
        n += np.bincount(row, minlength=len(column))
        at, place = vocabulary.find(h, seen)
        own, k = np.unique(row[at] * width + place, return_counts=True)
        keys, where = np.unique(np.concatenate([keys, own]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([counts, k]), len(keys)).astype(np.int64)
    return n, keys // width, keys % width, counts


def statistics(rows: DataFrame, vocabulary: Vocabulary) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms with repeats, and how many documents hold each term of the vocabulary: one scan, sums only."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    width = len(vocabulary.hashes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = shared.value.filter(), np.zeros(width + 2, np.int64)
        for part in slices(batches):
            n, _, place, _ = postings(part.column(1), shared.value, seen)
            total[:width] += np.bincount(place, minlength=width)
            total[width:] += [np.count_nonzero(n), n.sum()]
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slot, pa.int64()), "n": pa.array(total[slot], pa.int64())})

    total = np.zeros(width + 2, np.int64)
    for slot, n in rows.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        total[slot] = n
    return int(total[-2]), int(total[-1]), total[:-2]


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * k + 1))) for k in df.tolist()], np.int64)


def impacts(n: np.ndarray, row: np.ndarray, place: np.ndarray, tf: np.ndarray, block: Queries) -> np.ndarray:
    """Share of every posting in a score; lengths meet in Python's integers, which cannot overflow."""
    m = np.array([10 + 90 * k * block.documents // max(1, block.tokens) for k in n.tolist()], np.int64)
    return block.weight[place] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))


class Best:
    """The best documents of one query so far, in the order of the result."""

    def __init__(self, size: int):
        self.size, self.rows = size, []

    def least(self) -> int:
        """Score that a document must reach to enter (it may still lose by its key)."""
        return max(1, self.rows[-1][0]) if len(self.rows) == self.size else 1

    def add(self, scores: np.ndarray, keys: list) -> None:
        least = self.least()
        self.rows += [(s, k) for s, k in zip(scores.tolist(), keys, strict=True) if s >= least]
        self.rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))
        del self.rows[self.size :]


def search_slice(keys: list, column: pa.Array, block: Queries, seen: np.ndarray, lookup: np.ndarray, found: list[Best]) -> int:
    """Fold the rows into sketches, bound all queries at once, rescore by descending bound. Returns how many rows were rescored."""
    n, row, place, tf = postings(column, block.vocabulary, seen)
    impact = impacts(n, row, place, tf, block)
    first, own, rescored = np.searchsorted(row, np.arange(len(column) + 1)), np.zeros(len(block.vocabulary.hashes), bool), 0
    for low in range(0, len(column), SKETCH_ROWS):
        high = min(len(column), low + SKETCH_ROWS)
        here = slice(first[low], first[high])
        sketch = np.zeros((high - low, block.coordinates))
        np.maximum.at(sketch, (row[here] - low, coordinate(block)[place[here]]), impact[here])
        bounds = sketch @ lookup
        # Beyond 2**53 a sum may be rounded, so a bound gets that much more room.
        bounds += np.where(bounds > 2.0**52, bounds * 2.0**-40, 0.0)
        for q, best in enumerate(found):
            order = np.flatnonzero(bounds[:, q] >= best.least())
            if not len(order):
                continue
            order = order[np.argsort(-bounds[order, q], kind="stable")]
            terms_of = block.vocabulary.places[block.vocabulary.first[q] : block.vocabulary.first[q + 1]]
            own[terms_of] = True
            for at in range(0, len(order), STEP):
                rows = order[at : at + STEP]
                rows = rows[bounds[rows, q] >= best.least()]
                if not len(rows):
                    break
                size = first[low + rows + 1] - first[low + rows]
                at_posting = np.repeat(first[low + rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
                exact = np.zeros(len(rows), np.int64)
                np.add.at(exact, np.repeat(np.arange(len(rows)), size), np.where(own[place[at_posting]], impact[at_posting], 0))
                best.add(exact, [keys[low + i] for i in rows])
                rescored += len(rows)
            own[terms_of] = False
    return rescored


def coordinate(block: Queries) -> np.ndarray:
    """Sketch coordinate of every term of the vocabulary."""
    return (block.vocabulary.hashes % np.uint64(block.coordinates)).astype(np.int64)


def lookups(block: Queries) -> np.ndarray:
    """How often each query reads each coordinate: one column per query."""
    out = np.zeros((block.coordinates, len(block.ids)))
    query = np.repeat(np.arange(len(block.ids)), np.diff(block.vocabulary.first))
    np.add.at(out, (coordinate(block)[block.vocabulary.places], query), 1.0)
    return out


def search(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    best: int = 10,
    coordinates: int = COORDINATES,
) -> DataFrame:
    """The ``best`` highest-scoring rows of ``docs`` for each row of ``items``: ``item_key``, rank (from 1), ``key``, score (above 0).

    Equal scores rank by ascending ``key``, null keys last. Null and empty texts hold no terms: such a document is found by nothing
    and counted nowhere, such an item finds nothing. Repeated rows are documents, or items, of their own, so ranks of an item id that
    occurs twice occur twice. Texts of any length are read whole in segments; other columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    field, item_field = docs.schema[key], items.schema[item_key]
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    chars = items.agg(F.sum(F.char_length(item_text))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    found = None
    for number in range(blocks):
        own = items.where(F.pmod(F.xxhash64(item_key, item_text), F.lit(blocks)) == number).select(item_key, F.col(item_text).cast("string"))
        listed = list(own.toLocalIterator())
        vocabulary = Vocabulary.of([r[1] for r in listed])
        documents, tokens, df = statistics(rows, vocabulary)
        block = Queries([r[0] for r in listed], vocabulary, weights(documents, df), documents, tokens, coordinates, best)
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            seen, lookup, kept, kind = block.vocabulary.filter(), lookups(block), [Best(block.best) for _ in block.ids], None
            for part in slices(batches):
                kind = part.column(0).type
                search_slice(part.column(0).to_pylist(), part.column(1), block, seen, lookup, kept)
            if kind is not None:
                out = [(q, s, k) for q, b in enumerate(kept) for s, k in b.rows]
                columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), kind))]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "score", "key"])

        hits = rows.mapInArrow(run, f"query long, score long, key {field.dataType.simpleString()}")
        order = [F.desc("score"), F.asc_nulls_last("key")]
        for groups in (["query", "part"], ["query"]):
            hits = hits.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS))) if "part" in groups else hits.drop("part")
            hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("rank") <= best)
        names = spark.createDataFrame(list(enumerate(block.ids)), StructType([StructField("query", LongType()), StructField("item", item_field.dataType)]))
        ranked = hits.join(F.broadcast(names), "query").select(F.col("item").alias(item_key), "rank", F.col("key").alias(key), "score")
        ranked = checkpointed(ranked) if blocks > 1 else ranked
        found = ranked if found is None else found.unionAll(ranked)
    return found
