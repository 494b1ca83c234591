"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with up to k edits. Cut into k + 1 pieces, at least one piece then occurs unchanged, so an
automaton over all pieces finds every place worth a look, and Myers' bit-parallel distance decides there. The items are the stated
queries: they reach the tasks in blocks of bounded size, and every document is searched whole.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.filters import without_texts
from cohortloom.llm.tokens import slices
from cohortloom.session import ship_package
from cohortloom.sources.store import checkpointed

EDIT_SHARE = 0.06
BLOCK_CHARS = 2_000_000

def plain(text: str | None) -> str:
    """Lower case with single spaces."""
    return " ".join(text.lower().split()) if text else ""


def cut(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 pieces of nearly equal length, with their places."""
    n = edits + 1
    ends = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def best_distance(item: str, text: str) -> int:
    """Least edit distance between ``item`` and any substring of ``text`` (Myers 1999, one machine word of any width)."""
    m = len(item)
    if m == 0:
        return 0
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            best = min(best, score)
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best


@lru_cache(maxsize=2)
def _automaton(items: tuple[tuple[int, str, int], ...]):
    import ahocorasick

    places: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for i, (_, item, edits) in enumerate(items):
        for at, piece in cut(item, edits):
            places[piece].append((i, at))
    automaton = ahocorasick.Automaton()
    for piece, found in places.items():
        automaton.add_word(piece, (len(piece), found))
    automaton.make_automaton()
    return automaton


def leaks_in(text: str, items: tuple[tuple[int, str, int], ...]) -> list[tuple[int, int]]:
    """(index of the item, distance) of every item that occurs in a plain text within its edits."""
    starts: dict[int, set[int]] = defaultdict(set)
    for end, (n, found) in _automaton(items).iter(text):
        for i, at in found:
            starts[i].add(end + 1 - n - at)
    out = []
    for i, places in starts.items():
        _, item, edits = items[i]
        if item in text:
            out.append((i, 0))
            continue
        best, done = edits + 1, -1
        for start in sorted(places):
            first, last = max(0, start - edits, done - len(item) - edits), start + len(item) + edits
            if last > done:
                best = min(best, best_distance(item, text[first:last]))
                done = last
        if best <= edits:
            out.append((i, best))
    return out


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    edit_share: float = EDIT_SHARE,
) -> DataFrame:
    """A row for each document and item found in it: ``key``, ``item_key``, distance, item_chars.

    Both sides are compared in lower case with single spaces. An item may differ by up to ``edit_share`` of its
    characters (rounded down). distance is the least number of edits. Null and empty texts and items of white space only
    match nothing; repeated rows and items give a row each; other columns are ignored; an empty table gives an empty result.
    Items travel in blocks of about ``BLOCK_CHARS`` characters; further blocks mean further passes over the documents.
    """
    if not 0 <= edit_share < 0.5:
        raise ValueError("edit_share must be at least 0 and below 0.5: pieces of an item would be too short to be found")
    spark = docs.sparkSession
    ship_package(spark)
    kinds = [docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()]
    schema = f"`{key}` {kinds[0]}, `{item_key}` {kinds[1]}, distance int, item_chars int"
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    chars = benchmark.agg(F.sum(F.char_length(item_text))).first()[0] or 0
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    found = None
    for block in range(blocks):
        own = benchmark.where(F.pmod(F.xxhash64(item_key, item_text), F.lit(blocks)) == block).select(item_key, item_text)
        items = tuple((r[0], p, math.floor(edit_share * len(p))) for r in own.toLocalIterator() if (p := plain(r[1])))

        def search(batches: Iterator[pa.RecordBatch], items=spark.sparkContext.broadcast(items)) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                hits = [(k, *x) for k, t in enumerate(part.column(1).to_pylist()) if items.value and (p := plain(t)) for x in leaks_in(p, items.value)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array([h[0] for h in hits], pa.int32())),
                        pa.array([items.value[h[1]][0] for h in hits]).cast(item_type),
                        pa.array([h[2] for h in hits], pa.int32()),
                        pa.array([len(items.value[h[1]][1]) for h in hits], pa.int32()),
                    ],
                    names=[key, item_key, "distance", "item_chars"],
                )

        item_type = pa.string() if kinds[1] == "string" else pa.int32() if kinds[1] == "int" else pa.int64()
        here = rows.mapInArrow(search, schema)
        here = checkpointed(here) if blocks > 1 else here
        found = here if found is None else found.unionAll(here)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents in which no benchmark item occurs, with all their columns.

    The text alone decides: null and empty texts stay, whatever the key, null or repeated; rows with equal texts stay or go together; very
    long texts are searched whole. Columns of ``docs`` may have any names; an empty table on either side drops nothing.
    """
    return without_texts(docs, text, lambda texts, mark, column: find_leaks(texts, benchmark, mark, column).select(mark))
