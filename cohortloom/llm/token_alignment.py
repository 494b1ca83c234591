"""Alignment of two tokenizers over a corpus, with pair counts by external spill counting.

Tokens of both sides that end at the same byte cut a text into groups; every A token of a group is linked with every B token of it. How
many documents link a pair of ids, and which B ids have the highest count of their A id, is known only when the whole corpus is counted,
so the pair-document records spill and are read again:

1. A task encodes a slice of texts, sorts its distinct (A id, B id, document) records and radix-partitions them by A id into runs, zstd
   blobs in A-major order. A run holds its pairs with their counts, and apart from them the documents behind each pair. Runs and the figures
   of the documents are checkpointed, so no text is encoded twice.
2. The pairs alone meet: ``FAN_IN`` runs of a partition at a time are merged over a heap of open blocks, in rounds, until a partition is one run. A
   pair that every document holds is one entry per run there, never a row per document. In the last round the order by A id yields
   each id's maximum as its pairs pass.
3. Merged pairs stream past the runs of their partition again, ``SLICES_PER_GROUP`` slices to a group, and each run sends its documents' sums
   back to its slice.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.tokens import VOCABULARY, encoder, pieces, slices
from cohortloom.session import ship_package
from cohortloom.sources.store import checkpointed

PIECES = "piece_bpe_32k.model"
SLICE_BYTES = 2 << 20
PARTITIONS = 64
FAN_IN = 64
SLICES_PER_GROUP = 512
# Pairs of a block in a merged run; records that are expanded at once.
BLOCK_PAIRS = 1 << 16
STEP = 1 << 21

# A record is A id, B id and place of the document in its slice, from high bits to low; a pair is a record without the document.
ID_BITS, DOC_BITS = 22, 20
_LOW_DOC, _LOW_ID = (1 << DOC_BITS) - 1, (1 << ID_BITS) - 1
_KINDS = [np.dtype(t) for t in ("u1", "u2", "u4", "u8")]


def stored(*columns: np.ndarray) -> bytes:
    """Columns of non-negative integers as one zstd blob, each in the narrowest type that holds it."""
    head, body = [len(columns)], []
    for c in columns:
        kind = next(i for i, t in enumerate(_KINDS) if not len(c) or int(c.max()) <= np.iinfo(t).max)
        head += [kind, len(c)]
        body.append(c.astype(_KINDS[kind]).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, "u8").tobytes() + b"".join(body))


def loaded(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "u8", 1)[0])
    head, at, out = np.frombuffer(data, "u8", 1 + 2 * n)[1:].astype(int).tolist(), 8 * (1 + 2 * n), []
    for kind, size in zip(head[::2], head[1::2], strict=True):
        out.append(np.frombuffer(data, _KINDS[kind], size, at).astype(np.int64))
        at += size * _KINDS[kind].itemsize
    return out


def steps(sorted_values: np.ndarray) -> np.ndarray:
    """Differences of ascending values, which compress far better; ``cumsum`` restores them."""
    return np.diff(sorted_values, prepend=0)


class Sides:
    """Both tokenizers with the bytes of every id."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        if "/" not in b:
            import public_tokenizers

            b = public_tokenizers.path(b)
        self.a, self.b = encoder(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.spell_a = self.a.spelling()
        self.spell_b = [self._bytes(i) for i in range(self.b.get_piece_size())]
        if max(len(self.spell_a), len(self.spell_b)) > _LOW_ID:
            raise ValueError(f"a vocabulary may have {_LOW_ID} ids at most")
        self.size_a, self.size_b = (np.array([len(s) for s in spell], np.int64) for spell in (self.spell_a, self.spell_b))
        # Ids as they are written, followed by "," inside and by "|" or ";" at the end of a group.
        names = [f"{i}{end}".encode() for spell, mark in ((self.spell_a, "|"), (self.spell_b, ";")) for i in range(len(spell)) for end in (",", mark)]
        self.names = np.array(names, "S8")
        self.widths = np.char.str_len(self.names)

    def _bytes(self, i: int) -> bytes:
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both sides; none where the text is empty or a side does not give back its bytes.

        Long texts are cut where no token of either side reaches across: before a single space between other characters.
        """
        if not text:
            return [], []
        parts = list(pieces(text))
        parts = [parts[0], *(p[1:] for p in parts[1:])]
        a = [i for p in parts for i in self.a.encode_plain(f" {p}")]
        b = [i for ids in self.b.encode(parts, num_threads=1) for i in ids]
        want = f" {text}".encode()
        if b"".join(map(self.spell_a.__getitem__, a)) != want or b"".join(map(self.spell_b.__getitem__, b)) != want:
            return [], []
        return a, b


@lru_cache(maxsize=2)
def sides(a: str, b: str) -> Sides:
    return Sides(a, b)


@dataclass
class Aligned:
    """Tokens of a slice of texts, one after the other, with the group of each; groups are numbered through the slice."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    doc_of_group: np.ndarray
    docs: int

    @classmethod
    def of(cls, texts: list[str | None], both: Sides) -> Aligned:
        # Lists of Python integers take ten times the room of an array, so each text's are turned at once.
        ids = [tuple(np.array(side, np.int32) for side in both.encode(t)) for t in texts]
        a, b = (np.concatenate([x[side] for x in ids]).astype(np.int64) for side in (0, 1))
        # Both sides of a text have the same bytes, so the ends stay comparable over the whole slice.
        end_a, end_b = np.cumsum(both.size_a[a]), np.cumsum(both.size_b[b])
        met_a, met_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        n_a, n_b = (np.array([len(x[side]) for x in ids], np.int64) for side in (0, 1))
        del ids
        doc_of_group = np.repeat(np.arange(len(texts)), n_a)[met_a]
        return cls(a, b, np.cumsum(met_a) - met_a, np.cumsum(met_b) - met_b, n_a, n_b, doc_of_group, len(texts))

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """A tokens and B tokens of every group."""
        groups = len(self.doc_of_group)
        return np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)

    def per_doc(self, of_group: np.ndarray) -> np.ndarray:
        out = np.zeros(self.docs, np.int64)
        np.add.at(out, self.doc_of_group, of_group)
        return out

    def written(self, both: Sides) -> list[bytes]:
        """The groups of every text as ``a1,a2|b1;a3|b2,b3``."""
        in_a, in_b = self.sizes()
        last_a, last_b = np.diff(self.group_a, append=len(in_a)) > 0, np.diff(self.group_b, append=len(in_b)) > 0
        code = np.zeros(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[self.group_a]] = 2 * self.a + last_a
        code[np.arange(len(self.b)) + np.cumsum(in_a)[self.group_b]] = 2 * (self.b + len(both.spell_a)) + last_b
        wide = both.names[code]
        flat = wide.view(np.uint8)
        data = flat[flat != 0].tobytes()
        ends = np.concatenate([[0], np.cumsum(both.widths[code])])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        return [data[s : max(s, e - 1)] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def records(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (A id, B id, document), sorted, and how many links of the document each stands for."""
        in_a, in_b = self.sizes()
        links = in_b[self.group_a]
        ends, first_b = np.cumsum(links), np.cumsum(in_b) - in_b
        keys, counts, low = [], [], 0
        while low < len(links):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + STEP, side="right")))
            n = links[low:high]
            at_a = np.repeat(np.arange(low, high), n)
            at_b = first_b[self.group_a[at_a]] + np.arange(len(at_a)) - np.repeat(np.cumsum(n) - n, n)
            key = (self.a[at_a] << (ID_BITS + DOC_BITS)) | (self.b[at_b] << DOC_BITS) | self.doc_of_group[self.group_a[at_a]]
            own, k = np.unique(key.astype(np.uint64), return_counts=True)
            keys.append(own)
            counts.append(k)
            low = high
        if len(keys) == 1:
            return keys[0].astype(np.uint64), counts[0]
        if not keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return summed(np.concatenate(keys), np.concatenate(counts))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def runs(keys: np.ndarray, links: np.ndarray, partitions: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(partition, first pair, pairs and their counts, documents and their links) of sorted records, radix-partitioned by the A id."""
    part = ((keys >> np.uint64(ID_BITS + DOC_BITS)) % np.uint64(partitions)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=partitions))])
    for p in range(partitions):
        own = order[ends[p] : ends[p + 1]]
        if len(own):
            pair = (keys[own] >> np.uint64(DOC_BITS)).astype(np.int64)
            new = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            count = np.diff(new, append=len(pair))
            yield p, int(pair[0]), stored(steps(pair[new]), count), stored((keys[own] & np.uint64(_LOW_DOC)).astype(np.int64), links[own])


def merged(blocks: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k-way merge of runs that arrive as blocks of (pairs, counts) by their first pair; counts of equal pairs are added.

    A heap holds the open blocks by their last pair. All below the first pair of the next block is complete: it is taken from every
    open block, added up and sent on, and blocks that end there leave the heap.
    """
    heap: list = []
    held, number = 0, 0

    def take(below: int | None) -> tuple[np.ndarray, np.ndarray]:
        nonlocal held
        pairs, counts = [], []
        for entry in heap:
            _, _, own, n, start = entry
            stop = len(own) if below is None else int(np.searchsorted(own, below))
            pairs.append(own[start:stop])
            counts.append(n[start:stop])
            entry[4] = stop
            held -= stop - start
        while heap and (below is None or heap[0][0] < below):
            heapq.heappop(heap)
        return summed(np.concatenate(pairs), np.concatenate(counts))

    for pairs, counts in blocks:
        if held > BLOCK_PAIRS:
            out = take(int(pairs[0]))
            if len(out[0]):
                yield out
        heapq.heappush(heap, [int(pairs[-1]), number, pairs, counts, 0])
        held += len(pairs)
        number += 1
    if heap:
        out = take(None)
        if len(out[0]):
            yield out


def with_maxima(blocks: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pairs, counts, whether the count is the highest of the A id) of merged blocks; the pairs of an A id leave together."""
    rest = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for block in _then_none(blocks):
        pairs, counts = (np.concatenate(c) for c in zip(rest, block, strict=True)) if block is not None else rest
        cut = len(pairs) if block is None else int(np.searchsorted(pairs, pairs[-1] >> ID_BITS << ID_BITS))
        rest = pairs[cut:], counts[cut:]
        if cut:
            side = pairs[:cut] >> ID_BITS
            new = np.flatnonzero(np.r_[True, side[1:] != side[:-1]])
            top = np.repeat(np.maximum.reduceat(counts[:cut], new), np.diff(new, append=cut))
            yield pairs[:cut], counts[:cut], (counts[:cut] == top).astype(np.int64)


def _then_none(items: Iterable) -> Iterator:
    yield from items
    yield None


def cut_blocks(pairs: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(first pair, blob) of blocks of bounded size."""
    for low in range(0, len(pairs), BLOCK_PAIRS):
        yield int(pairs[low]), stored(steps(pairs[low : low + BLOCK_PAIRS]), *(c[low : low + BLOCK_PAIRS] for c in columns))


def _restored(blob: bytes) -> list[np.ndarray]:
    pairs, *columns = loaded(blob)
    return [np.cumsum(pairs), *columns]


MERGED = "part int, run long, first long, pairs binary"


def _merge_round(rows: DataFrame, groups: int, last: bool) -> DataFrame:
    """Merge the runs of every (partition, group of runs) into one run of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arriving() -> Iterator[tuple[tuple[int, int], bytes]]:
            for b in batches:
                for part, run, blob in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                    yield (part, run), blob

        stream, after = arriving(), [None]

        def blocks(first: bytes, group: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            yield tuple(_restored(first)[:2])
            for other, blob in stream:
                if other != group:
                    after[0] = (other, blob)
                    return
                yield tuple(_restored(blob)[:2])

        after[0] = next(stream, None)
        while after[0] is not None:
            (group, blob), after[0] = after[0], None
            done = merged(blocks(blob, group))
            for columns in with_maxima(done) if last else done:
                out = list(cut_blocks(*columns))
                arrays = [pa.array([group[0]] * len(out), pa.int32()), pa.array([group[1]] * len(out), pa.int64()), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "run", "first", "pairs"])

    grouped = rows.withColumn("run", F.pmod(F.xxhash64("run"), F.lit(groups))) if groups > 1 else rows.withColumn("run", F.lit(0).cast("long"))
    return grouped.repartition("part", "run").sortWithinPartitions("part", "run", "first").mapInArrow(run, MERGED)


@dataclass
class Alignment:
    """What one pass over the corpus leaves behind: figures of the documents, runs of records, and the merged pair counts."""

    docs: DataFrame
    runs: DataFrame
    merged: DataFrame
    slices: int
    key: str

    def pairs(self) -> DataFrame:
        """a, b, count (documents that link them), best (no B id has a higher count with the A id)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    pair, count, best = _restored(blob)
                    yield pa.RecordBatch.from_arrays([pa.array(pair >> ID_BITS), pa.array(pair & _LOW_ID), pa.array(count), pa.array(best == 1)], names=["a", "b", "count", "best"])

        return self.merged.select("pairs").mapInArrow(run, "a long, b long, count long, best boolean")

    def documents(self) -> DataFrame:
        """One row per input row: the key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups, if wanted)."""
        groups = max(1, math.ceil(self.slices / SLICES_PER_GROUP))
        group = F.pmod(F.xxhash64("slice"), F.lit(groups)).cast("int")
        pairs = self.merged.select("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(0).alias("turn"), "first", F.lit(0).cast("long").alias("slice"), "pairs", F.lit(None).cast("binary").alias("docs"))
        own = self.runs.select("part", group.alias("group"), F.lit(1).alias("turn"), F.lit(0).cast("long").alias("first"), "slice", "pairs", "docs")
        met = pairs.unionAll(own).repartition("part", "group").sortWithinPartitions("part", "group", "turn", "first")
        back = met.mapInArrow(_contributions, "slice long, sums binary")
        width = [f.name for f in self.docs.schema.fields]
        sent = back.selectExpr("slice", "-1 AS place", "sums", *(f"CAST(NULL AS {self.docs.schema[c].dataType.simpleString()}) AS `{c}`" for c in width[2:]))
        held = self.docs.selectExpr("slice", "place", "CAST(NULL AS binary) AS sums", *(f"`{c}`" for c in width[2:]))
        lined = sent.unionAll(held).repartition("slice").sortWithinPartitions("slice", "place")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.docs.schema.fields[2:])
        out = lined.mapInArrow(_gathered, f"{schema}, n_best long, count_sum long")
        named = out.withColumnRenamed("_key", self.key)
        return named.select(self.key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if "groups" in named.columns else []))


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged pairs of a (partition, group) first, then its runs: every run sends the sums of its documents to its slice."""
    group, tables, table = None, [], None
    for b in batches:
        out = []
        for part, number, turn, slice_id, pairs, docs in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6)), strict=True):
            if (part, number) != group:
                group, tables, table = (part, number), [], None
            if turn == 0:
                tables.append(_restored(pairs))
                continue
            if table is None:
                table, tables = [np.concatenate(c) for c in zip(*tables, strict=True)], []
            pair, times = _restored(pairs)
            at = np.repeat(np.searchsorted(table[0], pair), times)
            doc, links = loaded(docs)
            best, total = (np.zeros(int(doc.max()) + 1, np.int64) for _ in range(2))
            np.add.at(best, doc, links * table[2][at])
            np.add.at(total, doc, links * table[1][at])
            own = np.flatnonzero(total)
            out.append((slice_id, stored(steps(own), best[own], total[own])))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["slice", "sums"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a slice first, then its documents by place: every document gets its own."""
    current, best, total = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        slice_ids, place = b.column(0).to_numpy(), b.column(1).to_numpy()
        n_best, count_sum = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
        sums = b.column(2)
        bounds = np.flatnonzero(np.r_[True, (slice_ids[1:] != slice_ids[:-1]), True]) if b.num_rows else []
        for low, high in zip(bounds[:-1], bounds[1:]):
            if slice_ids[low] != current:
                current, best, total = slice_ids[low], np.zeros(0, np.int64), np.zeros(0, np.int64)
            docs = low + int(np.searchsorted(place[low:high], 0))
            for i in range(low, docs):
                own, more_best, more_total = _restored(sums[i].as_py())
                if len(own) and own[-1] >= len(best):
                    best, total = (np.concatenate([c, np.zeros(int(own[-1]) + 1 - len(best), np.int64)]) for c in (best, total))
                best[own] += more_best
                total[own] += more_total
            at = np.arange(docs, high)
            at = at[place[at] < len(best)]
            n_best[at], count_sum[at] = best[place[at]], total[place[at]]
        kept = pa.array(np.flatnonzero(place >= 0))
        columns = [*(b.column(i).take(kept) for i in range(3, b.num_columns)), pa.array(n_best).take(kept), pa.array(count_sum).take(kept)]
        yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[3:], "n_best", "count_sum"])


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", a: str = VOCABULARY, b: str = PIECES, partitions: int = PARTITIONS, with_groups: bool = False) -> Alignment:
    """Align the tokens of vocabulary ``a`` (of space and text) and ``b`` (of the text, whose leading space it adds) over all rows.

    Null and empty texts, and texts whose bytes a side does not give back, have no tokens: zeros and an empty groups column. Repeated
    rows are documents of their own; long texts are encoded whole, cut only where no token reaches across; other columns are ignored; an
    empty table gives empty results.
    """
    ship_package(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = sides(a, b), TaskContext.get().partitionId() << 32
        for part in (p.slice(i, 1 << DOC_BITS) for p in slices(batches, SLICE_BYTES) for i in range(0, p.num_rows, 1 << DOC_BITS)):
            found = Aligned.of(part.column(1).to_pylist(), both)
            in_a, in_b = found.sizes()
            written = found.written(both)
            digests = [hashlib.sha256(w).hexdigest() if w else "" for w in written]
            figures = [found.n_a, found.n_b, found.per_doc(np.ones(len(in_a), np.int64)), found.per_doc(in_a * in_b)]
            out = list(runs(*found.records(), partitions))
            n, m = part.num_rows, len(out)

            def column(values: Iterable, kind: pa.DataType, first: bool, n: int = n, m: int = m) -> pa.Array:
                own, none = pa.array(values, kind), pa.nulls(m if first else n, kind)
                return pa.concat_arrays([own, none] if first else [none, own])

            columns = {
                "slice": pa.array(np.full(n + m, number)),
                "place": column(range(n), pa.int32(), True),
                "_key": pa.concat_arrays([part.column(0), pa.nulls(m, part.column(0).type)]),
                **{c: column(v, pa.int64(), True) for c, v in zip(("n_a", "n_b", "n_groups", "n_links"), figures, strict=True)},
                "groups_sha256": column(digests, pa.string(), True),
                **({"groups": column([w.decode() for w in written], pa.string(), True)} if with_groups else {}),
                "part": column([o[0] for o in out], pa.int32(), False),
                "first": column([o[1] for o in out], pa.int64(), False),
                "pairs": column([o[2] for o in out], pa.binary(), False),
                "docs": column([o[3] for o in out], pa.binary(), False),
            }
            yield pa.RecordBatch.from_pydict(columns)
            number += 1

    figures = f"slice long, place int, _key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string" + ", groups string" * with_groups
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    spilled = checkpointed(rows.mapInArrow(run, f"{figures}, part int, first long, pairs binary, docs binary"))
    own = spilled.where("part IS NOT NULL").select("slice", "part", "first", "pairs", "docs")
    n = spilled.agg(F.count_distinct("slice")).first()[0]
    left, groups = own.selectExpr("part", "slice AS run", "first", "pairs"), n
    while True:
        groups = max(1, math.ceil(groups / FAN_IN))
        left = checkpointed(_merge_round(left, groups, groups == 1))
        if groups == 1:
            break
    return Alignment(spilled.where("part IS NULL").drop("part", "first", "pairs", "docs"), own, left, n, key)
