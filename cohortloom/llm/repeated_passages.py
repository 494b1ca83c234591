"""Removal of repeated passages with a logarithmic family of suffix arrays.

Every byte window of ``length`` bytes that occurs twice contains the same anchor: the least-hashed short gram inside it, at the same
place. So only windows around repeated anchors can repeat, and these are brought together by anchor. Every task holds one family: the
windows (the suffixes that start there, to ``length`` bytes) of each new batch are sorted into an array, merge-scanned against all arrays of
the family for equal starts, and join it, where arrays of similar size merge geometrically. Arrays are in the order of a digest of the
window, since only equality is asked for. Anchors with very many places are dealt over several tasks; what these hold at the end meets once
more, by window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.exact_dedup import merge_runs
from cohortloom.llm.filters import BROADCAST_ROWS
from cohortloom.llm.tokens import slices
from cohortloom.llm.words import mixed, text_bytes
from cohortloom.session import ship_package
from cohortloom.sources.store import checkpointed

LENGTH = 200
GRAM = 32
# Places of one anchor that a task takes at most (on average); more are dealt over further tasks.
ANCHOR_PLACES = 4096
# Bytes around repeated anchors that one task takes: its family holds a window for each at most.
TASK_BYTES = 6 << 20
_SEGMENT = 1 << 21
_PLACE_BITS = 22
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=2)
def _value(which: int) -> np.ndarray:
    return np.random.default_rng(which).integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(n: int, which: int, down: bool) -> np.ndarray:
    if len(_POWERS.get((which, down), ())) < n:
        base = pow(_BASES[which], -1, 1 << 64) if down else _BASES[which]
        steps = np.full(max(n, 1 << 20), _U(base))
        steps[0] = 1
        _POWERS[which, down] = np.cumprod(steps)
    return _POWERS[which, down][:n]


def gram_hashes(data: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of the ``size`` bytes from every place on that has as many."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_value(which)[data] * _powers(len(data), which, False))])
    return mixed((sums[size:] - sums[:-size]) * _powers(n, which, True))


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: anchor hash, row, first and last window start (within the row)."""
    n, width = len(data), length - gram + 1
    windows = n - length + 1
    if windows <= 0:
        return np.zeros(0, _U), *(np.zeros(0, np.int64),) * 3
    h = gram_hashes(data, gram)
    low = _U((1 << _PLACE_BITS) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=_U)
    blocks = -(-len(key) // width)
    padded = np.full(blocks * width, ~_U(0))
    padded[: len(key)] = key
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(padded, axis=1).reshape(-1)
    place = (np.minimum(ahead[:windows], behind[width - 1 : width - 1 + windows]) & low).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(row[:windows] == row[length - 1 :])
    if not len(start):
        return np.zeros(0, _U), *(np.zeros(0, np.int64),) * 3
    own = place[start]
    new = np.ones(len(start), bool)
    new[1:] = (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    r = row[start[first]]
    return h[own[first]], r, start[first] - offsets[r], start[last] - offsets[r]


def segments(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Byte ranges of at most ``_SEGMENT`` bytes that hold every window once: begin, end, their row starts, and for each row (index, shift)."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = row + 1
        while stop < rows and offsets[stop + 1] - offsets[row] <= _SEGMENT:
            stop += 1
        begin, end = int(offsets[row]), int(offsets[stop])
        if end - begin <= _SEGMENT:
            yield begin, end, offsets[row : stop + 1] - begin, np.stack([np.arange(row, stop), np.zeros(stop - row, np.int64)])
        else:
            at = begin
            while at < end:
                to = min(end, at + _SEGMENT)
                yield at, to, np.array([0, to - at]), np.array([[row], [at - begin]])
                if to == end:
                    break
                at = to - length + 1
        row = stop


_PLACE = "anchor long, spread long, known int, name long, first long, last long"


def _places(h: np.ndarray, names: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Rows of ``_PLACE``: places whose anchor repeats within this batch are known (1) and spread over tasks, one row (2) stands for them."""
    _, at, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    known = (n > 1)[back]
    marks = at[n > 1]
    rows = np.concatenate([np.arange(len(h)), marks])
    state = np.concatenate([known.astype(np.int32), np.full(len(marks), 2, np.int32)])
    spread = np.where(state == 1, (mixed(names[rows].view(_U) + first[rows].view(_U)) >> _U(1)).view(np.int64) | 1, 0)
    columns = [h.view(np.int64)[rows], spread, state, names[rows], first[rows], last[rows]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "spread", "known", "name", "first", "last"])


def _adjacent(rows: DataFrame) -> DataFrame:
    """Places whose anchor occurs at another place too; streams over partitions sorted by anchor, with a row of state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        before: int | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            key, known = t.column(0).to_numpy(), t.column(2).to_numpy()
            same = np.zeros(len(key) + 1, bool)
            same[1:-1] = key[1:] == key[:-1]
            same[0] = before is not None and key[0] == before
            out = ((same[:-1] | same[1:]) & (known == 0) | (known == 1))[:-1]
            yield from t.slice(0, len(key) - 1).filter(pa.array(out)).combine_chunks().to_batches()
            before = int(key[-2]) if len(key) > 1 else before
            held = t.slice(len(key) - 1)
        if held is not None:
            key, known = held.column(0)[0].as_py(), held.column(2)[0].as_py()
            if known == 1 or known == 0 and key == before:
                yield from held.combine_chunks().to_batches()

    dealt = rows.repartition("anchor", "spread").sortWithinPartitions("spread", "anchor")
    return dealt.mapInArrow(run, _PLACE).select("anchor", "name", "first", "last")


class Family:
    """Sorted arrays of distinct windows (halves ``a`` and ``b`` of their digests), each array at least twice as long as the next."""

    def __init__(self) -> None:
        self.levels: list[dict[str, np.ndarray]] = []
        self.batches = 0

    def add(self, batch: dict[str, np.ndarray]) -> list[dict[str, np.ndarray]]:
        """Take in sorted distinct windows; returns the windows, of the batch and of the family, that turn out to repeat for the first time."""
        self.batches += 1
        found = []
        for level in self.levels:
            old = _same(level, batch)
            hit = old >= 0
            if hit.any():
                old = old[hit]
                fresh = ~level["known"][old]
                found.append({k: level[k][old[fresh]] for k in ("name", "start")})
                level["known"][old] = True
                mine = np.flatnonzero(hit)
                found.append({k: batch[k][mine[~batch["known"][mine]]] for k in ("name", "start")})
                batch = {k: v[~hit] for k, v in batch.items()}
        while self.levels and len(self.levels[-1]["a"]) < 2 * max(1, len(batch["a"])):
            other = self.levels.pop()
            merged = {k: np.concatenate([other[k], batch[k]]) for k in batch}
            order = np.lexsort((merged["b"], merged["a"]))
            batch = {k: v[order] for k, v in merged.items()}
        self.levels.append(batch)
        return found


def _same(level: dict[str, np.ndarray], batch: dict[str, np.ndarray]) -> np.ndarray:
    """Place in a level of the equal window of every window of a batch, -1 where there is none."""
    out = np.full(len(batch["a"]), -1)
    at = np.searchsorted(level["a"], batch["a"])
    left = np.arange(len(at))
    while len(left):
        # Equal first halves are nearly always the same window; where they are not, the next entry is looked at.
        left = left[at[left] < len(level["a"])]
        left = left[level["a"][at[left]] == batch["a"][left]]
        equal = level["b"][at[left]] == batch["b"][left]
        out[left[equal]] = at[left[equal]]
        left = left[~equal]
        at[left] += 1
    return out


def window_keys(data: np.ndarray, length: int) -> np.ndarray:
    """A sortable 128-bit digest of the ``length`` bytes from each place on."""
    out = np.empty(max(0, len(data) - length + 1), np.dtype("V16"))
    halves = out.view(np.dtype([("a", _U), ("b", _U)]))
    halves["a"], halves["b"] = gram_hashes(data, length, 0), gram_hashes(data, length, 1)
    return halves


def _runs(names: np.ndarray, starts: np.ndarray, length: int) -> pa.RecordBatch:
    """Spans covered by repeated windows."""
    order = np.lexsort((starts, names))
    names, starts = names[order], starts[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (starts[1:] > starts[:-1] + length)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(names)] - 1
    return names[first], starts[first], starts[last] + length


_FOUND = "name long, start long, stop long, a long, b long, known boolean"


def _scan(length: int):
    """Task function over rows (anchor, salt, many, name, first, context): one family takes the windows of all of them."""

    def spans(found: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if found and sum(len(f["name"]) for f in found):
            name, start, stop = _runs(np.concatenate([f["name"] for f in found]), np.concatenate([f["start"] for f in found]), length)
            nothing = pa.nulls(len(name), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(start), pa.array(stop), nothing, nothing, pa.nulls(len(name), pa.bool_())], names=["name", "start", "stop", "a", "b", "known"])

    def rest(family: Family) -> Iterator[pa.RecordBatch]:
        """Windows of anchors that other tasks hold too."""
        for level in family.levels:
            w = {k: v[level["many"]] for k, v in level.items()}
            if len(w["a"]):
                columns = [w["name"], w["start"], w["start"] + length, w["a"].view(np.int64), w["b"].view(np.int64), w["known"]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["name", "start", "stop", "a", "b", "known"])

    def windows(b: pa.RecordBatch) -> dict[str, np.ndarray]:
        data, offsets = text_bytes(b.column(5))
        row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
        at = np.flatnonzero(row[: len(data) - length + 1] == row[length - 1 :]) if len(data) >= length else np.zeros(0, np.int64)
        owner, key = row[at], window_keys(data, length)
        return {
            "a": key["a"][at],
            "b": key["b"][at],
            "name": b.column(3).to_numpy()[owner],
            "start": b.column(4).to_numpy()[owner] + at - offsets[owner],
            "many": b.column(2).to_numpy(zero_copy_only=False)[owner],
        }

    def array(w: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], list[dict[str, np.ndarray]]]:
        """The sorted array of distinct windows of a batch, and the windows that repeat within it."""
        order = np.lexsort((w["b"], w["a"]))
        w = {k: v[order] for k, v in w.items()}
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = (w["a"][1:] == w["a"][:-1]) & (w["b"][1:] == w["b"][:-1])
        w["known"] = same[:-1] | same[1:]
        return {k: v[~same[:-1]] for k, v in w.items()}, [{k: w[k][w["known"]] for k in ("name", "start")}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Family()
        for whole in batches:
            for b in slices([whole.select([0, 5, 1, 2, 3, 4])], 1 << 20):
                part, twice = array(windows(b.select([0, 2, 3, 4, 5, 1])))
                yield from spans(twice + family.add(part))
        yield from rest(family)

    return run


def covered(spans: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Maximal runs of a union of spans within n bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], min(b, n)))
        else:
            out.append((a, min(b, n)))
    return out


def _with_text(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """Texts joined with their row of ``lists`` by name; texts without one are dropped before the shuffle where the names fit a broadcast."""
    lists = checkpointed(lists)
    if lists.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(lists.select("name")), "name", "left_semi")
    return texts.join(lists, "name")


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, with_kept: bool = False) -> DataFrame:
    """One row per input row: ``key``, n_bytes, n_removed, n_spans, kept_sha256 (and spans and the kept bytes, if wanted).

    Removed is every byte covered by a string of ``length`` bytes (UTF-8) that starts at any other place of any text too; overlaps
    count, matches stay within a text and are judged on the input. Null and empty texts have no bytes; a repeated row is another place;
    other columns are ignored; an empty table gives an empty result. Windows are compared by 128-bit hashes, rows named
    by a 64-bit hash of key and text.
    """
    if length <= gram:
        raise ValueError("length must exceed gram")
    ship_package(docs.sparkSession)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(key), whole).alias("name"), whole.alias("text"))
    texts = named.select("name", "text")
    rows = checkpointed(
        named.select("id", "name", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("digest"), F.spark_partition_id().cast("long").alias("run"))
    )
    rows = checkpointed(merge_runs(rows, ["digest", "n_bytes"], F.struct("id", "name")).select("id", "name", "n_bytes", "digest", F.col("n").alias("copies"), F.col("best.name").alias("owner")))
    heads = rows.where(f"name = owner AND n_bytes >= {length}").select("name").distinct()
    heads = checkpointed(heads)
    side = F.broadcast(heads) if heads.count() <= BROADCAST_ROWS else heads

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offsets = text_bytes(part.column(1))
            names = part.column(0).to_numpy()
            for begin, end, starts, (row, shift) in segments(offsets, length):
                h, r, first, last = anchors(data[begin:end], starts, length, gram)
                yield _places(h, names[row[r]], first + shift[r], last + shift[r])

    places = checkpointed(_adjacent(texts.join(side, "name", "left_semi").mapInArrow(find, _PLACE)))
    many = checkpointed(places.groupBy("anchor").agg(F.count(F.lit(1)).alias("places")).where(F.col("places") > ANCHOR_PLACES))
    places = places.join(F.broadcast(many) if many.count() <= BROADCAST_ROWS else many, "anchor", "left")
    salt = F.when(F.col("places").isNotNull(), F.pmod(F.xxhash64("name", "first"), F.ceil(F.col("places") / ANCHOR_PLACES))).otherwise(F.lit(0))
    places = places.select("name", F.struct("anchor", salt.cast("long").alias("salt"), F.col("places").isNotNull().alias("many"), "first", "last").alias("place"))
    size = places.agg(F.sum(F.col("place.last") - F.col("place.first") + length).alias("n")).first()["n"] or 0

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(b.select([0, 1, 2]) for b in batches):
            data, offsets = text_bytes(part.column(1))
            lists = part.column(2)
            held = np.diff(lists.offsets.to_numpy())
            inner = lists.flatten()
            anchor, salted, is_many, first, last = inner.flatten()
            row = np.repeat(np.arange(part.num_rows), held)
            a = offsets[row] + first.to_numpy()
            b = offsets[row] + last.to_numpy() + length
            size = b - a
            ends = np.concatenate([[0], np.cumsum(size)])
            for i, j in _blocks(size):
                flat = np.arange(ends[i], ends[j]) - np.repeat(ends[i:j] - a[i:j], size[i:j])
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((ends[i : j + 1] - ends[i]).astype(np.int64)), pa.py_buffer(data[flat])])
                yield pa.RecordBatch.from_arrays(
                    [anchor[i:j], salted[i:j], is_many[i:j], pa.array(part.column(0).to_numpy()[row[i:j]]), first[i:j], column.cast(pa.binary())],
                    names=["anchor", "salt", "many", "name", "first", "context"],
                )

    lists = places.groupBy("name").agg(F.collect_list("place").alias("places"))
    wide = _with_text(texts, lists).select("name", "text", "places")
    wide = wide.mapInArrow(contexts, "anchor long, salt long, many boolean, name long, first long, context binary")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // TASK_BYTES))
    dealt = wide.repartition(tasks, "anchor", "salt")
    met = checkpointed(dealt.mapInArrow(_scan(length), _FOUND))
    again = met.where("a IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("name", "start", "stop", "known")).alias("own"))
    again = again.where("n > 1").select(F.explode("own").alias("own")).where("NOT own.known").select("own.name", "own.start", "own.stop")
    spans = met.where("a IS NULL").select("name", "start", "stop").unionAll(again)
    spans = spans.groupBy("name").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = []
            for t, own in zip(part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                gone = covered([(s["start"], s["stop"]) for s in own], len(t))
                ends = [0, *(x for g in gone for x in g), len(t)]
                left = b"".join(t[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2))
                out.append((sum(b - a for a, b in gone), len(gone), hashlib.sha256(left).hexdigest(), [{"start": a, "stop": b} for a, b in gone], left))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            arrays = [part.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())]
            if with_kept:
                arrays += [pa.array(columns[3], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(columns[4], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["name", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: len(arrays)])

    schema = "name long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start: long, stop: long>>, kept binary" * with_kept
    parts = _with_text(texts, spans).select("name", "text", "spans").mapInArrow(cut, schema).dropDuplicates(["name"])
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    out = rows.join(parts, "name", "left").select(
        F.col("id").alias(key),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        *([F.when(gone, F.expr("array(struct(0L AS start, n_bytes AS stop))")).otherwise(F.coalesce("spans", F.expr("array()"))).alias("spans"), F.when(~gone, F.col("kept")).alias("kept")] if with_kept else []),
    )
    return out


def _blocks(size: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about ``most`` bytes."""
    ends = np.cumsum(size)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield i, j
        i = j
