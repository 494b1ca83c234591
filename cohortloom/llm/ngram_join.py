"""N-gram Jaccard join with prefix trees.

Every text is its set of distinct word shingles, globally ordered with common shingles last. Two sets of Jaccard similarity t or more share
shingles among the first of each, and almost all shingles of either lie in some other set. Both facts, used in turn, leave
the sets that can have a partner at all. These are ordered anew, rare shingles first by their exact numbers, and fall into blocks of sets that
share several of the leading ones. In every block the sets stand in a trie that each of them traverses: an overlap counted along a path serves all sets below it, and a subtree is left as soon as its
remaining lengths cannot reach the wanted overlap. Large blocks are cut into parts that are joined pair by pair.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.components import components
from cohortloom.llm.exact_dedup import merge_runs
from cohortloom.llm.filters import BROADCAST_ROWS, free_name, without
from cohortloom.llm.tokens import slices
from cohortloom.llm.words import mixed, shingles
from cohortloom.session import ship_package
from cohortloom.sources.store import checkpointed

BITS = 20
# Tokens in a part of a block on average: with two parts a task holds a bounded table.
PART_TOKENS = 1_000_000
MATRIX_BYTES = 8 << 20
EDGE_TOKENS = 128
SLICE_BYTES = 1 << 20
# Sets up to which those of a token are counted for its level (two levels to a doubling, the last from here on).
RANKED_SETS = 50_000
# Sets up to which those of a leading token are compared pair by pair before they are put into one block.
PAIRED_SETS = 16
_U = np.uint64


def need(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Least overlap a set of n shingles has with any partner."""
    return -(-n * percent // 100)


def depth(n: np.ndarray | int) -> np.ndarray | int:
    """Common shingles wanted among the leading ones; grows with the set, so that a shared passage alone is not enough."""
    return 1 + n // 16


def _sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of all rows in sequence, where each row starts, and two 64-bit digests of each row's set."""
    row, x, _ = shingles(column, width)
    n = np.bincount(row, minlength=len(column))
    offsets = np.concatenate([[0], np.cumsum(n)])
    sums = [np.concatenate([np.zeros(1, _U), np.cumsum(mixed(x * _U(k)))]) for k in (3, 5)]
    ids = [(s[offsets[1:]] - s[offsets[:-1]]).view(np.int64) for s in sums]
    return x, offsets, *ids


def _ordered(x: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Shingles as signed integers in the global order: by level of their bucket, then by hash."""
    level = levels[(x >> _U(64 - BITS)).astype(np.int64)].astype(_U)
    return ((level << _U(58)) | (x & _U((1 << 58) - 1))).view(np.int64)


def _short(token: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Tokens of rows cut to 40 bits, which the shuffle packs better, with their number among the row's tokens cut alike.

    Two rows have at least as many of these in common as they have tokens: cutting may add a match, but loses none.
    """
    cut = token.view(_U) << _U(24)
    order = np.lexsort((cut, row))
    same = np.zeros(len(order), bool)
    same[1:] = (cut[order[1:]] == cut[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    place = np.arange(len(order))
    cut[order] |= (place - np.maximum.accumulate(np.where(same, 0, place))).astype(_U)
    return cut.view(np.int64)


def _levels(counts: np.ndarray) -> np.ndarray:
    """Doublings of each bucket above twice the mean: buckets of common shingles stand out at any size."""
    return np.clip(np.floor(np.log2(np.maximum(counts, 1) / max(counts.mean(), 0.5))), 0, 31).astype(np.uint8)


def _bucket_levels(texts: DataFrame, width: int) -> np.ndarray:
    """Level of every shingle bucket, from counts over all texts. Size of the table: 2**BITS, whatever the data."""
    block = 1 << 12

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(1 << BITS, np.int32), set()
        for part in slices((b.select([0, 0]) for b in batches), SLICE_BYTES):
            x, offsets, one, _ = _sets(part.column(0), width)
            new = np.array([not (i in seen or seen.add(i)) for i in one.tolist()], bool)
            total += np.bincount((x[np.repeat(new, np.diff(offsets))] >> _U(64 - BITS)).astype(np.int64), minlength=1 << BITS).astype(np.int32)
        rows = total.reshape(-1, block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array([r.tobytes() for r in rows], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(c, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "counts"])

    schema = "block long, counts binary"
    counts = np.zeros(1 << BITS, np.int64)
    for r in texts.mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).toLocalIterator():
        counts[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(r["counts"], np.int64)
    return _levels(counts)


def _grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Distinct rows (token, owner, ...) of sorted batches with the size of their token's group and the least owner in it.

    Groups come whole up to ``most`` rows; a larger one comes in pieces of size ``most + 1``, so what is held is bounded.
    """
    held: list[np.ndarray] = []
    hot: tuple[int, int] | None = None

    def laid(rows: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        token, owner = rows[:2]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        n = np.diff(first, append=len(token))
        size, least = np.minimum(n, most + 1), owner[first]
        if hot is not None and token[0] == hot[0]:
            size[0], least[0] = most + 1, hot[1]
        return *rows, np.repeat(size, n), np.repeat(least, n)

    for b in batches:
        if not b.num_rows:
            continue
        new = [c.to_numpy() for c in b.columns]
        rows = [np.concatenate(pair) for pair in zip(held, new, strict=True)] if held else new
        token, owner = rows[:2]
        fresh = np.r_[True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])]
        rows = [c[fresh] for c in rows]
        token = rows[0]
        # The last group waits for its rest; of one that is too large already only the last row does, to tell repeated rows.
        low = int(np.searchsorted(token, token[-1]))
        known = hot is not None and token[-1] == hot[0]
        leader = hot[1] if known else int(rows[1][low])
        large = known or len(token) - low > most + 1
        end = len(token) - 1 if large else low
        if end:
            out = [c[:end] for c in rows]
            if large and not known:
                whole = laid([c[:low] for c in out]) if low else None
                hot = int(token[-1]), leader
                if whole is not None:
                    yield whole
                out = [c[low:] for c in out]
            yield laid(out)
        held = [c[end:] for c in rows]
    if held:
        yield laid(held)


def _shared(postings: DataFrame) -> DataFrame:
    """The postings (token, set) of tokens that at least two sets have; streams over sorted partitions."""
    return _recurring(postings, 1, lambda token, n: token)


def _ranked(postings: DataFrame) -> DataFrame:
    """The same; the level of a token becomes that of the number of sets that have it, so that rare tokens come first at any size of the data."""

    def by_number(token: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (np.minimum(2.0 * np.log2(n), 31.0).astype(np.int64) << 58) | (token & ((1 << 58) - 1))

    return _recurring(postings, RANKED_SETS, by_number)


def _recurring(postings: DataFrame, most: int, renamed: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, owner, n, _ in _grouped(batches, most):
            out = n > 1
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(renamed(token[out], n[out])), pa.array(owner[out])], names=["token", "owner"])

    return postings.repartition("token").sortWithinPartitions("token", "owner").mapInArrow(run, "token long, owner long")


def _met(postings: DataFrame) -> DataFrame:
    """Pairs a, b of sets that may link, by the postings (token, owner, deep) of their leading tokens.

    Two sets that link share at least the lesser ``deep`` of their leading tokens. Pairs are counted token by token; those that a token of more than
    ``PAIRED_SETS`` sets brings together are taken as they are, as links to one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, owner, deep, n, least in _grouped(batches, PAIRED_SETS):
            far = (n > PAIRED_SETS) & (owner != least)
            ends, one = [(least[far], owner[far])], np.ones(far.sum(), np.int64)
            wanted = [one]
            few = n <= PAIRED_SETS
            token, owner, deep = token[few], owner[few], deep[few]
            for d in range(1, PAIRED_SETS):
                same = token[d:] == token[:-d]
                if not same.any():
                    break
                ends.append((owner[:-d][same], owner[d:][same]))
                wanted.append(np.minimum(deep[:-d][same], deep[d:][same]))
            a, b = (np.concatenate([e[i] for e in ends]) for i in range(2))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate(wanted))], names=["a", "b", "deep"])

    dealt = postings.repartition("token").sortWithinPartitions("token", "owner").mapInArrow(run, "a long, b long, deep long")
    counted = dealt.groupBy("a", "b").agg(F.min("deep").alias("deep"), F.count(F.lit(1)).alias("n"))
    return counted.where("n >= deep").select("a", "b")


def _explode(sets: DataFrame, take, deep=None) -> DataFrame:
    """(token, owner) of the leading ``take(size of the set, tokens at hand)`` tokens of each row (owner, size, tokens), and ``deep(size)`` if given."""
    names = ["token", "owner"] + ["deep"] * (deep is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, size, tokens = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            offsets = tokens.offsets.to_numpy()
            held = np.diff(offsets)
            n = np.clip(take(size, held), 0, held)
            place = np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], held)
            chosen = place < np.repeat(n, held)
            flat = tokens.values.to_numpy()[offsets[0] : offsets[-1]]
            columns = [flat[chosen], np.repeat(owner, n)] + ([np.repeat(deep(size), n)] if deep is not None else [])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return sets.select("owner", "size", "tokens").mapInArrow(run, ", ".join(f"{c} long" for c in names))


class Trie:
    """Sets in a compressed prefix tree, which many queries traverse together."""

    def __init__(self, sets: list[tuple[int, int, np.ndarray]], percent: int):
        """``sets``: id, full size, tokens in the global order (the full size may count tokens no other set has)."""
        self.percent = percent
        # A path branches at most once for each set and each token of a part.
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 50_000))
        self.root = self._build(sorted(sets, key=lambda s: s[2].astype(">i4").tobytes()), 0)

    def _build(self, sets: list, at: int) -> tuple:
        """(tokens of the edge, ids and sizes that end here, children, most tokens still below, least size below)."""
        first, last = sets[0][2], sets[-1][2]
        shared = min(len(first), len(last))
        apart = np.flatnonzero(first[at:shared] != last[at:shared])
        end = at + int(apart[0]) if len(apart) else shared
        here, children, i = [], [], 0
        while i < len(sets) and len(sets[i][2]) == end:
            here.append((sets[i][0], sets[i][1]))
            i += 1
        while i < len(sets):
            j, token = i, sets[i][2][end]
            while j < len(sets) and sets[j][2][end] == token:
                j += 1
            children.append(self._build(sets[i:j], end))
            i = j
        rest = max([0, *(len(c[0]) + c[3] for c in children)])
        least = min([s for _, s in here] + [c[4] for c in children])
        return first[at:end], here, children, rest, least

    def join(self, has: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(id, queries that link with it). ``has``: tokens by queries; a link is percent * |union| <= 100 * |overlap|.

        On an edge the queries' overlaps grow by its tokens, a few at a time; a query leaves the path when all that is left
        below it and in itself could not make a link.
        """
        p = self.percent
        held = has.sum(axis=0)
        stack = [(self.root, np.arange(len(size)), np.zeros(len(size), np.int64))]
        while stack:
            (edge, here, children, rest, least), who, overlap = stack.pop()
            for at in range(0, len(edge), EDGE_TOKENS):
                some = edge[at : at + EDGE_TOKENS]
                rows = has[some] if len(who) == len(size) else has[some][:, who]
                overlap = overlap + rows.sum(axis=0, dtype=np.int32)
                left = np.minimum(rest + len(edge) - at - len(some), held[who] - overlap)
                stay = (100 + p) * (overlap + left) >= p * (size[who] + least)
                who, overlap = who[stay], overlap[stay]
                if not len(who):
                    break
            if len(who):
                for i, n in here:
                    found = who[(100 + p) * overlap >= p * (size[who] + n)]
                    if len(found):
                        yield i, found
                stack.extend((c, who, overlap) for c in children)


def _forest(n: int, pairs: Iterator[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """For n sets one member of each one's component by the given links, and the number of its links."""
    root, links = list(range(n)), np.zeros(n, np.int64)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, others in pairs:
        links[i] += len(others)
        links[others] += 1
        for j in others.tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)]), links


def _links(parts: DataFrame, percent: int) -> DataFrame:
    """Links inside every group (block, left, right) of rows owner, size, tokens, part, between part ``left`` and part ``right``.

    A row for each linked set of a group: b, a one set for all that its links in this group lead to, n the number of these links.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        left, right = key[1].as_py(), key[2].as_py()
        owner, size, part = (table.column(c).to_numpy() for c in ("owner", "size", "part"))
        lists = table.column("tokens").combine_chunks()
        held = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(owner)), held)
        # Only tokens that two sets of the group have can add to an overlap; they are numbered in the global order.
        _, token, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        number = np.cumsum(times > 1) - 1
        keep = times[token] > 1
        row, token = row[keep], number[token[keep]]
        ends = np.searchsorted(row, np.arange(len(owner) + 1))
        sets = [(i, int(size[i]), np.sort(token[ends[i] : ends[i + 1]]).astype(np.int32)) for i in np.flatnonzero(part == left).tolist()]
        trie = Trie(sets, percent) if sets else None
        n_tokens = int(number[-1]) + 1 if len(number) else 0
        step = max(1, MATRIX_BYTES // max(1, n_tokens))

        def pairs() -> Iterator[tuple[int, np.ndarray]]:
            queries = np.flatnonzero(part == right) if trie else np.zeros(0, np.int64)
            for at in range(0, len(queries), step):
                some = queries[at : at + step]
                place = np.full(len(owner), -1)
                place[some] = np.arange(len(some))
                mine = place[row] >= 0
                has = np.zeros((n_tokens, len(some)), bool)
                has[token[mine], place[row[mine]]] = True
                yield from ((i, some[q]) for i, q in trie.join(has, size[some]))

        # Inside one part every pair comes up twice.
        root, links = _forest(len(owner), ((i, q[q > i] if left == right else q) for i, q in pairs()))
        linked = links > 0
        return pa.table({"a": owner[root[linked]], "b": owner[linked], "n": links[linked]})

    # The groups weigh alike by design, so the tasks are not merged by the size of what they read.
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(tasks, "block", "left", "right").groupBy("block", "left", "right").applyInArrow(run, "a long, b long, n long")


def similar_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One row per input row: ``key``, n_shingles, component_id, set_id, n_links.

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct shingles of ``width`` words of the whole text (a
    shorter text is one shingle; one without words, or a null, is empty and linked with nothing). Texts link when 100 * overlap >=
    ``percent`` * union of their sets. component_id is the least key reachable by links, itself included; ``key`` must be an integer
    and not null (rows with a null key keep a null component). Equal sets share a set_id, n_links counts the other
    sets linked to it. Repeated rows are equal sets; rows of one key with different texts are sets of their own and share the names
    that their key gives. Shingles are 64-bit and sets 128-bit hashes. Texts of any length are read whole; other columns are ignored; an empty
    table gives an empty result.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    if not _repeats(texts):
        return _similar(texts, width, percent).withColumnRenamed("id", key)
    # Each row has a number in place of its key; names are the least keys of what the numbers name.
    rows = _numbered(texts)
    found = _similar(rows.select(F.when(F.col("id").isNotNull(), F.col("row")).alias("id"), "text"), width, percent)
    own = found.where("id IS NOT NULL").withColumnRenamed("id", "row").join(rows.select("row", "id"), "row")
    for name in ("component_id", "set_id"):
        own = own.join(own.groupBy(name).agg(F.min("id").alias(f"{name}_key")), name).drop(name).withColumnRenamed(f"{name}_key", name)
    return own.unionByName(found.where("id IS NULL").withColumn("row", F.lit(None).cast("long"))).select(F.col("id").alias(key), *found.columns[1:])


def _repeats(texts: DataFrame) -> bool:
    """Whether a key stands in more than one row."""
    return bool(texts.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count())


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with a number each that stays theirs."""
    return checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))


def _similar(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``similar_sets`` of id and text, where no id but null repeats: id, n_shingles, component_id, set_id, n_links."""
    spark = texts.sparkSession

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE_BYTES):
            _, offsets, one, two = _sets(part.column(1), width)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(one), pa.array(two)], names=["id", "size", "one", "two"])

    digests = texts.mapInArrow(digest, "id long, size long, one long, two long").withColumn("run", F.spark_partition_id().cast("long"))
    rows = checkpointed(digests)
    merged = merge_runs(rows.where("size > 0 AND id IS NOT NULL"), ["one", "two", "size"], F.col("id"))
    named = checkpointed(merged.select("id", "size", "one", F.col("best").alias("owner")))

    levels = spark.sparkContext.broadcast(_bucket_levels(texts.select("text"), width))

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in slices(batches, SLICE_BYTES):
            x, offsets, one, _ = _sets(part.column(1), width)
            size = np.diff(offsets)
            new = np.array([not (i in seen or seen.add(i)) for i in one.tolist()], bool)
            n = np.where(new & (100 * size >= percent * (size + 1)), size - need(size, percent) + depth(size), 0)
            n = np.minimum(n, size)
            token, row = _ordered(x, levels.value), np.repeat(np.arange(len(size)), size)
            token = token[np.lexsort((token, row))]
            chosen = np.arange(len(token)) - np.repeat(offsets[:-1], size) < np.repeat(n, size)
            yield pa.RecordBatch.from_arrays([pa.array(_short(token[chosen], row[chosen])), pa.array(np.repeat(one, n))], names=["token", "owner"])

    # Cut tokens can only let more sets through here; the sets that pass are compared by whole tokens.
    hits = _shared(texts.mapInArrow(leading, "token long, owner long")).groupBy("owner").agg(F.count(F.lit(1)).alias("hits"))
    wanted = F.expr(f"1 + ((size * {percent} + 99) div 100) div 16")
    heads = named.where("id = owner").select("id", "size", "one").distinct()
    alive = checkpointed(heads.join(hits.withColumnRenamed("owner", "one"), "one").where(F.col("hits") >= wanted).select(F.col("id").alias("head"), "size"))
    n_alive = alive.count()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, SLICE_BYTES):
            x, offsets, _, _ = _sets(part.column(1), width)
            token, row = _ordered(x, levels.value), np.repeat(np.arange(part.num_rows), np.diff(offsets))
            token = token[np.lexsort((token, row))]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(token))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), lists], names=["owner", "size", "tokens"])

    side = F.broadcast(alive) if n_alive <= BROADCAST_ROWS else alive
    chosen = texts.join(side, F.col("id") == F.col("head"), "left_semi")
    core = chosen.mapInArrow(whole, "owner long, size long, tokens array<long>").dropDuplicates(["owner"])
    for _ in range(2):
        # A set whose tokens are mostly its own has no partner; without it, more tokens of the others turn out to be their own.
        core = checkpointed(core)
        held = _ranked(_explode(core, lambda size, held: held)).groupBy("owner").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
        core = core.select("owner", "size").join(held, "owner").where(F.size("tokens") >= F.expr(f"(size * {percent} + 99) div 100"))
    core = checkpointed(core)

    def wanted_of(size: np.ndarray) -> np.ndarray:
        return depth(need(size, percent))

    # A single token may be shared by chance, and in large data chance joins everything to one block; sets that link share more of them.
    leaders = _explode(core, lambda size, held: held - need(size, percent) + wanted_of(size), wanted_of)
    blocks = components(_met(leaders)).select(F.col("node").alias("owner"), F.col("component").alias("block"))
    blocks = checkpointed(blocks)
    sets = checkpointed(core.join(blocks, "owner"))
    large = sets.groupBy("block").agg(F.sum(F.size("tokens")).alias("held")).where(F.col("held") > PART_TOKENS)
    large = checkpointed(large)
    sets = sets.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, "block", "left")
    # A large block is cut by a hash of the owner; every pair of its parts is a group of its own.
    sets = sets.withColumn("cut", F.coalesce(F.ceil(F.col("held") / PART_TOKENS), F.lit(1)).cast("int"))
    sets = sets.withColumn("part", F.pmod(F.xxhash64("owner"), F.col("cut")).cast("int"))
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    sets = sets.select("block", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "owner", "size", "tokens", "part")
    links = checkpointed(_links(sets, percent))
    reached = components(links).select(F.col("node").alias("owner"), "component")
    degree = links.groupBy(F.col("b").alias("owner")).agg(F.sum("n").alias("n_links"))
    linked = checkpointed(reached.join(degree, "owner"))
    side = F.broadcast(linked) if linked.count() <= BROADCAST_ROWS else linked
    found = named.join(side, "owner", "left").select(
        "id", F.col("size").alias("n_shingles"), F.coalesce("component", "owner").alias("component_id"),
        F.col("owner").alias("set_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    empty = rows.where("size = 0 OR id IS NULL").select(
        "id", F.col("size").alias("n_shingles"), F.col("id").alias("component_id"), F.col("id").alias("set_id"), F.lit(0).cast("long").alias("n_links")
    )
    return found.unionAll(empty)


def drop_similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of linked texts, that with the least key, with all their columns.

    Where a key repeats, its rows are told apart: of a group one row stays, that with the least key among those that have one. Rows with a
    null key are linked with nothing and stay, and so do null and empty texts. Very long texts are read whole; columns may have any names; an
    empty table gives an empty result.
    """
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    if not _repeats(texts):
        return without(docs, similar_sets(docs, key, text).where(f"component_id <> `{key}`").select(key), [key])
    row = free_name(docs, "row")
    rows = checkpointed(docs.withColumn(row, F.monotonically_increasing_id()))
    own = rows.where(F.col(key).isNotNull()).select(F.col(row).alias("id"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    found = _similar(own.select("id", "text"), 5, 75).join(own.select("id", "key"), "id")
    best = found.groupBy("component_id").agg(F.min(F.struct("key", "id")).alias("best"))
    gone = found.join(best, "component_id").where("id <> best.id").select("id")
    return without(rows, gone, [row]).drop(row)
