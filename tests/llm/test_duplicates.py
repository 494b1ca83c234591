"""Exact duplicates, n-gram joins and repeated passages against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from llm.cases import documents, empty, frame, words

from cohortloom.llm import ngram_join, repeated_passages
from cohortloom.llm.components import components
from cohortloom.llm.exact_dedup import drop_exact_duplicates, exact_duplicates


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_duplicates_equal_brute_force(spark):
    rows = [*documents(), (2000, "ab c"), (2001, "a  bc"), (2002, "abc"), (2003, "a  bc"), (None, "abc")]
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append((-len(t or ""), i is None, i, t))
    for partitions, fan_in in ((1, 2), (7, 2), (7, 8)):
        got = exact_duplicates(frame(spark, rows, partitions), fan_in=fan_in).collect()
        assert len(got) == len(rows)
        for r in got:
            own = next(g for g in groups.values() if any(x[2] == r["doc_id"] for x in g))
            best = min(own, key=lambda x: x[:2] + (x[2] or 0,))
            assert (r["keep_id"], r["group_size"]) == (best[2], len(own))
            assert r["kept"] == (r["doc_id"] == best[2])
            assert r["text_sha256"] == hashlib.sha256(plain(own[0][3]).encode()).hexdigest()


def test_exact_duplicates_keep_one_of_repeated_rows(spark):
    docs = frame(spark, [(1, "a b"), (1, "a b"), (2, "ab"), (3, None), (3, "")])
    got = exact_duplicates(docs)
    assert got.where("kept").count() == 2
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == [(1, "a b"), (3, "")]
    assert exact_duplicates(empty(spark)).count() == 0
    assert drop_exact_duplicates(empty(spark)).count() == 0


def test_exact_duplicates_run_no_python(spark):
    plan = exact_duplicates(frame(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    label = {i: i for i, _ in sets}
    links = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k] if s and t and 100 * len(s & t) >= 75 * len(s | t)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return {i: (len(s), label[i]) for i, s in sets}


@pytest.mark.parametrize("part_tokens", [1_000_000, 250])
def test_similar_sets_equal_brute_force(spark, monkeypatch, part_tokens):
    monkeypatch.setattr(ngram_join, "PART_TOKENS", part_tokens)
    rng = random.Random(3)
    rows = documents(seed=5, n=150)
    base = words(rng, 80)
    for i in range(60):
        # Near copies around the threshold: the changed words leave between 60 and 95 of 100 shingles.
        own = list(base)
        for at in rng.sample(range(80), rng.randint(0, 5)):
            own[at] = f"w{rng.randint(0, 3)}"
        rows.append((3000 + i, " ".join(own)))
    want = brute_components(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_sets(frame(spark, rows)).collect()}
    assert got == want


def test_shingles_shared_by_chance_do_not_join_blocks(spark, monkeypatch):
    rng = random.Random(11)
    families = [words(rng, 120) for _ in range(30)]
    for i, own in enumerate(families):
        # One shingle in common with each of five others, far less than links need.
        for k in range(1, 6):
            own[20 * (k - 1) : 20 * (k - 1) + 5] = families[(i + 7 * k) % 30][100 + 3 * k - 3 : 100 + 3 * k + 2]
    rows = [(10 * i + j, " ".join([*own[:-1], f"z{i}{j}"])) for i, own in enumerate(families) for j in range(3)]
    sizes, links = [], ngram_join._links

    def seen(parts, percent):
        sizes.extend(r["n"] for r in parts.select("block", "owner").distinct().groupBy("block").count().withColumnRenamed("count", "n").collect())
        return links(parts, percent)

    monkeypatch.setattr(ngram_join, "_links", seen)
    # Buckets of large data hold too many shingles to tell rare ones from others.
    monkeypatch.setattr(ngram_join, "_bucket_levels", lambda texts, width: np.zeros(1 << ngram_join.BITS, np.uint8))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_sets(frame(spark, rows)).collect()}
    assert got == {i: 10 * (i // 10) for i, _ in rows}
    assert sizes == [3] * 30


@pytest.mark.parametrize("most", [1, 3, 6])
def test_groups_come_whole_up_to_their_bound(most):
    rng = random.Random(most)
    rows = sorted((rng.choice([1, 2, 2, 5, 5, 5, 9, rng.randint(10, 40)]), rng.randint(0, 12)) for _ in range(150))
    cuts = [0, *sorted(rng.sample(range(len(rows)), 12)), len(rows)]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[a:b]], pa.int64()) for i in range(2)], names=["token", "owner"]) for a, b in zip(cuts, cuts[1:])]
    got = [x for piece in ngram_join._grouped(iter(batches), most) for x in zip(*(c.tolist() for c in piece), strict=True)]
    groups = collections.defaultdict(list)
    for t, o in sorted(set(rows)):
        groups[t].append(o)
    assert got == [(t, o, min(len(own), most + 1), own[0]) for t, own in groups.items() for o in own]


def test_similar_sets_at_the_threshold(spark):
    a = [f"a{i}" for i in range(11)]
    # 7 shingles each, 6 common of 8; then 5 common of 9.
    rows = [(1, " ".join(a)), (2, " ".join(["z", *a[1:]])), (3, " ".join(["y", "y", *a[2:]])), (4, " ".join([*a[1:], "q"]))]
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.similar_sets(frame(spark, rows)).collect()} == {i: brute_components(rows)[i][1] for i in (1, 2, 3, 4)}


def test_similar_sets_edges(spark):
    docs = frame(spark, [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (6, None), (7, " ")])
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar_sets(docs).collect()), key=str)
    assert got == sorted([(None, 2, None), (5, 2, 5), (5, 2, 5), (6, 0, 6), (7, 0, 7)], key=str)
    assert ngram_join.similar_sets(empty(spark)).count() == 0
    assert ngram_join.drop_similar(frame(spark, [(1, "a b c d e"), (2, "a b c d e")])).select("doc_id").collect()[0][0] == 1


@pytest.mark.parametrize("edge", [1, 3, 32])
def test_trie_finds_what_pairs_find(monkeypatch, edge):
    monkeypatch.setattr(ngram_join, "EDGE_TOKENS", edge)
    rng = random.Random(1)
    sets = []
    for i in range(80):
        n = rng.randint(1, 14)
        sets.append((i, n + rng.randint(0, 2), np.array(sorted(rng.sample(range(18), n)))))
    has = np.zeros((18, 80), bool)
    for i, _, own in sets:
        has[own, i] = True
    got = {i: set(q.tolist()) for i, q in ngram_join.Trie(sets, 75).join(has, np.array([n for _, n, _ in sets]))}
    for i, n, own in sets:
        want = {j for j, m, other in sets if 175 * len(set(own.tolist()) & set(other.tolist())) >= 75 * (n + m)}
        assert got.get(i, set()) == want, i


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {90: 90, 100: 90}


def brute_passages(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def passages(rng):
    shared = [" ".join(words(rng, 60, "abcdeéß")) for _ in range(5)]
    rows = []
    for i in range(90):
        text = " ".join(words(rng, rng.randint(1, 90), "abcdeéß"))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, len(p))
            p = p[a : a + rng.randint(100, 400)]
            if rng.random() < 0.4:
                j = rng.randint(0, len(p))
                p = f"{p[:j]}X{p[j:]}"
            k = rng.randint(0, len(text))
            text = text[:k] + p + text[k:]
        rows.append((i, text + "ab " * (rng.randint(50, 200) if rng.random() < 0.1 else 0)))
    return rows + [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, ""), (204, "x" * 199), (205, "x" * 199), (206, "y" * 200), (207, "z" * 201), (208, " ".join(words(rng, 9000)))]


@pytest.mark.parametrize("places", [4096, 2])
def test_repeated_passages_equal_brute_force(spark, monkeypatch, places):
    monkeypatch.setattr(repeated_passages, "ANCHOR_PLACES", places)
    rows = passages(random.Random(places))
    got = sorted(tuple(r) for r in repeated_passages.repeated_passages(frame(spark, rows)).collect())
    assert got == brute_passages(rows, 200)


def test_repeated_passages_give_spans_and_bytes(spark):
    p = " ".join(words(random.Random(2), 80))
    rows = [(1, f"first {p} end"), (2, f"{p} second"), (3, "short")]
    got = {r["doc_id"]: r for r in repeated_passages.repeated_passages(frame(spark, rows), with_kept=True).collect()}
    assert got[1]["kept"].decode().startswith("first") and got[1]["kept"].decode().endswith("end")
    assert [(s["start"], s["stop"]) for s in got[2]["spans"]] == [(0, len(p) + 1)]
    assert repeated_passages.repeated_passages(empty(spark)).count() == 0


def test_segments_hold_every_window_once(monkeypatch):
    import numpy as np

    monkeypatch.setattr(repeated_passages, "_SEGMENT", 50)
    offsets = np.cumsum([0, 10, 0, 45, 200, 3, 30, 30])
    seen = collections.Counter()
    for begin, _, starts, (row, shift) in repeated_passages.segments(offsets, 7):
        assert begin == offsets[row[0]] + shift[0]
        for k in range(len(row)):
            seen.update((int(row[k]), int(p + shift[k])) for p in range(starts[k + 1] - starts[k] - 6))
    assert seen == {(r, p): 1 for r in range(7) for p in range(offsets[r + 1] - offsets[r] - 6)}


@pytest.mark.parametrize("percent", [50, 60, 90])
def test_links_at_other_shares(spark, percent):
    """Small sets link below 67 percent: two shingles inside three, one inside two."""
    rng = random.Random(percent)
    stem = words(rng, 7)
    rows = [(1, " ".join(stem[:6])), (2, " ".join(stem)), (3, " ".join(stem[:5])), *((10 + i, t) for i, (_, t) in enumerate(documents(n=60)[:60]))]
    sets = {i: shingle_set(t) for i, t in rows}
    got = {r["doc_id"]: r for r in ngram_join.similar_sets(frame(spark, rows), percent=percent).collect()}
    for i, s in sets.items():
        partners = {t for t in sets.values() if t and t != s and 100 * len(s & t) >= percent * len(s | t)}
        assert got[i]["n_links"] == (len(partners) if s else 0), (i, percent)
    assert (got[1]["component_id"] == got[2]["component_id"]) == (percent <= 66)


def test_repeated_keys_with_different_texts_are_sets_of_their_own(spark):
    rng = random.Random(2)
    a, b = (" ".join(words(rng, 50)) for _ in range(2))
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, "alone in the world of texts"), (None, a), (4, "alone in the world of texts"), (6, None)]
    got = sorted(tuple(r) for r in ngram_join.similar_sets(frame(spark, rows)).collect() if r["doc_id"] is not None)
    n = len(shingle_set(a)), len(shingle_set(b))
    assert got == sorted([(1, n[0], 1, 1, 1), (1, n[1], 1, 1, 1), (2, n[0] + 1, 1, 2, 1), (3, n[1] + 1, 1, 3, 1), (4, 2, 4, 4, 0), (4, 2, 4, 4, 0), (6, 0, 6, 6, 0)])


def test_every_batch_passes_the_family(monkeypatch):
    """Batches are merge-scanned against all levels; levels at least halve; equal first halves are told apart by the second."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    made = []

    class Counted(repeated_passages.Family):
        def __init__(self):
            super().__init__()
            made.append(self)

    monkeypatch.setattr(repeated_passages, "Family", Counted)
    monkeypatch.setattr(repeated_passages, "slices", lambda batches, most: (b.slice(i, 3) for b in batches for i in range(0, b.num_rows, 3)))
    texts = [rng.integers(97, 99, 40).astype(np.uint8).tobytes() for _ in range(30)]
    texts += texts[:5]
    columns = [pa.array([1] * 35), pa.array([0] * 35), pa.array([False] * 35), pa.array(range(35)), pa.array([0] * 35), pa.array(texts, pa.binary())]
    batch = pa.RecordBatch.from_arrays([c.cast(pa.int64()) if pa.types.is_integer(c.type) else c for c in columns], names=["anchor", "salt", "many", "name", "first", "context"])
    found = {(n, s) for b in repeated_passages._scan(12)([batch]) for n, a, z in zip(*(b.column(i).to_pylist() for i in range(3))) for s in range(a, z)}
    every = collections.Counter(t[i : i + 12] for t in texts for i in range(29))
    assert found == {(n, i + j) for n, t in enumerate(texts) for i in range(29) if every[t[i : i + 12]] > 1 for j in range(12)}
    (family,) = made
    sizes = [len(level["a"]) for level in family.levels]
    assert family.batches == 12 and all(x >= 2 * y for x, y in zip(sizes, sizes[1:])) and sum(sizes) == len(every)
    level = {"a": np.array([1, 5, 5, 5, 9], np.uint64), "b": np.array([0, 1, 2, 3, 0], np.uint64)}
    batch = {"a": np.array([0, 5, 5, 9, 9], np.uint64), "b": np.array([0, 3, 4, 0, 1], np.uint64)}
    assert repeated_passages._same(level, batch).tolist() == [-1, 3, -1, 4, -1]


def test_cut_tokens_lose_no_match():
    """The leading shingles travel as 40 bits; tokens of a row that are cut alike stay apart, so counts of common ones never fall."""
    from cohortloom.llm.ngram_join import _short

    a = np.array([5, 5 | 1 << 40, 7, 5 | 2 << 40, 5 | 1 << 40, -1], np.int64)
    row = np.array([0, 0, 0, 1, 1, 1])
    got = _short(a, row)
    assert len(set(got[:3].tolist())) == len(set(got[3:].tolist())) == 3
    # Row 0 and row 1 have one token in common, and two that are cut alike.
    assert len(set(got[:3].tolist()) & set(got[3:].tolist())) == 2
    assert (got.view(np.uint64) & np.uint64(0xFFFF00) == 0).all()


def test_leading_shingles_take_few_bytes(spark):
    """Tokens of the first shuffle end in zeros, which lz4 packs away; whole 64-bit hashes held the disk above four times the input."""
    from cohortloom.llm import ngram_join

    seen = []
    shared = ngram_join._shared
    try:
        ngram_join._shared = lambda postings: seen.append(postings) or shared(postings)
        texts = spark.createDataFrame([(i, " ".join(f"w{(i // 2) * 100 + j}" for j in range(60))) for i in range(20)], "doc_id long, text string")
        found = ngram_join.similar_sets(texts)
        assert {(r["doc_id"], r["component_id"]) for r in found.collect()} == {(i, i - i % 2) for i in range(20)}
    finally:
        ngram_join._shared = shared
    tokens = [r["token"] for r in seen[0].collect()]
    assert tokens and all(t & 0xFFFFFF < 60 for t in tokens)
