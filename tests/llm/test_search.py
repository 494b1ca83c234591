"""Ranked lexical search: bounds, results against a direct reading of the scores, rows of every kind."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm.cases import documents, empty, frame, words

from cohortloom.llm import lexical_search as ls
from cohortloom.llm.terms import terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def spelled(text):
    return TERM.findall((text or "").translate(LOWER))


def ranking(rows, items, best=10):
    """(position of the item, rank, key, score) by the definition."""
    held = [(k, Counter(spelled(t))) for k, t in rows]
    sizes = [sum(c.values()) for _, c in held]
    n_docs, n_terms, df = sum(n > 0 for n in sizes), sum(sizes), Counter(t for _, c in held for t in c)
    out = []
    for at, (_, text) in enumerate(items):
        hits = []
        for (k, c), n in zip(held, sizes, strict=True):
            m = 10 + 90 * n * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(spelled(text)) if t in c)
            if score > 0:
                hits.append((-score, k is None, k or 0, k))
        out += [(at, i + 1, h[3], -h[0]) for i, h in enumerate(sorted(hits)[:best])]
    return out


def by_id(items, wanted):
    return Counter((items[at][0], rank, k, s) for at, rank, k, s in wanted)


def found(spark, rows, items, **options):
    queries = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS query", "1 AS rank", "2 AS score", "3 AS doc_id")
    got = ls.search(frame(spark, rows), queries, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return Counter(tuple(r) for r in got.collect())


ROWS = [*documents(n=150), (None, "one two three four"), (2000, "one two three"), (2000, "one two three"), (2001, "ONE, Two; three!"), (2002, "!?,. "), (2003, "日本語 naïve 日本語")]
ITEMS = [(1, "one two three"), (2, "One one ONE"), (3, None), (4, ""), (5, "...."), (6, "日本語 ÇÀ çà"), (7, "absent-word zzzz"), (8, " ".join(words(random.Random(3), 300)))]
ITEMS += [(100 + i, t) for i, (_, t) in enumerate(documents(n=40)[:40])] + [(1, "one two three"), (None, "one two")]


def test_search_equals_brute_force(spark):
    assert found(spark, ROWS, ITEMS) == by_id(ITEMS, ranking(ROWS, ITEMS))


@pytest.mark.parametrize("options", [{"coordinates": 1}, {"coordinates": 7, "best": 3}, {"best": 1}])
def test_any_sketch_gives_the_same_ranking(spark, options):
    assert found(spark, ROWS, ITEMS, **options) == by_id(ITEMS, ranking(ROWS, ITEMS, options.get("best", 10)))


def test_queries_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ls, "BLOCK_CHARS", 700)
    assert found(spark, ROWS, ITEMS) == by_id(ITEMS, ranking(ROWS, ITEMS))


def test_ties_of_many_copies_go_by_key(spark):
    rows = [(i, "same words here") for i in random.Random(1).sample(range(5000), 400)] + [(9000, "other text")]
    got = found(spark, rows, [(1, "words here")])
    assert got == by_id([(1, "")], ranking(rows, [(1, "words here")])) and sorted(r[2] for r in got) == sorted(k for k, _ in rows)[:10]


def test_empty_tables(spark):
    assert found(spark, [], ITEMS) == Counter()
    assert found(spark, ROWS, []) == Counter()
    assert found(spark, [(1, None), (2, "")], ITEMS) == Counter()
    assert ls.search(empty(spark), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_terms_across_segments():
    texts = ["a" * 500 + " b", None, "", "x日本" * 40, "x日本" * 40 + "y", "ab", "AB", "tail" + "é" * 90]
    whole = [(int(h), int(r)) for hs, rs in terms(pa.array(texts)) for h, r in zip(hs, rs, strict=True)]
    for most in (1, 7, 64, 333):
        assert [(int(h), int(r)) for hs, rs in terms(pa.array(texts), most) for h, r in zip(hs, rs, strict=True)] == whole
    assert [r for _, r in whole] == [0, 0, 3, 4, 5, 6, 7]
    names = [w for t in texts for w in spelled(t)]
    assert len({h for h, _ in whole}) == len(set(names)) == 6


def test_bounds_prune_and_never_fall_below_scores():
    rng = random.Random(9)
    texts = [" ".join(words(rng, rng.randint(5, 60), "abcdefghijklmnop")) for _ in range(300)]
    items = [" ".join(t.split()[:6]) for t in texts[:20]]
    vocabulary = ls.Vocabulary.of(items)
    seen, column = vocabulary.filter(), pa.array(texts)
    n, row, place, tf = ls.postings(column, vocabulary, seen)
    df = np.bincount(place, minlength=len(vocabulary.hashes))
    block = ls.Queries(list(range(20)), vocabulary, ls.weights(300, df), 300, int(n.sum()), 512, 10)
    kept = [ls.Best(10) for _ in items]
    rescored = ls.search_slice(list(range(300)), column, block, seen, ls.lookups(block), kept)
    want = ranking(list(enumerate(texts)), list(enumerate(items)))
    assert [(q, i + 1, k, s) for q, b in enumerate(kept) for i, (s, k) in enumerate(b.rows)] == want
    assert rescored < 300 * 20 / 2
