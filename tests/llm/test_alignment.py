"""Cross-tokenizer alignment: every figure against a direct reading of its definition, and the parts of the spill counting."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.cases import documents, empty, frame, words

from cohortloom.llm import token_alignment as ta
from cohortloom.llm import tokens

ROWS = [
    *documents(n=60)[:-2],
    (None, "key is null"),
    (2000, "twice the same"),
    (2000, "twice the same"),
    (2001, "<|endoftext|> <s> </s> <unk> <0x41> plain text"),
    (2002, "▁ is a mark of its own"),
    (2003, "  two  spaces\tand\nlines \n"),
    (2004, " "),
    (2005, "naïve ﬁ ½ 日本語 \U0001f600\U0001f680 ñandú ＡＢ"),
    (2006, "\x00 control \x7f"),
    (2007, " ".join(words(random.Random(8), 9000, "etaoin"))),
]


def encoded(texts):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public.path(tokens.VOCABULARY))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public.path(ta.PIECES))
    chars = tokens._byte_of_char()
    for text in texts:
        if not text:
            yield [], [], [], []
            continue
        ea, eb = a.encode(f" {text}", add_special_tokens=False), b.encode(text)
        spell_a = [bytes(chars[c] for c in t) for t in ea.tokens]
        spell_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in eb]
        same = b"".join(spell_a) == b"".join(spell_b) == f" {text}".encode()
        yield (ea.ids, eb, spell_a, spell_b) if same else ([], [], [], [])


def groups_of(ids_a, ids_b, spell_a, spell_b):
    ends = [list(np.cumsum([len(s) for s in spell])) for spell in (spell_a, spell_b)]
    out, left = [], 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        out.append(tuple([i for i, e in zip(ids, own, strict=True) if left < e <= end] for ids, own in zip((ids_a, ids_b), ends, strict=True)))
        left = end
    return out


def expected(rows):
    cut = [groups_of(*e) for e in encoded([t for _, t in rows])]
    links = [Counter((a, b) for ga, gb in groups for a in ga for b in gb) for groups in cut]
    count = Counter(pair for own in links for pair in own)
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for (key, _), groups, own in zip(rows, cut, links, strict=True):
        written = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        n = [sum(len(g[i]) for g in groups) for i in (0, 1)]
        best = sum(k for p, k in own.items() if count[p] == top[p[0]])
        out.append((key, *n, len(groups), sum(own.values()), best, sum(k * count[p] for p, k in own.items()), hashlib.sha256(written.encode()).hexdigest() if written else "", written))
    return Counter(out), {(a, b, n, n == top[a]) for (a, b), n in count.items()}


@pytest.fixture(scope="module")
def wanted():
    return expected(ROWS)


def test_alignment_equals_brute_force(spark, wanted):
    found = ta.align(frame(spark, ROWS), with_groups=True)
    got = found.documents()
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
    assert Counter(tuple(r) for r in got.collect()) == wanted[0]
    assert {tuple(r) for r in found.pairs().collect()} == wanted[1]


def test_many_slices_rounds_and_blocks(spark, wanted, monkeypatch):
    for name, value in (("SLICE_BYTES", 300), ("FAN_IN", 3), ("SLICES_PER_GROUP", 5), ("BLOCK_PAIRS", 7), ("STEP", 11)):
        monkeypatch.setattr(ta, name, value)
    found = ta.align(frame(spark, ROWS), partitions=3)
    assert found.slices > 27
    assert Counter(tuple(r) for r in found.documents().collect()) == Counter({r[:-1]: n for r, n in wanted[0].items()})
    assert Counter(tuple(r) for r in found.pairs().collect()) == Counter(wanted[1])


def test_texts_without_tokens(spark):
    rows = [(1, None), (2, ""), (3, "▁")]
    assert sorted(tuple(r) for r in ta.align(frame(spark, rows)).documents().collect()) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]
    found = ta.align(empty(spark))
    assert found.documents().count() == 0 and found.pairs().count() == 0


def test_long_texts_are_cut_where_no_token_reaches(monkeypatch):
    pytest.importorskip("public_tokenizers")
    rng = random.Random(6)
    text = "".join(rng.choice(["ab", " ", "  ", "\n", "7", ".", "é", "don't", "日本", " the"]) for _ in range(3000))
    both = ta.Sides(tokens.VOCABULARY, ta.PIECES)
    whole = both.encode(text)
    monkeypatch.setattr(ta, "pieces", lambda t: tokens.pieces(t, 40))
    assert both.encode(text) == whole and len(list(tokens.pieces(text, 40))) > 20 and len(whole[0]) > 1000
    # No piece holds a space behind another character, so none reaches across the cuts.
    assert not any(s.lstrip(b" ").count(b" ") for s in both.spell_b)


def test_merge_of_runs():
    rng = random.Random(2)
    runs = [sorted(rng.sample(range(400), rng.randint(1, 200))) for _ in range(12)]
    blocks = [(np.array(r[i : i + 9]), np.array([k % 5 + 1 for k in r[i : i + 9]])) for r in runs for i in range(0, len(r), 9)]
    want = Counter()
    for r in runs:
        want.update({k: k % 5 + 1 for k in r})
    blocks.sort(key=lambda b: b[0][0])
    out = list(ta.merged(blocks))
    keys = np.concatenate([k for k, _ in out])
    assert (np.diff(keys) > 0).all() and dict(zip(keys.tolist(), np.concatenate([n for _, n in out]).tolist(), strict=True)) == dict(want)


def test_blobs_round_trip():
    columns = [np.array([], np.int64), np.array([0, 255]), np.array([256, 1 << 40]), np.arange(70_000)]
    assert all((a == b).all() for a, b in zip(ta.loaded(ta.stored(*columns)), columns, strict=True))
