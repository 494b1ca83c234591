"""Language identification: held-out rows, back-off, rows of every kind, the same model under any partitioning."""

import math
import random
import zlib

import numpy as np
import pytest
from llm.cases import CLASHING, words
from pyspark.sql import functions as F

from cohortloom.llm import language as lid

ALPHABETS = {"aa": "abcdefg", "bb": "abcxyzw", "cc": "аbвгде"}


def corpus(n=240, seed=3):
    rng = random.Random(seed)
    common = {name: words(rng, 40, letters) for name, letters in ALPHABETS.items()}
    rows = []
    for i in range(n):
        name = rng.choice(list(ALPHABETS))
        own = [rng.choice(common[name]) if rng.random() < 0.6 else words(rng, 1, ALPHABETS[name])[0] for _ in range(rng.randint(4, 60))]
        rows.append((i, " ".join(own).capitalize() + ".", name))
    return rows


def frame(spark, rows, partitions=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(partitions)
    return docs.withColumns({c: F.lit("x") for c in [*CLASHING, "lang_pred", "draw", "share", "place", "gram"]})


EXTRA = [(None, "abc abc", "aa"), (5000, None, "aa"), (5001, "", "bb"), (5002, "12 34 _ ² !", "cc"), (5003, "abcxyz", None), (5003, "abcxyz", None), (5004, "中文", None), (5005, "a²b ²", None)]


def plain_score(model, text):
    """Scores by the definition, one word and one language at a time."""
    index = {k: i for i, k in enumerate(model.keys)}
    found = [w for w in lid._WORD.findall(text.lower()) if any(c.isalpha() for c in w)]
    total = [0.0] * len(model.languages)
    for w in found:
        for j in range(len(total)):
            if w in index:
                total[j] += model.logs[index[w]][j]
                continue
            value = model.floor
            for n in range(lid.LONGEST, 0, -1):
                padded = f" {w} " if n > 1 else w
                own = [index[f"{n}{padded[i:i + n]}"] for i in range(len(padded) - n + 1) if f"{n}{padded[i:i + n]}" in index]
                if own:
                    value = sum(model.logs[i][j] for i in own) / len(own)
                    break
            total[j] += value
    return total, len(found)


def test_held_out_rows_are_recognised(spark):
    rows = corpus()
    docs = frame(spark, [*rows, *EXTRA])
    got = lid.predict(docs, lid.fit(docs)).collect()
    assert len(got) == len(rows) + len(EXTRA)
    truth = {i: name for i, _, name in rows}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    scored = [r["lang_pred"] == truth[r["doc_id"]] for r in held if r["doc_id"] in truth]
    assert len(scored) > 40 and np.mean(scored) > 0.97
    assert all(0.0 <= r["score"] <= 1.0 for r in got)
    by_id = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [by_id[i] for i in (5000, 5001, 5002)] == ["und"] * 3
    assert by_id[5003] in ALPHABETS and by_id[5004] in ALPHABETS and by_id[5005] in ALPHABETS


def test_scores_equal_a_plain_version(spark):
    rows = corpus(60)
    model = lid.fit(frame(spark, rows))
    scorer = lid.Scorer(model)
    for _, text, _ in [*rows, (0, "zzz unseen Abc 7up x", ""), (0, "жж a²b", "")]:
        got, n = scorer.score(text)
        want, m = plain_score(model, text)
        assert n == m and np.allclose(got, want)


def test_labels_of_held_out_rows_do_not_teach(spark):
    rows = corpus(80)
    swapped = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else n) for i, t, n in rows] + [(None, "q q q q", "nokey")]
    a, b = lid.fit(frame(spark, rows)), lid.fit(frame(spark, swapped))
    assert a.languages == b.languages and a.keys == b.keys and np.array_equal(a.logs, b.logs)


def test_sample_is_bounded_and_does_not_depend_on_partitions(spark):
    rows = corpus(200)
    models = [lid.fit(frame(spark, rows, p), rows=8, least=1) for p in (1, 7)]
    assert models[0].keys == models[1].keys and np.array_equal(models[0].logs, models[1].logs)
    assert len(models[0].keys) < len(lid.fit(frame(spark, rows), least=1).keys) / 2
    copies = [(900, "abc abcd", "aa")] * 50 + rows
    once = [(900, "abc abcd", "aa"), *rows]
    assert lid.fit(frame(spark, copies)).keys == lid.fit(frame(spark, once)).keys


def test_long_texts_in_stretches(spark, monkeypatch):
    text = " ".join(words(random.Random(4), 4000, "abcdefg")) + " x1y2"
    whole = [w for part in lid.words_of(text) for w in part]
    monkeypatch.setattr(lid, "STRETCH", 500)
    assert [w for part in lid.words_of(text) for w in part] == whole and len(list(lid.words_of(text))) > 20
    assert sum(len(w) for part in lid.words_of("a" * 5000) for w in part) == 5000


def test_unseen_words_are_forgotten_without_harm(monkeypatch):
    model = lid.from_counts(["p", "q"], ["ab", "1a", "1b"], np.array([[4.0, 1.0], [5.0, 1.0], [1.0, 5.0]]))
    monkeypatch.setattr(lid, "REMEMBERED", 3)
    scorer = lid.Scorer(model)
    texts = [f"{a}{b} b" for a in "abcdefgh" for b in "xyz"]
    assert [scorer.predict(t) for t in texts] == [lid.Scorer(model).predict(t) for t in texts]
    assert scorer.predict("ab")[0] == "p" and scorer.predict("bbb")[0] == "q"
    assert math.isclose(scorer.predict("zz")[1], 0.5)


@pytest.mark.parametrize("rows", [[], [(1, None, "aa")], [(1, "text", None), (2, "more", None)]])
def test_nothing_to_learn(spark, rows):
    docs = frame(spark, rows)
    got = lid.predict(docs, lid.fit(docs)).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * len(rows)
