"""The pipeline against a plain version of its stages, and the registered queries against their SQL."""

import random
import re
import tempfile

import pytest
from compare import connect, difference
from llm.cases import words
from llm.test_duplicates import brute_components, plain

import corpus_pipeline
from cohortloom.llm import decontaminate, ngram_join, toxicity
from cohortloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert difference(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_names(name):
    assert re.fullmatch(r"op(1[0-3]|[1-9])_[a-z0-9_]+", name)


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_stages_take_effect(spark):
    rng = random.Random(12)
    base = [" ".join(words(rng, 60)) for _ in range(150)]
    items = [" ".join(words(rng, 25)) for _ in range(3)]
    rows = list(enumerate(base))
    toxic = {i for i in range(150) if i % 5 == 1}
    for i in toxic:
        w = rows[i][1].split()
        for at in (5, 25, 45):
            w[at] = rng.choice(["idiot", "stupid", "scum"])
        rows[i] = (i, " ".join(w))
    near = base[0].split()
    near[30] = "changed"
    rows += [(500, base[0] + "\n"), (501, " ".join(near)), (502, f"{base[2][:100]} {items[1]} {base[3][:90]}"), (503, None), (504, ""), (505, base[4]), (505, base[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    root = tempfile.mkdtemp(prefix="cohortloom-pipeline-")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")

    kept = [(i, t) for i, t in rows if i not in toxic]
    best = {}
    for i, t in kept:
        best[plain(t)] = min(best.get(plain(t), (1, 0)), (-len(t or ""), i))
    kept = list({(i, t) for i, t in kept if best[plain(t)][1] == i})
    components = brute_components(kept)
    kept = [(i, t) for i, t in kept if components[i][1] == i]
    want = {i for i, t in kept if not any(x in (t or "") for x in items)}

    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        now = stage(spark, now, root)
        assert now.columns == docs.columns, name
        now.write.parquet(f"{root}/stage-{k}")
        now = spark.read.parquet(f"{root}/stage-{k}")
    assert sorted(r["doc_id"] for r in now.collect()) == sorted(want)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, root).collect()} == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_duplicates", "decontamination", "packing"]


def test_stages_tell_rows_apart_by_their_texts(spark):
    """Clean rows with null or repeated keys stay when another row with that key goes; extra columns may have any name."""
    rng = random.Random(5)
    clean = [" ".join(words(rng, 60)) for _ in range(8)]
    bad = "you are a stupid idiot and worthless scum. you pathetic moron, you disgusting loser."
    item = " ".join(words(rng, 30))
    near = clean[0].split()
    near[30] = "changed"
    names = "doc_id long, text string, row long, text_digest string"

    def kept(stage, rows):
        docs = spark.createDataFrame([(k, t, 7, "x") for k, t in rows], names).repartition(3)
        out = stage(docs)
        assert out.columns == docs.columns
        return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)

    def want(rows):
        return sorted(rows, key=repr)

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(None, clean[0]), (None, bad), (1, clean[1]), (1, bad), (2, None), (3, ""), (4, clean[2] + f" {bad} " + clean[3])]
    assert kept(lambda d: toxicity.drop_toxic(d, labels), rows) == want([r for r in rows if bad not in (r[1] or "")])
    benchmark = spark.createDataFrame([(0, item)], "item_id long, text string")
    rows = [(None, clean[0]), (None, f"{clean[1]} {item}"), (1, clean[1]), (1, item), (2, None), (3, "")]
    assert kept(lambda d: decontaminate.drop_leaks(d, benchmark), rows) == want([r for r in rows if item not in (r[1] or "")])
    rows = [(5, clean[0]), (1, " ".join(near)), (1, clean[1]), (None, clean[0]), (2, clean[1] + " end"), (7, None), (7, ""), (7, clean[2])]
    assert kept(ngram_join.drop_similar, rows) == want([r for r in rows if r not in ((5, clean[0]), (2, clean[1] + " end"))])
    for stage in (lambda d: toxicity.drop_toxic(d, labels), lambda d: decontaminate.drop_leaks(d, benchmark), ngram_join.drop_similar):
        assert kept(stage, []) == []


def test_edit_shares_that_would_lose_items_are_refused(spark):
    with pytest.raises(ValueError, match="edit_share"):
        decontaminate.find_leaks(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"), edit_share=1.0)
