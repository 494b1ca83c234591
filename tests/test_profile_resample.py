import re
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import resample
from cohortloom.operators.profile import (
    class_shares,
    column_kinds,
    kept_by_threshold,
    missing_profile,
    overlap_share,
    pair_counts,
    prune_missing,
    split_by_kind,
)
from cohortloom.operators.resample import (
    assign_folds,
    bootstrap_interval,
    exact_sample,
    hash_folds,
    repeat_rows,
    run_trials,
    t_interval,
)
from cohortloom.operators.scale import standardize


@pytest.fixture(scope="module")
def mixed(spark):
    nan = float("nan")
    data = [
        (i, float(i % 2), 0.0, 1.0, None, float(i % 10), float(i % 11), nan if i == 0 else float(i), 1.0 if i % 10 else None)
        for i in range(100)
    ]
    return spark.createDataFrame(
        data, "id int, two double, zeros double, ones double, none double, ten double, eleven double, many double, tenth double"
    )


COLS = ["two", "zeros", "ones", "none", "ten", "eleven", "many", "tenth"]


def test_kinds(mixed):
    kinds = column_kinds(mixed, COLS)
    assert split_by_kind(kinds) == {
        "binary": ["two", "zeros", "ones", "none", "tenth"], "categorical": ["ten"], "continuous": ["eleven", "many"]
    }
    levels = {r["column"]: r["levels"] for r in kinds.collect()}
    assert levels["ten"] == [float(i) for i in range(10)] and levels["many"] is None and levels["none"] == []


def test_kinds_with_a_large_threshold(mixed):
    assert split_by_kind(column_kinds(mixed, ["eleven", "many"], max_levels=300)) == {
        "binary": [], "categorical": ["eleven", "many"], "continuous": []
    }


def test_missing_profile_and_strict_threshold(mixed):
    shares = {r["column"]: (r["n_rows"], r["n_missing"], r["missing_share"]) for r in missing_profile(mixed, COLS).collect()}
    assert shares["tenth"] == (100, 10, 0.1) and shares["none"] == (100, 100, 1.0) and shares["many"] == (100, 1, 0.01)
    df, kept = prune_missing(mixed, COLS, 0.1)
    assert kept == ["two", "zeros", "ones", "ten", "eleven", "many"] and df.columns == ["id", *kept]
    assert {r["threshold"]: r["n_kept"] for r in kept_by_threshold(mixed, COLS, [0.1, 0.3]).collect()} == {0.1: 6, 0.3: 7}


def test_profile_of_empty_frame(mixed):
    rows = missing_profile(mixed.filter("id < 0"), COLS).collect()
    assert len(rows) == len(COLS) and all(r["missing_share"] is None for r in rows)


def test_shares_and_overlap(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (3,)], "label int")
    assert {r["label"]: (r["n"], r["share"]) for r in class_shares(df, "label").collect()} == {1: (2, 0.5), 2: (1, 0.25), 3: (1, 0.25)}
    other = spark.createDataFrame([(1,), (3,), (3,)], "label int")
    r = overlap_share(df, other, "label").first()
    assert (r["n_ids"], r["n_found"]) == (3, 2) and r["share_found"] == pytest.approx(2 / 3)


def test_pair_counts_match_joins(spark):
    a = spark.createDataFrame([(i,) for i in range(10)], "id int")
    b = spark.createDataFrame([(i,) for i in range(5, 12)], "id int")
    got = {(r[0], r[1]): r[2] for r in pair_counts({"A": a, "B": b}, "id", {"A": a, "B": b}).collect()}
    assert got == {("A", "B"): 5, ("B", "A"): 5}


@pytest.mark.parametrize("frac,n", [(0.0, 0), (0.37, 37), (1.0, 100), (0.005, 0), (0.015, 2)])
def test_exact_sample_size(mixed, frac, n):
    out = exact_sample(mixed, "id", frac, seed=1)
    ids = [r["id"] for r in out.select("id").collect()]
    assert len(ids) == n == len(set(ids)) and out.columns == mixed.columns


def test_exact_sample_is_seeded_and_checked(mixed):
    pick = lambda s: sorted(r["id"] for r in exact_sample(mixed, "id", 0.3, s).collect())
    assert pick(1) == pick(1) != pick(2)
    with pytest.raises(ValueError):
        exact_sample(mixed, "id", 1.5)


def test_exact_sample_with_one_hot_key(spark, monkeypatch):
    """A third of the rows share key and content: the size stays exact."""
    monkeypatch.setattr(resample, "HOT_BUCKET_ROWS", 10)
    monkeypatch.setattr(resample, "COPIES_PER_TASK", 7)
    df = spark.range(200).selectExpr("id AS id", "1 AS v").unionAll(spark.range(100).selectExpr("-1L AS id", "5 AS v"))
    sizes = {f: exact_sample(df, "id", f, seed=3).count() for f in (0.1, 0.5, 0.9)}
    assert sizes == {0.1: 30, 0.5: 150, 0.9: 270}


def test_repeat_rows(spark, monkeypatch):
    monkeypatch.setattr(resample, "COPIES_PER_TASK", 3)
    df = spark.createDataFrame([("a", 8), ("b", 1)], "x string, n long")
    assert Counter(r["x"] for r in repeat_rows(df, "n").collect()) == {"a": 8, "b": 1}


@pytest.mark.parametrize("n,k", [(100, 5), (101, 5), (7, 3)])
def test_folds_partition_evenly(spark, n, k):
    folds = Counter(r["fold"] for r in assign_folds(spark.range(n), "id", k, seed=4).collect())
    assert sorted(folds) == list(range(k)) and max(folds.values()) - min(folds.values()) <= 1


def test_folds_do_not_depend_on_bucket_sizes(spark, monkeypatch):
    """One order at every size: hot keys, repeated rows and partitionings give the same folds."""
    df = spark.range(300).selectExpr("id", "id % 7 AS v").unionAll(spark.range(200).selectExpr("-1L AS id", "id % 50 AS v")).unionAll(spark.range(90).selectExpr("-2L AS id", "1L AS v"))
    seen, plans = [], []
    for rows, limit, partitions in ((20_000, 10**9, 3), (20_000, 5, 1), (16, 5, 7), (16, 10**9, 2)):
        monkeypatch.setattr(resample, "BUCKET_ROWS", rows)
        monkeypatch.setattr(resample, "HOT_BUCKET_ROWS", limit)
        monkeypatch.setattr(resample, "COPIES_PER_TASK", 11)
        out = assign_folds(df.repartition(partitions), "id", 5, seed=4)
        assert out.columns == ["id", "v", "fold"]
        seen.append(Counter(tuple(r) for r in out.collect()))
        plans.append(out._jdf.queryExecution().logical().toString())
    assert seen[0] == seen[1] == seen[2] == seen[3]
    # Hot buckets are rows of a table: no bucket is named in a plan.
    assert not any(re.search(r"\bIN \(|'[0-9a-f]{3,}'", plan) for plan in plans)
    folds = Counter(fold for (_, _, fold), n in seen[0].items() for _ in range(n))
    assert sum(folds.values()) == 590 and max(folds.values()) - min(folds.values()) <= 1


def test_folds_reject_too_few_rows(spark):
    with pytest.raises(ValueError):
        assign_folds(spark.range(3), "id", 5)
    assert hash_folds(spark.range(50), "id", 5).filter("fold BETWEEN 0 AND 4").count() == 50


def test_bootstrap_interval_contains_the_mean(spark):
    scores = spark.createDataFrame([("m", i, v) for i, v in enumerate([0.1, 0.2, 0.3, 0.4, 0.5])], "model string, fold int, r2 double")
    r = bootstrap_interval(scores, ["model"], "fold", "r2", reps=500).first()
    assert r["mean"] == pytest.approx(0.3) and 0.1 <= r["ci_low"] < 0.3 < r["ci_high"] <= 0.5
    t = t_interval(scores, ["model"], "r2").first()
    half = 2.776445 * statistics.stdev([0.1, 0.2, 0.3, 0.4, 0.5]) / 5**0.5
    assert t["ci_low"] == pytest.approx(0.3 - half) and t["ci_high"] == pytest.approx(0.3 + half)


def test_run_trials_keeps_order(spark):
    assert run_trials(spark, [(i,) for i in range(6)], lambda i: spark.range(i).count(), 3) == list(range(6))


def test_standardize_uses_population_deviation(spark):
    x = np.array([1.0, 2.0, 4.0, 9.0])
    df = spark.createDataFrame([(float(v), 5.0) for v in x], "x double, c double")
    got = sorted((r["x"], r["c"]) for r in standardize(df, ["x", "c"]).collect())
    assert np.allclose([g[0] for g in got], (x - x.mean()) / x.std()) and all(g[1] == 0.0 for g in got)
    assert standardize(df.filter(F.lit(False)), ["x", "c"]).count() == 0


def test_folds_and_linear_scores_take_few_passes(spark):
    from cohortloom.operators.regress import linear_models, score_linear

    def jobs(name, work):
        spark.sparkContext.setJobGroup(name, "")
        try:
            return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    df = spark.range(2000).selectExpr("id", "id % 7 + 0.0D AS x", "id * 2.0D AS y").repartition(4).persist()
    df.count()
    # One aggregate, a shuffle with its result, gives the sizes and with them the offsets.
    folded, n = jobs("folds", lambda: assign_folds(df, "id", 5))
    assert n <= 2
    assert Counter(r["fold"] for r in folded.collect()) == {f: 400 for f in range(5)}
    folded = folded.persist()
    folded.count()
    scores, n = jobs("scores", lambda: score_linear(folded, ["x"], "y", "fold", linear_models()))
    assert n <= 4 and len(scores) == 15
