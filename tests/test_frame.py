import functools
import random

import pytest
from pyspark.sql import DataFrame

from cohortloom.catalog import Feature
from cohortloom.functions.numeric import round_half_even, to_double
from cohortloom.functions.recode import in_thousands, recode
from cohortloom.operators.frame import complete_cases, join_features, keep_ids, keyed_join, union_common, within
from cohortloom.sources.release import nan_to_null


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def frames(spark):
    rng = random.Random(3)

    def make(name, n):
        data = [(rng.choice([None, *range(12)]), rng.random()) for _ in range(n)]
        return spark.createDataFrame(data, f"id int, {name} double")

    return [make("a", 20), make("b", 15), make("c", 10)]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_outer_join_equals_chained_full_outer_joins(frames, n):
    """With repeated keys, missing keys and null keys."""
    chosen = frames[:n]
    expected = functools.reduce(lambda a, b: a.join(b, "id", "full_outer"), chosen)
    assert rows(keyed_join(chosen, "id", "outer")) == rows(expected)


@pytest.mark.parametrize("how", ["inner", "left", "right"])
def test_other_joins_equal_the_plain_chain(frames, how):
    expected = functools.reduce(lambda a, b: a.join(b, "id", how), frames)
    assert rows(keyed_join(frames, "id", how)) == rows(expected)


def test_empty_instrument_joins(spark, frames):
    empty = spark.createDataFrame([], "id int, z double")
    assert keyed_join([frames[0], empty], "id", "outer").count() == frames[0].count()
    assert keyed_join([frames[0], empty], "id", "inner").count() == 0


def test_complete_cases_of_outer_join_plan_as_inner_join(spark, tmp_path):
    paths = []
    for i, c in enumerate("abc"):
        path = str(tmp_path / c)
        spark.range(50).selectExpr(f"id * {i + 1} AS id", f"CAST(id AS DOUBLE) AS {c}").write.parquet(path)
        paths.append(path)
    joined = complete_cases(keyed_join([spark.read.parquet(p) for p in paths], "id"), ["a", "b", "c"])
    text = plan(joined)
    assert "FullOuter" not in text and "Union" not in text and "Aggregate" not in text
    assert "PushedFilters: [IsNotNull(a)" in text


def test_join_rejects_unusable_requests(spark, frames):
    with pytest.raises(ValueError, match="empty"):
        join_features({}, [], "id")
    with pytest.raises(ValueError, match="not loaded"):
        join_features({"A": frames[0]}, [Feature("B", "x")], "id")
    with pytest.raises(ValueError, match="unsupported join kind"):
        keyed_join(frames, "id", "cross")
    with pytest.raises(ValueError, match="more than one table"):
        keyed_join([frames[0], frames[0]], "id")


def test_range_filter_rejects_missing_and_nan(spark):
    df = spark.createDataFrame([(1, 4.0), (2, 18.0), (3, None), (4, float("nan")), (5, 3.9)], "id int, age double")
    assert [r["id"] for r in within(df, {"age": (4, 18)}).orderBy("id").collect()] == [1, 2]
    assert [r["id"] for r in within(df, {}, {"age": 4}).collect()] == [5]
    assert complete_cases(df).count() == 3
    assert nan_to_null(df).filter("age IS NULL").count() == 2


def test_keep_ids_ignores_repeats(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    ids = spark.createDataFrame([(2,), (2,), (9,)], "id int")
    assert rows(keep_ids(df, ids, "id")) == [(2,)]


def test_union_common_keeps_duplicates_and_first_order(spark):
    a = spark.createDataFrame([(1, "x", 5)], "id int, only_a string, v int")
    b = spark.createDataFrame([(7, 1, "y")], "v int, id int, only_b string")
    out = union_common([a, b])
    assert out.columns == ["id", "v"] and rows(out) == [(1, 5), (1, 7)]
    with pytest.raises(ValueError):
        union_common([a.select("only_a"), b.select("only_b")])


def test_recode_maps_text_only_and_null_wins(spark):
    df = spark.createDataFrame([("1", 1, "-"), ("other", 2, "a"), (None, 3, "b")], "t string, n int, u string")
    out = recode(df, [(["t", "n", "u"], {"1": 2, "2": 9, "-": None, "a": 0})])
    assert rows(out) == rows(df.sparkSession.createDataFrame([("2", 1, None), ("other", 2, "0"), (None, 3, "b")], "t string, n int, u string"))


def test_recode_is_simultaneous(spark):
    df = spark.createDataFrame([("1",), ("2",)], "t string")
    assert rows(recode(df, [(["t"], {"1": 2, "2": 1})])) == [("1",), ("2",)]


def test_cast_raises_on_text_unless_lenient(spark):
    df = spark.createDataFrame([(1, "1.5", True), (2, "x", False)], "id int, t string, b boolean")
    assert rows(to_double(df, "id", lenient=True)) == [(1, 1.5, 1.0), (2, None, 0.0)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        to_double(df, "id").collect()


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-0.5,), (None,)], "x double")
    assert [r["x"] for r in round_half_even(df, ["x"]).collect()] == [0.0, 2.0, 2.0, 0.0, None]


def test_thousands_match_binary_rounding(spark):
    ns = [150, 250, 350, 1250, 17251, 150000, 1234567, 0]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    assert [r[0] for r in df.select(in_thousands(df.n)).collect()] == [f"{n / 1000:.1f}" for n in ns]


def test_helpers_return_frames(frames):
    assert isinstance(keyed_join(frames, "id"), DataFrame)


def test_more_frames_than_a_mask_has_bits(spark):
    """Outer joins and pair counts of seventy frames."""
    from cohortloom.operators.profile import pair_counts

    frames = [spark.createDataFrame([(i % 3, i), (7, -i)], f"id long, c{i} long") for i in range(70)]
    rows = {r["id"]: r for r in keyed_join(frames[60:70], "id").collect()}
    assert set(rows) == {0, 1, 2, 7} and rows[7]["c69"] == -69 and rows[0]["c69"] == 69 and rows[0]["c67"] is None
    from cohortloom.operators import frame as own

    held = {r["id"]: r for r in own._membership(frames, "id").collect()}
    assert held[7]["_mask0"] == 2**62 - 1 and held[7]["_mask1"] == 2**8 - 1 and held[0]["_mask1"] == sum(1 << (i - 62) for i in range(62, 70) if i % 3 == 0)
    named = {f"I{i}": f.select("id") for i, f in enumerate(frames)}
    counts = {(r["question_inst"], r["score_inst"]): r["n"] for r in pair_counts(named, "id", {k: named[k] for k in ("I1", "I68")}).collect()}
    assert counts["I69", "I68"] == 1 and counts["I65", "I68"] == 2 and counts["I0", "I1"] == 1 and len(counts) == 138
