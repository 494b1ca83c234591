import pytest

from cohortloom.catalog import Catalog, Feature, Instrument, features_from_columns
from cohortloom.release_catalog import preparation_features, release_catalog


def test_feature_names():
    f = Feature("CBCL_6_18", "q001_acts_young")
    assert f.col == "CBCL_6_18_q001_acts_young"
    assert f.name == "CBCL_6_18_Q001_ACTS_YOUNG"


def test_lookup_ignores_case_and_rejects_unknown():
    catalog = release_catalog()
    assert catalog.from_code("srs_2_da").code == "SRS_2_DA"
    assert len(catalog.codes) == 31
    with pytest.raises(ValueError, match="unknown instrument"):
        catalog.from_code("nope")


def test_roles_come_from_column_names():
    columns = ["subject_sp_id", "q01_a", "q56_b", "q056a_c", "final_score", "quality", "q1_short"]
    resolved = release_catalog().resolved({"SCQ": columns})
    assert resolved.from_code("scq").questions == ("q01_a", "q56_b", "q056a_c")
    assert resolved.from_code("rbsr").question_features is None
    assert resolved.from_code("adi").final_score_feature is None


def test_preparation_lists_follow_the_rule():
    resolved = release_catalog().resolved({"SCQ": ["q01_a", "q02_b"], "RBSR": ["q01_c"], "CBCL_6_18": ["q001_d"]})
    lists = preparation_features(resolved)
    scq = [f.source_col for f in lists["SCQ"]]
    assert scq == ["missing_values", "sex", "asd", "age_at_eval_years", "q02_b", "final_score"]
    assert [f.source_col for f in lists["BHC"]] == [f.source_col for f in lists["BHS"]]
    assert len(lists["BHC"]) == 28


def test_preparation_lists_have_their_lengths():
    """A release table has 40, 43 and 119 question columns for these three."""
    columns = {
        "SCQ": [f"q{i:02d}_x" for i in range(1, 41)],
        "RBSR": [f"q{i:02d}_x" for i in range(1, 44)],
        "CBCL_6_18": [*(f"q{i:03d}_x" for i in range(1, 119)), "q056_h_other"],
    }
    lists = preparation_features(release_catalog().resolved(columns))
    assert {code: len(features) for code, features in lists.items()} == {"SCQ": 44, "RBSR": 51, "CBCL_6_18": 144, "BHC": 28, "BHS": 28}


def test_plain_instruments_keep_the_order_of_a_release():
    codes = release_catalog().codes
    assert codes[:6] == ["DCDQ", "RBSR", "SCQ", "CBCL_6_18", "CBCL_1_5", "BMS"] and codes[-1] == "ADOS_2_4"


def test_feature_sets_and_pairs():
    catalog = Catalog(
        [Instrument("a", "a", ("q1", "q2"), None, "s"), Instrument("b", "b", ("q3",), None, None), Instrument("c", "c", None, None, "t")],
        "id",
    )
    assert [f.col for f in catalog.feature_set("questions", ["b", "a"])] == ["B_q3", "A_q1", "A_q2"]
    assert [f.col for f in catalog.feature_set("final_score", ["a", "b", "c"])] == ["A_s", "C_t"]
    with pytest.raises(ValueError, match="unknown feature set"):
        catalog.feature_set(".", ["a"])
    pairs = [(x.code, y.code) for x, y in catalog.score_pairs()]
    assert pairs == [("A", "C"), ("B", "A"), ("B", "C")]


def test_features_from_columns_leave_out_key_and_taken():
    feats = features_from_columns("BHC", ["id", "asd", "age"], "id", taken=["asd"])
    assert [f.name for f in feats] == ["BHC_AGE"]


def test_roles_table_keeps_instruments_without_roles(spark):
    catalog = Catalog([Instrument("a", "a", ("q1",), None, "s"), Instrument("b", "b")], "id")
    rows = {tuple(r) for r in catalog.roles_df(spark).collect()}
    assert ("A", "question", "q1") in rows and ("A", "subscale", None) in rows and ("B", "final_score", None) in rows
