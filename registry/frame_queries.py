"""Projections, filters, joins and set operations."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from cohortloom.catalog import Feature
from cohortloom.functions.numeric import round_half_even, to_double
from cohortloom.operators.frame import (
    complete_cases,
    group_by_instrument,
    keep_ids,
    keyed_join,
    prefix_columns,
    project,
    union_common,
    within,
)
from cohortloom.operators.profile import prune_missing
from cohortloom.plans.predictability import pair_frame
from registry.base import query
from registry.tables import (
    ALL_SQL,
    COLUMNS,
    EVENTS_SQL,
    KEY,
    LINES_SQL,
    ORDERS_SQL,
    PROFILE_SQL,
    catalog,
    cohort,
    events,
    orders,
    profile,
    read,
    rounded,
)

F_ = Feature


@query("project_features", "P1", f"WITH {PROFILE_SQL} SELECT subject, acctbal, segment FROM profile")
def project_features(spark, sf):
    return project(profile(spark, sf), KEY, ["acctbal", "segment"])


@query(
    "qualified_names", "P2 C2",
    f"WITH {PROFILE_SQL} SELECT subject, acctbal AS \"PROFILE_acctbal\", segment AS \"PROFILE_segment\" FROM profile",
)
def qualified_names(spark, sf):
    return cohort(spark, sf).join([F_("PROFILE", "acctbal"), F_("PROFILE", "segment")])


@query("source_names", "P2", f"WITH {PROFILE_SQL} SELECT subject, acctbal, segment FROM profile")
def source_names(spark, sf):
    return cohort(spark, sf).join([F_("PROFILE", "acctbal"), F_("PROFILE", "segment")], rename=False)


@query(
    "prefixed_columns", "P3",
    f"WITH {PROFILE_SQL} SELECT subject, nationkey AS \"BHC_nationkey\", segment AS \"BHC_segment\", acctbal AS \"BHC_acctbal\" FROM profile",
)
def prefixed_columns(spark, sf):
    return prefix_columns(profile(spark, sf), KEY, "BHC_")


@query(
    "features_grouped_by_instrument", "P4 U3",
    f"WITH {ALL_SQL} SELECT 0 AS position, 'EVENTS' AS inst_code, 2 AS n_features, count(*) AS n_rows FROM evts"
    " UNION ALL SELECT 1, 'PROFILE', 1, count(*) FROM profile",
)
def features_grouped_by_instrument(spark, sf):
    c = cohort(spark, sf)
    wanted = [F_("EVENTS", "e_click"), F_("PROFILE", "acctbal"), F_("EVENTS", "e_view"), F_("EVENTS", "e_click")]
    out = None
    for i, (code, group) in enumerate(group_by_instrument(wanted).items()):
        part = c.tables[code].agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(i).alias("position"), F.lit(code).alias("inst_code"), F.lit(len(group)).alias("n_features"), "n_rows"
        )
        out = part if out is None else out.unionAll(part)
    return out


@query("drop_columns", "P5", f"WITH {PROFILE_SQL} SELECT subject, segment FROM profile")
def drop_columns(spark, sf):
    return profile(spark, sf).drop("nationkey", "acctbal")


@query(
    "features_and_target", "P6",
    f"WITH {ORDERS_SQL} SELECT subject, round(p1 + 2 * p2 + 3 * p3 + 4 * p4 + 5 * p5, 3) AS weighted, round(total, 4) AS target"
    " FROM ords WHERE p1 IS NOT NULL AND p2 IS NOT NULL AND p3 IS NOT NULL AND p4 IS NOT NULL AND p5 IS NOT NULL",
)
def features_and_target(spark, sf):
    from pyspark.ml.functions import vector_to_array

    from cohortloom.operators.cluster import assemble

    cols = COLUMNS["ORDERS"][:-1]
    assembled = assemble(complete_cases(orders(spark, sf)), cols)
    x = vector_to_array("features")
    weighted = sum(((i + 1) * x[i] for i in range(1, len(cols))), x[0])
    return rounded(rounded(assembled.select(KEY, weighted.alias("weighted"), F.col("total").alias("target")), 3, "weighted"), 4, "target")


@query(
    "indicators_and_covariates", "P7",
    f"WITH {PROFILE_SQL}, {EVENTS_SQL} SELECT subject, nationkey AS covariate, round(e_click + e_view, 4) AS indicator_sum"
    " FROM profile JOIN evts USING (subject)",
)
def indicators_and_covariates(spark, sf):
    df = keyed_join([profile(spark, sf), events(spark, sf)], KEY, "inner")
    return rounded(
        df.select(KEY, F.col("nationkey").alias("covariate"), (F.col("e_click") + F.col("e_view")).alias("indicator_sum")),
        4, "indicator_sum",
    )


@query(
    "cast_to_double", "P8",
    "SELECT doc_id AS subject, CAST(n_chars AS DOUBLE) AS n_chars, CAST(CAST(n_chars AS VARCHAR) AS DOUBLE) AS from_text,"
    " CAST(n_chars > 500 AS DOUBLE) AS from_boolean FROM documents",
)
def cast_to_double(spark, sf):
    df = read(spark, sf, "documents").select(
        F.col("doc_id").alias(KEY), "n_chars", F.col("n_chars").cast("string").alias("from_text"), (F.col("n_chars") > 500).alias("from_boolean")
    )
    return to_double(df, KEY)


@query(
    "lenient_cast", "P8",
    "SELECT o_orderkey AS subject, TRY_CAST(CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE CAST(o_orderkey AS VARCHAR) END AS DOUBLE) AS code FROM orders",
)
def lenient_cast(spark, sf):
    df = read(spark, sf, "orders").select(
        F.col("o_orderkey").alias(KEY),
        F.when(F.col("o_orderkey") % 5 == 0, "-").otherwise(F.col("o_orderkey").cast("string")).alias("code"),
    )
    return to_double(df, KEY, lenient=True)


@query(
    "round_half_even", "P9",
    "SELECT l_orderkey, l_linenumber, round_even(l_quantity / 2.0, 0) + 0.0 AS half, round_even(l_extendedprice, 0) + 0.0 AS price FROM lineitem",
)
def rounding(spark, sf):
    df = read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") / 2.0).alias("half"), F.col("l_extendedprice").alias("price")
    )
    return round_half_even(df, ["half", "price"])


@query("range_filter", "F1", f"WITH {PROFILE_SQL} SELECT * FROM profile WHERE nationkey BETWEEN 4 AND 18")
def range_filter(spark, sf):
    return within(profile(spark, sf), {"nationkey": (4, 18)})


@query(
    "conjunctive_filter", "F2 J1",
    f"WITH {PROFILE_SQL}, {EVENTS_SQL} SELECT subject, nationkey AS \"PROFILE_nationkey\", acctbal AS \"PROFILE_acctbal\","
    " round(e_click, 4) AS \"EVENTS_e_click\", round(e_view, 4) AS \"EVENTS_e_view\" FROM profile FULL JOIN evts USING (subject)"
    " WHERE nationkey BETWEEN 4 AND 18 AND acctbal < 5000 AND e_click BETWEEN 10 AND 100000 AND e_view < 900",
)
def conjunctive_filter(spark, sf):
    df = cohort(spark, sf).join([F_("PROFILE", "nationkey"), F_("PROFILE", "acctbal"), F_("EVENTS", "e_click"), F_("EVENTS", "e_view")])
    kept = within(
        df, {"PROFILE_nationkey": (4, 18), "EVENTS_e_click": (10, 100000)}, {"PROFILE_acctbal": 5000, "EVENTS_e_view": 900}
    )
    return rounded(kept, 4, "EVENTS_e_click", "EVENTS_e_view")


@query(
    "id_membership", "F3 J6",
    f"WITH {PROFILE_SQL} SELECT * FROM profile WHERE subject IN (SELECT user_id FROM events WHERE value > 20)",
)
def id_membership(spark, sf):
    ids = read(spark, sf, "events").filter(F.col("value") > 20).select(F.col("user_id").alias(KEY))
    return keep_ids(profile(spark, sf), ids, KEY)


FINAL = ["PROFILE_acctbal", "ORDERS_total", "EVENTS_total_value"]
FINAL_SQL = (
    f"WITH {PROFILE_SQL}, {ORDERS_SQL}, {EVENTS_SQL} SELECT subject, acctbal AS \"PROFILE_acctbal\","
    " round(total, 4) AS \"ORDERS_total\", round(total_value, 4) AS \"EVENTS_total_value\""
    " FROM profile {how} ords USING (subject) {how} evts USING (subject)"
)


def final_features():
    return catalog().feature_set("final_score", ["PROFILE", "ORDERS", "EVENTS"])


@query(
    "complete_final_scores", "F4 J1 J4",
    FINAL_SQL.replace("{how}", "FULL JOIN") + " WHERE acctbal IS NOT NULL AND total IS NOT NULL AND total_value IS NOT NULL",
)
def complete_final_scores(spark, sf):
    df = complete_cases(cohort(spark, sf).join(final_features()), FINAL)
    return rounded(df, 4, "ORDERS_total", "EVENTS_total_value")


@query(
    "prune_missing_columns", "F5 A1",
    f"WITH {ORDERS_SQL}, {EVENTS_SQL}, {PROFILE_SQL}, wide AS (SELECT * FROM profile FULL JOIN ords USING (subject) FULL JOIN evts USING (subject)), shares AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", 1 - count({c}) / count(*)::DOUBLE AS s FROM wide"
        for code in ("PROFILE", "ORDERS", "EVENTS") for c in COLUMNS[code]
    )
    + ") SELECT \"column\" FROM shares WHERE s < 0.15",
)
def prune_missing_columns(spark, sf):
    c = cohort(spark, sf)
    df = keyed_join([c.tables[x] for x in ("PROFILE", "ORDERS", "EVENTS")], KEY)
    _, kept = prune_missing(df, [x for x in df.columns if x != KEY], 0.15)
    return spark.createDataFrame([(x,) for x in kept], "column string")


CAT_ROWS = "('PROFILE', true, true), ('ORDERS', true, true), ('LINES', true, true), ('EVENTS', true, true), ('DOCS', false, false)"


@query(
    "valid_instrument_pairs", "F6 J7",
    f"WITH {ALL_SQL}, cat(code, has_questions, has_score) AS (VALUES {CAT_ROWS}), sizes AS ("
    "SELECT 'PROFILE' AS code, count(*) AS n FROM profile UNION ALL SELECT 'ORDERS', count(*) FROM ords UNION ALL"
    " SELECT 'LINES', count(*) FROM lins UNION ALL SELECT 'EVENTS', count(*) FROM evts)"
    " SELECT x.code AS question_inst, y.code AS score_inst, n AS n_question_rows FROM cat x CROSS JOIN cat y JOIN sizes s ON s.code = x.code"
    " WHERE x.code <> y.code AND x.has_questions AND y.has_score",
)
def valid_instrument_pairs(spark, sf):
    c = cohort(spark, sf)
    pairs = spark.createDataFrame([(x.code, y.code) for x, y in c.catalog.score_pairs()], "question_inst string, score_inst string")
    sizes = None
    for code in ("PROFILE", "ORDERS", "LINES", "EVENTS"):
        part = c.tables[code].agg(F.count(F.lit(1)).alias("n_question_rows")).withColumn("question_inst", F.lit(code))
        sizes = part if sizes is None else sizes.unionByName(part)
    return pairs.join(sizes, "question_inst")


@query("outer_join", "J1", FINAL_SQL.replace("{how}", "FULL JOIN"))
def outer_join(spark, sf):
    return rounded(cohort(spark, sf).join(final_features()), 4, "ORDERS_total", "EVENTS_total_value")


@query("inner_join", "J2", FINAL_SQL.replace("{how}", "JOIN"))
def inner_join(spark, sf):
    return rounded(cohort(spark, sf).join(final_features(), "inner"), 4, "ORDERS_total", "EVENTS_total_value")


@query("left_join", "J3", FINAL_SQL.replace("{how}", "LEFT JOIN"))
def left_join(spark, sf):
    return rounded(cohort(spark, sf).join(final_features(), "left"), 4, "ORDERS_total", "EVENTS_total_value")


@query("right_join", "J3", FINAL_SQL.replace("{how}", "RIGHT JOIN"))
def right_join(spark, sf):
    return rounded(cohort(spark, sf).join(final_features(), "right"), 4, "ORDERS_total", "EVENTS_total_value")


STACKED_SQL = (
    "stacked AS (SELECT c_custkey AS subject, c_nationkey AS nationkey, c_acctbal AS balance FROM customer WHERE c_nationkey BETWEEN 4 AND 18"
    " UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey BETWEEN 4 AND 18)"
)


def stacked(spark, sf):
    child = read(spark, sf, "customer").select(
        F.col("c_custkey").alias(KEY), F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")
    )
    sibling = read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias(KEY), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name")
    )
    return union_common([within(child, {"nationkey": (4, 18)}), within(sibling, {"nationkey": (4, 18)})])


@query("union_common_columns", "U1", f"WITH {STACKED_SQL} SELECT subject, nationkey, balance FROM stacked")
def union_common_columns(spark, sf):
    return stacked(spark, sf)


@query(
    "left_join_with_repeats", "J5 U1 P3",
    f"WITH {STACKED_SQL}, {ORDERS_SQL} SELECT subject, round(total, 4) AS total, nationkey AS \"BHC_nationkey\", balance AS \"BHC_balance\""
    " FROM ords LEFT JOIN stacked USING (subject)",
)
def left_join_with_repeats(spark, sf):
    history = prefix_columns(stacked(spark, sf), KEY, "BHC_")
    return rounded(keyed_join([orders(spark, sf).select(KEY, "total"), history], KEY, "left"), 4, "total")


@query(
    "pair_frame", "J8",
    f"WITH {EVENTS_SQL}, {PROFILE_SQL} SELECT subject, "
    + ", ".join(f"round({c}, 4) AS \"EVENTS_{c}\"" for c in COLUMNS["EVENTS"][:-1])
    + ", acctbal AS \"PROFILE_acctbal\" FROM evts JOIN profile USING (subject) WHERE acctbal IS NOT NULL AND "
    + " AND ".join(f"{c} IS NOT NULL" for c in COLUMNS["EVENTS"][:-1]),
)
def pair(spark, sf):
    c = cohort(spark, sf)
    df, questions, _ = pair_frame(c, c.instrument("EVENTS"), c.instrument("PROFILE"))
    return rounded(df, 4, *questions)


@query(
    "distinct_ids", "U2",
    "SELECT DISTINCT user_id AS subject FROM events",
)
def distinct_ids(spark, sf):
    return read(spark, sf, "events").select(F.col("user_id").alias(KEY)).distinct()


@query(
    "distinct_instrument_codes", "U3",
    "SELECT DISTINCT upper(event_type) AS inst_code FROM events",
)
def distinct_instrument_codes(spark, sf):
    return read(spark, sf, "events").select(F.upper("event_type").alias("inst_code")).distinct()
