"""Catalog lookups, sources and sinks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.catalog import Feature, feature_table, features_from_columns
from cohortloom.cohort import Cohort, read_and_join
from cohortloom.operators.profile import missing_profile
from cohortloom.sources.release import clean_ids, instrument_path, read_csv, read_id_list, read_release, release_date
from cohortloom.sources.store import (
    ensure_checkpoint_dir,
    materialize,
    read_matrices,
    write_matrices,
)
from registry.base import query
from registry.tables import ALL_SQL, COLUMNS, CTE, EVENTS_SQL, KEY, ORDERS_SQL, PROFILE_SQL, catalog, cohort, profile, read, rounded

CODES = ("PROFILE", "ORDERS", "LINES", "EVENTS", "DOCS")


def scratch(spark, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _present_sql(codes) -> str:
    return " UNION ALL ".join(
        f"SELECT '{code}' AS inst_code, '{c}' AS source_col, count({c}) AS n_present FROM {CTE[code]}"
        for code in codes
        for c in COLUMNS[code]
    )


def _present(c: Cohort, codes) -> DataFrame:
    parts = [
        missing_profile(c.tables[code], COLUMNS[code]).select(
            F.lit(code).alias("inst_code"), F.col("column").alias("source_col"),
            (F.col("n_rows") - F.col("n_missing")).alias("n_present"),
        )
        for code in codes
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "feature_catalog", "C1 C2 X1 X3",
    f"WITH {ALL_SQL}, present AS ({_present_sql(CODES)}) SELECT inst_code, source_col,"
    " inst_code || '_' || source_col AS col, upper(inst_code || '_' || source_col) AS feature, n_present FROM present",
)
def feature_catalog(spark, sf):
    c = cohort(spark, sf)
    features = feature_table(spark, c.tables, KEY).drop("type")
    return features.join(_present(c, CODES), ["inst_code", "source_col"])


@query(
    "features_per_instrument", "C1",
    f"WITH {ALL_SQL}, present AS ({_present_sql(CODES)}) SELECT inst_code, count(*) AS n_features,"
    " sum(n_present)::BIGINT AS n_values FROM present GROUP BY inst_code",
)
def features_per_instrument(spark, sf):
    return feature_catalog(spark, sf).groupBy("inst_code").agg(
        F.count(F.lit(1)).alias("n_features"), F.sum("n_present").alias("n_values")
    )


ROLES_SQL = """
    ('PROFILE', 'question', 'nationkey'), ('PROFILE', 'subscale', NULL), ('PROFILE', 'final_score', 'acctbal'),
    ('ORDERS', 'question', 'p1'), ('ORDERS', 'question', 'p2'), ('ORDERS', 'question', 'p3'), ('ORDERS', 'question', 'p4'),
    ('ORDERS', 'question', 'p5'), ('ORDERS', 'subscale', NULL), ('ORDERS', 'final_score', 'total'),
    ('LINES', 'question', 'q_af'), ('LINES', 'question', 'q_ao'), ('LINES', 'question', 'q_nf'), ('LINES', 'question', 'q_no'),
    ('LINES', 'question', 'q_rf'), ('LINES', 'question', 'q_ro'), ('LINES', 'subscale', 'discount'), ('LINES', 'subscale', 'tax'),
    ('LINES', 'final_score', 'extended'),
    ('EVENTS', 'question', 'e_click'), ('EVENTS', 'question', 'e_error'), ('EVENTS', 'question', 'e_purchase'),
    ('EVENTS', 'question', 'e_signup'), ('EVENTS', 'question', 'e_view'), ('EVENTS', 'subscale', NULL), ('EVENTS', 'final_score', 'total_value'),
    ('DOCS', 'question', NULL), ('DOCS', 'subscale', NULL), ('DOCS', 'final_score', NULL)
"""


@query(
    "instrument_roles", "C3",
    f"WITH {ALL_SQL}, present AS ({_present_sql(CODES)}), roles(code, role, source_col) AS (VALUES {ROLES_SQL})"
    " SELECT r.code, r.role, r.source_col, p.n_present FROM roles r"
    " LEFT JOIN present p ON p.inst_code = r.code AND p.source_col = r.source_col",
)
def instrument_roles(spark, sf):
    c = cohort(spark, sf)
    present = _present(c, CODES).withColumnRenamed("inst_code", "code")
    return c.catalog.roles_df(spark).join(present, ["code", "source_col"], "left")


@query(
    "instrument_lookup", "C4",
    f"WITH {ALL_SQL} SELECT 'ORDERS' AS code, 'orders' AS path, count(*) AS n_subjects FROM ords",
)
def instrument_lookup(spark, sf):
    c = cohort(spark, sf)
    found = c.instrument("orders")
    return c.tables[found.code].agg(F.count(F.lit(1)).alias("n_subjects")).select(
        F.lit(found.code).alias("code"), F.lit(found.path).alias("path"), "n_subjects"
    )


FEATURE_SETS = {"questions": ("ORDERS", "EVENTS", "PROFILE"), "final_score": ("ORDERS", "EVENTS", "PROFILE")}


SET_SQL = {
    "questions": [
        ("ORDERS_p1", "p1", "ords"), ("ORDERS_p2", "p2", "ords"), ("ORDERS_p3", "p3", "ords"), ("ORDERS_p4", "p4", "ords"),
        ("ORDERS_p5", "p5", "ords"), ("EVENTS_e_click", "e_click", "evts"), ("EVENTS_e_error", "e_error", "evts"),
        ("EVENTS_e_purchase", "e_purchase", "evts"), ("EVENTS_e_signup", "e_signup", "evts"), ("EVENTS_e_view", "e_view", "evts"),
        ("PROFILE_nationkey", "nationkey", "profile"),
    ],
    "final_score": [("ORDERS_total", "total", "ords"), ("EVENTS_total_value", "total_value", "evts"), ("PROFILE_acctbal", "acctbal", "profile")],
}


def _set_sql(name: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS position, '{col}' AS col, count({source}) AS n_present FROM {table}" for i, (col, source, table) in enumerate(SET_SQL[name])
    )


def _feature_set(name):
    def run(spark, sf):
        c = cohort(spark, sf)
        feats = c.catalog.feature_set(name, FEATURE_SETS[name])
        listed = spark.createDataFrame(
            [(i, f.inst_code, f.source_col, f.col) for i, f in enumerate(feats)],
            "position int, inst_code string, source_col string, col string",
        )
        return listed.join(_present(c, FEATURE_SETS[name]), ["inst_code", "source_col"]).select("position", "col", "n_present")

    return run


for _name in FEATURE_SETS:
    query(f"feature_set_{_name}", "C5", f"WITH {ALL_SQL} {_set_sql(_name)}")(_feature_set(_name))


CURATED = [("LINES", "q_af"), ("LINES", "q_ro"), ("LINES", "tax"), ("ORDERS", "p2"), ("EVENTS", "e_click"), ("PROFILE", "segment")]


@query(
    "curated_feature_list", "C6 P4",
    f"WITH {ALL_SQL} SELECT subject, round(l.q_af, 4) AS \"LINES_q_af\", round(l.q_ro, 4) AS \"LINES_q_ro\","
    " round(l.tax, 6) AS \"LINES_tax\", round(o.p2, 4) AS \"ORDERS_p2\", round(e.e_click, 4) AS \"EVENTS_e_click\","
    " p.segment AS \"PROFILE_segment\" FROM lins l FULL JOIN ords o USING (subject) FULL JOIN evts e USING (subject)"
    " FULL JOIN profile p USING (subject)",
)
def curated_feature_list(spark, sf):
    df = cohort(spark, sf).join([Feature(i, c) for i, c in CURATED])
    return rounded(rounded(df, 4, "LINES_q_af", "LINES_q_ro", "ORDERS_p2", "EVENTS_e_click"), 6, "LINES_tax")


@query(
    "features_from_schema", "C7",
    f"WITH {ALL_SQL}, present AS ({_present_sql(['ORDERS', 'EVENTS'])}) SELECT upper(inst_code || '_' || source_col) AS feature,"
    " n_present FROM present WHERE source_col <> 'total'",
)
def features_from_schema(spark, sf):
    c = cohort(spark, sf)
    feats = features_from_columns("ORDERS", c.tables["ORDERS"].columns, KEY, taken=["total"])
    feats += features_from_columns("EVENTS", c.tables["EVENTS"].columns, KEY)
    listed = spark.createDataFrame([(f.inst_code, f.source_col, f.name) for f in feats], "inst_code string, source_col string, feature string")
    return listed.join(_present(c, ["ORDERS", "EVENTS"]), ["inst_code", "source_col"]).select("feature", "n_present")


@query(
    "release_paths", "S1 X2",
    "SELECT url, regexp_extract(url, '[^/]*$') AS tail, reverse(split_part(reverse(url), '_', 1)) AS release_date,"
    " 'ados/module_1-' || reverse(split_part(reverse(url), '_', 1)) || '.csv' AS file FROM pages",
)
def release_paths(spark, sf):
    date = F.substring_index("url", "_", -1)
    return read(spark, sf, "pages").select(
        "url",
        F.element_at(F.split("url", "/"), -1).alias("tail"),
        date.alias("release_date"),
        F.concat(F.lit("ados/module_1-"), date, F.lit(".csv")).alias("file"),
    )


def _written_release(spark, sf) -> str:
    """The instruments written as a dated CSV release."""
    directory = f"{scratch(spark, 'release')}_2024-01-01"
    c = cohort(spark, sf)
    for code in ("PROFILE", "ORDERS", "EVENTS"):
        path = instrument_path(directory, c.instrument(code).path)
        c.tables[code].write.option("header", True).csv(path)
    assert release_date(directory) == "2024-01-01"
    return directory


SCHEMAS = {
    "PROFILE": T.StructType([T.StructField(KEY, T.LongType()), T.StructField("nationkey", T.IntegerType()),
                             T.StructField("segment", T.StringType()), T.StructField("acctbal", T.DoubleType())]),
}


@query(
    "csv_scan", "S1 S2",
    f"WITH {PROFILE_SQL} SELECT subject, nationkey, segment, acctbal FROM profile",
)
def csv_scan(spark, sf):
    directory = _written_release(spark, sf)
    return read_release(spark, directory, catalog(), ["profile"], SCHEMAS)["PROFILE"]


def _quoted_csv(spark, df: DataFrame, name: str) -> DataFrame:
    """Write a frame as CSV with every cell in quotes and read it back without a schema."""
    path = f"{scratch(spark, name)}.csv"
    df.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read_csv(spark, path, KEY, multi_line=True)


@query(
    "csv_quotes", "S2",
    "SELECT CAST(doc_id AS VARCHAR) AS subject, doc_id || ', \"' || text || '\", end' AS said, n_chars FROM documents",
)
def csv_quotes(spark, sf):
    docs = read(spark, sf, "documents")
    said = F.concat(F.col("doc_id").cast("string"), F.lit(', "'), "text", F.lit('", end'))
    return _quoted_csv(spark, docs.select(F.col("doc_id").alias(KEY), said.alias("said"), "n_chars"), "quotes")


_FORMS_SQL = {
    "yes": "CASE WHEN o_orderkey % 2 = 0 THEN 'y' ELSE 'n' END",
    "truth": "CASE WHEN o_orderkey % 2 = 0 THEN 't' ELSE 'f' END",
    "suffix": "CAST(o_orderkey % 9 AS VARCHAR) || 'd'",
    "flag": "CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'False' END",
    "whole": "CAST(o_custkey AS VARCHAR)",
    "real": "CAST(o_orderkey % 9 AS VARCHAR) || '.5e1'",
}
_KINDS = {"yes": "string", "truth": "string", "suffix": "string", "flag": "boolean", "whole": "bigint", "real": "double"}


@query(
    "csv_types", "S2",
    " UNION ALL ".join(f"SELECT '{c}' AS name, '{_KINDS[c]}' AS kind, count(DISTINCT {sql}) AS n FROM orders" for c, sql in _FORMS_SQL.items()),
)
def csv_types(spark, sf):
    cells = {c: sql.replace("VARCHAR", "STRING") for c, sql in _FORMS_SQL.items()}
    frame = read(spark, sf, "orders").selectExpr(f"o_orderkey AS {KEY}", *[f"{sql} AS {c}" for c, sql in cells.items()])
    back = _quoted_csv(spark, frame, "types")
    kinds = dict(back.dtypes)
    parts = [back.agg(F.countDistinct(c).alias("n")).select(F.lit(c).alias("name"), F.lit(kinds[c]).alias("kind"), "n") for c in cells]
    return reduce(DataFrame.unionByName, parts)


@query(
    "load_instruments", "S3 S4",
    f"WITH {ALL_SQL} SELECT 'PROFILE' AS code, count(*) AS n FROM profile UNION ALL SELECT 'ORDERS', count(*) FROM ords"
    " UNION ALL SELECT 'EVENTS', count(*) FROM evts",
)
def load_instruments(spark, sf):
    directory = _written_release(spark, sf)
    c = Cohort.read(spark, directory, catalog(), ["profile", "orders", "events"])
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(code).alias("code"), "n") for code, df in c.tables.items()]
    return reduce(DataFrame.unionByName, parts)


@query(
    "load_and_join", "J4 S4",
    f"WITH {ALL_SQL} SELECT CAST(subject AS VARCHAR) AS subject, acctbal AS \"PROFILE_acctbal\","
    " round(total_value, 4) AS \"EVENTS_total_value\" FROM profile FULL JOIN evts USING (subject)",
)
def load_and_join(spark, sf):
    directory = _written_release(spark, sf)
    features = [Feature("PROFILE", "acctbal"), Feature("EVENTS", "total_value")]
    _, df, _ = read_and_join(spark, directory, catalog(), features)
    return rounded(df, 4, "EVENTS_total_value")


@query(
    "id_list", "S5 U2 X4",
    "SELECT DISTINCT trim(CAST(user_id AS VARCHAR)) AS subject FROM events WHERE event_id % 3 <> 0",
)
def id_list(spark, sf):
    path = scratch(spark, "ids")
    ids = read(spark, sf, "events").select(
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("  "), F.col("user_id").cast("string"), F.lit(" "))).otherwise("   ").alias("value")
    )
    ids.write.text(path)
    return read_id_list(spark, path, KEY)


@query(
    "clean_text_ids", "X4 U2",
    "SELECT DISTINCT trim(role) AS subject FROM conversations WHERE length(trim(role)) > 0",
)
def clean_text_ids(spark, sf):
    return clean_ids(read(spark, sf, "conversations"), "role", KEY)


@query(
    "result_table_roundtrip", "K1 S6",
    f"WITH {ORDERS_SQL} SELECT subject, round(total, 4) AS total FROM ords",
)
def result_table_roundtrip(spark, sf):
    path = scratch(spark, "result")
    rounded(cohort(spark, sf).tables["ORDERS"].select(KEY, "total"), 4, "total").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query(
    "matrices_roundtrip", "K2 S7",
    "SELECT l_returnflag AS model, l_linestatus AS score_inst, l_linenumber AS question_inst, round(avg(l_discount), 8) AS r2_mean"
    " FROM lineitem GROUP BY 1, 2, 3",
)
def matrices_roundtrip(spark, sf):
    tidy = read(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("score_inst"), F.col("l_linenumber").alias("question_inst")
    ).agg(F.avg("l_discount").alias("r2_mean"))
    path = scratch(spark, "matrices")
    write_matrices(rounded(tidy, 8, "r2_mean"), path)
    return read_matrices(spark, path)


@query(
    "compute_or_load", "K3",
    f"WITH {EVENTS_SQL} SELECT subject, round(total_value, 4) AS total_value, 2 AS n_loads FROM evts",
)
def compute_or_load(spark, sf):
    root = scratch(spark, "cache")
    params = {"sf": sf, "column": "total_value"}
    build = lambda: rounded(cohort(spark, sf).tables["EVENTS"].select(KEY, "total_value"), 4, "total_value")
    materialize(spark, build, root, "events", params)

    def never():
        raise AssertionError("the second load must read the stored result")

    return materialize(spark, never, root, "events", params).withColumn("n_loads", F.lit(2))


@query("model_roundtrip", "K4")
def model_roundtrip(spark, sf):
    from pyspark.ml.clustering import KMeansModel

    from cohortloom.operators.cluster import assemble, fit_kmeans, label_all
    from cohortloom.sources.store import save_model
    from registry.tables import DIMS, vectors

    features = assemble(vectors(spark, sf), [f"d{i}" for i in range(DIMS)])
    path = scratch(spark, "model")
    save_model(fit_kmeans(features, 3, seed=1), path)
    labelled = label_all(features, [KMeansModel.load(path)])
    return labelled.groupBy(F.col("labels")[0].alias("label")).agg(F.count(F.lit(1)).alias("n"))
