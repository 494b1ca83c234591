"""Recode maps and label functions over codes derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import fixed_values as fixed
from cohortloom.functions.recode import display_label, in_thousands, metric_label, recode
from registry.base import query
from registry.tables import read

MAPS = {
    "lives_with_v2": ("R1 R2 R3", fixed.LIVES_WITH_V2),
    "parental_education": ("R1 R4", fixed.EDUCATION),
    "lives_with": ("R1 R2 R5", fixed.LIVES_WITH),
    "income_band": ("R1 R6", fixed.INCOME),
    "handedness": ("R1 R7", fixed.HAND),
    "social_competence": ("R1 R8", fixed.SOCIAL_COMPETENCE),
    "gender": ("R1 R9", fixed.GENDER),
    "multiple_birth": ("R1 R9", fixed.MULTIPLE_BIRTH),
    "school_grade": ("R1 R9", fixed.GRADE),
    "sex": ("R1 R9", fixed.SEX),
}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _codes(mapping) -> list[str]:
    """The codes of a map and one that it does not know."""
    return [*mapping, "unlisted_code"]


def _sql(mapping) -> str:
    codes = _codes(mapping)
    listed = "[" + ", ".join(_quote(c) for c in codes) + "]"
    cases = " ".join(f"WHEN {_quote(k)} THEN {'NULL' if v is None else _quote(str(v))}" for k, v in mapping.items())
    return (
        f"WITH t AS (SELECT l_linenumber AS item, ({listed})[(l_orderkey % {len(codes)}) + 1] AS code FROM lineitem)"
        f" SELECT item, CASE code {cases} ELSE code END AS value, count(*) AS n FROM t GROUP BY 1, 2"
    )


def _recode(mapping):
    def run(spark, sf):
        codes = F.array(*[F.lit(c) for c in _codes(mapping)])
        df = read(spark, sf, "lineitem").select(
            F.col("l_linenumber").alias("item"),
            F.get(codes, (F.col("l_orderkey") % len(_codes(mapping))).cast("int")).alias("value"),
        )
        # The numeric item column is listed too: numbers never match a text code.
        return recode(df, [(["value", "item"], mapping)]).groupBy("item", "value").agg(F.count(F.lit(1)).alias("n"))

    return run


for _name, (_covers, _mapping) in MAPS.items():
    query(f"recode_{_name}", _covers, _sql(_mapping))(_recode(_mapping))


@query(
    "recode_column_groups", "R1",
    "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '0' WHEN '2-HIGH' THEN '1' ELSE o_orderpriority END AS o_orderpriority,"
    " CASE o_orderstatus WHEN 'P' THEN '2' WHEN '2-HIGH' THEN '1' WHEN 'F' THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders",
)
def recode_column_groups(spark, sf):
    df = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return recode(
        df,
        [
            (["o_orderpriority"], {"1-URGENT": 0, "2-HIGH": 1}),
            (["o_orderstatus"], {"P": 2, "2-HIGH": 1, "F": None}),
        ],
    )


@query("upper_case", "X1", "SELECT doc_id, upper(lang) AS code, upper(source) AS source FROM documents")
def upper_case(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.upper("lang").alias("code"), F.upper("source").alias("source"))


@query(
    "split_take_last", "X2",
    "SELECT n_nationkey, reverse(split_part(reverse(n_name), '_', 1)) AS last_part, c.n AS n_customers FROM nation"
    " LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c.c_nationkey = n_nationkey",
)
def split_take_last(spark, sf):
    counts = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_customers"))
    return read(spark, sf, "nation").select("n_nationkey", F.substring_index("n_name", "_", -1).alias("last_part")).join(counts, "n_nationkey", "left")


@query(
    "concat_format", "X3",
    "SELECT c_custkey, c_mktsegment || '_' || c_name AS col, printf('%s-%s.csv', c_mktsegment, CAST(c_nationkey AS VARCHAR)) AS file FROM customer",
)
def concat_format(spark, sf):
    return read(spark, sf, "customer").select(
        "c_custkey",
        F.concat_ws("_", "c_mktsegment", "c_name").alias("col"),
        F.format_string("%s-%s.csv", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("file"),
    )


@query(
    "trim_and_blank_test", "X4",
    "SELECT conv_id, turn, trim(text) AS text, length(trim(text)) = 0 AS is_blank FROM conversations",
)
def trim_and_blank_test(spark, sf):
    return read(spark, sf, "conversations").select(
        "conv_id", "turn", F.trim("text").alias("text"), (F.length(F.trim("text")) == 0).alias("is_blank")
    )


@query(
    "metric_labels", "X5",
    "WITH t AS (SELECT lower(p_type) || '_' || replace(p_name, ' ', '_') AS metric FROM part)"
    " SELECT metric, list_aggregate(list_transform(string_split(replace(metric, '_', ' '), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), 'string_agg', ' ') AS label,"
    " count(*) AS n FROM t GROUP BY 1, 2",
)
def metric_labels(spark, sf):
    metric = F.concat(F.lower("p_type"), F.lit("_"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
    df = read(spark, sf, "part").select(metric.alias("metric"))
    return df.select("metric", metric_label(F.col("metric")).alias("label")).groupBy("metric", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "display_labels", "X6",
    "SELECT CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'Deutsch' ELSE lang END AS label, count(*) AS n FROM documents GROUP BY 1",
)
def display_labels(spark, sf):
    df = read(spark, sf, "documents").select(display_label(F.col("lang"), {"en": "English", "de": "Deutsch"}).alias("label"))
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "thousands_format", "X7",
    "SELECT o_orderpriority, printf('%.1f', count(*) / 1000.0) AS thousands FROM orders GROUP BY 1",
)
def thousands_format(spark, sf):
    return read(spark, sf, "orders").groupBy("o_orderpriority").agg(in_thousands(F.count(F.lit(1))).alias("thousands"))
