"""The given tables seen as instruments keyed by subject, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.catalog import Catalog, Instrument
from cohortloom.cohort import Cohort

KEY = "subject"
PRIORITIES = {"p1": "1-URGENT", "p2": "2-HIGH", "p3": "3-MEDIUM", "p4": "4-NOT SPECIFIED", "p5": "5-LOW"}
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
LINE_GROUPS = {"q_af": ("A", "F"), "q_ao": ("A", "O"), "q_nf": ("N", "F"), "q_no": ("N", "O"), "q_rf": ("R", "F"), "q_ro": ("R", "O")}
DIMS = 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr(
        f"c_custkey AS {KEY}", "c_nationkey AS nationkey", "c_mktsegment AS segment", "c_acctbal AS acctbal"
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = [F.expr(f"sum(CASE WHEN o_orderpriority = '{v}' THEN o_totalprice END) AS {c}") for c, v in PRIORITIES.items()]
    return read(spark, sf_dir, "orders").groupBy(F.expr(f"o_custkey AS {KEY}")).agg(*sums, F.expr("sum(o_totalprice) AS total"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", f"o_custkey AS {KEY}")
    sums = [
        F.expr(f"sum(CASE WHEN l_returnflag = '{f}' AND l_linestatus = '{s}' THEN l_quantity END) AS {c}")
        for c, (f, s) in LINE_GROUPS.items()
    ]
    means = [F.expr("avg(l_discount) AS discount"), F.expr("avg(l_tax) AS tax"), F.expr("sum(l_extendedprice) AS extended")]
    return read(spark, sf_dir, "lineitem").join(owners, "l_orderkey").groupBy(KEY).agg(*sums, *means)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = [F.expr(f"sum(CASE WHEN event_type = '{t}' THEN value END) AS e_{t}") for t in EVENT_TYPES]
    return read(spark, sf_dir, "events").groupBy(F.expr(f"user_id AS {KEY}")).agg(*sums, F.expr("sum(value) AS total_value"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(read(spark, sf_dir, "labels"), "doc_id", "left").withColumnRenamed("doc_id", KEY)


def vectors(spark: SparkSession, sf_dir: str, dims: int = DIMS) -> DataFrame:
    return read(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "label", *[f"CAST(embedding[{i}] AS DOUBLE) AS d{i}" for i in range(dims)]
    )


INSTRUMENTS = (
    Instrument("profile", "customer", ("nationkey",), None, "acctbal"),
    Instrument("orders", "orders", tuple(PRIORITIES), None, "total"),
    Instrument("lines", "lineitem", tuple(LINE_GROUPS), ("discount", "tax"), "extended"),
    Instrument("events", "events", tuple(f"e_{t}" for t in EVENT_TYPES), None, "total_value"),
    Instrument("docs", "documents"),
)


def catalog() -> Catalog:
    return Catalog(INSTRUMENTS, KEY)


def cohort(spark: SparkSession, sf_dir: str) -> Cohort:
    tables = {
        "PROFILE": profile(spark, sf_dir),
        "ORDERS": orders(spark, sf_dir),
        "LINES": lines(spark, sf_dir),
        "EVENTS": events(spark, sf_dir),
        "DOCS": documents(spark, sf_dir),
    }
    return Cohort(catalog(), tables)


# The same instruments as SQL common table expressions.
PROFILE_SQL = "profile AS (SELECT c_custkey AS subject, c_nationkey AS nationkey, c_mktsegment AS segment, c_acctbal AS acctbal FROM customer)"
ORDERS_SQL = (
    "ords AS (SELECT o_custkey AS subject, "
    + ", ".join(f"sum(CASE WHEN o_orderpriority = '{v}' THEN o_totalprice END) AS {c}" for c, v in PRIORITIES.items())
    + ", sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)"
)
LINES_SQL = (
    "lins AS (SELECT o_custkey AS subject, "
    + ", ".join(
        f"sum(CASE WHEN l_returnflag = '{f}' AND l_linestatus = '{s}' THEN l_quantity END) AS {c}"
        for c, (f, s) in LINE_GROUPS.items()
    )
    + ", avg(l_discount) AS discount, avg(l_tax) AS tax, sum(l_extendedprice) AS extended"
    " FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey)"
)
EVENTS_SQL = (
    "evts AS (SELECT user_id AS subject, "
    + ", ".join(f"sum(CASE WHEN event_type = '{t}' THEN value END) AS e_{t}" for t in EVENT_TYPES)
    + ", sum(value) AS total_value FROM events GROUP BY user_id)"
)
DOCS_SQL = (
    "docs AS (SELECT d.doc_id AS subject, lang, source, n_chars, quality, toxic"
    " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)
ALL_SQL = ", ".join([PROFILE_SQL, ORDERS_SQL, LINES_SQL, EVENTS_SQL, DOCS_SQL])
CTE = {"PROFILE": "profile", "ORDERS": "ords", "LINES": "lins", "EVENTS": "evts", "DOCS": "docs"}
COLUMNS = {
    "PROFILE": ["nationkey", "segment", "acctbal"],
    "ORDERS": [*PRIORITIES, "total"],
    "LINES": [*LINE_GROUPS, "discount", "tax", "extended"],
    "EVENTS": [*[f"e_{t}" for t in EVENT_TYPES], "total_value"],
    "DOCS": ["lang", "source", "n_chars", "quality", "toxic"],
}


def vectors_sql(dims: int = DIMS) -> str:
    cols = ", ".join(f"embedding[{i + 1}]::DOUBLE AS d{i}" for i in range(dims))
    return f"vecs AS (SELECT vec_id, label, {cols} FROM embeddings)"


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Round columns for comparison; adding zero removes negative zeros."""
    chosen = set(cols)
    return df.selectExpr(*[f"round(`{c}`, {digits}) + 0.0D AS `{c}`" if c in chosen else f"`{c}`" for c in df.columns])
