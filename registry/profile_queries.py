"""Missing-value profiles, column kinds, counts, sampling, folds and bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.numeric import round_half_even
from cohortloom.operators.frame import complete_cases, keyed_join
from cohortloom.operators.mixture import Descriptor
from cohortloom.operators.profile import (
    class_shares,
    cohort_summary,
    column_kinds,
    frame_shape,
    kept_by_threshold,
    matrix,
    missing_profile,
    overlap_share,
    pair_counts,
)
from cohortloom.operators.resample import (
    assign_folds,
    bootstrap_interval,
    bootstrap_means,
    exact_sample,
    hash_folds,
    mean_std,
    t_interval,
)
from cohortloom.operators.scale import standardize
from registry.base import query
from registry.tables import (
    ALL_SQL,
    COLUMNS,
    CTE,
    DOCS_SQL,
    EVENTS_SQL,
    KEY,
    LINES_SQL,
    ORDERS_SQL,
    PROFILE_SQL,
    cohort,
    documents,
    events,
    lines,
    orders,
    profile,
    read,
    rounded,
    vectors,
    vectors_sql,
)

WIDE_CODES = ("PROFILE", "ORDERS", "LINES", "EVENTS")
WIDE_COLUMNS = [c for code in WIDE_CODES for c in COLUMNS[code]]
WIDE_SQL = (
    f"{PROFILE_SQL}, {ORDERS_SQL}, {LINES_SQL}, {EVENTS_SQL}, wide AS (SELECT * FROM profile FULL JOIN ords USING (subject)"
    " FULL JOIN lins USING (subject) FULL JOIN evts USING (subject))"
)
SHARES_SQL = "shares AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_missing,"
    f" (count(*) - count({c})) / count(*)::DOUBLE AS missing_share FROM wide"
    for c in WIDE_COLUMNS
) + ")"


def wide(spark, sf):
    return keyed_join([profile(spark, sf), orders(spark, sf), lines(spark, sf), events(spark, sf)], KEY)


@query("missing_profile", "A1", f"WITH {WIDE_SQL}, {SHARES_SQL} SELECT \"column\", n_rows, n_missing, round(missing_share, 10) AS missing_share FROM shares")
def missing(spark, sf):
    return rounded(missing_profile(wide(spark, sf), WIDE_COLUMNS), 10, "missing_share")


@query(
    "kept_by_threshold", "A12 F5",
    f"WITH {WIDE_SQL}, {SHARES_SQL} SELECT t.threshold, count_if(missing_share < t.threshold) AS n_kept FROM shares,"
    " (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.3::DOUBLE), (0.95::DOUBLE)) t(threshold) GROUP BY 1",
)
def thresholds(spark, sf):
    return kept_by_threshold(wide(spark, sf), WIDE_COLUMNS, [0.05, 0.1, 0.3, 0.95])


@query("frame_shape", "A2", f"WITH {WIDE_SQL} SELECT count(*) AS n_rows, {len(WIDE_COLUMNS) + 1} AS n_columns FROM wide")
def shape(spark, sf):
    return frame_shape(wide(spark, sf))


# Columns of every kind: two-valued, few-valued, many-valued, all null.
KIND_EXPRS = {
    "quality": "quality", "toxic": "toxic", "n_chars": "n_chars", "decade": "n_chars % 10", "eleven": "n_chars % 11",
    "half": "CASE WHEN n_chars % 2 = 0 THEN 0 ELSE 0.5 END", "zero": "n_chars * 0", "empty": "CAST(NULL AS DOUBLE)",
}


def kind_frame(spark, sf):
    return documents(spark, sf).selectExpr(*[f"CAST({e} AS DOUBLE) AS {c}" for c, e in KIND_EXPRS.items()])


KINDS_SQL = (
    f"{DOCS_SQL}, mixed AS (SELECT " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in KIND_EXPRS.items()) + " FROM docs), kinds AS ("
    + " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", CASE WHEN coalesce(bool_and({c} IN (0, 1)), true) THEN 'binary'"
        f" WHEN count(DISTINCT {c}) <= 10 THEN 'categorical' ELSE 'continuous' END AS kind, count(DISTINCT {c}) AS n FROM mixed"
        for i, c in enumerate(KIND_EXPRS)
    )
    + ")"
)


@query(
    "column_kinds", "A3",
    f"WITH {KINDS_SQL} SELECT position, \"column\", kind, CASE kind WHEN 'binary' THEN 2 WHEN 'categorical' THEN n END AS n_levels FROM kinds",
)
def kinds(spark, sf):
    return column_kinds(kind_frame(spark, sf), list(KIND_EXPRS)).drop("levels")


@query(
    "mixed_descriptor", "A4",
    f"WITH {KINDS_SQL} SELECT \"column\", kind, CASE kind WHEN 'binary' THEN 2 WHEN 'categorical' THEN n END AS n_levels FROM kinds",
)
def descriptor(spark, sf):
    return Descriptor.from_kinds(column_kinds(kind_frame(spark, sf), list(KIND_EXPRS))).to_df(spark)


@query(
    "number_of_parameters", "L8",
    f"WITH {KINDS_SQL} SELECT k, (k * sum(CASE kind WHEN 'binary' THEN 1 WHEN 'continuous' THEN 2 ELSE n - 1 END) + (k - 1))::BIGINT AS n_parameters"
    " FROM kinds, range(2, 10) t(k) GROUP BY k",
)
def number_of_parameters(spark, sf):
    d = Descriptor.from_kinds(column_kinds(kind_frame(spark, sf), list(KIND_EXPRS)))
    return spark.createDataFrame([(k, d.n_parameters(k)) for k in range(2, 10)], "k long, n_parameters long")


@query(
    "mean_and_std_over_repeats", "A5",
    "SELECT l_linenumber AS k, round(avg(l_quantity), 6) AS mean_quantity, round(avg(l_extendedprice), 4) AS mean_price,"
    " round(stddev_pop(l_quantity), 6) AS std_quantity, round(stddev_pop(l_extendedprice), 4) AS std_price FROM lineitem GROUP BY 1",
)
def repeats(spark, sf):
    trials = read(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price")
    )
    return rounded(rounded(mean_std(trials, "k", ["quantity", "price"]), 6, "mean_quantity", "std_quantity"), 4, "mean_price", "std_price")


def _complete(code: str) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in COLUMNS[code][:-1])


SCORE_COLUMN = {"PROFILE": "acctbal", "ORDERS": "total", "EVENTS": "total_value"}
QUESTION_SQL = {"PROFILE": "nationkey IS NOT NULL", "ORDERS": _complete("ORDERS"), "EVENTS": _complete("EVENTS")}
COUNT_PAIRS = [(x, y) for x in QUESTION_SQL for y in QUESTION_SQL if x != y]
PAIR_COUNTS_SQL = f"{ALL_SQL}, counts AS (" + " UNION ALL ".join(
    f"SELECT '{x}' AS question_inst, '{y}' AS score_inst, count(*) AS n FROM {CTE[x]} a JOIN {CTE[y]} b USING (subject)"
    f" WHERE b.{SCORE_COLUMN[y]} IS NOT NULL AND {QUESTION_SQL[x].replace('nationkey', 'a.nationkey')}"
    for x, y in COUNT_PAIRS
) + ")"


def counts_of_pairs(spark, sf):
    c = cohort(spark, sf)
    questions = {x: complete_cases(c.tables[x], c.instrument(x).questions) for x in QUESTION_SQL}
    scores = {x: complete_cases(c.tables[x], [SCORE_COLUMN[x]]) for x in QUESTION_SQL}
    return pair_counts(questions, KEY, scores)


@query("subject_counts_per_pair", "A6", f"WITH {PAIR_COUNTS_SQL} SELECT * FROM counts")
def subject_counts(spark, sf):
    return counts_of_pairs(spark, sf)


@query(
    "subject_count_matrix", "A6 A11",
    f"WITH {PAIR_COUNTS_SQL} SELECT question_inst, "
    + ", ".join(f"coalesce(max(CASE WHEN score_inst = '{c}' THEN n END), 0) AS \"{c}\"" for c in QUESTION_SQL)
    + " FROM counts GROUP BY question_inst",
)
def subject_count_matrix(spark, sf):
    return matrix(counts_of_pairs(spark, sf), ["question_inst"], "score_inst", list(QUESTION_SQL), "n")


@query(
    "subject_count_cells", "G10 X6 X7",
    f"WITH {PAIR_COUNTS_SQL} SELECT question_inst AS question, score_inst AS score, n, printf('%.1f', n / 1000.0) AS thousands,"
    " n > (SELECT max(n) FROM counts) / 2.0 AS light_text FROM counts",
)
def subject_count_cells(spark, sf):
    from cohortloom.plans.predictability import count_cells

    return count_cells(counts_of_pairs(spark, sf))


@query(
    "r2_matrix", "G10 A11",
    "WITH t AS (SELECT l_returnflag AS model, l_linenumber % 3 AS q, (l_linenumber + 1) % 3 AS s, avg(l_discount) AS r FROM lineitem GROUP BY 1, 2, 3)"
    " SELECT model, 'I' || q AS question_inst, "
    + ", ".join(f"round(coalesce(max(CASE WHEN s = {i} THEN r END), 0), 8) AS \"I{i}\"" for i in range(3))
    + " FROM t GROUP BY 1, 2",
)
def r2_matrix(spark, sf):
    from cohortloom.plans.predictability import r2_matrices

    tidy = read(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("model"),
        F.concat(F.lit("I"), F.col("l_linenumber") % 3).alias("question_inst"),
        F.concat(F.lit("I"), (F.col("l_linenumber") + 1) % 3).alias("score_inst"),
    ).agg(F.avg("l_discount").alias("r2_mean"))
    return rounded(r2_matrices(tidy, ["I0", "I1", "I2"]), 8, "I0", "I1", "I2")


@query(
    "cohort_summary", "A8",
    f"WITH {PROFILE_SQL} SELECT segment, count(*) AS n_subjects, round(count(*) / sum(count(*)) OVER (), 10) AS share, 3 AS n_features FROM profile GROUP BY segment",
)
def summary(spark, sf):
    return rounded(cohort_summary(profile(spark, sf), "segment", 3), 10, "share")


@query(
    "class_shares", "A9",
    "SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 10) AS share FROM embeddings GROUP BY label",
)
def shares(spark, sf):
    return rounded(class_shares(read(spark, sf, "embeddings"), "label"), 10, "share")


@query(
    "overlap_share", "A10",
    "SELECT count(*) AS n_ids, count(u) AS n_found, round(count(u) / count(*), 10) AS share_found FROM (SELECT DISTINCT c_custkey FROM customer)"
    " LEFT JOIN (SELECT DISTINCT user_id AS u FROM events) ON c_custkey = u",
)
def overlap(spark, sf):
    ids = read(spark, sf, "customer").select(F.col("c_custkey").alias(KEY))
    other = read(spark, sf, "events").select(F.col("user_id").alias(KEY))
    return rounded(overlap_share(ids, other, KEY), 10, "share_found")


def folds_sql(table: str, key: str, k: int = 5, seed: int = 1) -> str:
    return f"(row_number() OVER (ORDER BY md5('{seed}:' || {key})) - 1) % {k}"


@query(
    "exact_sample", "B1",
    "SELECT c_custkey, c_name FROM customer ORDER BY md5('1:' || c_custkey) LIMIT (SELECT round_even(0.37 * count(*), 0)::BIGINT FROM customer)",
)
def sample(spark, sf):
    return exact_sample(read(spark, sf, "customer"), "c_custkey", 0.37, seed=1).select("c_custkey", "c_name")


@query("full_sample", "B1", "SELECT c_custkey, c_name FROM customer")
def full_sample(spark, sf):
    return exact_sample(read(spark, sf, "customer"), "c_custkey", 1.0).select("c_custkey", "c_name")


@query("exact_folds", "B2", f"SELECT o_orderkey, {folds_sql('orders', 'o_orderkey')} AS fold FROM orders")
def folds(spark, sf):
    return assign_folds(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5, seed=1)


@query("exact_folds_hot_key", "B2", f"SELECT user_id, {folds_sql('events', 'user_id')} AS fold FROM events")
def folds_hot_key(spark, sf):
    return assign_folds(read(spark, sf, "events").select("user_id"), "user_id", 5, seed=1)


@query(
    "hash_folds", "B2",
    "SELECT o_orderkey, ('0x' || substr(md5('1:' || o_orderkey), 1, 8))::BIGINT % 5 AS fold FROM orders",
)
def approximate_folds(spark, sf):
    return hash_folds(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5, seed=1)


# Five fold scores per model: average discount per return flag and order fold.
FOLD_SCORES_SQL = (
    "fold_scores AS (SELECT l_returnflag AS model, l_orderkey % 5 AS fold, avg(l_discount) AS r2 FROM lineitem GROUP BY 1, 2),"
    " numbered AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY fold) - 1 AS i, count(*) OVER (PARTITION BY model) AS n FROM fold_scores),"
    " boot AS (SELECT m.model, rep, avg(s.r2) AS boot_mean FROM (SELECT DISTINCT model, n FROM numbered) m, range(0, 1000) t(rep), range(0, 5) u(i)"
    " JOIN numbered s ON s.model = m.model AND s.i = ('0x' || substr(md5('1:' || t.rep || ':' || u.i), 1, 8))::BIGINT % m.n GROUP BY 1, 2)"
)


def fold_scores(spark, sf):
    return read(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("model"), (F.col("l_orderkey") % 5).cast("int").alias("fold")
    ).agg(F.avg("l_discount").alias("r2"))


@query("bootstrap_means", "B4", f"WITH {FOLD_SCORES_SQL} SELECT model, rep, round(boot_mean, 9) AS boot_mean FROM boot")
def boot_means(spark, sf):
    return rounded(bootstrap_means(fold_scores(spark, sf), ["model"], "fold", "r2", 1000, 1), 9, "boot_mean")


@query(
    "bootstrap_interval", "B5 A7",
    f"WITH {FOLD_SCORES_SQL} SELECT b.model, round(m.mean, 9) AS mean, round(quantile_cont(boot_mean, 0.025), 9) AS ci_low,"
    " round(quantile_cont(boot_mean, 0.975), 9) AS ci_high FROM boot b JOIN (SELECT model, avg(r2) AS mean FROM fold_scores GROUP BY 1) m USING (model)"
    " GROUP BY b.model, m.mean",
)
def boot_interval(spark, sf):
    return rounded(bootstrap_interval(fold_scores(spark, sf), ["model"], "fold", "r2", 1000, 1), 9, "mean", "ci_low", "ci_high")


@query(
    "student_t_interval", "B7",
    f"WITH {FOLD_SCORES_SQL} SELECT model, round(avg(r2), 9) AS mean, round(avg(r2) - 2.776445 * stddev_samp(r2) / sqrt(count(*)), 9) AS ci_low,"
    " round(avg(r2) + 2.776445 * stddev_samp(r2) / sqrt(count(*)), 9) AS ci_high FROM fold_scores GROUP BY model",
)
def student(spark, sf):
    return rounded(t_interval(fold_scores(spark, sf), ["model"], "r2"), 9, "mean", "ci_low", "ci_high")


@query(
    "standardized_columns", "M1",
    f"WITH {vectors_sql()}, s AS (SELECT vec_id, " + ", ".join(
        f"(d{i} - avg(d{i}) OVER ()) / stddev_pop(d{i}) OVER () AS d{i}" for i in range(64)
    ) + ", 0.0::DOUBLE AS constant FROM vecs) SELECT vec_id, constant, " + ", ".join(f"round(d{i}, 6) + 0.0 AS d{i}" for i in range(64)) + " FROM s",
)
def standardized(spark, sf):
    cols = [f"d{i}" for i in range(64)]
    df = vectors(spark, sf).drop("label").withColumn("constant", F.lit(7.5))
    return rounded(standardize(df, [*cols, "constant"]), 6, *cols)


@query(
    "rounded_wide_frame", "P8 P9 F4",
    f"WITH {WIDE_SQL} SELECT subject, " + ", ".join(f"round_even({c}, 0) + 0.0 AS {c}" for c in WIDE_COLUMNS if c not in ("segment", "discount", "tax"))
    + " FROM wide WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in WIDE_COLUMNS),
)
def rounded_wide(spark, sf):
    cols = [c for c in WIDE_COLUMNS if c not in ("segment", "discount", "tax")]
    df = complete_cases(wide(spark, sf), WIDE_COLUMNS).select(KEY, *[F.col(c).cast("double").alias(c) for c in cols])
    return round_half_even(df, cols)
