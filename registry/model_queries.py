"""Regression, predictability, cohort preparation and latent classes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cohortloom.catalog import Catalog, Instrument
from cohortloom.cohort import Cohort
from cohortloom.functions.recode import recode_column
from cohortloom.operators.frame import complete_cases, keyed_join
from cohortloom.operators.metrics import information_criteria, posterior_entropy
from cohortloom.operators.mixture import (
    Descriptor,
    MixtureFit,
    _Layout,
    assign_classes,
    fit_mixtures,
    mixture_metrics,
    parameter_table,
    score_fits,
)
from cohortloom.operators.profile import column_kinds
from cohortloom.operators.regress import Linear, cross_validate, linear_models, r2_score, score_linear, tree_models
from cohortloom.operators.resample import assign_folds
from cohortloom.operators.trees import BoostedTrees, Forest
from cohortloom.plans.latent import class_sweep, latent_class_job, optimal_k_job
from cohortloom.plans.predictability import fold_scores, predictability, regression_job
from cohortloom.plans.prepare import History, PrepareSpec, prepare, prepared_frame
from registry.base import query
from registry.catalog_queries import scratch
from registry.profile_queries import folds_sql
from registry.tables import (
    ALL_SQL,
    COLUMNS,
    CTE,
    EVENT_TYPES,
    EVENTS_SQL,
    KEY,
    LINE_GROUPS,
    LINES_SQL,
    ORDERS_SQL,
    PRIORITIES,
    PROFILE_SQL,
    cohort,
    documents,
    events,
    lines,
    orders,
    profile,
    read,
    rounded,
)

# One question, one score: quantity shipped predicts spending.
PAIR_SQL = (
    f"{ORDERS_SQL}, {LINES_SQL}, pair AS (SELECT subject, q_af AS x, total AS y FROM lins JOIN ords USING (subject) WHERE q_af IS NOT NULL AND total IS NOT NULL),"
    f" folded AS (SELECT *, {folds_sql('pair', 'subject')} AS fold FROM pair),"
    " sets AS (SELECT f.fold AS held, p.* FROM (SELECT DISTINCT fold FROM folded) f JOIN folded p ON p.fold <> f.fold),"
    " train AS (SELECT held AS fold, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, covar_pop(x, y) AS cxy, count(*) AS n FROM sets GROUP BY held)"
)


def pair(spark, sf):
    joined = keyed_join(
        [lines(spark, sf).select(KEY, F.col("q_af").alias("x")), orders(spark, sf).select(KEY, F.col("total").alias("y"))], KEY, "inner"
    )
    return assign_folds(complete_cases(joined), KEY, 5, seed=1)


def _scored_sql(slope: str) -> str:
    return (
        f"WITH {PAIR_SQL}, fit AS (SELECT fold, mx, my, {slope} AS slope FROM train)"
        " SELECT fold::INTEGER AS fold, round(1 - sum(power(y - (my + slope * (x - mx)), 2)) / (var_pop(y) * count(*)), 8) AS r2"
        " FROM folded JOIN fit USING (fold) GROUP BY fold"
    )


def _linear_scores(name):
    def run(spark, sf):
        rows = score_linear(pair(spark, sf).persist(), ["x"], "y", "fold", {name: linear_models()[name]})
        scores = spark.createDataFrame(rows, "model string, fold int, r2 double").drop("model")
        return rounded(scores, 8, "r2")

    return run


SLOPES = {
    "Linear": ("least_squares_scores", "G1 G7 B3", "cxy / (sx * sx)"),
    # Ridge and lasso act on the scaled column: n * cxy / sx against n + 1, and a soft threshold of 1.
    "Ridge": ("ridge_scores", "G2 G7 B3", "n * (cxy / sx) / (n + 1) / sx"),
    "Lasso": ("lasso_scores", "G3 G7 B3", "sign(cxy / sx) * greatest(abs(cxy / sx) - 1, 0) / sx"),
}
for _name, (_query, _covers, _slope) in SLOPES.items():
    query(_query, _covers, _scored_sql(_slope))(_linear_scores(_name))


@query(
    "r2_score", "G7",
    "SELECT l_returnflag, round(1 - sum(power(l_extendedprice - 1500 * l_quantity, 2)) / (var_pop(l_extendedprice) * count(*)), 8) AS r2 FROM lineitem GROUP BY 1",
)
def r2(spark, sf):
    df = read(spark, sf, "lineitem").withColumn("p", 1500 * F.col("l_quantity"))
    return rounded(r2_score(df, "l_extendedprice", "p", ["l_returnflag"]), 8, "r2")


def event_pair(spark, sf):
    joined = keyed_join([events(spark, sf), profile(spark, sf).select(KEY, "acctbal")], KEY, "inner")
    return assign_folds(complete_cases(joined), KEY, 5, seed=1).persist()


X_EVENTS = [f"e_{t}" for t in EVENT_TYPES]


@query("boosted_trees_scores", "G4 G6 B3")
def boosted(spark, sf):
    models = tree_models()
    return cross_validate(spark, event_pair(spark, sf), X_EVENTS, "acctbal", "fold", {"HistGBRT": models["HistGBRT"]})


@query("random_forest_scores", "G5 G6 B3")
def forest(spark, sf):
    models = tree_models()
    return cross_validate(spark, event_pair(spark, sf), X_EVENTS, "acctbal", "fold", {"Random Forest": models["Random Forest"]})


@query("model_registry_scores", "G8 G6 G1 G2 G3")
def registry_scores(spark, sf):
    from pyspark.ml.regression import LinearRegression

    models = {**linear_models(), "Own": LinearRegression(regParam=0.1), "Strong ridge": Linear("ridge", 50.0)}
    return cross_validate(spark, event_pair(spark, sf), X_EVENTS, "total_value", "fold", models)


# One discrete column: whole trees predict its group means, boosting comes as near to them as its rounds shrink the rest.
PRICE_SQL = (
    "pair AS (SELECT o_orderkey AS subject, substr(o_orderpriority, 1, 1)::DOUBLE AS x, o_totalprice::DOUBLE AS y FROM orders),"
    f" folded AS (SELECT *, {folds_sql('pair', 'subject')} AS fold FROM pair),"
    " sets AS (SELECT f.fold AS held, p.* FROM (SELECT DISTINCT fold FROM folded) f JOIN folded p ON p.fold <> f.fold),"
    " train AS (SELECT held AS fold, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, covar_pop(x, y) AS cxy, count(*) AS n FROM sets GROUP BY held),"
    " means AS (SELECT held AS fold, x, avg(y) AS mean FROM sets GROUP BY held, x)"
)
# One minus the part of a residual that a hundred rounds at a rate of a tenth leave.
_TREE_SHARE = {"HistGBRT": "1 - power(0.9::DOUBLE, 100)", "Random Forest": "1.0"}


def _price_scores_sql(model: str, prediction: str) -> str:
    return (
        f"SELECT '{model}' AS model, fold::INTEGER AS fold, round(1 - sum(power(y - ({prediction}), 2)) / (var_pop(y) * count(*)), 8) AS r2"
        " FROM folded JOIN train USING (fold) JOIN means USING (fold, x) GROUP BY fold"
    )


_PRICE_MODELS = {m: _price_scores_sql(m, f"my + ({share}) * (mean - my)") for m, share in _TREE_SHARE.items()}
_PRICE_MODELS |= {m: _price_scores_sql(m, f"my + ({slope}) * (x - mx)") for m, (_, _, slope) in SLOPES.items()}
_PRICE_MODELS["Estimator"] = _price_scores_sql("Estimator", f"my + ({SLOPES['Linear'][2]}) * (x - mx)")


def prices(spark, sf):
    df = read(spark, sf, "orders").selectExpr(f"o_orderkey AS {KEY}", "CAST(substring(o_orderpriority, 1, 1) AS DOUBLE) AS x", "CAST(o_totalprice AS DOUBLE) AS y")
    return assign_folds(df, KEY, 5, seed=1).persist()


# No rows are set aside, since SQL sees all of them; unit weights in place of drawn ones.
WHOLE_TREES = {"HistGBRT": BoostedTrees(early_stop_rows=2**62), "Random Forest": Forest(trees=10, bootstrap=False)}


@query("boosted_trees_group_means", "G4 B3", f"WITH {PRICE_SQL} {_PRICE_MODELS['HistGBRT']}")
def boosted_group_means(spark, sf):
    return rounded(cross_validate(spark, prices(spark, sf), ["x"], "y", "fold", {"HistGBRT": WHOLE_TREES["HistGBRT"]}), 8, "r2")


@query("random_forest_group_means", "G5 B3", f"WITH {PRICE_SQL} {_PRICE_MODELS['Random Forest']}")
def forest_group_means(spark, sf):
    return rounded(cross_validate(spark, prices(spark, sf), ["x"], "y", "fold", {"Random Forest": WHOLE_TREES["Random Forest"]}), 8, "r2")


@query("model_registry_one_column", "G8 G6 G1 G2 G3 G4 G5", f"WITH {PRICE_SQL} " + " UNION ALL ".join(_PRICE_MODELS.values()))
def registry_one_column(spark, sf):
    from pyspark.ml.regression import LinearRegression

    models = {**linear_models(), **WHOLE_TREES, "Estimator": LinearRegression(regParam=0.0, solver="normal")}
    return rounded(cross_validate(spark, prices(spark, sf), ["x"], "y", "fold", models), 8, "r2")


# Two columns: the normal equations of each fold in closed form.
TWO_SQL = (
    "pair AS (SELECT o_orderkey AS subject, substr(o_orderpriority, 1, 1)::DOUBLE AS u, (o_custkey % 10)::DOUBLE AS v, o_totalprice::DOUBLE AS y FROM orders),"
    f" folded AS (SELECT *, {folds_sql('pair', 'subject')} AS fold FROM pair),"
    " train AS (SELECT f.fold, avg(u) AS mu, avg(v) AS mv, avg(y) AS my, var_pop(u) AS suu, var_pop(v) AS svv, covar_pop(u, v) AS suv, covar_pop(u, y) AS suy, covar_pop(v, y) AS svy,"
    " count(*) AS n FROM (SELECT DISTINCT fold FROM folded) f JOIN folded p ON p.fold <> f.fold GROUP BY f.fold)"
)


def _two_sql(model: str, u: str, v: str) -> str:
    return (
        f"SELECT '{model}' AS model, fold::INTEGER AS fold, round(1 - sum(power(y - (my + ({u}) * (u - mu) + ({v}) * (v - mv)), 2)) / (var_pop(y) * count(*)), 8) AS r2"
        " FROM folded JOIN train USING (fold) GROUP BY fold"
    )


# Ridge acts on columns of unit variance, whose moments are n times their correlations.
_RUV, _RUY, _RVY = "n * suv / sqrt(suu * svv)", "n * suy / sqrt(suu)", "n * svy / sqrt(svv)"
_RIDGE_DET = f"((n + 1) * (n + 1) - ({_RUV}) * ({_RUV}))"
_TWO_MODELS = {
    "Linear": ("(suy * svv - svy * suv) / (suu * svv - suv * suv)", "(svy * suu - suy * suv) / (suu * svv - suv * suv)"),
    "Ridge": (f"(({_RUY}) * (n + 1) - ({_RVY}) * ({_RUV})) / {_RIDGE_DET} / sqrt(suu)", f"(({_RVY}) * (n + 1) - ({_RUY}) * ({_RUV})) / {_RIDGE_DET} / sqrt(svv)"),
}


@query("two_column_scores", "B3 G1 G2 G7", f"WITH {TWO_SQL} " + " UNION ALL ".join(_two_sql(m, u, v) for m, (u, v) in _TWO_MODELS.items()))
def two_columns(spark, sf):
    df = read(spark, sf, "orders").selectExpr(f"o_orderkey AS {KEY}", "CAST(substring(o_orderpriority, 1, 1) AS DOUBLE) AS u", "CAST(o_custkey % 10 AS DOUBLE) AS v", "CAST(o_totalprice AS DOUBLE) AS y")
    models = {m: linear_models()[m] for m in _TWO_MODELS}
    return rounded(cross_validate(spark, assign_folds(df, KEY, 5, seed=1).persist(), ["u", "v"], "y", "fold", models), 8, "r2")


# Predictability over instruments with one question each.
SINGLE = {"PROFILE": ("nationkey", "acctbal"), "ORDERS": ("p1", "total"), "LINES": ("q_af", "extended")}
SINGLE_PAIRS = [(x, y) for x in SINGLE for y in SINGLE if x != y]


def _single_pair_sql(x: str, y: str) -> str:
    q, s = SINGLE[x][0], SINGLE[y][1]
    return (
        f"(WITH pair AS (SELECT subject, a.{q} AS x, b.{s} AS y FROM {CTE[x]} a JOIN {CTE[y]} b USING (subject) WHERE a.{q} IS NOT NULL AND b.{s} IS NOT NULL),"
        f" folded AS (SELECT *, {folds_sql('pair', 'subject')} AS fold, count(*) OVER () AS n_all FROM pair),"
        " fit AS (SELECT f.fold, regr_slope(y, x) AS slope, regr_intercept(y, x) AS b0 FROM (SELECT DISTINCT fold FROM folded) f JOIN folded p ON p.fold <> f.fold GROUP BY f.fold)"
        f" SELECT '{x}' AS question_inst, '{y}' AS score_inst, fold, any_value(n_all) AS n, 1 - sum(power(y - (b0 + slope * x), 2)) / (var_pop(y) * count(*)) AS r2"
        " FROM folded JOIN fit USING (fold) GROUP BY fold)"
    )


SINGLE_SQL = f"{ALL_SQL}, scores AS (" + " UNION ALL ".join(_single_pair_sql(x, y) for x, y in SINGLE_PAIRS) + ")"


def single_question_cohort(spark, sf):
    full = cohort(spark, sf)
    cat = Catalog([Instrument(code, code.lower(), (q,), None, s) for code, (q, s) in SINGLE.items()], KEY)
    return Cohort(cat, {code: full.tables[code] for code in SINGLE})


@query("pair_fold_scores", "G9 B3", f"WITH {SINGLE_SQL} SELECT 'Linear' AS model, question_inst, score_inst, fold::INTEGER AS fold, round(r2, 7) + 0.0 AS r2, n FROM scores")
def pair_fold_scores(spark, sf):
    scores = fold_scores(single_question_cohort(spark, sf), list(SINGLE), {"Linear": Linear()})
    return rounded(scores, 7, "r2")


@query(
    "predictability_linear", "G9 B5",
    f"WITH {SINGLE_SQL}, numbered AS (SELECT *, row_number() OVER (PARTITION BY question_inst, score_inst ORDER BY fold) - 1 AS i FROM scores),"
    " boot AS (SELECT p.question_inst, p.score_inst, rep, avg(s.r2) AS m FROM (SELECT DISTINCT question_inst, score_inst FROM scores) p, range(0, 1000) t(rep), range(0, 5) u(j)"
    " JOIN numbered s ON s.question_inst = p.question_inst AND s.score_inst = p.score_inst AND s.i = ('0x' || substr(md5('1:' || t.rep || ':' || u.j), 1, 8))::BIGINT % 5 GROUP BY 1, 2, 3),"
    " means AS (SELECT question_inst, score_inst, avg(r2) AS r2_mean, max(n) AS n FROM scores GROUP BY 1, 2)"
    " SELECT 'Linear' AS model, question_inst, score_inst, n, round(r2_mean, 7) + 0.0 AS r2_mean, round(quantile_cont(m, 0.025), 7) + 0.0 AS ci_low, round(quantile_cont(m, 0.975), 7) + 0.0 AS ci_high"
    " FROM boot JOIN means USING (question_inst, score_inst) GROUP BY question_inst, score_inst, n, r2_mean",
)
def predictability_linear(spark, sf):
    out = predictability(single_question_cohort(spark, sf), list(SINGLE), {"Linear": Linear()})
    return rounded(out, 7, "r2_mean", "ci_low", "ci_high")


@query("predictability_matrix", "G9 G8 G1 G2 G3")
def predictability_matrix(spark, sf):
    return predictability(cohort(spark, sf), ["PROFILE", "ORDERS", "LINES", "EVENTS"], linear_models())


@query("regression_job", "G11 G10 K3 G4 G5")
def regression(spark, sf):
    tables = regression_job(cohort(spark, sf), ["PROFILE", "ORDERS", "LINES", "EVENTS"], scratch(spark, "regression"), sf)
    return tables["results"].join(
        tables["counts"].select(F.col("question").alias("question_inst"), F.col("score").alias("score_inst"), "thousands"),
        ["question_inst", "score_inst"],
    )


# Latent classes with fixed parameters: documents with two binary, one categorical, one continuous column, one covariate.
LANGS = {"de": 0, "en": 1, "es": 2, "fr": 3}
CLASS_SQL = (
    "d AS (SELECT doc_id AS subject, (n_chars % 2)::DOUBLE AS odd, (n_chars > 1000)::INTEGER::DOUBLE AS long,"
    " (CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 ELSE 3 END)::DOUBLE AS lang, n_chars / 1000.0::DOUBLE AS size,"
    " substr(source, 4)::DOUBLE AS source FROM documents)"
)


def class_frame(spark, sf):
    return read(spark, sf, "documents").select(
        F.col("doc_id").alias(KEY),
        (F.col("n_chars") % 2).cast("double").alias("odd"),
        (F.col("n_chars") > 1000).cast("double").alias("long"),
        recode_column(F.col("lang"), LANGS).cast("double").alias("lang"),
        (F.col("n_chars") / 1000.0).alias("size"),
        F.substring("source", 4, 4).cast("double").alias("source"),
    )


CLASS_D = Descriptor(("odd", "long"), ("size",), ("lang",), ((0.0, 1.0, 2.0, 3.0),), ("source",))
CLASS_FIT = MixtureFit(
    3, 0, 0,
    p_binary=np.array([[0.5, 0.9], [0.4, 0.2], [0.6, 0.6]]),
    mean=np.array([[4.0], [0.4], [2.0]]),
    variance=np.array([[9.0], [0.1], [1.5]]),
    p_levels=np.array([[0.1, 0.7, 0.1, 0.1], [0.2, 0.4, 0.2, 0.2], [0.25, 0.25, 0.25, 0.25]]),
    beta=np.array([[0.0, 0.0], [0.5, -0.02], [-0.3, 0.01]]),
    shares=np.array([0.5, 0.3, 0.2]),
)
CLASS_LAYOUT = _Layout(CLASS_D, np.zeros(1), np.zeros(1), np.ones(1))


def _class_sql() -> str:
    f = CLASS_FIT
    terms = []
    for c in range(3):
        odd, long = f.p_binary[c]
        langs = " ".join(f"WHEN {i} THEN {float(p)!r}::DOUBLE" for i, p in enumerate(f.p_levels[c]))
        terms.append(
            f"ln(CASE WHEN odd = 1 THEN {float(odd)!r}::DOUBLE ELSE 1 - {float(odd)!r}::DOUBLE END) + ln(CASE WHEN long = 1 THEN {float(long)!r}::DOUBLE ELSE 1 - {float(long)!r}::DOUBLE END)"
            f" + ln(CASE lang::INTEGER {langs} END) - 0.5 * (ln(2 * pi() * {float(f.variance[c][0])!r}::DOUBLE) + power(size - {float(f.mean[c][0])!r}::DOUBLE, 2) / {float(f.variance[c][0])!r}::DOUBLE) AS m{c}"
        )
    plain = ", ".join(f"m{c} + ln({float(f.shares[c])!r}::DOUBLE) AS j{c}" for c in range(3))
    z = [f"exp({float(b[0])!r}::DOUBLE + ({float(b[1])!r}::DOUBLE) * source)" for b in f.beta]
    cov = ", ".join(f"m{c} + ln({z[c]} / ({' + '.join(z)})) AS j{c}" for c in range(3))
    tail = (
        ", {n}_l AS (SELECT *, ln(exp(j0 - greatest(j0, j1, j2)) + exp(j1 - greatest(j0, j1, j2)) + exp(j2 - greatest(j0, j1, j2))) + greatest(j0, j1, j2) AS ll FROM {n})"
        ", {n}_p AS (SELECT *, exp(j0 - ll) AS p0, exp(j1 - ll) AS p1, exp(j2 - ll) AS p2 FROM {n}_l)"
    )
    return (
        f"{CLASS_SQL}, meas AS (SELECT *, {', '.join(terms)} FROM d), plain AS (SELECT subject, {plain} FROM meas), cov AS (SELECT subject, {cov} FROM meas)"
        + tail.replace("{n}", "plain") + tail.replace("{n}", "cov")
    )


FIXED_CLASS_SQL = _class_sql()


def _assigned(spark, sf, with_covariates):
    return assign_classes(class_frame(spark, sf), KEY, CLASS_LAYOUT, CLASS_FIT, with_covariates)


@query(
    "class_assignment", "L3",
    f"WITH {FIXED_CLASS_SQL} SELECT subject, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS label FROM plain_p",
)
def class_assignment(spark, sf):
    return _assigned(spark, sf, False).select(KEY, "label")


@query(
    "class_posteriors_with_covariates", "L1 P7",
    f"WITH {FIXED_CLASS_SQL} SELECT subject, round(p0, 8) AS p0, round(p1, 8) AS p1, round(p2, 8) AS p2, round(ll, 8) AS log_likelihood FROM cov_p",
)
def class_posteriors(spark, sf):
    p = F.col("probabilities")
    df = _assigned(spark, sf, True).select(KEY, *[p[i].alias(f"p{i}") for i in range(3)], "log_likelihood")
    return rounded(df, 8, "p0", "p1", "p2", "log_likelihood")


_N_PAR = CLASS_D.n_parameters(3)


@query(
    "class_information_criteria", "L4 L8",
    f"WITH {FIXED_CLASS_SQL} SELECT round(-2 * sum(ll) + 2 * {_N_PAR}, 6) AS aic, round(-2 * sum(ll) + {_N_PAR} * ln(count(*)), 6) AS bic,"
    f" round(-2 * sum(ll) + {_N_PAR} * (ln(count(*)) + 1), 6) AS caic FROM plain_p",
)
def class_criteria(spark, sf):
    totals = _assigned(spark, sf, False).agg(F.sum("log_likelihood").alias("ll"), F.count(F.lit(1)).alias("n"))
    criteria = information_criteria(F.col("ll"), F.lit(float(_N_PAR)), F.col("n"))
    return rounded(totals.select(*[c.alias(n) for n, c in criteria.items()]), 6, "aic", "bic", "caic")


@query(
    "class_entropy", "L5",
    f"WITH {FIXED_CLASS_SQL}, e AS (SELECT -sum(p0 * ln(greatest(p0, 1e-300)) + p1 * ln(greatest(p1, 1e-300)) + p2 * ln(greatest(p2, 1e-300))) AS entropy, count(*) AS n FROM plain_p)"
    " SELECT round(entropy, 6) AS entropy, round(1 - entropy / (n * ln(3)), 8) AS scaled_entropy FROM e",
)
def class_entropy(spark, sf):
    return rounded(rounded(posterior_entropy(_assigned(spark, sf, False), "probabilities", 3), 6, "entropy"), 8, "scaled_entropy")


@query(
    "class_lower_bound", "L6",
    f"WITH {FIXED_CLASS_SQL} SELECT round(avg(ll), 8) AS log_likelihood, count(*) AS n FROM cov_p",
)
def class_lower_bound(spark, sf):
    ll, _, n = score_fits(class_frame(spark, sf), CLASS_LAYOUT, [CLASS_FIT], with_covariates=True)[0]
    return rounded(spark.createDataFrame([(float(ll / n), int(n))], "log_likelihood double, n bigint"), 8, "log_likelihood")


@query("class_fit", "L1 A9")
def class_fit(spark, sf):
    df = class_frame(spark, sf).persist()
    fitted = fit_mixtures(df, KEY, CLASS_D, [3], restarts=20)
    labels = assign_classes(df, KEY, fitted.layout, fitted.best()[0])
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("class_fit_restarts", "L2")
def class_restarts(spark, sf):
    df = class_frame(spark, sf).persist()
    fitted = fit_mixtures(df, KEY, CLASS_D, [2], restarts=20)
    best = max(f.log_likelihood for f in fitted.fits)
    rows = [(f.restart, float(f.log_likelihood), f.iterations, f.log_likelihood == best) for f in fitted.fits]
    return spark.createDataFrame(rows, "restart int, log_likelihood double, iterations int, is_best boolean")


@query("class_parameters", "L1 K4")
def class_parameters(spark, sf):
    df = class_frame(spark, sf).persist()
    fitted = fit_mixtures(df, KEY, CLASS_D, [2], restarts=20)
    return parameter_table(spark, fitted.layout, fitted.best()[0])


# Cohort preparation on the given tables.
def prepare_spec(**switches) -> PrepareSpec:
    from cohortloom.catalog import Feature

    features = [Feature("PROFILE", c) for c in COLUMNS["PROFILE"]]
    features += [Feature("LINES", c) for c in COLUMNS["LINES"]] + [Feature("ORDERS", c) for c in COLUMNS["ORDERS"]]
    return PrepareSpec(
        features=features,
        history=History(("CHILD", "SIBLING"), {"CHILD": ["nationkey", "segment", "balance"], "SIBLING": ["nationkey", "name", "balance"]}, "nationkey", (2, 20), "BHC_"),
        ranges={"PROFILE_nationkey": (4, 18)},
        below={"PROFILE_acctbal": 9000, "LINES_discount": 1},
        ephemeral=["LINES_discount", "BHC_nationkey"],
        rules=[(["PROFILE_segment"], {"AUTOMOBILE": 0, "BUILDING": 1, "FURNITURE": 2, "HOUSEHOLD": 3, "MACHINERY": 3})],
        covariates=["PROFILE_nationkey", "PROFILE_acctbal"],
        missing_threshold=0.12,
        **switches,
    )


def prepare_cohort(spark, sf):
    full = cohort(spark, sf)
    tables = {code: full.tables[code] for code in ("PROFILE", "ORDERS", "LINES")}
    tables["CHILD"] = read(spark, sf, "customer").select(
        F.col("c_custkey").alias(KEY), F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")
    )
    tables["SIBLING"] = read(spark, sf, "supplier").select(
        (F.col("s_suppkey") + 1_000_000).alias(KEY), F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    cat = Catalog([*full.catalog, Instrument("child", "child"), Instrument("sibling", "sibling")], KEY)
    return Cohort(cat, tables)


def prepare_ids(spark, sf):
    return read(spark, sf, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias(KEY))


def _prepared_columns() -> dict[str, str]:
    out = {
        "PROFILE_nationkey": "nationkey", "PROFILE_acctbal": "acctbal",
        "PROFILE_segment": "CASE segment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 ELSE 3 END",
        "BHC_balance": "balance",
    }
    out |= {f"LINES_{c}": c for c in COLUMNS["LINES"] if c != "discount"}
    out |= {f"ORDERS_{c}": c for c in COLUMNS["ORDERS"]}
    return out


_LONG = " UNION ALL ".join(f"SELECT subject, '{n}' AS \"column\", ({e})::DOUBLE AS v FROM kept" for n, e in _prepared_columns().items())
PREPARED_SQL = (
    f"{PROFILE_SQL}, {ORDERS_SQL}, {LINES_SQL}, history AS (SELECT c_custkey AS subject, c_acctbal AS balance FROM customer WHERE c_nationkey BETWEEN 2 AND 20"
    " UNION ALL SELECT s_suppkey + 1000000, s_acctbal FROM supplier WHERE s_nationkey BETWEEN 2 AND 20),"
    " kept AS (SELECT * FROM profile FULL JOIN lins USING (subject) FULL JOIN ords USING (subject) LEFT JOIN history USING (subject)"
    " WHERE nationkey BETWEEN 4 AND 18 AND acctbal < 9000 AND discount < 1 AND subject IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)),"
    f" long AS ({_LONG}),"
    " cols AS (SELECT \"column\" FROM long GROUP BY 1 HAVING (count(*) - count(v)) / count(*)::DOUBLE < 0.12),"
    " complete AS (SELECT subject FROM long WHERE \"column\" IN (SELECT \"column\" FROM cols) GROUP BY 1 HAVING count(v) = (SELECT count(*) FROM cols)),"
    " prepared AS (SELECT subject, \"column\", round_even(v, 0) + 0.0 AS value FROM long JOIN complete USING (subject) WHERE \"column\" IN (SELECT \"column\" FROM cols))"
)


def _long_form(df):
    cols = [c for c in df.columns if c != KEY]
    return df.unpivot([KEY], cols, "column", "value")


@query("prepared_cohort", "L9 F1 U1 P3 J1 J5 F2 P5 R1 F3 F5 F4 P8 P9", f"WITH {PREPARED_SQL} SELECT * FROM prepared")
def prepared(spark, sf):
    df, _ = prepared_frame(prepare_cohort(spark, sf), prepare_spec(), prepare_ids(spark, sf))
    return _long_form(df)


@query(
    "prepared_sample", "L9 B1",
    f"WITH {PREPARED_SQL}, s AS (SELECT subject FROM (SELECT DISTINCT subject FROM prepared) ORDER BY md5('1:' || subject)"
    " LIMIT (SELECT round_even(0.25 * count(DISTINCT subject), 0)::BIGINT FROM prepared)) SELECT * FROM prepared WHERE subject IN (SELECT subject FROM s)",
)
def prepared_sample(spark, sf):
    df, _ = prepared_frame(prepare_cohort(spark, sf), prepare_spec(sample_frac=0.25), prepare_ids(spark, sf))
    return _long_form(df)


@query(
    "prepared_kinds", "L9 A3 A4",
    f"WITH {PREPARED_SQL} SELECT \"column\", CASE WHEN bool_and(value IN (0, 1)) THEN 'binary' WHEN count(DISTINCT value) <= 10 THEN 'categorical' ELSE 'continuous' END AS kind"
    " FROM prepared WHERE \"column\" NOT IN ('PROFILE_nationkey', 'PROFILE_acctbal') GROUP BY 1",
)
def prepared_kinds(spark, sf):
    return prepare(prepare_cohort(spark, sf), prepare_spec(), prepare_ids(spark, sf)).kinds.select("column", "kind")


@query("class_sweep", "L7 L4 L5 L6")
def sweep(spark, sf):
    ready = prepare(prepare_cohort(spark, sf), prepare_spec(), prepare_ids(spark, sf))
    return class_sweep(ready, KEY)


@query("optimal_k_job", "L7 K3 A5")
def optimal_k(spark, sf):
    ready = prepare(prepare_cohort(spark, sf), prepare_spec(), prepare_ids(spark, sf))
    return optimal_k_job(ready, KEY, scratch(spark, "classes"), sf)


@query("latent_class_job", "L10 K4 L3")
def latent_job(spark, sf):
    _, labels = latent_class_job(
        prepare_cohort(spark, sf), prepare_spec(), scratch(spark, "latent"), prepare_ids(spark, sf), n_components=3
    )
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
