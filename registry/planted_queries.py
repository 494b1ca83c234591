"""Fits on groups that SQL can describe in closed form.

Orders fall into three groups far apart, so k-means, Gaussian mixtures and latent classes must end at the groups' own sizes, means and
variances, and every metric of such a fit is an aggregate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cohortloom.catalog import Catalog, Feature, Instrument
from cohortloom.cohort import Cohort
from cohortloom.operators.cluster import COVARIANCE_FLOOR, fit_gaussian_mixture_sweep, label_sweep
from cohortloom.operators.mixture import Descriptor, assign_classes, fit_mixtures, mixture_of, parameter_table
from cohortloom.operators.passes import points
from cohortloom.operators.scale import standardize
from cohortloom.plans.latent import class_sweep, latent_class_job, optimal_k_job
from cohortloom.plans.phenotype import KMEANS_METRICS, MIXTURE_METRICS, kmeans_trials, phenotype_job, run_gmm, run_k_means
from cohortloom.plans.predictability import regression_job
from cohortloom.plans.prepare import PrepareSpec, prepare
from cohortloom.operators.regress import Linear
from registry.base import query
from registry.catalog_queries import scratch
from registry.model_queries import CLASS_FIT, CLASS_LAYOUT, FIXED_CLASS_SQL, SINGLE, SINGLE_SQL, class_frame, single_question_cohort
from registry.tables import KEY, read, rounded

GROUPS = 3
COLS = ["a", "b"]
A, B = "10 * (o_custkey % 3) + (o_orderkey % 7) / 10.0", "20 * CAST(o_custkey % 3 = 1 AS INT) + (o_orderkey % 5) / 10.0"
PLANTED_SQL = f"raw AS (SELECT o_orderkey AS subject, o_custkey % 3 AS g, ({A})::DOUBLE AS a, ({B})::DOUBLE AS b FROM orders)"
SCALED_SQL = (
    f"{PLANTED_SQL}, moments AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM raw),"
    " pts AS (SELECT g, (a - ma) / sa AS a, (b - mb) / sb AS b FROM raw, moments),"
    " cen AS (SELECT g, count(*) AS n, avg(a) AS ca, avg(b) AS cb FROM pts GROUP BY g),"
    " far AS (SELECT g, sum(power(a - ca, 2) + power(b - cb, 2)) AS ss, avg(sqrt(power(a - ca, 2) + power(b - cb, 2))) AS s FROM pts JOIN cen USING (g) GROUP BY g),"
    # Equal points count together: far fewer pairs.
    " w AS (SELECT g, a, b, count(*) AS w FROM pts GROUP BY ALL),"
    " dist AS (SELECT x.g, x.a, x.b, x.w, y.g AS other, sum(y.w * sqrt(power(x.a - y.a, 2) + power(x.b - y.b, 2))) AS d FROM w x, w y GROUP BY ALL),"
    " sil AS (SELECT d.w, max(CASE WHEN d.other = d.g THEN d.d / (cen.n - 1) END) AS near, min(CASE WHEN d.other <> d.g THEN d.d / cen.n END) AS away"
    " FROM dist d JOIN cen ON cen.g = d.other GROUP BY d.g, d.a, d.b, d.w),"
    " metrics AS (SELECT (SELECT sum(ss) FROM far) AS inertia, (SELECT sum(w * (away - near) / greatest(away, near)) / sum(w) FROM sil) AS silhouette_score,"
    " (SELECT avg(worst) FROM (SELECT x.g, max((x.s + y.s) / sqrt(power(p.ca - q.ca, 2) + power(p.cb - q.cb, 2))) AS worst"
    " FROM far x JOIN cen p USING (g), far y JOIN cen q USING (g) WHERE x.g <> y.g GROUP BY x.g)) AS davies_bouldin_score,"
    " (SELECT sum(n * (power(ca, 2) + power(cb, 2))) * (sum(n) - 3) / ((SELECT sum(ss) FROM far) * 2) FROM cen) AS calinski_harabasz_score)"
)
# Groups this far apart have posteriors of 0 and 1, so a point's density is that of its own group.
_EPS = f"{COVARIANCE_FLOOR!r}::DOUBLE"
GAUSS_SQL = (
    f"{SCALED_SQL}, cov AS (SELECT g, count(*) AS n, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS vab, (SELECT count(*) FROM pts) AS total FROM pts GROUP BY g),"
    f" det AS (SELECT *, (va + {_EPS}) * (vb + {_EPS}) - vab * vab AS det FROM cov),"
    " ll AS (SELECT any_value(total) AS total, sum(n * (ln(n / total) - ln(2 * pi()) - 0.5 * ln(det)"
    f" - 0.5 * ((vb + {_EPS}) * va - 2 * vab * vab + (va + {_EPS}) * vb) / det)) AS ll FROM det),"
    # Three full covariances and means in two dimensions, two free weights.
    " gauss AS (SELECT ll / total AS log_likelihood, -2 * ll + 17 * ln(total) AS bic, -2 * ll + 34 AS aic FROM ll)"
)


def planted(spark, sf):
    return read(spark, sf, "orders").selectExpr(f"o_orderkey AS {KEY}", "CAST(o_custkey % 3 AS INT) AS g", f"CAST({A} AS DOUBLE) AS a", f"CAST({B} AS DOUBLE) AS b")


def _sweep_sql(metrics, source: str) -> str:
    columns = ", ".join(f"round({m}, 5) AS mean_{m}, 0.0::DOUBLE AS std_{m}" for m in metrics)
    return f"WITH {source} SELECT 3 AS k, {columns} FROM metrics" + (", gauss" if "bic" in metrics else "")


def _rounded_sweep(df, metrics):
    return rounded(df, 5, *(f"{side}_{m}" for side in ("mean", "std") for m in metrics))


@query("kmeans_sweep_planted", "M11 M2 M3 M8 M9 M10 B6", _sweep_sql(KMEANS_METRICS, SCALED_SQL))
def kmeans_planted(spark, sf):
    return _rounded_sweep(run_k_means(planted(spark, sf), COLS, k_values=[GROUPS], repeats=3), KMEANS_METRICS)


@query(
    "kmeans_trials_planted", "B6 M2",
    f"WITH {SCALED_SQL} SELECT 3 AS k, repeat::INTEGER AS repeat, " + ", ".join(f"round({m}, 5) AS {m}" for m in KMEANS_METRICS) + " FROM metrics, range(0, 4) t(repeat)",
)
def trials_planted(spark, sf):
    return rounded(kmeans_trials(planted(spark, sf), COLS, [GROUPS], repeats=4), 5, *KMEANS_METRICS).drop("seed")


@query("mixture_sweep_planted", "M12 M4 M5 M6 M7 M8 M9 M10 B6", _sweep_sql(MIXTURE_METRICS, GAUSS_SQL))
def mixtures_planted(spark, sf):
    return _rounded_sweep(run_gmm(planted(spark, sf), COLS, k_values=[GROUPS], repeats=3), MIXTURE_METRICS)


@query(
    "gaussian_mixture_planted", "M4",
    f"WITH {GAUSS_SQL} SELECT round(cov.n / total, 6) AS weight, round(ca, 6) + 0.0 AS mean_a, round(cb, 6) + 0.0 AS mean_b, round(va + {_EPS}, 6) AS var_a, round(vab, 6) + 0.0 AS cov_ab,"
    " cov.n AS n_hard FROM cov JOIN cen USING (g)",
)
def gaussian_planted(spark, sf):
    df = standardize(planted(spark, sf).select(*COLS), COLS).persist()
    n = df.count()
    (fit,) = fit_gaussian_mixture_sweep(points(df, COLS), [(GROUPS, 1)], n)
    hard = label_sweep(df, COLS, [fit]).groupBy(F.col("labels")[0].alias("label")).agg(F.count(F.lit(1)).alias("n_hard"))
    rows = [(i, float(fit.weights[i]), *map(float, fit.means[i]), float(fit.covariances[i][0, 0]), float(fit.covariances[i][0, 1])) for i in range(GROUPS)]
    parameters = spark.createDataFrame(rows, "label int, weight double, mean_a double, mean_b double, var_a double, cov_ab double")
    return rounded(parameters.join(hard, "label").drop("label"), 6, "weight", "mean_a", "mean_b", "var_a", "cov_ab")


_LABELS = {m: " ".join(w.capitalize() for w in m.split("_")) for m in (*KMEANS_METRICS, *MIXTURE_METRICS)}
_LIMITS = {"inertia": ("0", "NULL"), "silhouette_score": ("-1", "1"), "davies_bouldin_score": ("0", "NULL"), "calinski_harabasz_score": ("0", "NULL")}


def _figure_sql(analysis: str, metrics) -> str:
    return " UNION ALL ".join(
        f"SELECT '{analysis}' AS analysis, 3 AS k, '{m}' AS metric, '{_LABELS[m]}' AS label, round({m}, 5) AS mean, 0.0::DOUBLE AS std,"
        f" {_LIMITS.get(m, ('NULL', 'NULL'))[0]}::DOUBLE AS y_low, {_LIMITS.get(m, ('NULL', 'NULL'))[1]}::DOUBLE AS y_high FROM metrics, gauss"
        for m in metrics
    )


def planted_cohort(spark, sf):
    df = planted(spark, sf)
    cat = Catalog([Instrument("first", "first", (), None, "a"), Instrument("second", "second", (), None, "b")], KEY)
    return Cohort(cat, {"FIRST": df.select(KEY, "a"), "SECOND": df.select(KEY, "b")})


@query("phenotype_job_planted", "M14 M11 M12 M13 K3", f"WITH {GAUSS_SQL} {_figure_sql('k_means', KMEANS_METRICS)} UNION ALL {_figure_sql('gmm', MIXTURE_METRICS)}")
def phenotype_planted(spark, sf):
    tables = phenotype_job(planted_cohort(spark, sf), "final_score", ["FIRST", "SECOND"], scratch(spark, "planted"), sf, k_values=[GROUPS], repeats=2)
    both = [tables[name].withColumn("analysis", F.lit(name)) for name in ("k_means", "gmm")]
    return rounded(both[0].unionByName(both[1]), 5, "mean", "std")


# Latent classes: two binary, one continuous and one categorical column that all tell the groups apart.
CLASSES_SQL = (
    f"{PLANTED_SQL}, per AS (SELECT g, count(*) AS n, (SELECT count(*) FROM raw) AS total, avg(a) AS mean_a, var_pop(a) AS var_a FROM raw GROUP BY g),"
    " fit AS (SELECT any_value(total) AS total, sum(n * (ln(n / total) - 0.5 * ln(2 * pi() * var_a) - 0.5)) AS ll FROM per)"
)
CLASSES = Descriptor(("one", "two"), ("a",), ("g",), ((0.0, 1.0, 2.0),))
# Two probabilities, a mean, a variance and two free levels for each class, and two free shares.
_FREE = 3 * 6 + 2


def class_rows(spark, sf):
    return planted(spark, sf).selectExpr(KEY, "CAST(g = 1 AS DOUBLE) AS one", "CAST(g = 2 AS DOUBLE) AS two", "a", "CAST(g AS DOUBLE) AS g")


@query("class_fit_planted", "L1 L3 A9", f"WITH {CLASSES_SQL} SELECT g::DOUBLE AS g, n, round(n / total, 8) AS share, round(mean_a, 8) AS mean_a, round(var_a, 8) AS var_a, (g = 1)::INTEGER::DOUBLE AS one FROM per")
def class_fit_planted(spark, sf):
    df = class_rows(spark, sf).persist()
    fitted = fit_mixtures(df, KEY, CLASSES, [GROUPS], restarts=20)
    (fit,) = fitted.best()
    labels = assign_classes(df, KEY, fitted.layout, fit).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    rows = [(i, float(np.argmax(fit.p_levels[i])), float(fit.shares[i]), float(fit.mean[i, 0]), float(fit.variance[i, 0]), float(fit.p_binary[i, 0])) for i in range(GROUPS)]
    table = spark.createDataFrame(rows, "label int, g double, share double, mean_a double, var_a double, one double")
    return rounded(table.join(labels, "label").drop("label"), 8, "share", "mean_a", "var_a", "one")


@query("class_restarts_planted", "L2", f"WITH {CLASSES_SQL} SELECT 3 AS k, repeat::INTEGER AS repeat, 20 AS restarts, round(ll / total, 5) AS best FROM fit, range(0, 2) t(repeat)")
def class_restarts_planted(spark, sf):
    df = class_rows(spark, sf).persist()
    fitted = fit_mixtures(df, KEY, CLASSES, [GROUPS], repeats=2, restarts=20)
    n = df.count()
    rows = [(f.k, f.repeat, sum(g.repeat == f.repeat for g in fitted.fits), float(f.log_likelihood / n)) for f in fitted.best()]
    return rounded(spark.createDataFrame(rows, "k int, repeat int, restarts int, best double"), 5, "best")


CLASS_METRICS_SQL = (
    f"{CLASSES_SQL}, metrics AS (SELECT round(-2 * ll + 2 * {_FREE}, 3) AS aic, round(-2 * ll + {_FREE} * ln(total), 3) AS bic, round(-2 * ll + {_FREE} * (ln(total) + 1), 3) AS caic,"
    " 0.0::DOUBLE AS entropy, 1.0::DOUBLE AS scaled_entropy, round(ll / total, 5) AS log_likelihood FROM fit)"
)


def class_cohort(spark, sf):
    cat = Catalog([Instrument("rows", "rows", ("one", "two", "a", "g"), None, None)], KEY)
    return Cohort(cat, {"ROWS": class_rows(spark, sf)})


def class_spec() -> PrepareSpec:
    return PrepareSpec([Feature("ROWS", c) for c in ("one", "two", "a", "g")], None, {}, {}, [], [], [], round_values=False)


@query("class_sweep_planted", "L7 L4 L5 L6", f"WITH {CLASS_METRICS_SQL} SELECT 3 AS k, repeat::INTEGER AS repeat, metrics.*, {_FREE} AS n_parameters, 1.0::DOUBLE AS certain FROM metrics, range(0, 2) t(repeat)")
def class_sweep_planted(spark, sf):
    from cohortloom.operators.mixture import SWEEP_METRICS

    ready = prepare(class_cohort(spark, sf), class_spec())
    metrics = {**SWEEP_METRICS, "certain": lambda s: s["sure_rows"] / s["rows"]}
    out = class_sweep(ready, KEY, [GROUPS], repeats=2, metrics=metrics, row_statistics={"sure_rows": lambda r, ll: (r.max(1) > 0.99).sum()})
    return rounded(rounded(out, 3, "aic", "bic", "caic"), 5, "entropy", "scaled_entropy", "log_likelihood")


@query(
    "optimal_k_planted", "L7 K3 A5",
    f"WITH {CLASS_METRICS_SQL} SELECT 3 AS k, " + ", ".join(f"{m} AS mean_{m}, 0.0::DOUBLE AS std_{m}" for m in ("aic", "bic", "caic", "entropy", "scaled_entropy", "log_likelihood")) + " FROM metrics",
)
def optimal_k_planted(spark, sf):
    out = optimal_k_job(prepare(class_cohort(spark, sf), class_spec()), KEY, scratch(spark, "planted_k"), sf, [GROUPS], repeats=2)
    coarse = [f"{side}_{m}" for side in ("mean", "std") for m in ("aic", "bic", "caic")]
    return rounded(rounded(out, 3, *coarse), 5, *[c for c in out.columns if c != "k" and c not in coarse])


@query("latent_class_planted", "L10 L9 K4 L3", f"WITH {CLASSES_SQL} SELECT g::DOUBLE AS g, n FROM per")
def latent_planted(spark, sf):
    source = class_cohort(spark, sf)
    path, labels = latent_class_job(source, class_spec(), scratch(spark, "planted_latent"), n_components=GROUPS, n_init=20)
    _, fit = mixture_of(spark.read.parquet(path))
    codes = spark.createDataFrame([(i, float(np.argmax(p))) for i, p in enumerate(fit.p_levels)], "label int, g double")
    # Counted before the join: joined by label, all rows would meet in as many tasks as there are classes.
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(codes, "label").groupBy("g").agg(F.sum("n").alias("n"))


@query(
    "stored_mixture", "K4 L3",
    f"WITH {FIXED_CLASS_SQL} SELECT subject, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS label, round(p0, 8) AS p0 FROM cov_p",
)
def stored_mixture(spark, sf):
    path = scratch(spark, "mixture")
    parameter_table(spark, CLASS_LAYOUT, CLASS_FIT).write.parquet(path)
    layout, fit = mixture_of(spark.read.parquet(path))
    out = assign_classes(class_frame(spark, sf), KEY, layout, fit, with_covariates=True)
    return rounded(out.select(KEY, "label", F.col("probabilities")[0].alias("p0")), 8, "p0")


_PAIRS_SQL = (
    f"WITH {SINGLE_SQL}, means AS (SELECT question_inst, score_inst, avg(r2) AS r2_mean, max(n) AS n FROM scores GROUP BY 1, 2)"
)


@query(
    "regression_job_one_question", "G11 G9 G10 K3",
    f"{_PAIRS_SQL} SELECT 'Linear' AS model, question_inst, score_inst, n, round(r2_mean, 7) + 0.0 AS r2_mean, n > (SELECT max(n) FROM means) / 2.0 AS light_text FROM means",
)
def regression_job_one_question(spark, sf):
    tables = regression_job(single_question_cohort(spark, sf), list(SINGLE), scratch(spark, "one_question"), sf, {"Linear": Linear()})
    cells = tables["counts"].select(F.col("question").alias("question_inst"), F.col("score").alias("score_inst"), "light_text")
    return rounded(tables["results"].join(cells, ["question_inst", "score_inst"]).drop("ci_low", "ci_high"), 7, "r2_mean")


