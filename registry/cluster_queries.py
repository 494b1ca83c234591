"""Cluster metrics, fits and sweeps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cohortloom.operators.cluster import (
    GaussianParams,
    assemble,
    fit_gaussian_mixture,
    fit_kmeans,
    fit_kmeans_sweep,
    kmeans_costs,
    label_all,
    mixture_log_likelihoods,
    mixture_scores,
    nearest_centroid_step,
)
from cohortloom.operators.metrics import (
    calinski_harabasz,
    cluster_moments,
    davies_bouldin,
    inertia,
    silhouette,
    silhouette_squared,
    with_labels,
)
from cohortloom.operators.passes import points, spread
from cohortloom.operators.resample import mean_std, run_trials
from cohortloom.operators.scale import standardize
from cohortloom.plans.phenotype import DEFAULT_K, kept, kmeans_trials, metrics_against_k, phenotype_job, run_gmm, run_k_means
from registry.base import query
from registry.catalog_queries import scratch
from registry.tables import DIMS, cohort, read, rounded, vectors, vectors_sql

COLS = [f"d{i}" for i in range(DIMS)]
# Two partitions of the same points, so that metrics of several trials are checked at once.
LABELS = ("label", "vec_id % 4")
LABELLED_SQL = (
    f"{vectors_sql()}, lab AS (SELECT 0 AS trial, label AS l, * EXCLUDE (label) FROM vecs UNION ALL SELECT 1, vec_id % 4, * EXCLUDE (label) FROM vecs)"
)
CENTROIDS_SQL = (
    "cen AS (SELECT trial, l, count(*) AS n, " + ", ".join(f"avg({c}) AS m_{c}" for c in COLS) + " FROM lab GROUP BY 1, 2),"
    " total AS (SELECT trial, " + ", ".join(f"avg({c}) AS g_{c}" for c in COLS) + " FROM lab GROUP BY 1)"
)
SQ_TO_CENTROID = " + ".join(f"({c} - m_{c}) * ({c} - m_{c})" for c in COLS)
WITHIN_SQL = f"w AS (SELECT trial, l, sum({SQ_TO_CENTROID}) AS ss, avg(sqrt({SQ_TO_CENTROID})) AS s, count(*) AS n FROM lab JOIN cen USING (trial, l) GROUP BY 1, 2)".replace(
    "count(*) AS n FROM lab", "count(*) AS cnt FROM lab"
)


def labelled(spark, sf):
    df = vectors(spark, sf).withColumn("other", F.col("vec_id") % 4)
    return with_labels(df, "label", "other").select(*COLS, "labels")


@query("inertia", "M3", f"WITH {LABELLED_SQL}, {CENTROIDS_SQL}, {WITHIN_SQL} SELECT trial, round(sum(ss), 6) AS inertia FROM w GROUP BY trial")
def cluster_inertia(spark, sf):
    return rounded(inertia(cluster_moments(labelled(spark, sf), COLS)), 6, "inertia")


@query(
    "calinski_harabasz", "M10",
    f"WITH {LABELLED_SQL}, {CENTROIDS_SQL}, {WITHIN_SQL}, b AS (SELECT trial, sum(n * ("
    + " + ".join(f"(m_{c} - g_{c}) * (m_{c} - g_{c})" for c in COLS)
    + ")) AS bss, count(*) AS k, sum(n) AS n FROM cen JOIN total USING (trial) GROUP BY 1)"
    " SELECT trial, round(bss * (n - k) / (wss * (k - 1)), 8) AS calinski_harabasz_score FROM b JOIN (SELECT trial, sum(ss) AS wss FROM w GROUP BY 1) USING (trial)",
)
def calinski(spark, sf):
    return rounded(calinski_harabasz(cluster_moments(labelled(spark, sf), COLS)), 8, "calinski_harabasz_score")


@query(
    "davies_bouldin", "M9",
    f"WITH {LABELLED_SQL}, {CENTROIDS_SQL}, {WITHIN_SQL}, cs AS (SELECT * FROM cen JOIN w USING (trial, l)),"
    " r AS (SELECT a.trial, a.l, max((a.s + b.s) / sqrt(" + " + ".join(f"(a.m_{c} - b.m_{c}) * (a.m_{c} - b.m_{c})" for c in COLS)
    + ")) AS worst FROM cs a JOIN cs b ON a.trial = b.trial AND a.l <> b.l GROUP BY 1, 2)"
    " SELECT trial, round(avg(worst), 8) AS davies_bouldin_score FROM r GROUP BY trial",
)
def davies(spark, sf):
    return rounded(davies_bouldin(cluster_moments(labelled(spark, sf), COLS)), 8, "davies_bouldin_score")


DIST = "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _silhouette_sql(distance: str, name: str) -> str:
    return (
        "WITH pts AS (SELECT 0 AS trial, vec_id, label AS l, embedding FROM embeddings UNION ALL SELECT 1, vec_id, vec_id % 4, embedding FROM embeddings),"
        " sizes AS (SELECT trial, l, count(*) AS n FROM pts GROUP BY 1, 2),"
        f" sums AS (SELECT a.trial, a.vec_id, a.l, b.l AS other, sum({distance}) AS s FROM pts a JOIN pts b USING (trial) GROUP BY 1, 2, 3, 4),"
        " per AS (SELECT trial, vec_id, max(CASE WHEN other = l THEN s / (n - 1) END) AS a, min(CASE WHEN other <> l THEN s / n END) AS b"
        " FROM sums JOIN sizes z USING (trial) WHERE z.l = other GROUP BY 1, 2)"
        f" SELECT trial, round(avg((b - a) / greatest(a, b)), 8) AS {name} FROM per GROUP BY trial"
    ).replace("sums JOIN sizes z USING (trial) WHERE z.l = other", "sums JOIN sizes z ON sums.trial = z.trial AND z.l = other").replace(
        "SELECT trial, vec_id, max(", "SELECT sums.trial, vec_id, max("
    ).replace("other = l THEN", "other = sums.l THEN").replace("other <> l THEN", "other <> sums.l THEN")


@query("silhouette", "M8", _silhouette_sql(DIST, "silhouette_score"))
def silhouette_score(spark, sf):
    df = labelled(spark, sf)
    return rounded(silhouette(df, COLS, moments=cluster_moments(df, COLS)), 8, "silhouette_score")


@query("silhouette_squared", "M8", _silhouette_sql(f"power({DIST}, 2)", "silhouette_squared"))
def squared(spark, sf):
    df = labelled(spark, sf)
    return rounded(silhouette_squared(df, COLS, cluster_moments(df, COLS)), 8, "silhouette_squared")


FIXED_CENTRES = [[0.05 * ((c + d) % 3 - 1) for d in range(DIMS)] for c in range(3)]
_COSTS = [" + ".join(f"({c} - ({v!r}::DOUBLE)) * ({c} - ({v!r}::DOUBLE))" for c, v in zip(COLS, centre)) for centre in FIXED_CENTRES]


@query(
    "nearest_centroid_step", "M2",
    f"WITH {vectors_sql()}, c AS (SELECT *, " + ", ".join(f"{e} AS c{i}" for i, e in enumerate(_COSTS)) + " FROM vecs),"
    " a AS (SELECT *, CASE WHEN c0 <= c1 AND c0 <= c2 THEN 0 WHEN c1 <= c2 THEN 1 ELSE 2 END AS new_label, least(c0, c1, c2) AS cost FROM c)"
    " SELECT new_label AS label, count(*) AS n, round(sum(cost), 6) AS cost, " + ", ".join(f"round(avg({c}), 8) + 0.0 AS {c}" for c in COLS) + " FROM a GROUP BY 1",
)
def centroid_step(spark, sf):
    return rounded(rounded(nearest_centroid_step(vectors(spark, sf), COLS, FIXED_CENTRES), 8, *COLS), 6, "cost")


@query("kmeans_fit", "M2 A9")
def kmeans_fit(spark, sf):
    features = assemble(standardize(vectors(spark, sf), COLS), COLS).persist()
    model = fit_kmeans(features, 4, seed=1)
    return label_all(features, [model]).groupBy(F.col("labels")[0].alias("label")).agg(F.count(F.lit(1)).alias("n"))


GAUSS = GaussianParams(
    np.array([0.6, 0.4]),
    np.stack([np.zeros(DIMS), np.resize([0.1, -0.1, 0.05], DIMS)]),
    np.stack([np.diag(np.resize([0.02, 0.03, 0.04], DIMS)), np.diag(np.resize([0.05, 0.04, 0.03], DIMS))]),
)


def _density(c: int) -> str:
    w, mean, var = GAUSS.weights[c], GAUSS.means[c], np.diag(GAUSS.covariances[c])
    q = " + ".join(f"power(d{i} - ({float(m)!r}::DOUBLE), 2) / {float(v)!r}::DOUBLE" for i, (m, v) in enumerate(zip(mean, var)))
    norm = " * ".join(f"sqrt(2 * pi() * {float(v)!r}::DOUBLE)" for v in var)
    return f"{float(w)!r}::DOUBLE * exp(-0.5 * ({q})) / ({norm})"


GAUSS_LL_SQL = f"{vectors_sql()}, ll AS (SELECT sum(ln({_density(0)} + {_density(1)})) AS ll, count(*) AS n FROM vecs)"


@query("mixture_log_likelihood", "M5", f"WITH {GAUSS_LL_SQL} SELECT 0 AS trial, round(ll, 6) AS log_likelihood, n FROM ll")
def mixture_ll(spark, sf):
    return rounded(mixture_log_likelihoods(vectors(spark, sf), COLS, [GAUSS]), 6, "log_likelihood")


# Two weights that sum to one, two means and two symmetric covariances in 64 dimensions.
_P = 1 + 2 * 64 + 2 * 2080


@query(
    "mixture_criteria", "M5 M6 M7",
    f"WITH {GAUSS_LL_SQL} SELECT 0 AS trial, round(ll / n, 8) AS log_likelihood, round(-2 * ll + {_P} * ln(n), 6) AS bic, round(-2 * ll + 2 * {_P}, 6) AS aic FROM ll",
)
def mixture_criteria(spark, sf):
    return rounded(rounded(mixture_scores(vectors(spark, sf), COLS, [GAUSS]), 8, "log_likelihood"), 6, "bic", "aic")


@query("gaussian_mixture_fit", "M4 M5 M6 M7")
def gmm_fit(spark, sf):
    scaled = standardize(vectors(spark, sf).drop("label", "vec_id"), COLS)
    features = assemble(scaled, COLS).persist()
    model = fit_gaussian_mixture(features, 3, seed=1, n_rows=features.count())
    return mixture_scores(features, COLS, [GaussianParams.of(model)])


@query("kmeans_trials", "B6 M2 M3")
def trials(spark, sf):
    return kmeans_trials(vectors(spark, sf), COLS)


@query("driver_parallel_trials", "B6")
def parallel_trials(spark, sf):
    # One trial is a repeat: its fits of every k share their scans, and the trials run side by side.
    rows = points(vectors(spark, sf), COLS)
    n = rows.count()
    repeats = [(r,) for r in range(5)]
    with kept(spread(rows, n, DIMS)) as x:
        sweeps = run_trials(spark, repeats, lambda r: fit_kmeans_sweep(x, [(k, 1009 * k + r) for k in DEFAULT_K], n))
        costs = kmeans_costs(x, [fit for fits in sweeps for fit in fits])
    table = [(k, r, cost) for (r, k), cost in zip([(r, k) for (r,) in repeats for k in DEFAULT_K], costs, strict=True)]
    return mean_std(spark.createDataFrame(table, "k int, repeat int, inertia double"), "k", ["inertia"])


@query("kmeans_sweep", "M11")
def kmeans_sweep(spark, sf):
    return run_k_means(vectors(spark, sf), COLS)


@query("gaussian_mixture_sweep", "M12")
def gmm_sweep(spark, sf):
    return run_gmm(vectors(spark, sf), COLS)


_SWEEP_METRICS = {"inertia": "l_quantity", "silhouette_score": "l_discount", "bic": "l_tax"}
_LIMITS = {"inertia": ("0.0", "NULL"), "silhouette_score": ("-1.0", "1.0"), "bic": ("NULL", "NULL")}
_TITLES = {"inertia": "Inertia", "silhouette_score": "Silhouette Score", "bic": "Bic"}


@query(
    "metrics_against_k", "M13 X5",
    " UNION ALL ".join(
        f"SELECT l_linenumber AS k, '{m}' AS metric, '{_TITLES[m]}' AS label, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std,"
        f" {_LIMITS[m][0]}::DOUBLE AS y_low, {_LIMITS[m][1]}::DOUBLE AS y_high FROM lineitem GROUP BY 1"
        for m, c in _SWEEP_METRICS.items()
    ),
)
def against_k(spark, sf):
    tidy = read(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("k"), *[F.col(c).alias(m) for m, c in _SWEEP_METRICS.items()]
    )
    sweep = mean_std(tidy, "k", list(_SWEEP_METRICS))
    return rounded(metrics_against_k(sweep, list(_SWEEP_METRICS)), 6, "mean", "std")


@query("phenotype_job", "M14")
def phenotype(spark, sf):
    tables = phenotype_job(cohort(spark, sf), "final_score", ["PROFILE", "ORDERS", "EVENTS"], scratch(spark, "phenotype"), sf)
    return tables["k_means"].withColumn("analysis", F.lit("k_means")).unionByName(
        tables["gmm"].withColumn("analysis", F.lit("gmm"))
    )
