import numpy as np
import pytest

from cohortloom.operators.cluster import (
    GaussianParams,
    assemble,
    fit_gaussian_mixture_sweep,
    fit_kmeans_sweep,
    label_all,
    label_sweep,
    fit_kmeans,
    mixture_log_likelihoods,
    mixture_scores,
)
from cohortloom.operators.metrics import (
    calinski_harabasz,
    cluster_moments,
    davies_bouldin,
    gaussian_parameters,
    inertia,
    partition_scores,
    posterior_entropy,
    silhouette,
    silhouette_squared,
    with_labels,
)
from cohortloom.operators.passes import batched_by_size, points
from cohortloom.plans.phenotype import KMEANS_METRICS, MIXTURE_METRICS, kmeans_trials, metrics_against_k, mixture_trials, run_gmm

COLS = ["a", "b"]


def frame(spark, x, *labels):
    names = [f"l{i}" for i in range(len(labels))]
    data = [(float(p[0]), float(p[1]), *(int(lab[i]) for lab in labels)) for i, p in enumerate(x)]
    df = spark.createDataFrame(data, ", ".join([*(f"{c} double" for c in COLS), *(f"{n} int" for n in names)]))
    return with_labels(df, *names).select(*COLS, "labels") if labels else df


def brute_silhouette(x, lab, power=1):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) ** power
    out = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][lab == c].mean() for c in set(lab) - {lab[i]})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def brute_davies(x, lab):
    ks = sorted(set(lab))
    mu = {c: x[lab == c].mean(0) for c in ks}
    s = {c: np.sqrt(((x[lab == c] - mu[c]) ** 2).sum(1)).mean() for c in ks}
    return float(np.mean([max((s[i] + s[j]) / np.linalg.norm(mu[i] - mu[j]) for j in ks if j != i) for i in ks]))


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(5)
    centres = np.array([[0, 0], [6, 0], [0, 6]])
    truth = np.repeat([0, 1, 2], 40)
    return centres[truth] + rng.normal(size=(120, 2)), truth


@pytest.mark.parametrize("block_points", [7, 50, 5000])
def test_metrics_match_brute_force(spark, blobs, block_points):
    x, truth = blobs
    rng = np.random.default_rng(1)
    other = rng.integers(3, 7, len(x))
    single = np.where(np.arange(len(x)) == 0, 9, other)
    # Repeat a third of the rows as one identical point.
    x = np.vstack([x, np.tile(x[:1], (60, 1))])
    labels = [np.concatenate([lab, np.full(60, lab[1])]) for lab in (truth, other, single)]
    df = frame(spark, x, *labels)
    sil = {r["trial"]: r["silhouette_score"] for r in silhouette(df, COLS, block_points).collect()}
    for t, lab in enumerate(labels):
        assert sil[t] == pytest.approx(brute_silhouette(x, lab), abs=1e-9)
    moments = cluster_moments(df, COLS)
    db = {r["trial"]: r["davies_bouldin_score"] for r in davies_bouldin(moments).collect()}
    sq = {r["trial"]: r["silhouette_squared"] for r in silhouette_squared(df, COLS, moments).collect()}
    ch = {r["trial"]: r["calinski_harabasz_score"] for r in calinski_harabasz(moments).collect()}
    sse = {r["trial"]: r["inertia"] for r in inertia(moments).collect()}
    for t, lab in enumerate(labels):
        mu = {c: x[lab == c].mean(0) for c in set(lab)}
        within = sum(((x[lab == c] - m) ** 2).sum() for c, m in mu.items())
        between = sum((lab == c).sum() * ((m - x.mean(0)) ** 2).sum() for c, m in mu.items())
        assert db[t] == pytest.approx(brute_davies(x, lab))
        assert sq[t] == pytest.approx(brute_silhouette(x, lab, 2), abs=1e-9)
        assert sse[t] == pytest.approx(within)
        assert ch[t] == pytest.approx(between * (len(x) - len(mu)) / (within * (len(mu) - 1)))


def test_kmeans_sweep_finds_blobs_and_does_not_worsen(spark, blobs):
    x, truth = blobs
    df = frame(spark, x)
    pts = points(df, COLS).persist()
    fits = fit_kmeans_sweep(pts, [(3, 1), (3, 2), (2, 1)], len(x))
    labels = np.array([r["labels"] for r in label_sweep(df, COLS, fits).collect()])
    costs = []
    for t, fit in enumerate(fits):
        costs.append(((x[:, None] - fit[None]) ** 2).sum(-1).min(1).sum())
        # Every centre is the mean of its points.
        for c in range(len(fit)):
            assert np.allclose(fit[c], x[labels[:, t] == c].mean(0), atol=0.02)
    assert costs[0] < costs[2]
    assert sorted(np.bincount(labels[:, 0])) == pytest.approx([40, 40, 40], abs=3)
    first = fit_kmeans_sweep(pts, [(3, 1)], len(x), max_iter=1)[0]
    assert costs[0] <= ((x[:, None] - first[None]) ** 2).sum(-1).min(1).sum() + 1e-9


def test_single_fit_labels_match_own_centres(spark, blobs):
    x, _ = blobs
    features = assemble(frame(spark, x), COLS)
    model = fit_kmeans(features, 3, seed=1)
    centres = np.array(model.clusterCenters())
    got = [(r["a"], r["b"], r["labels"][0]) for r in label_all(features, [model]).collect()]
    assert all(((np.array(g[:2]) - centres) ** 2).sum(1).argmin() == g[2] for g in got)


def test_gaussian_mixture_likelihood_never_falls(spark, blobs):
    x, _ = blobs
    df = frame(spark, x)
    pts = points(df, COLS).persist()
    last = -np.inf
    for iterations in (1, 2, 4, 8):
        params = fit_gaussian_mixture_sweep(pts, [(3, 1)], len(x), max_iter=iterations, tol=0.0)
        ll = mixture_log_likelihoods(df, COLS, params).first()["log_likelihood"]
        assert ll >= last - 1e-6
        last = ll
    p = params[0]
    assert p.weights.sum() == pytest.approx(1.0) and sorted(p.weights) == pytest.approx([1 / 3] * 3, abs=0.05)
    dens = sum(
        w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)) / (2 * np.pi * np.sqrt(np.linalg.det(c)))
        for w, m, c in zip(p.weights, p.means, p.covariances)
    )
    assert last == pytest.approx(np.log(dens).sum())
    scores = mixture_scores(df, COLS, params).first()
    free = gaussian_parameters(3, 2)
    assert free == 17 and scores["bic"] == pytest.approx(-2 * last + free * np.log(len(x)))
    assert isinstance(p, GaussianParams)


def test_sweep_tables(spark, blobs):
    df = frame(spark, blobs[0])
    trials = kmeans_trials(df, COLS, [2, 3], repeats=2)
    assert {(r["k"], r["repeat"]) for r in trials.collect()} == {(2, 0), (2, 1), (3, 0), (3, 1)}
    assert set(KMEANS_METRICS) <= set(trials.columns)
    best = {r["k"]: r["silhouette_score"] for r in trials.collect()}
    assert best[3] > best[2]
    sweep = run_gmm(df, COLS, k_values=[2, 3], repeats=2)
    assert set(sweep.columns) == {"k", *(f"{s}_{m}" for s in ("mean", "std") for m in MIXTURE_METRICS)}
    tidy = metrics_against_k(sweep, MIXTURE_METRICS)
    assert tidy.count() == 12 and tidy.filter("metric = 'bic' AND y_low IS NULL").count() == 2
    assert set(MIXTURE_METRICS) <= set(mixture_trials(df, COLS, [2], repeats=1).columns)


def test_partition_scores_have_one_row_per_trial(spark, blobs):
    x, truth = blobs
    df = frame(spark, x, truth, truth % 2)
    assert partition_scores(df, COLS).count() == 2


def test_posterior_entropy(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.5, 0.5],)], "p array<double>")
    r = posterior_entropy(df, "p", 2).first()
    assert r["entropy"] == pytest.approx(np.log(2)) and r["scaled_entropy"] == pytest.approx(0.5)


def test_fits_are_grouped_by_size():
    assert list(batched_by_size("abcd", [3, 3, 3, 9], 6)) == [[0, 1], [2], [3]]


def test_sweep_starts_reach_every_far_point(spark):
    """Starts come from all rows: far single points are found by every seed, under any partitioning."""
    rng = np.random.default_rng(0)
    rows = [(v.tolist(),) for v in rng.standard_normal((1000, 2))] + [([5000.0, 0.0],), ([0.0, 5000.0],), ([-5000.0, 0.0],)]
    df = spark.createDataFrame(rows, "x array<double>")
    grid = [(4, seed) for seed in range(8)]
    fits = [fit_kmeans_sweep(df.repartition(n).persist(), grid, 1003) for n in (1, 5)]
    for a, b in zip(*fits):
        assert np.allclose(sorted(np.abs(a).max(1))[1:], 5000.0) and np.allclose(a, b)


def test_sweep_starts_with_repeated_rows(spark):
    df = spark.createDataFrame([([float(i % 3), 0.0],) for i in range(90)], "x array<double>").persist()
    for centres in fit_kmeans_sweep(df, [(3, s) for s in range(5)] + [(5, 1)], 90):
        assert {round(c, 6) for c in centres[:, 0]} == {0.0, 1.0, 2.0}


def test_sweep_queries_run_on_all_dimensions_with_default_settings(spark, sf_dir, monkeypatch):
    from registry import cluster_queries as registered

    seen = {}

    def record(name, result=None):
        return lambda *args, **options: seen.setdefault(name, (args, options)) and result

    for name in ("run_gmm", "run_k_means", "kmeans_trials"):
        monkeypatch.setattr(registered, name, record(name))
    registered.gmm_sweep(spark, sf_dir), registered.kmeans_sweep(spark, sf_dir), registered.trials(spark, sf_dir)
    assert all(list(args[1]) == registered.COLS and set(registered.COLS) <= set(args[0].columns) and len(args) == 2 and not options for args, options in seen.values())
    one = spark.createDataFrame([(2,)], "k int")
    monkeypatch.setattr(registered, "phenotype_job", record("phenotype_job", {"k_means": one, "gmm": one}))
    registered.phenotype(spark, sf_dir)
    assert not {"k_values", "repeats"} & set(seen["phenotype_job"][1])


def test_far_clusters_do_not_meet(spark, monkeypatch):
    """With bounds a block of points needs its own and the nearest clusters only; the score is the same."""
    from cohortloom.operators import silhouette as sil

    rng = np.random.default_rng(8)
    lab = np.repeat(np.arange(-3, 9), 30)
    x = np.column_stack([lab * 40.0, rng.normal(size=len(lab))]) + rng.normal(size=(len(lab), 2))
    df = frame(spark, x, lab).repartition(3)
    moments = cluster_moments(df, COLS)
    bounds = sil.bounds_of(moments)
    names = sil.cluster_names(lab[:, None])
    needed = bounds.needed(x[lab == 2], names[lab == 2])
    assert 2 <= len(needed) <= 3
    met = []
    monkeypatch.setattr(sil, "SUPER_BLOCKS", 1)
    real = sil._blocks
    monkeypatch.setattr(sil, "_blocks", lambda *a: met.append(real(*a)) or met[-1])
    with_bounds = sil.silhouette(df, COLS, 10, moments).first()["silhouette_score"]
    assert with_bounds == pytest.approx(brute_silhouette(x, lab), abs=1e-9)
    assert sil.silhouette(df, COLS, 10).first()["silhouette_score"] == pytest.approx(with_bounds, abs=1e-12)
    pruned = [len(r["needed"]) for r in met[0].select("needed").collect()]
    assert max(pruned) <= 6 and len(pruned) > 20
    monkeypatch.setattr(sil, "BOUND_VALUES", 0)
    assert sil.bounds_of(moments) is None


def test_moments_where_labels_are_many(spark, blobs, monkeypatch):
    """The same moments when centroids meet the rows by their cluster, in tasks that pass sums on early, and in small blocks of clusters."""
    from cohortloom.operators import metrics

    x, truth = blobs
    df = frame(spark, x, truth - 1, np.arange(len(x)) // 2, np.zeros(len(x), int)).repartition(3)
    usual = {(r["trial"], r["label"]): r for r in cluster_moments(df, COLS).collect()}
    ratios = {r["trial"]: r["davies_bouldin_score"] for r in davies_bouldin(cluster_moments(df, COLS)).collect()}
    for name, value in (("CENTROID_VALUES", 0), ("TASK_SUMS", 5), ("BLOCK_CLUSTERS", 3)):
        monkeypatch.setattr(metrics, name, value)
    moments = cluster_moments(df, COLS)
    for r in moments.collect():
        want = usual.pop((r["trial"], r["label"]))
        assert r["n"] == want["n"] and r["centroid"] == pytest.approx(want["centroid"])
        assert (r["within"], r["scatter"]) == pytest.approx((want["within"], want["scatter"]))
    assert not usual
    assert {r["trial"]: r["davies_bouldin_score"] for r in davies_bouldin(moments).collect()} == pytest.approx(ratios)
    assert ratios[0] == pytest.approx(brute_davies(x, truth)) and ratios[2] == 0.0
    scores = {r["trial"]: r["silhouette_score"] for r in silhouette(df, COLS, moments=moments).collect()}
    assert scores[2] is None and scores[1] == pytest.approx(brute_silhouette(x, np.arange(len(x)) // 2), abs=1e-9)


def test_sums_travel_as_chunks(spark, monkeypatch):
    from cohortloom.operators import passes

    monkeypatch.setattr(passes, "CHUNK", 5)
    df = points(spark.range(40).selectExpr("CAST(id AS DOUBLE) AS a", "CAST(id % 3 AS DOUBLE) AS b").repartition(4), ["a", "b"])

    def statistics(batch, state):
        x = passes.columns_of(batch)
        sparse = np.zeros(23)
        sparse[7], sparse[22] = len(x), x[:, 0].sum()
        return [x.sum(0) * state, sparse]

    for tasks in (None, 4):
        got = passes.sum_statistics(df, 2.0, statistics, [2, 23], tasks)
        assert got[0].tolist() == [1560.0, 78.0] and got[1][7] == 40 and got[1][22] == 780 and np.count_nonzero(got[1]) == 2
    assert [(n, p is None) for n, p, _ in passes.chunked(np.r_[np.zeros(5), 1.0, np.zeros(4), np.ones(3)], 5)] == [(1, False), (2, True)]


def test_sweeps_use_every_core(spark, blobs):
    """Points of one file or row group are dealt over all cores before the scans of a sweep."""
    from cohortloom.plans.phenotype import _scaled

    df = frame(spark, blobs[0]).coalesce(1)
    with _scaled(df, COLS) as (x, _, n):
        sizes = x.rdd.glom().map(len).collect()
    assert sum(sizes) == n and len(sizes) >= spark.sparkContext.defaultParallelism
    assert max(sizes) <= n / len(sizes) + len(sizes)


def test_densities_from_features_equal_whitened_ones():
    """All mixtures of a sweep share one product; covariances too narrow for that stay whitened, with the same statistics."""
    import pyarrow as pa

    from cohortloom.operators import cluster

    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 4))
    fits = []
    for k, width in ((2, 1.0), (3, 1e-6), (4, 0.2)):
        root = rng.normal(size=(k, 4, 4))
        fits.append(cluster.GaussianParams(rng.dirichlet(np.ones(k)), rng.normal(size=(k, 4)), width * (root @ root.transpose(0, 2, 1) + np.eye(4))))
    state = cluster._densities_of(fits, float(np.abs(x).max()))
    assert [isinstance(s, np.ndarray) for s in state] == [True, False, True]
    got = cluster._soft_statistics(pa.RecordBatch.from_arrays([pa.array(list(x))], names=["x"]), state)
    for p, flat in zip(fits, got):
        joint = cluster._component_log_density(x, cluster.Whitened.of(p))
        ll = cluster._log_sum_exp(joint)
        r = np.exp(joint - ll[:, None])
        upper = np.triu_indices(4)
        second = [((x * r[:, [c]]).T @ x)[upper] for c in range(r.shape[1])]
        np.testing.assert_allclose(flat, np.concatenate([[ll.sum()], r.sum(0), (r.T @ x).ravel(), *second]), rtol=1e-9, atol=1e-9)


def test_parallel_trials_share_their_scans(spark, sf_dir, monkeypatch):
    """Five trials of thirteen fits; a Spark job per fit and iteration ran out of time on 1 GB."""
    from registry import cluster_queries as registered

    grids = []

    def fit(x, grid, n):
        grids.append(grid)
        return [np.zeros((k, registered.DIMS)) for k, _ in grid]

    monkeypatch.setattr(registered, "fit_kmeans_sweep", fit)
    rows = registered.parallel_trials(spark, sf_dir).collect()
    assert len(grids) == 5 and len({pair for grid in grids for pair in grid}) == 65
    vectors = registered.vectors(spark, sf_dir).select(*registered.COLS).toPandas().to_numpy()
    assert [r["k"] for r in sorted(rows)] == list(range(2, 15)) and all(abs(r["mean_inertia"] - (vectors**2).sum()) < 1e-6 for r in rows)
