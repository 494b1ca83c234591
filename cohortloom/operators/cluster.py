"""k-means and Gaussian-mixture fits, and the labels of many fits in one scan."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, GaussianMixtureModel, KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.operators.metrics import gaussian_parameters
from cohortloom.functions.sql import double_array, number, quoted
from cohortloom.operators.passes import batched_by_size, columns_of, doubles, partitions_for, points, sum_statistics

from cohortloom.session import ship_package

# Seeding scans; each draws about twice as many candidates as a fit has clusters, from all rows.
SEED_ROUNDS = 3
COVARIANCE_FLOOR = 1e-6


def assemble(df: DataFrame, cols: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=output, handleInvalid="error").transform(df)


def fit_kmeans(features: DataFrame, k: int, seed: int, max_iter: int = 300, tol: float = 1e-4) -> KMeansModel:
    """One k-means fit with parallel k-means++ seeding."""
    return KMeans(k=k, seed=seed, initMode="k-means||", maxIter=max_iter, tol=tol).fit(features)


def fit_gaussian_mixture(
    features: DataFrame, k: int, seed: int, n_rows: int, max_iter: int = 100, tol: float = 1e-3
) -> GaussianMixtureModel:
    """One full-covariance mixture fit; ``tol`` is per row, Spark's is on the total log-likelihood."""
    return GaussianMixture(k=k, seed=seed, maxIter=max_iter, tol=tol * n_rows).fit(features)


def label_all(features: DataFrame, models: Sequence[KMeansModel | GaussianMixtureModel]) -> DataFrame:
    """``labels``: hard assignment under every model, in one projection over the data."""
    out = features
    for i, m in enumerate(models):
        m = m.copy().setPredictionCol(f"_p{i}")
        if isinstance(m, GaussianMixtureModel):
            m = m.setProbabilityCol("")
        out = m.transform(out)
    predicted = [f"_p{i}" for i in range(len(models))]
    return out.withColumn("labels", F.array(*predicted)).drop(*predicted)


@dataclass(frozen=True)
class GaussianParams:
    """Weights, means and covariances of a mixture."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    @classmethod
    def of(cls, model: GaussianMixtureModel) -> GaussianParams:
        gaussians = model.gaussians
        return cls(
            np.asarray(model.weights),
            np.stack([g.mean.toArray() for g in gaussians]),
            np.stack([g.cov.toArray() for g in gaussians]),
        )


@dataclass(frozen=True)
class Whitened:
    """A mixture as tasks use it: covariances factored once, on the driver. ``axes`` is columns x (components * columns)."""

    axes: np.ndarray
    centres: np.ndarray
    constants: np.ndarray

    @classmethod
    def of(cls, p: GaussianParams) -> Whitened:
        k, d = p.means.shape
        values, vectors = np.linalg.eigh(p.covariances)
        keep = values > np.finfo(float).eps * d * values.max(axis=1, keepdims=True)
        kept = np.where(keep, values, 1.0)
        axes = np.where(keep[:, None, :], vectors / np.sqrt(kept)[:, None, :], 0.0)
        norm = np.log(kept).sum(1) + d * np.log(2.0 * np.pi)
        centres = np.einsum("kd,kde->ke", p.means, axes)
        return cls(axes.transpose(1, 0, 2).reshape(d, k * d), centres, np.log(np.maximum(p.weights, 1e-300)) - 0.5 * norm)


# Numbers that the densities of a batch hold at once (32 MB).
_DENSITY_VALUES = 4_000_000


def _component_log_density(x: np.ndarray, p: Whitened) -> np.ndarray:
    """Rows x components: log of weight times density."""
    k, d = p.centres.shape
    step = max(1, _DENSITY_VALUES // (k * d))
    parts = []
    for low in range(0, len(x), step):
        y = (x[low : low + step] @ p.axes).reshape(-1, k, d) - p.centres
        parts.append(p.constants - 0.5 * np.einsum("nkd,nkd->nk", y, y))
    return np.concatenate(parts)


def _log_sum_exp(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1)
    return top + np.log(np.exp(a - top[:, None]).sum(axis=1))


def _likelihoods(batch: pa.RecordBatch, params: Sequence[Whitened]) -> list[np.ndarray]:
    x = columns_of(batch)
    return [np.array([_log_sum_exp(_component_log_density(x, p)).sum(), len(x)]) for p in params]


def mixture_log_likelihoods(df: DataFrame, cols: Sequence[str], params: Sequence[GaussianParams]) -> DataFrame:
    """``trial, log_likelihood`` (total) and ``n`` of every mixture, all from one scan."""
    sums = sum_statistics(points(df, cols), [Whitened.of(p) for p in params], _likelihoods, [2] * len(params))
    return df.sparkSession.createDataFrame(
        [(i, float(ll), int(n)) for i, (ll, n) in enumerate(sums)], "trial int, log_likelihood double, n bigint"
    )


def mixture_scores(df: DataFrame, cols: Sequence[str], params: Sequence[GaussianParams]) -> DataFrame:
    """Mean log-likelihood, BIC and AIC per mixture."""
    totals = mixture_log_likelihoods(df, cols, params)
    free = F.array(*[F.lit(float(gaussian_parameters(len(p.weights), len(cols)))) for p in params])[F.col("trial")]
    ll = F.col("log_likelihood")
    return totals.select(
        "trial",
        (ll / F.col("n")).alias("log_likelihood"),
        (-2.0 * ll + free * F.ln("n")).alias("bic"),
        (-2.0 * ll + 2.0 * free).alias("aic"),
    )


def _step_statistics(batch: pa.RecordBatch, centres: np.ndarray) -> list[np.ndarray]:
    x = columns_of(batch)
    costs = np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)
    labels = costs.argmin(1)
    hot = _indicator(labels, len(centres))
    return [np.concatenate([hot.sum(0), hot.T @ costs[np.arange(len(x)), labels], (hot.T @ x).ravel()])]


def nearest_centroid_step(df: DataFrame, cols: Sequence[str], centroids: Sequence[Sequence[float]]) -> DataFrame:
    """One assignment and update step of k-means from given centroids: label, n, cost and the new centre of each cluster with rows."""
    centres = np.array(centroids, float)
    k, d = centres.shape
    (flat,) = sum_statistics(points(df, cols), centres, _step_statistics, [k * (d + 2)])
    n, cost, total = flat[:k], flat[k : 2 * k], flat[2 * k :].reshape(k, d)
    rows = [(i, int(n[i]), float(cost[i]), *(total[i] / n[i]).tolist()) for i in range(k) if n[i]]
    schema = ", ".join(["label int", "n bigint", "cost double", *(f"{quoted(c)} double" for c in cols)])
    return df.sparkSession.createDataFrame(rows, schema)


# Sweeps: many fits over the same rows.


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _drawn(x: DataFrame, centres: Sequence[np.ndarray | None], wanted: Sequence[int], salts: Sequence[int]) -> list[np.ndarray]:
    """For every fit a draw of distinct points from all rows, weighted by squared distance to its centres.

    The noise of a point comes from a hash of its values, so the draw does not depend on the partitioning.
    Tasks keep the ``wanted`` best of each fit, and so does the merge.
    """
    ship_package(x.sparkSession)
    shared = x.sparkSession.sparkContext.broadcast((list(centres), list(wanted), list(salts)))

    def best(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        centres, wanted, salts = shared.value
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros((0, 0)))] * len(wanted)
        for b in batches:
            if b.num_rows == 0:
                continue
            rows = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            h = b.column(1).to_numpy().view(np.uint64)
            _, first = np.unique(h, return_index=True)
            rows, h = rows[first], h[first]
            for i, (own, n, salt) in enumerate(zip(centres, wanted, salts)):
                u = (_mixed(h ^ _mixed(np.uint64(salt) + np.zeros(1, np.uint64))) >> np.uint64(11)).astype(float) + 0.5
                far = np.ones(len(rows)) if own is None else _squared_distances(rows, own).min(1)
                # Rows on a centre, up to rounding, are no candidates.
                scale = 1.0 if own is None else (rows * rows).sum(1) + (own * own).sum(1).max()
                with np.errstate(divide="ignore"):
                    key = np.where(far > 1e-12 * scale, -np.log(u / 2.0**53) / far, np.inf)
                key, points = np.concatenate([kept[i][0], key]), np.vstack([kept[i][1].reshape(-1, rows.shape[1]), rows])
                first = np.argpartition(key, 2 * n)[: 2 * n] if len(key) > 4 * n else np.arange(len(key))
                order = first[np.argsort(key[first], kind="stable")][: 2 * n]
                order = order[np.isfinite(key[order])]
                key, points = key[order], points[order]
                new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
                kept[i] = key[new][:n], points[new][:n]
        for i, (key, points) in enumerate(kept):
            if len(key):
                yield pa.RecordBatch.from_pydict({"fit": pa.array(np.full(len(key), i), pa.int32()), "key": pa.array(key), "x": pa.array(list(points), pa.list_(pa.float64()))})

    drawn = x.select("x", F.xxhash64("x").alias("h")).mapInArrow(best, "fit int, key double, x array<double>").groupBy("fit", "x").agg(F.min("key").alias("key"))
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("fit").orderBy("key", "x")))
    limits = F.array(*[F.lit(int(n)) for n in wanted])
    out: list[list[list[float]]] = [[] for _ in wanted]
    for r in ranked.filter(F.col("rank") <= limits[F.col("fit")]).orderBy("fit", "rank").collect():
        out[r["fit"]].append(r["x"])
    shared.unpersist()
    return [np.array(rows, float) for rows in out]


def _candidate_counts(batch: pa.RecordBatch, fits: Sequence[np.ndarray]) -> list[np.ndarray]:
    x = columns_of(batch)
    return [np.bincount(_squared_distances(x, c).argmin(1), minlength=len(c)).astype(float) for c in fits]


def _starts(x: DataFrame, grid: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    """Parallel k-means++ starts of every (k, seed) over all rows; only candidates, about six per cluster, reach the driver."""
    pools = _drawn(x, [None] * len(grid), [1] * len(grid), [seed for _, seed in grid])
    for turn in range(1, SEED_ROUNDS + 1):
        more = _drawn(x, pools, [2 * k for k, _ in grid], [seed * 1009 + turn for _, seed in grid])
        pools = [np.vstack([a, b]) if len(b) else a for a, b in zip(pools, more)]
    sizes = [len(p) for p in pools]
    weights: list[np.ndarray] = [np.zeros(0)] * len(pools)
    for group in batched_by_size(pools, [n * pools[0].shape[1] for n in sizes]):
        for i, w in zip(group, sum_statistics(x, [pools[i] for i in group], _candidate_counts, [sizes[i] for i in group])):
            weights[i] = w
    return [_spread_out_start(rows, k, seed, w) for rows, w, (k, seed) in zip(pools, weights, grid)]


def _spread_out_start(rows: np.ndarray, k: int, seed: int, weights: np.ndarray) -> np.ndarray:
    """Weighted greedy k-means++ among candidates: of a few draws by weight times squared distance, the one that lowers the cost most."""
    rng = np.random.default_rng(seed)
    weights = np.maximum(weights, 1e-9)
    between = _squared_distances(rows, rows)
    chosen = [int(rng.choice(len(rows), p=weights / weights.sum()))]
    nearest = between[chosen[0]]
    draws = 2 + int(np.log(k))
    for _ in range(1, k):
        drawn = weights * nearest
        total = drawn.sum()
        some = rng.choice(len(rows), size=draws, p=drawn / total) if total > 0 else rng.integers(len(rows), size=1)
        costs = [(weights * np.minimum(nearest, between[i])).sum() for i in some]
        at = int(some[int(np.argmin(costs))])
        chosen.append(at)
        nearest = np.minimum(nearest, between[at])
    return rows[chosen].copy()


def _squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2.0 * (x @ centres.T)
    return np.maximum(sq, 0.0)


def _indicator(labels: np.ndarray, k: int) -> np.ndarray:
    hot = np.zeros((len(labels), k))
    hot[np.arange(len(labels)), labels] = 1.0
    return hot


# Numbers that a batch holds at once while it is summed for many fits (8 MB).
_CHUNK_VALUES = 1_000_000


def _slices(ks: Sequence[int]) -> list[slice]:
    ends = np.cumsum(ks).tolist()
    return [slice(end - k, end) for k, end in zip(ks, ends)]


def _nearest_of_each(x: np.ndarray, centres: np.ndarray, own: Sequence[slice]) -> np.ndarray:
    """Rows x all clusters of all fits: one where a row is nearest within its fit."""
    cost = (centres * centres).sum(1) - 2.0 * (x @ centres.T)
    hot, every = np.zeros(cost.shape), np.arange(len(x))
    for s in own:
        hot[every, s.start + cost[:, s].argmin(1)] = 1.0
    return hot


def _lloyd_statistics(batch: pa.RecordBatch, fits: Sequence[np.ndarray]) -> list[np.ndarray]:
    x, centres, own = columns_of(batch), np.vstack(fits), _slices([len(c) for c in fits])
    count, total = np.zeros(len(centres)), np.zeros(centres.shape)
    step = max(64, _CHUNK_VALUES // len(centres))
    for low in range(0, len(x), step):
        part = x[low : low + step]
        hot = _nearest_of_each(part, centres, own)
        count += hot.sum(0)
        total += hot.T @ part
    return [np.concatenate([count[s], total[s].ravel()]) for s in own]


def _costs(batch: pa.RecordBatch, fits: Sequence[np.ndarray]) -> list[np.ndarray]:
    x = columns_of(batch)
    return [np.array([_squared_distances(x, c).min(1).sum()]) for c in fits]


def kmeans_costs(x: DataFrame, fits: Sequence[np.ndarray]) -> list[float]:
    """Sum of squared distances to the nearest centre, for all fits from one scan of ``points``."""
    return [float(s[0]) for s in sum_statistics(x, list(fits), _costs, [1] * len(fits))]


def fit_kmeans_sweep(
    x: DataFrame,
    grid: Sequence[tuple[int, int]],
    n_rows: int,
    max_iter: int = 300,
    tol: float = 1e-4,
) -> list[np.ndarray]:
    """Centres of every (k, seed) fit; one scan per iteration serves all fits that still move.

    ``x`` is a persisted frame of scaled ``points``, best ``spread``.  A fit ends when its centres move
    by less than ``tol`` in total squared distance.  Starts are drawn from all rows.
    """
    fits = _starts(x, grid)
    d = fits[0].shape[1]
    tasks = partitions_for(x.sparkSession, n_rows, d)
    running = list(range(len(fits)))
    for _ in range(max_iter):
        moving = []
        sizes = [len(fits[i]) * (d + 1) for i in running]
        for group in batched_by_size(running, sizes):
            members = [running[g] for g in group]
            stats = sum_statistics(x, [fits[i] for i in members], _lloyd_statistics, [sizes[g] for g in group], tasks)
            for i, flat in zip(members, stats):
                k = len(fits[i])
                count, total = flat[:k], flat[k:].reshape(k, d)
                # An empty cluster keeps its centre.
                moved = np.where(count[:, None] > 0, total / np.maximum(count, 1.0)[:, None], fits[i])
                shift = ((moved - fits[i]) ** 2).sum()
                fits[i] = moved
                if shift > tol:
                    moving.append(i)
        running = moving
        if not running:
            break
    return fits


def _features(x: np.ndarray) -> np.ndarray:
    """One, the columns, and the products of all pairs of columns, whose second moments are symmetric: half of them suffice."""
    d = x.shape[1]
    upper = np.triu_indices(d)
    out = np.empty((len(x), 1 + d + len(upper[0])))
    out[:, 0], out[:, 1 : 1 + d] = 1.0, x
    np.multiply(x[:, upper[0]], x[:, upper[1]], out=out[:, 1 + d :])
    return out


def _quadratic(p: Whitened) -> np.ndarray:
    """Features x components: coefficients by which features give the log of weight times density."""
    k, d = p.centres.shape
    axes = p.axes.reshape(d, k, d).transpose(1, 0, 2)
    precision = axes @ axes.transpose(0, 2, 1)
    upper = np.triu_indices(d)
    products = precision[:, upper[0], upper[1]] * np.where(upper[0] == upper[1], -0.5, -1.0)
    linear = np.einsum("kde,ke->kd", axes, p.centres)
    return np.column_stack([p.constants - 0.5 * (p.centres**2).sum(1), linear, products]).T


# Most rounding of a log density that may come from its features; beyond that it comes from whitened rows.
_FEATURE_ROUNDING = 1e-9


def _densities_of(fits: Sequence[GaussianParams], reach: float) -> list[np.ndarray | Whitened]:
    """Every mixture as coefficients of features, or whitened where its covariances are too narrow for rows up to ``reach``."""
    out: list[np.ndarray | Whitened] = []
    for p in fits:
        w = Whitened.of(p)
        theta = _quadratic(w)
        d = w.centres.shape[1]
        scale = np.concatenate([[1.0], np.full(d, reach), np.full(len(theta) - 1 - d, reach * reach)])
        exact = np.finfo(float).eps * (scale @ np.abs(theta)).max() <= _FEATURE_ROUNDING
        out.append(theta if exact else w)
    return out


def _moment_sums(x: np.ndarray, ks: Sequence[int], weigh: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Per fit its total, and sizes, sums and second moments of its components.

    ``weigh(rows, features)`` gives the totals per fit and the weights (rows x all components of all fits). All fits share one
    product of weights and features.
    """
    d, own = x.shape[1], _slices(ks)
    totals, acc = np.zeros(len(own)), 0.0
    step = max(64, _CHUNK_VALUES // max(sum(ks), 1 + d + d * (d + 1) // 2))
    for low in range(0, len(x), step):
        part = x[low : low + step]
        features = _features(part)
        total, weights = weigh(part, features)
        totals += total
        acc = acc + weights.T @ features
    return [np.concatenate([[t], acc[s, 0], acc[s, 1 : 1 + d].ravel(), acc[s, 1 + d :].ravel()]) for t, s in zip(totals, own, strict=True)]


def _hard_statistics(batch: pa.RecordBatch, fits: Sequence[np.ndarray]) -> list[np.ndarray]:
    ks, centres = [len(c) for c in fits], np.vstack(fits)
    own = _slices(ks)
    return _moment_sums(columns_of(batch), ks, lambda rows, _: (np.zeros(len(own)), _nearest_of_each(rows, centres, own)))


def _soft_statistics(batch: pa.RecordBatch, fits: Sequence[np.ndarray | Whitened]) -> list[np.ndarray]:
    x = columns_of(batch)
    ks = [f.shape[1] if isinstance(f, np.ndarray) else len(f.centres) for f in fits]
    own = _slices(ks)
    starts = [s.start for s in own]
    theta = np.hstack([f if isinstance(f, np.ndarray) else np.zeros((1 + x.shape[1] + x.shape[1] * (x.shape[1] + 1) // 2, k)) for f, k in zip(fits, ks)])

    def weigh(rows: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        joint = features @ theta
        for f, s in zip(fits, own):
            if isinstance(f, Whitened):
                joint[:, s] = _component_log_density(rows, f)
        top = np.maximum.reduceat(joint, starts, axis=1)
        joint -= np.repeat(top, ks, axis=1)
        np.exp(joint, out=joint)
        total = np.add.reduceat(joint, starts, axis=1)
        joint /= np.repeat(total, ks, axis=1)
        return (top + np.log(total)).sum(0), joint

    return _moment_sums(x, ks, weigh)


def _gaussian_update(flat: np.ndarray, k: int, d: int) -> GaussianParams:
    n = flat[1 : 1 + k] + 10.0 * np.finfo(float).eps
    means = flat[1 + k : 1 + k + k * d].reshape(k, d) / n[:, None]
    upper, second = np.triu_indices(d), np.zeros((k, d, d))
    second[:, upper[0], upper[1]] = second[:, upper[1], upper[0]] = flat[1 + k + k * d :].reshape(k, -1) / n[:, None]
    cov = second - means[:, :, None] * means[:, None, :] + COVARIANCE_FLOOR * np.eye(d)
    return GaussianParams(n / n.sum(), means, cov)


def fit_gaussian_mixture_sweep(
    x: DataFrame,
    grid: Sequence[tuple[int, int]],
    n_rows: int,
    max_iter: int = 100,
    tol: float = 1e-3,
) -> list[GaussianParams]:
    """Full-covariance mixtures of every (k, seed), started from the k-means fit of the same seed.

    ``tol`` is the change in mean log-likelihood that ends a fit.
    """
    starts = fit_kmeans_sweep(x, grid, n_rows)
    d = starts[0].shape[1]
    sizes = [1 + k * (1 + d + d * (d + 1) // 2) for k, _ in grid]
    fits: list[GaussianParams] = [None] * len(grid)
    for group in batched_by_size(starts, sizes):
        stats = sum_statistics(x, [starts[i] for i in group], _hard_statistics, [sizes[i] for i in group])
        for i, flat in zip(group, stats):
            fits[i] = _gaussian_update(flat, grid[i][0], d)
    reach = x.select(F.max(F.array_max(F.transform("x", F.abs)))).first()[0]
    last = [-np.inf] * len(grid)
    running = list(range(len(grid)))
    for _ in range(max_iter):
        moving = []
        for group in batched_by_size(running, [sizes[i] for i in running]):
            members = [running[g] for g in group]
            stats = sum_statistics(x, _densities_of([fits[i] for i in members], reach), _soft_statistics, [sizes[i] for i in members])
            for i, flat in zip(members, stats):
                fits[i] = _gaussian_update(flat, grid[i][0], d)
                mean_ll = flat[0] / n_rows
                if abs(mean_ll - last[i]) >= tol:
                    moving.append(i)
                last[i] = mean_ll
        running = moving
        if not running:
            break
    return fits


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return _squared_distances(x, centres).argmin(1)


def _likeliest(x: np.ndarray, p: Whitened) -> np.ndarray:
    return _component_log_density(x, p).argmax(1)


def label_sweep(df: DataFrame, cols: Sequence[str], fits: Sequence[np.ndarray | GaussianParams]) -> DataFrame:
    """The columns with ``labels``: the hard assignment under every fit, from one scan."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast([Whitened.of(f) if isinstance(f, GaussianParams) else f for f in fits])

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rules: list[tuple[Callable, object]] = [
            (_likeliest if isinstance(f, Whitened) else _nearest, f) for f in shared.value
        ]
        for b in batches:
            if b.num_rows == 0:
                continue
            x = columns_of(b)
            labels = np.stack([rule(x, f) for rule, f in rules], axis=1).astype(np.int32)
            offsets = np.arange(0, labels.size + 1, labels.shape[1], dtype=np.int32)
            nested = pa.ListArray.from_arrays(pa.array(offsets), pa.array(labels.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, nested], names=[*cols, "labels"])

    schema = ", ".join(f"{quoted(c)} double" for c in cols) + ", labels array<int>"
    return doubles(df, cols).mapInArrow(assign, schema)
