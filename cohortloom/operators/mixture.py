"""Latent-class mixture over binary, categorical and continuous columns, with covariates on class membership.

Expectation-maximization runs as one Spark job per iteration for *all* fits
still running (every k, repeat and restart): tasks score their rows under
every fit and add the sufficient statistics up, Spark sums them, and the
driver sees only as many numbers as the models have parameters.

Two steps of a fit show where its path leads, so every third scan tries a point further along it (squared extrapolation). A try that
lowers the likelihood is dropped and the fit goes on from where the two steps ended, so the likelihood never falls.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.numeric import hash_order
from cohortloom.functions.sql import named, quoted
from cohortloom.operators.passes import batched_by_size, doubles, partitions_for, spread, sum_statistics
from cohortloom.operators.scale import vector_moments
from cohortloom.session import ship_package

PROBABILITY_FLOOR = 1e-10
VARIANCE_FLOOR = 1e-6
# Distinct profiles per class from which the starts of every fit are chosen.
START_POOL = 24
# Rows read for each profile of the pool before all rows are grouped by profile.
START_SPARE = 4


@dataclass(frozen=True)
class Descriptor:
    """Indicator columns by kind, and the covariates."""

    binary: tuple[str, ...] = ()
    continuous: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    levels: tuple[tuple[float, ...], ...] = ()
    covariates: tuple[str, ...] = ()

    @classmethod
    def from_kinds(cls, kinds: DataFrame, covariates: Sequence[str] = ()) -> Descriptor:
        rows = kinds.orderBy("position").collect()
        pick = lambda kind: tuple(r["column"] for r in rows if r["kind"] == kind)
        levels = tuple(tuple(r["levels"]) for r in rows if r["kind"] == "categorical")
        return cls(pick("binary"), pick("continuous"), pick("categorical"), levels, tuple(covariates))

    @property
    def columns(self) -> list[str]:
        return [*self.binary, *self.continuous, *self.categorical, *self.covariates]

    @property
    def n_levels(self) -> int:
        return sum(len(v) for v in self.levels)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(c, "binary", 2) for c in self.binary]
        rows += [(c, "continuous", None) for c in self.continuous]
        rows += [(c, "categorical", len(v)) for c, v in zip(self.categorical, self.levels)]
        rows += [(c, "covariate", None) for c in self.covariates]
        return spark.createDataFrame(rows, "column string, kind string, n_levels int")

    def n_parameters(self, k: int) -> int:
        """Estimated parameters of a k-class fit."""
        free = len(self.binary) + 2 * len(self.continuous) + sum(max(len(v) - 1, 0) for v in self.levels)
        return k * free + (k - 1) * (1 + len(self.covariates))


@dataclass(frozen=True)
class MixtureFit:
    """Parameters of one fit; ``beta`` rows are classes, the first one fixed at zero."""

    k: int
    repeat: int
    restart: int
    p_binary: np.ndarray
    mean: np.ndarray
    variance: np.ndarray
    p_levels: np.ndarray
    beta: np.ndarray
    shares: np.ndarray
    log_likelihood: float = -np.inf
    iterations: int = 0
    converged: bool = False
    trace: tuple[float, ...] = field(default=(), repr=False)


class _Layout:
    """Turns Arrow batches into matrices and statistics into flat vectors."""

    def __init__(self, d: Descriptor, centre: np.ndarray, z_mean: np.ndarray, z_scale: np.ndarray):
        self.d, self.centre, self.z_mean, self.z_scale = d, centre, z_mean, z_scale
        self.q = 1 + len(d.covariates)

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        d = self.d
        take = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(d.columns))]
        n, nb, ng, nc = batch.num_rows, len(d.binary), len(d.continuous), len(d.categorical)
        stack = lambda cols: np.column_stack(cols) if cols else np.zeros((n, 0))
        binary, gauss = stack(take[:nb]), stack(take[nb : nb + ng]) - self.centre
        hot = np.zeros((n, d.n_levels))
        start = 0
        for col, values in zip(take[nb + ng : nb + ng + nc], d.levels):
            at = np.searchsorted(values, col)
            at = np.minimum(at, len(values) - 1)
            hot[np.arange(n), start + at] = np.asarray(values)[at] == col
            start += len(values)
        z = np.column_stack([np.ones(n), (stack(take[nb + ng + nc :]) - self.z_mean) / self.z_scale])
        return binary, gauss, hot, z

    def measurement(self, fit: MixtureFit, binary: np.ndarray, gauss: np.ndarray, hot: np.ndarray) -> np.ndarray:
        p = np.clip(fit.p_binary, PROBABILITY_FLOOR, 1.0 - PROBABILITY_FLOOR)
        out = binary @ np.log(p).T + (1.0 - binary) @ np.log1p(-p).T
        out += hot @ np.log(np.maximum(fit.p_levels, PROBABILITY_FLOOR)).T
        for c in range(fit.k):
            gap = gauss - (fit.mean[c] - self.centre)
            out[:, c] -= 0.5 * (np.log(2.0 * np.pi * fit.variance[c]).sum() + (gap * gap / fit.variance[c]).sum(1))
        return out

    def membership(self, fit: MixtureFit, z: np.ndarray, with_covariates: bool) -> np.ndarray:
        if not with_covariates:
            return np.broadcast_to(np.log(np.maximum(fit.shares, 1e-300)), (len(z), fit.k))
        score = z @ fit.beta.T
        return score - _log_sum_exp(score)[:, None]


def _log_sum_exp(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1)
    return top + np.log(np.exp(a - top[:, None]).sum(axis=1))


def _posterior(
    layout: _Layout, fit: MixtureFit, batch_parts: tuple, with_covariates: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    binary, gauss, hot, z = batch_parts
    prior = layout.membership(fit, z, with_covariates)
    joint = layout.measurement(fit, binary, gauss, hot) + prior
    ll = _log_sum_exp(joint)
    return np.exp(joint - ll[:, None]), prior, ll


def _slots(layout: _Layout, k: int) -> dict[str, tuple[int, tuple[int, ...]]]:
    """Where each statistic lives in the flat vector of a k-class fit."""
    d = layout.d
    shapes = {
        "ll": (1,), "n": (k,), "binary": (k, len(d.binary)), "sum": (k, len(d.continuous)),
        "square": (k, len(d.continuous)), "hot": (k, d.n_levels), "gradient": (k, layout.q),
        "hessian": (k, k, layout.q, layout.q), "zz": (layout.q, layout.q),
    }
    out, at = {}, 0
    for name, shape in shapes.items():
        out[name] = (at, shape)
        at += int(np.prod(shape))
    out["end"] = (at, ())
    return out


def _statistics(layout: _Layout, fit: MixtureFit, parts: tuple) -> np.ndarray:
    binary, gauss, hot, z = parts
    r, prior, ll = _posterior(layout, fit, parts, True)
    p = np.exp(prior)
    hessian = np.empty((fit.k, fit.k, layout.q, layout.q))
    for a in range(fit.k):
        for b in range(fit.k):
            hessian[a, b] = z.T @ (z * (p[:, a] * ((a == b) - p[:, b]))[:, None])
    pieces = [
        np.array([ll.sum()]), r.sum(0), r.T @ binary, r.T @ gauss, r.T @ (gauss * gauss), r.T @ hot,
        (r - p).T @ z, hessian, z.T @ z,
    ]
    return np.concatenate([x.ravel() for x in pieces])


# Shares that the fits of one size hold at once in a task (0.5 MB, so that they stay in the cache), and the most rounding of a log density that may
# come from products of columns.
_CHUNK_VALUES = 65_536
_FEATURE_ROUNDING = 1e-9


def _coefficients(layout: _Layout, fits: Sequence[MixtureFit]) -> np.ndarray:
    """Classes x features x fits: the log densities of fits of one size are products with one, binary, continuous, squared and level columns."""
    p = np.clip([f.p_binary for f in fits], PROBABILITY_FLOOR, 1.0 - PROBABILITY_FLOOR)
    mean, variance = np.array([f.mean for f in fits]) - layout.centre, np.array([f.variance for f in fits])
    constant = np.log1p(-p).sum(2) - 0.5 * (np.log(2.0 * np.pi * variance) + mean * mean / variance).sum(2)
    levels = np.log(np.maximum([f.p_levels for f in fits], PROBABILITY_FLOOR))
    every = np.concatenate([constant[:, :, None], np.log(p) - np.log1p(-p), mean / variance, -0.5 / variance, levels], axis=2)
    return np.ascontiguousarray(every.transpose(1, 2, 0))


def _normalized(joint: np.ndarray) -> np.ndarray:
    """Classes x rows x fits of logarithms become shares of the classes, in place; returns the logarithms of their sums."""
    top = joint.max(axis=0)
    joint -= top
    np.exp(joint, out=joint)
    total = joint.sum(axis=0)
    joint *= 1.0 / total
    return top + np.log(total)


def _sized_statistics(layout: _Layout, fits: Sequence[MixtureFit], parts: tuple) -> list[np.ndarray]:
    """``_statistics`` of many fits with equally many classes: they share the products of their columns.

    Shares are laid out classes x rows x fits, so that sums over classes and products of two classes run along memory. The curvature of the
    memberships needs only pairs of different classes, since its rows add up to zero.
    """
    k, g, q, ng = fits[0].k, len(fits), layout.q, len(layout.d.continuous)
    theta = _coefficients(layout, fits)
    beta = np.ascontiguousarray(np.array([f.beta for f in fits]).transpose(1, 2, 0))
    upper = np.triu_indices(q)
    ll, zz = np.zeros(g), np.zeros((q, q))
    acc, gradient = np.zeros((k, theta.shape[1], g)), np.zeros((k, q, g))
    cross = np.zeros((k, k, len(upper[0]), g))
    step = max(16, _CHUNK_VALUES // (k * g))
    for low in range(0, len(parts[0]), step):
        binary, gauss, hot, z = (x[low : low + step] for x in parts)
        features = np.hstack([np.ones((len(z), 1)), binary, gauss, gauss * gauss, hot])
        squares = z[:, upper[0]] * z[:, upper[1]]
        p = z @ beta
        r = features @ theta
        r += p
        r -= _normalized(p)
        ll += _normalized(r).sum(0)
        acc += features.T @ r
        zz += z.T @ z
        for a in range(k - 1):
            cross[a, a + 1 :] += squares.T @ (p[a] * p[a + 1 :])
        r -= p
        gradient += z.T @ r
    nb, at = len(layout.d.binary), 1 + len(layout.d.binary)
    acc, gradient = acc.transpose(2, 0, 1), gradient.transpose(2, 0, 1)
    hessian = np.zeros((g, k, k, q, q))
    hessian[..., upper[0], upper[1]] = -(cross + cross.swapaxes(0, 1)).transpose(3, 0, 1, 2)
    hessian[..., upper[1], upper[0]] = hessian[..., upper[0], upper[1]]
    hessian[:, np.arange(k), np.arange(k)] = -hessian.sum(2)
    out = []
    for i in range(g):
        own = acc[i]
        pieces = [
            ll[i : i + 1], own[:, 0], own[:, 1 : 1 + nb], own[:, at : at + ng], own[:, at + ng : at + 2 * ng], own[:, at + 2 * ng :],
            gradient[i], hessian[i], zz,
        ]
        out.append(np.concatenate([x.ravel() for x in pieces]))
    return out


def _batch_statistics(batch: pa.RecordBatch, state: tuple) -> list[np.ndarray]:
    """Fits of one size together; those with a variance too small for products of columns one by one."""
    layout, fits = state
    parts = layout.read(batch)
    reach = np.abs(parts[1]).max(axis=0, initial=0.0)
    out: list[np.ndarray] = [np.zeros(0)] * len(fits)
    sized: dict[int, list[int]] = {}
    for i, f in enumerate(fits):
        far = (reach + np.abs(f.mean - layout.centre)) ** 2 / f.variance
        if np.finfo(float).eps * far.sum(1).max(initial=0.0) <= _FEATURE_ROUNDING:
            sized.setdefault(f.k, []).append(i)
        else:
            out[i] = _statistics(layout, f, parts)
    for members in sized.values():
        for i, own in zip(members, _sized_statistics(layout, [fits[i] for i in members], parts), strict=True):
            out[i] = own
    return out


def _sweep(frame: DataFrame, layout: _Layout, fits: Sequence[MixtureFit], tasks: int | None = None) -> list[dict[str, np.ndarray]]:
    """Sufficient statistics of all fits, sharing as few scans as their size allows."""
    wheres = [_slots(layout, f.k) for f in fits]
    sizes = [w["end"][0] for w in wheres]
    out: list[dict[str, np.ndarray]] = []
    for group in batched_by_size(fits, sizes):
        flats = sum_statistics(
            frame, (layout, [fits[i] for i in group]), _batch_statistics, [sizes[i] for i in group], tasks
        )
        out += [
            {
                name: flat[at : at + int(np.prod(shape))].reshape(shape)
                for name, (at, shape) in wheres[i].items()
                if name != "end"
            }
            for i, flat in zip(group, flats)
        ]
    return out


def _covariate_step(fit: MixtureFit, s: dict[str, np.ndarray], safe: bool = False) -> np.ndarray:
    """Newton step on the membership coefficients, or a slower one that can never lower the likelihood.

    The safe step replaces the curvature by a fixed upper bound of it.
    """
    k, q = fit.beta.shape
    grad = s["gradient"][1:].ravel()
    if k == 1:
        return fit.beta
    if safe:
        h = np.kron(0.5 * (np.eye(k - 1) - np.full((k - 1, k - 1), 1.0 / k)), s["zz"])
    else:
        h = s["hessian"][1:, 1:].transpose(0, 2, 1, 3).reshape((k - 1) * q, (k - 1) * q)
    ridge = 1e-9 * max(1.0, np.trace(s["zz"])) * np.eye((k - 1) * q)
    beta = fit.beta.copy()
    beta[1:] += np.linalg.lstsq(h + ridge, grad, rcond=None)[0].reshape(k - 1, q)
    return beta


def _maximize(layout: _Layout, fit: MixtureFit, s: dict[str, np.ndarray]) -> MixtureFit:
    weight = np.maximum(s["n"], 1e-12)[:, None]
    mean = s["sum"] / weight
    start, p_levels = 0, s["hot"].copy()
    for v in layout.d.levels:
        block = p_levels[:, start : start + len(v)]
        block /= np.maximum(block.sum(1, keepdims=True), 1e-300)
        start += len(v)
    return replace(
        fit,
        p_binary=s["binary"] / weight,
        mean=mean + layout.centre,
        variance=np.maximum(s["square"] / weight - mean * mean, VARIANCE_FLOOR),
        p_levels=p_levels,
        beta=_covariate_step(fit, s),
        shares=s["n"] / s["n"].sum(),
    )


def _profiles(rows: Sequence[Row], d: Descriptor, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Rows as points: binary and continuous columns in units of their deviation, a coordinate for each level of a category."""
    measured = [*d.binary, *d.continuous]
    n = len(measured)
    x = np.array([[float(r[c]) for c in measured] for r in rows]).reshape(len(rows), n)
    x = (x - mean[:n]) / np.where(var[:n] > 0, np.sqrt(var[:n]), 1.0)
    levels = [[float(float(r[c]) == v) for c, values in zip(d.categorical, d.levels) for v in values] for r in rows]
    return np.hstack([x, np.array(levels).reshape(len(rows), d.n_levels)])


def _spread_out(x: np.ndarray, k: int, rng: np.random.Generator) -> list[int]:
    """k rows far from one another: the first at random, each next by its squared distance to those chosen."""
    chosen = [int(rng.integers(len(x)))]
    nearest = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        total = nearest.sum()
        at = int(rng.choice(len(x), p=nearest / total)) if total > 0 else int(rng.integers(len(x)))
        chosen.append(at)
        nearest = np.minimum(nearest, ((x - x[at]) ** 2).sum(1))
    return chosen


def _start(df: DataFrame, key: str, d: Descriptor, fits: Sequence[tuple[int, int, int]], seed: int) -> tuple[_Layout, list[MixtureFit], int]:
    """Layout, starting values and the number of rows: classes start at distinct rows far apart, blended with the overall profile and slightly shaken."""
    numeric = [*d.binary, *d.continuous, *d.covariates]
    if numeric:
        n, moments = vector_moments(df, numeric)
    else:
        n, moments = df.count(), {}
    if not n:
        raise ValueError("the mixture needs at least one row")
    mean = np.array([moments[c][0] for c in numeric])
    var = np.array([moments[c][1] ** 2 for c in numeric])
    nb, ng = len(d.binary), len(d.continuous)
    z_scale = np.sqrt(var[nb + ng :])
    layout = _Layout(d, mean[nb : nb + ng], mean[nb + ng :], np.where(z_scale > 0, z_scale, 1.0))
    # The first distinct profiles in the order of key hash and row content: a bounded top-k in every task.
    pool = START_POOL * max(k for k, _, _ in fits)
    digest = F.expr(f"xxhash64({', '.join(map(quoted, d.columns))})")
    order = F.concat(hash_order(key, seed), F.hex(digest))
    ordered = df.select(*d.columns, order.alias("_h"))
    # Rows in the order of their hashes show the first distinct profiles; only where rows repeat too much are all of them grouped.
    rows: list[Row] = list(dict.fromkeys(r[:-1] for r in ordered.orderBy("_h").limit(START_SPARE * pool).collect()))[:pool]
    if len(rows) < pool:
        first = ordered.groupBy(*d.columns).agg(F.min("_h").alias("_h"))
        rows = [tuple(r) for r in first.orderBy("_h").limit(pool).select(*d.columns).collect()]
    rows = [Row(*d.columns)(*r) for r in rows]
    profiles = _profiles(rows, d, mean, var)
    rng = np.random.default_rng(seed)
    out = []
    for k, repeat, restart in fits:
        chosen = [rows[i] for i in _spread_out(profiles, k, rng)]
        b = np.array([[float(r[c]) for c in d.binary] for r in chosen]).reshape(k, nb)
        g = np.array([[float(r[c]) for c in d.continuous] for r in chosen]).reshape(k, ng)
        hot = np.zeros((k, d.n_levels))
        start = 0
        for c, values in zip(d.categorical, d.levels):
            for i, r in enumerate(chosen):
                hot[i, start : start + len(values)] = [
                    0.5 * (float(r[c]) == v) + 0.5 / len(values) for v in values
                ]
            start += len(values)
        out.append(
            MixtureFit(
                k, repeat, restart,
                p_binary=np.clip(0.5 * b + 0.5 * np.clip(mean[:nb], 0.05, 0.95) + rng.uniform(-0.02, 0.02, b.shape), 0.01, 0.99),
                mean=g + rng.uniform(-0.01, 0.01, g.shape) * np.sqrt(var[nb : nb + ng]),
                variance=np.tile(np.maximum(var[nb : nb + ng], VARIANCE_FLOOR), (k, 1)),
                p_levels=hot,
                beta=np.zeros((k, layout.q)),
                shares=np.full(k, 1.0 / k),
            )
        )
    return layout, out, n


@dataclass(frozen=True)
class FittedMixtures:
    layout: _Layout
    fits: list[MixtureFit]

    def best(self) -> list[MixtureFit]:
        """Per k and repeat, the restart with the highest likelihood, classes ordered by share."""
        chosen: dict[tuple[int, int], MixtureFit] = {}
        for f in self.fits:
            at = (f.k, f.repeat)
            if at not in chosen or f.log_likelihood > chosen[at].log_likelihood:
                chosen[at] = f
        return [_by_share(f) for f in chosen.values()]


def _by_share(f: MixtureFit) -> MixtureFit:
    order = np.argsort(-f.shares, kind="stable")
    beta = f.beta[order] - f.beta[order][0]
    return replace(
        f, p_binary=f.p_binary[order], mean=f.mean[order], variance=f.variance[order],
        p_levels=f.p_levels[order], shares=f.shares[order], beta=beta,
    )


class _Path:
    """One fit on its way: plain steps, and after every second one a try further along (Varadhan and Roland 2008, scheme S3)."""

    def __init__(self, layout: _Layout, start: MixtureFit, tol: float, accelerate: bool):
        self.layout, self.current, self.tol, self.accelerate = layout, start, tol, accelerate
        self.known: MixtureFit | None = None
        self.slow: Callable[[], np.ndarray] | None = None
        self.steps: list[MixtureFit] = []
        self.ahead: MixtureFit | None = None
        self.done = False
        self.scans = 0

    def take(self, s: dict[str, np.ndarray]) -> None:
        """Statistics of the current parameters arrive: accept them and go on, or go back."""
        ll, n, last = float(s["ll"][0]), s["n"].sum(), self.known
        self.scans += 1
        falls = last is not None and not ll >= last.log_likelihood - 1e-9 * abs(last.log_likelihood)
        if self.ahead is not None:
            resume, self.ahead = self.ahead, None
            if falls:
                # The try went too far: on from the end of the two steps.
                self.current, self.steps = resume, []
                return
            self.steps = []
        elif falls:
            if self.slow is None:
                self.known, self.done = replace(last, converged=True), True
            else:
                self.current, self.slow = replace(self.current, beta=self.slow()), None
            return
        elif last is not None and (ll - last.log_likelihood) / n < self.tol:
            self.known, self.done = self._accepted(ll, True), True
            return
        self.known = self._accepted(ll, False)
        moved, known = _maximize(self.layout, self.known, s), self.known
        self.slow = lambda: _covariate_step(known, s, safe=True)
        self.steps.append(self.known)
        if self.accelerate and len(self.steps) == 2:
            further = _further(self.steps[0], self.steps[1], moved, self.layout)
            if further is not None:
                self.ahead, self.current, self.slow = moved, further, None
                return
            self.steps = []
        self.current = moved

    def _accepted(self, ll: float, converged: bool) -> MixtureFit:
        trace = self.known.trace if self.known is not None else ()
        return replace(self.current, log_likelihood=ll, iterations=self.scans, trace=(*trace, ll), converged=converged)


def _flat(fit: MixtureFit) -> np.ndarray:
    """Parameters as one vector: probabilities as they are, means in standard deviations, variances as logarithms."""
    return np.concatenate([v.ravel() for v in (fit.p_binary, fit.mean, np.log(fit.variance), fit.p_levels, fit.beta)])


def _further(a: MixtureFit, b: MixtureFit, c: MixtureFit, layout: _Layout) -> MixtureFit | None:
    """The point that squared extrapolation of the steps a to b to c leads to; none where they do not reach beyond c."""
    unit = np.sqrt(np.maximum(a.variance, VARIANCE_FLOOR))
    scaled = [_flat(replace(f, mean=f.mean / unit)) for f in (a, b, c)]
    r, v = scaled[1] - scaled[0], scaled[2] - 2.0 * scaled[1] + scaled[0]
    length = np.linalg.norm(v)
    if length < 1e-12 or np.linalg.norm(r) <= length:
        return None
    alpha = -np.linalg.norm(r) / length
    parts = np.split(scaled[0] - 2.0 * alpha * r + alpha * alpha * v, np.cumsum([x.size for x in (a.p_binary, a.mean, a.variance, a.p_levels)]))
    p_levels, start = np.maximum(parts[3].reshape(a.p_levels.shape), PROBABILITY_FLOOR), 0
    for values in layout.d.levels:
        block = p_levels[:, start : start + len(values)]
        block /= block.sum(1, keepdims=True)
        start += len(values)
    log_variance = np.clip(parts[2].reshape(a.variance.shape), np.log(VARIANCE_FLOOR), 700.0)
    out = replace(
        c,
        p_binary=np.clip(parts[0].reshape(a.p_binary.shape), PROBABILITY_FLOOR, 1.0 - PROBABILITY_FLOOR),
        mean=parts[1].reshape(a.mean.shape) * unit,
        variance=np.exp(log_variance),
        p_levels=p_levels,
        beta=parts[4].reshape(a.beta.shape),
    )
    return out if np.isfinite(_flat(out)).all() else None


def fit_mixtures(
    df: DataFrame,
    key: str,
    descriptor: Descriptor,
    k_values: Sequence[int],
    repeats: int = 1,
    restarts: int = 1,
    max_iter: int = 1000,
    tol: float = 1e-4,
    seed: int = 1,
    accelerate: bool = True,
) -> FittedMixtures:
    """Fit every (k, repeat, restart).  ``tol`` is the gain in mean log-likelihood of a plain step that ends a fit.

    The columns are spread over all cores and kept for the scans, one per iteration.
    """
    grid = [(k, r, s) for k in k_values for r in range(repeats) for s in range(restarts)]
    layout, starts, n = _start(df, key, descriptor, grid, seed)
    width = max(1, len(descriptor.columns))
    tasks = partitions_for(df.sparkSession, n, width)
    frame = spread(doubles(df, descriptor.columns), n, width).persist()
    paths = [_Path(layout, start, tol, accelerate) for start in starts]
    try:
        for _ in range(max_iter):
            running = [p for p in paths if not p.done]
            if not running:
                break
            for path, s in zip(running, _sweep(frame, layout, [p.current for p in running], tasks), strict=True):
                path.take(s)
    finally:
        frame.unpersist()
    # Out of iterations: the last parameters whose likelihood is known stand.
    return FittedMixtures(layout, [p.known or p.current for p in paths])


def assign_classes(
    df: DataFrame, key: str, layout: _Layout, fit: MixtureFit, with_covariates: bool = False
) -> DataFrame:
    """``key, label, probabilities, log_likelihood`` per row; by default without the covariates."""
    cols = layout.d.columns
    lacking = [c for c in cols if c not in df.columns]
    if lacking:
        raise ValueError(f"the mixture needs the columns {lacking}")
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((layout, fit))
    key_type = df.schema[key].dataType.simpleString()

    def score(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        lay, model = shared.value
        for b in batches:
            if b.num_rows == 0:
                continue
            parts = lay.read(b.select(cols))
            r, _, ll = _posterior(lay, model, parts, with_covariates)
            yield pa.RecordBatch.from_arrays(
                [b.column("_key"), pa.array(r.argmax(1), pa.int32()), pa.array(list(r)), pa.array(ll)],
                names=[key, "label", "probabilities", "log_likelihood"],
            )

    narrow = df.selectExpr(
        named(quoted(key), "_key"), *[named(f"CAST({quoted(c)} AS DOUBLE)", c) for c in cols]
    )
    return narrow.mapInArrow(
        score, f"`{key}` {key_type}, label int, probabilities array<double>, log_likelihood double"
    )


RowStatistic = Callable[[np.ndarray, np.ndarray], float]
# Sums over rows that a scan delivers per fit, from the posteriors (rows x classes) and the log-likelihood of each row.
ROW_STATISTICS: dict[str, RowStatistic] = {
    "total_log_likelihood": lambda r, ll: ll.sum(),
    "entropy": lambda r, ll: -(r * np.log(np.maximum(r, 1e-300))).sum(),
    "rows": lambda r, ll: len(ll),
}


def fit_statistics(
    df: DataFrame, layout: _Layout, fits: Sequence[MixtureFit], with_covariates: bool = False, row_statistics: Mapping[str, RowStatistic] = ROW_STATISTICS
) -> list[dict[str, float]]:
    """Named statistics of every fit, all from one scan, with its size, its parameters and the mean log-likelihood it reached in fitting."""
    frame, wanted = doubles(df, layout.d.columns), list(row_statistics.values())

    def scores(batch: pa.RecordBatch, state: tuple) -> list[np.ndarray]:
        layout, fits = state
        parts, out = layout.read(batch), []
        for f in fits:
            r, _, ll = _posterior(layout, f, parts, with_covariates)
            out.append(np.array([float(own(r, ll)) for own in wanted]))
        return out

    sums = sum_statistics(frame, (layout, list(fits)), scores, [len(wanted)] * len(fits))
    out = []
    for fit, values in zip(fits, sums, strict=True):
        own = dict(zip(row_statistics, values.tolist(), strict=True))
        own |= {"k": fit.k, "n_parameters": layout.d.n_parameters(fit.k), "fitted_log_likelihood": fit.log_likelihood}
        out.append(own)
    return out


def score_fits(df: DataFrame, layout: _Layout, fits: Sequence[MixtureFit], with_covariates: bool = False) -> list[np.ndarray]:
    """Total log-likelihood, entropy and rows of every fit, from one scan."""
    return [np.array([s["total_log_likelihood"], s["entropy"], s["rows"]]) for s in fit_statistics(df, layout, fits, with_covariates)]


Metric = Callable[[Mapping[str, float]], float]
# Metrics of a sweep by name, as functions of the statistics of a fit.
SWEEP_METRICS: dict[str, Metric] = {
    "aic": lambda s: -2 * s["total_log_likelihood"] + 2 * s["n_parameters"],
    "bic": lambda s: -2 * s["total_log_likelihood"] + s["n_parameters"] * math.log(s["rows"]),
    "caic": lambda s: -2 * s["total_log_likelihood"] + s["n_parameters"] * (math.log(s["rows"]) + 1),
    "entropy": lambda s: s["entropy"],
    "scaled_entropy": lambda s: 1.0 - s["entropy"] / (s["rows"] * math.log(s["k"])) if s["k"] > 1 else 1.0,
    "log_likelihood": lambda s: s["fitted_log_likelihood"] / s["rows"],
}


def mixture_metrics(
    df: DataFrame,
    fitted: FittedMixtures,
    with_covariates: bool = False,
    metrics: Mapping[str, Metric] = SWEEP_METRICS,
    row_statistics: Mapping[str, RowStatistic] | None = None,
) -> DataFrame:
    """``k, repeat``, the metrics by their names and ``n_parameters`` of the best fit per (k, repeat), scored without covariates by default.

    A metric is a function of named statistics: those of ``ROW_STATISTICS`` and of the given ``row_statistics``, ``k``, ``n_parameters`` and
    ``fitted_log_likelihood``. All rows are scanned once for all of them.
    """
    best = fitted.best()
    statistics = fit_statistics(df, fitted.layout, best, with_covariates, {**ROW_STATISTICS, **(row_statistics or {})})
    rows = [(f.k, f.repeat, *(float(m(s)) for m in metrics.values()), s["n_parameters"]) for f, s in zip(best, statistics, strict=True)]
    schema = ", ".join(["k int", "repeat int", *(f"{quoted(m)} double" for m in metrics), "n_parameters int"])
    return df.sparkSession.createDataFrame(rows, schema)


# Version of the stored form of a mixture.
FORMAT = 1
PARAMETERS = "class int, parameter string, column string, level double, value double"


def parameter_table(spark: SparkSession, layout: _Layout, fit: MixtureFit) -> DataFrame:
    """Fitted parameters in tidy form, to be stored as Parquet and read by ``load_mixture``.

    Rows of class -1 hold the format version and the columns in order (value), with the levels of categories.
    """
    d = layout.d
    rows: list[tuple] = [(-1, "version", None, None, float(FORMAT))]
    kinds = [*((c, "binary", ()) for c in d.binary), *((c, "continuous", ()) for c in d.continuous)]
    kinds += [*((c, "categorical", v) for c, v in zip(d.categorical, d.levels, strict=True)), *((c, "covariate", ()) for c in d.covariates)]
    for place, (col, kind, levels) in enumerate(kinds):
        rows += [(-1, kind, col, float(v) if v is not None else None, float(place)) for v in (levels or (None,))]
    for c in range(fit.k):
        rows.append((c, "share", None, None, float(fit.shares[c])))
        rows += [(c, "probability", col, 1.0, float(v)) for col, v in zip(d.binary, fit.p_binary[c])]
        rows += [(c, "mean", col, None, float(v)) for col, v in zip(d.continuous, fit.mean[c])]
        rows += [(c, "variance", col, None, float(v)) for col, v in zip(d.continuous, fit.variance[c])]
        names = [(col, lv) for col, values in zip(d.categorical, d.levels) for lv in values]
        rows += [(c, "probability", col, float(lv), float(v)) for (col, lv), v in zip(names, fit.p_levels[c])]
        slopes = fit.beta[c][1:] / layout.z_scale
        rows.append((c, "intercept", None, None, float(fit.beta[c][0] - slopes @ layout.z_mean)))
        rows += [(c, "coefficient", col, None, float(v)) for col, v in zip(d.covariates, slopes)]
    return spark.createDataFrame(rows, PARAMETERS)


def mixture_of(table: DataFrame) -> tuple[_Layout, MixtureFit]:
    """Layout and parameters of a stored mixture; ``assign_classes`` takes both. The model's size is that of its columns and classes.

    Fails when the table is not such a store, is of another version, or lacks a parameter.
    """
    wanted = dict(part.split() for part in PARAMETERS.split(", "))
    found = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    if found != wanted:
        raise ValueError(f"a stored mixture has the columns {wanted}, not {found}")
    rows = table.collect()
    version = [r["value"] for r in rows if r["parameter"] == "version"]
    if version != [float(FORMAT)]:
        raise ValueError(f"stored mixture of version {version or 'none'}, this is {FORMAT}")
    heads = sorted((r for r in rows if r["class"] == -1 and r["column"] is not None), key=lambda r: (r["value"], r["level"] or 0.0))
    named_as = lambda kind: tuple(dict.fromkeys(r["column"] for r in heads if r["parameter"] == kind))
    levels = tuple(tuple(r["level"] for r in heads if r["column"] == c and r["parameter"] == "categorical") for c in named_as("categorical"))
    d = Descriptor(named_as("binary"), named_as("continuous"), named_as("categorical"), levels, named_as("covariate"))
    values = {(r["class"], r["parameter"], r["column"], r["level"]): r["value"] for r in rows}
    k = sum(r["parameter"] == "share" for r in rows)

    def read(parameter: str, keys: Sequence[tuple[str | None, float | None]]) -> np.ndarray:
        lacking = [key for c in range(k) for key in keys if (c, parameter, *key) not in values]
        if lacking:
            raise ValueError(f"the stored mixture lacks {parameter} of {lacking}")
        return np.array([[values[c, parameter, *key] for key in keys] for c in range(k)], float).reshape(k, len(keys))

    single = [(c, None) for c in d.continuous]
    fit = MixtureFit(
        k, 0, 0,
        p_binary=read("probability", [(c, 1.0) for c in d.binary]),
        mean=read("mean", single),
        variance=read("variance", single),
        p_levels=read("probability", [(c, v) for c, own in zip(d.categorical, d.levels, strict=True) for v in own]),
        beta=np.hstack([read("intercept", [(None, None)]), read("coefficient", [(c, None) for c in d.covariates])]),
        shares=read("share", [(None, None)])[:, 0],
    )
    z = len(d.covariates)
    return _Layout(d, np.zeros(len(d.continuous)), np.zeros(z), np.ones(z)), fit


def load_mixture(spark: SparkSession, path: str) -> tuple[_Layout, MixtureFit]:
    """Read a mixture that was stored as ``parameter_table``."""
    return mixture_of(spark.read.parquet(path))
