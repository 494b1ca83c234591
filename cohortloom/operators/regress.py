"""Cross-validated regression.

Linear, ridge and lasso need only fold-wise moments: one scan gives the moment
matrix of every fold, and the training moments of a fold are the total minus
that fold.  Boosted trees and forests of all folds grow over shared histograms.
Any other Spark ML estimator is fitted fold by fold.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.base import Estimator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions.sql import double_array, number, quoted
from cohortloom.operators.passes import columns_of, doubles, sum_statistics
from cohortloom.operators.resample import run_trials
from cohortloom.operators.trees import BoostedTrees, Forest, boosted_scores, forest_scores

SCORE_SCHEMA = "model string, fold int, r2 double"


class Linear:
    """Least squares on standardized columns, with a ridge or lasso penalty on request."""

    def __init__(self, penalty: str | None = None, alpha: float = 0.0):
        if penalty not in (None, "ridge", "lasso"):
            raise ValueError(f"unknown penalty {penalty!r}")
        self.penalty, self.alpha = penalty, alpha

    def solve(self, n: float, sxx: np.ndarray, sxy: np.ndarray) -> np.ndarray:
        """Coefficients from the centred and scaled moments of the training rows."""
        if self.penalty == "ridge":
            return np.linalg.solve(sxx + self.alpha * np.eye(len(sxx)), sxy)
        if self.penalty == "lasso":
            return _coordinate_descent(sxx / n, sxy / n, self.alpha)
        return np.linalg.lstsq(sxx, sxy, rcond=None)[0]


Model = Linear | BoostedTrees | Forest | Estimator


def _coordinate_descent(gram: np.ndarray, corr: np.ndarray, alpha: float, sweeps: int = 10_000) -> np.ndarray:
    """Lasso on the d x d moments: cost does not depend on the rows."""
    beta = np.zeros(len(corr))
    for _ in range(sweeps):
        largest = 0.0
        for j in range(len(beta)):
            if gram[j, j] <= 0.0:
                continue
            rho = corr[j] - gram[j] @ beta + gram[j, j] * beta[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / gram[j, j]
            largest, beta[j] = max(largest, abs(new - beta[j])), new
        if largest < 1e-12:
            break
    return beta


def linear_models() -> dict[str, Linear]:
    return {"Linear": Linear(), "Ridge": Linear("ridge", 1.0), "Lasso": Linear("lasso", 1.0)}


def tree_models(seed: int = 1, boost_rounds: int = 100, forest_size: int = 100, forest_depth: int = 30) -> dict[str, BoostedTrees | Forest]:
    """Leaf-wise histogram boosting and a random forest that considers every column at each split."""
    return {"HistGBRT": BoostedTrees(rounds=boost_rounds), "Random Forest": Forest(trees=forest_size, max_depth=forest_depth, seed=seed)}


def default_models(seed: int = 1) -> dict[str, Model]:
    return {**linear_models(), **tree_models(seed)}


def _batch_moments(batch: pa.RecordBatch, state: tuple[np.ndarray, list[int]]) -> list[np.ndarray]:
    shift, folds = state
    rows = columns_of(batch)
    z = np.column_stack([np.ones(len(rows)), rows[:, 1:] - shift])
    upper = np.triu_indices(z.shape[1])
    out = []
    for f in folds:
        part = z[rows[:, 0] == f]
        out.append((part.T @ part)[upper])
    return out


def fold_moments(
    df: DataFrame, x: Sequence[str], y: str, fold_col: str, folds: Sequence[int], centre: Mapping[str, float] | None = None
) -> dict[int, np.ndarray]:
    """Moment matrix of (1, x, y) per fold, all folds from one scan.

    Each task ships one triangle per fold, so shuffle and result depend on
    columns and folds, not on the rows.  ``centre`` shifts the columns to keep
    the sums well conditioned; fits and scores do not depend on it.
    """
    cols = [*x, y]
    shift = np.array([(centre or {}).get(c, 0.0) for c in cols])
    size = len(cols) + 1
    upper = np.triu_indices(size)
    frame = doubles(df, [fold_col, *cols])
    flats = sum_statistics(frame, (shift, list(folds)), _batch_moments, [len(upper[0])] * len(folds))
    out = {}
    for f, flat in zip(folds, flats):
        m = np.zeros((size, size))
        m[upper] = flat
        out[f] = m + np.triu(m, 1).T
    return out


def fit_from_moments(model: Linear, m: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and coefficients on the raw (shifted) columns; scaling is that of the given rows."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    centred = m[1:, 1:] - n * np.outer(mean, mean)
    raw = np.sqrt(np.maximum(np.diag(centred)[:-1] / n, 0.0))
    scale = np.where(raw > 1e-12 * np.maximum(1.0, np.abs(mean[:-1])), raw, 1.0)
    beta = model.solve(n, centred[:-1, :-1] / np.outer(scale, scale), centred[:-1, -1] / scale) / scale
    return float(mean[-1] - mean[:-1] @ beta), beta


def r2_from_moments(m: np.ndarray, intercept: float, beta: np.ndarray) -> float:
    """R² of a linear prediction over the rows behind a moment matrix."""
    v = np.concatenate([[-intercept], -beta, [1.0]])
    residual = v @ m @ v
    total = m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
    tiny = 1e-12 * max(1.0, abs(m[-1, -1]))
    if total <= tiny:
        # A constant target: perfect or worthless.
        return 1.0 if residual <= tiny else 0.0
    return float(1.0 - residual / total)


def fold_numbers(df: DataFrame, fold_col: str) -> list[int]:
    return sorted(r[fold_col] for r in df.select(fold_col).distinct().collect())


def fold_centres(df: DataFrame, cols: Sequence[str], fold_col: str) -> tuple[list[int], dict[str, float]]:
    """The folds that occur and the mean of every column over all of them, from one pass."""
    summary = Summarizer.metrics("count", "mean").summary(array_to_vector(double_array(cols)))
    own = sorted((r[fold_col], r["s"]["count"], r["s"]["mean"].toArray()) for r in df.groupBy(fold_col).agg(summary.alias("s")).collect())
    n = sum(count for _, count, _ in own)
    mean = sum((count / n * m for _, count, m in own), np.zeros(len(cols)))
    return [f for f, _, _ in own], dict(zip(cols, map(float, mean), strict=True))


def score_linear(
    df: DataFrame, x: Sequence[str], y: str, fold_col: str, models: Mapping[str, Linear]
) -> list[tuple[str, int, float]]:
    """Held-out R² of every linear model and fold: one pass for the folds and the centre, one for all fits and scores."""
    numbers, centre = fold_centres(df, [*x, y], fold_col)
    folds = fold_moments(df, x, y, fold_col, numbers, centre)
    total = sum(folds.values())
    return [
        (name, f, r2_from_moments(held_out, *fit_from_moments(model, total - held_out)))
        for name, model in models.items()
        for f, held_out in sorted(folds.items())
    ]


def training_moments(df: DataFrame, x: Sequence[str], fold_col: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and sample deviation of the rows outside every fold, all folds from one pass. A missing value raises."""

    def checked(c: str) -> Column:
        value = F.col(quoted(c)).cast("double")
        return F.when(value.isNull() | F.isnan(value), F.raise_error(F.lit(f"missing value in {c}")).cast("double")).otherwise(value)

    summary = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector(F.array(*map(checked, x))))
    own = {r[fold_col]: r["s"] for r in df.groupBy(fold_col).agg(summary.alias("s")).collect()}
    out = {}
    for f in sorted(own):
        n, mean, spread = 0, np.zeros(len(x)), np.zeros(len(x))
        for g in sorted(own):
            if g != f:
                k, away = own[g]["count"], own[g]["mean"].toArray() - mean
                spread += own[g]["variance"].toArray() * (k - 1) + away * away * (n * k / (n + k))
                mean += away * (k / (n + k))
                n += k
        out[f] = mean, np.sqrt(spread / max(1, n - 1))
    return out


def score_estimator(
    df: DataFrame, x: Sequence[str], y: str, fold_col: str, name: str, estimator: Estimator, parallelism: int = 2
) -> list[tuple[str, int, float]]:
    """Held-out R² per fold of any Spark ML regressor behind a scaling fitted on the training rows.

    One pass gives the scaling of every fold and one job the scores of all of them; only the fits read the rows fold by fold.
    """
    moments = training_moments(df, x, fold_col)

    def scaled(f: int) -> DataFrame:
        # As Spark's scaler: a constant column becomes zero.
        cells = [f"(CAST({quoted(c)} AS DOUBLE) - {number(m)}) * {number(1 / d if d else 0.0)}" for c, m, d in zip(x, *moments[f], strict=True)]
        return df.select(fold_col, y, array_to_vector(F.expr(f"array({', '.join(cells)})")).alias("_scaled"))

    def held_out(f: int) -> DataFrame:
        fitted = estimator.copy().setFeaturesCol("_scaled").setLabelCol(y).fit(scaled(f).filter(F.col(fold_col) != f))
        return fitted.transform(scaled(f).filter(F.col(fold_col) == f)).select(fold_col, F.col(y).cast("double").alias(y), F.col("prediction").cast("double"))

    parts = run_trials(df.sparkSession, [(f,) for f in moments], held_out, parallelism)
    predicted = functools.reduce(DataFrame.unionAll, parts)
    lost = F.sum((F.col(y) - F.col("prediction")) ** 2)
    scored = predicted.groupBy(fold_col).agg((1.0 - F.try_divide(lost, F.var_pop(y) * F.count(y))).alias("r2")).collect()
    r2 = {r[fold_col]: r["r2"] for r in scored}
    return [(name, f, r2[f] if r2[f] is not None and math.isfinite(r2[f]) else 0.0) for f in moments]


def score_trees(
    df: DataFrame, x: Sequence[str], y: str, fold_col: str, name: str, model: BoostedTrees | Forest
) -> list[tuple[str, int, float]]:
    """Held-out R² per fold of a tree model. Trees do not see the scale of a column, so none is fitted."""
    folds = fold_numbers(df, fold_col)
    scores = boosted_scores if isinstance(model, BoostedTrees) else forest_scores
    return [(name, f, r2) for f, r2 in zip(folds, scores(df, x, y, fold_col, folds, model), strict=True)]


def cross_validated(df: DataFrame, x: Sequence[str], y: str, fold_col: str, models: Mapping[str, Model]) -> list[tuple[str, int, float]]:
    """(model, fold, R²) for a registry of linear models, tree models and Spark ML estimators."""
    rows: list[tuple[str, int, float]] = []
    linear = {n: m for n, m in models.items() if isinstance(m, Linear)}
    if linear:
        rows += score_linear(df, x, y, fold_col, linear)
    for name, model in models.items():
        if isinstance(model, (BoostedTrees, Forest)):
            rows += score_trees(df, x, y, fold_col, name, model)
        elif not isinstance(model, Linear):
            rows += score_estimator(df, x, y, fold_col, name, model)
    return rows


def cross_validate(
    spark: SparkSession,
    df: DataFrame,
    x: Sequence[str],
    y: str,
    fold_col: str,
    models: Mapping[str, Model],
) -> DataFrame:
    """The same as a table: ``model, fold, r2``."""
    return spark.createDataFrame(cross_validated(df, x, y, fold_col, models), SCORE_SCHEMA)


def r2_score(df: DataFrame, y: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """R² of a prediction column; for a constant target 1 when perfect, else 0."""
    residual = F.col(y) - F.col(prediction)
    lost = F.sum(residual * residual)
    r2 = F.coalesce(1.0 - F.try_divide(lost, F.var_pop(y) * F.count(y)), F.when(lost == 0, 1.0).otherwise(0.0))
    return df.groupBy(*by).agg(r2.alias("r2"))
