"""Latent-class jobs: a single fit with stored parameters, and the sweep over k."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from cohortloom.cohort import Cohort
from cohortloom.operators.mixture import (
    SWEEP_METRICS,
    FittedMixtures,
    Metric,
    RowStatistic,
    assign_classes,
    fit_mixtures,
    mixture_metrics,
    parameter_table,
)
from cohortloom.operators.resample import mean_std
from cohortloom.plans.prepare import Prepared, PrepareSpec, prepare
from cohortloom.sources.store import code_digest, fingerprint, materialize


def fit_classes(
    prepared: Prepared, key: str, n_components: int = 4, n_init: int = 20, seed: int = 1, **limits
) -> tuple[FittedMixtures, DataFrame]:
    """Best of ``n_init`` restarts, and the class of every subject without covariates."""
    fitted = fit_mixtures(
        prepared.df, key, prepared.descriptor, [n_components], restarts=n_init, seed=seed, **limits
    )
    return fitted, assign_classes(prepared.df, key, fitted.layout, fitted.best()[0])


def latent_class_job(
    cohort: Cohort,
    spec: PrepareSpec,
    output: str,
    ids: DataFrame | None = None,
    n_components: int = 4,
    n_init: int = 1,
    seed: int = 1,
    **limits,
) -> tuple[str, DataFrame]:
    """Prepare, fit, store the parameters under a time-stamped folder; returns it with the labels."""
    prepared = prepare(cohort, spec, ids)
    fitted, labels = fit_classes(prepared, cohort.key, n_components, n_init, seed, **limits)
    path = f"{output.rstrip('/')}/model_{int(time.time() * 1000)}"
    parameter_table(prepared.df.sparkSession, fitted.layout, fitted.best()[0]).write.parquet(path)
    return path, labels


def class_sweep(
    prepared: Prepared,
    key: str,
    k_values: Sequence[int] = range(2, 10),
    repeats: int = 5,
    restarts: int = 20,
    seed: int = 1,
    metrics: Mapping[str, Metric] = SWEEP_METRICS,
    row_statistics: Mapping[str, RowStatistic] | None = None,
    **limits,
) -> DataFrame:
    """``k, repeat`` and the metrics (name to function, see ``mixture_metrics``), all fits sharing every scan of the data."""
    fitted = fit_mixtures(prepared.df, key, prepared.descriptor, list(k_values), repeats, restarts, seed=seed, **limits)
    return mixture_metrics(prepared.df, fitted, metrics=metrics, row_statistics=row_statistics)


def optimal_k_job(
    prepared: Prepared,
    key: str,
    cache_root: str,
    source: str,
    k_values: Sequence[int] = range(2, 10),
    repeats: int = 5,
    restarts: int = 20,
    seed: int = 1,
    metrics: Mapping[str, Metric] = SWEEP_METRICS,
    row_statistics: Mapping[str, RowStatistic] | None = None,
) -> DataFrame:
    """Mean and standard deviation of every metric per k, from the cached or computed sweep. The key of the cache knows the metrics' code."""
    params = {"source": source, "k": list(k_values), "repeats": repeats, "restarts": restarts, "seed": seed,
              "descriptor": repr(prepared.descriptor), "rows": fingerprint(prepared.df),
              "metrics": {n: code_digest(m) for n, m in metrics.items()},
              "row_statistics": {n: code_digest(m) for n, m in (row_statistics or {}).items()}}
    spark = prepared.df.sparkSession

    def build() -> DataFrame:
        return class_sweep(prepared, key, k_values, repeats, restarts, seed, metrics, row_statistics)

    return mean_std(materialize(spark, build, cache_root, "classes", params), "k", list(metrics))
