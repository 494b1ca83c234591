"""Cohort preparation: the relational flow in front of the latent-class mixture."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from cohortloom.catalog import Feature
from cohortloom.cohort import Cohort
from cohortloom.functions.numeric import round_half_even, to_double
from cohortloom.functions.recode import RecodeRule, recode, release_rules
from cohortloom.operators.frame import complete_cases, keyed_join, prefix_columns, project, union_common, within
from cohortloom.operators.mixture import Descriptor
from cohortloom.operators.profile import column_kinds, prune_missing
from cohortloom.operators.resample import exact_sample
from cohortloom.release_catalog import preparation_features
from cohortloom.sources.store import checkpointed


@dataclass(frozen=True)
class History:
    """Related tables stacked on their common columns and joined to the left of nothing else."""

    tables: Sequence[str]
    columns: Mapping[str, Sequence[str]]
    age_column: str
    ages: tuple[float, float]
    prefix: str


@dataclass(frozen=True)
class PrepareSpec:
    """What a preparation does; the defaults of the switches are those of the command."""

    features: Sequence[Feature]
    history: History | None
    ranges: Mapping[str, tuple[float, float]]
    below: Mapping[str, float]
    ephemeral: Sequence[str]
    rules: Sequence[RecodeRule]
    covariates: Sequence[str]
    missing_threshold: float = 0.1
    round_values: bool = True
    sample_frac: float | None = None
    sample_seed: int = 1


def release_spec(cohort: Cohort, **switches) -> PrepareSpec:
    """The preparation of the release layout."""
    lists = preparation_features(cohort.catalog)
    return PrepareSpec(
        features=[*lists["SCQ"], *lists["RBSR"], *lists["CBCL_6_18"]],
        history=History(
            ("BHC", "BHS"),
            {code: [f.source_col for f in lists[code]] for code in ("BHC", "BHS")},
            "age_at_eval_years",
            (4, 18),
            "BHC_",
        ),
        ranges={"SCQ_age_at_eval_years": (4, 18), "RBSR_age_at_eval_years": (4, 18)},
        below={"SCQ_missing_values": 1, "RBSR_missing_values": 1},
        ephemeral=[
            "SCQ_missing_values", "RBSR_missing_values", "RBSR_age_at_eval_years", "BHC_age_at_eval_years",
        ],
        rules=release_rules([f.col for f in lists["CBCL_6_18"]]),
        covariates=["SCQ_sex", "SCQ_age_at_eval_years"],
        **switches,
    )


def stacked_history(cohort: Cohort, history: History) -> DataFrame:
    """Range-filtered related tables, unioned over their common columns, with prefixed names."""
    parts = [
        within(
            project(cohort.tables[code], cohort.key, history.columns[code]), {history.age_column: history.ages}
        )
        for code in history.tables
    ]
    return prefix_columns(union_common(parts), cohort.key, history.prefix)


def wide_frame(cohort: Cohort, spec: PrepareSpec, ids: DataFrame | None = None) -> DataFrame:
    """Joined, filtered, recoded rows.

    The id filter reads only the key, so it shrinks every table ahead of the joins; column pruning and row dropping see the same rows.
    Every operator of a stage holds memory of its own, and the padded joins read their inputs more than once: the ids and the rows ahead
    of the left join are written down, so that no stage repeats them.
    """
    if ids is not None:
        cohort = cohort.restricted(checkpointed(ids.select(cohort.key).distinct()))
    df = cohort.join(spec.features, "outer")
    df = within(df, spec.ranges, spec.below)
    if spec.history is not None:
        # The filters only read instrument columns, so they come before the left join.
        df = keyed_join([checkpointed(df), stacked_history(cohort, spec.history)], cohort.key, "left")
    return recode(df.drop(*spec.ephemeral), spec.rules)


@dataclass(frozen=True)
class Prepared:
    """Analysis frame (key, indicators and covariates as doubles) and its descriptor."""

    df: DataFrame
    kinds: DataFrame
    descriptor: Descriptor

    @property
    def indicators(self) -> list[str]:
        d = self.descriptor
        return [*d.binary, *d.continuous, *d.categorical]


def prepared_frame(cohort: Cohort, spec: PrepareSpec, ids: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """The preparation up to the sample; one profiling job decides which columns stay."""
    # Profiled and then cut: kept, so that the joins run once.
    wide = checkpointed(wide_frame(cohort, spec, ids))
    cols = [c for c in wide.columns if c != cohort.key]
    pruned, kept = prune_missing(wide, cols, spec.missing_threshold)
    df = to_double(complete_cases(pruned, kept), cohort.key)
    if spec.round_values:
        df = round_half_even(df, kept)
    if spec.sample_frac:
        df = exact_sample(df, cohort.key, spec.sample_frac, spec.sample_seed)
    return df, kept


def prepare(cohort: Cohort, spec: PrepareSpec, ids: DataFrame | None = None) -> Prepared:
    df, kept = prepared_frame(cohort, spec, ids)
    lost = [c for c in spec.covariates if c not in kept]
    if lost:
        raise ValueError(f"covariates {lost} have too many missing values")
    indicators = [c for c in kept if c not in spec.covariates]
    df = df.persist()
    kinds = column_kinds(df, indicators)
    return Prepared(df, kinds, Descriptor.from_kinds(kinds, spec.covariates))
