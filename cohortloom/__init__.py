"""Cohort analytics on Spark: keyed tables in, wide frames, profiles, clusterings and predictability tables out."""

from cohortloom.catalog import Catalog, Feature, Instrument
from cohortloom.cohort import Cohort

__all__ = ["Catalog", "Cohort", "Feature", "Instrument"]
