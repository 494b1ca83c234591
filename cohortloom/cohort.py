"""The dataset object: lazily read instruments addressed by feature."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cohortloom.catalog import Catalog, Feature, Instrument
from cohortloom.operators.frame import group_by_instrument, join_features, keep_ids
from cohortloom.sources.release import read_release


class Cohort:
    """Keyed tables plus their catalog.  Frames are lazy, so a table that no feature asks for is never read."""

    def __init__(self, catalog: Catalog, tables: Mapping[str, DataFrame]):
        self.tables = {code.upper(): df for code, df in tables.items()}
        self.catalog = catalog.resolved({code: df.columns for code, df in self.tables.items()})

    @classmethod
    def read(
        cls,
        spark: SparkSession,
        directory: str,
        catalog: Catalog,
        codes: Iterable[str] | None = None,
        schemas: Mapping[str, T.StructType] | None = None,
        fmt: str = "csv",
    ) -> Cohort:
        return cls(catalog, read_release(spark, directory, catalog, codes, schemas, fmt))

    @property
    def key(self) -> str:
        return self.catalog.key

    def instrument(self, code: str) -> Instrument:
        return self.catalog.from_code(code)

    def restricted(self, ids: DataFrame) -> Cohort:
        """The same cohort with the rows of the listed subjects only, in every table."""
        return Cohort(self.catalog, {code: keep_ids(df, ids, self.key) for code, df in self.tables.items()})

    def join(self, features: Sequence[Feature], how: str = "outer", rename: bool = True) -> DataFrame:
        return join_features(self.tables, features, self.key, how, rename)


def read_and_join(
    spark: SparkSession,
    directory: str,
    catalog: Catalog,
    features: Sequence[Feature],
    how: str = "outer",
    schemas: Mapping[str, T.StructType] | None = None,
    fmt: str = "csv",
) -> tuple[Cohort, DataFrame, list[Instrument]]:
    """Read just the instruments the features come from, and join them."""
    codes = list(group_by_instrument(features))
    cohort = Cohort.read(spark, directory, catalog, codes, schemas, fmt)
    return cohort, cohort.join(features, how), [cohort.instrument(c) for c in codes]
