"""Catalog of instruments (tables) and features (columns).

The catalog is metadata only.  Question, subscale and final-score roles come
from rules over the column names of a table, so a release with thousands of
columns needs no generated code.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Feature:
    """One column of one instrument."""

    inst_code: str
    source_col: str

    @property
    def col(self) -> str:
        return f"{self.inst_code}_{self.source_col}"

    @property
    def name(self) -> str:
        return self.col.upper()


@dataclass(frozen=True)
class Instrument:
    """One table.  ``None`` for a role means the instrument does not have it."""

    code: str
    path: str
    questions: tuple[str, ...] | None = None
    subscales: tuple[str, ...] | None = None
    final_score: str | None = None
    question_pattern: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "code", self.code.upper())

    def resolve(self, columns: Iterable[str]) -> Instrument:
        """Fill the question role from ``question_pattern`` and the table's columns."""
        if self.questions is not None or self.question_pattern is None:
            return self
        found = tuple(c for c in columns if re.match(self.question_pattern, c))
        return replace(self, questions=found or None)

    @property
    def question_features(self) -> list[Feature] | None:
        return None if self.questions is None else [Feature(self.code, c) for c in self.questions]

    @property
    def subscale_features(self) -> list[Feature] | None:
        return None if self.subscales is None else [Feature(self.code, c) for c in self.subscales]

    @property
    def final_score_feature(self) -> Feature | None:
        return None if self.final_score is None else Feature(self.code, self.final_score)


ROLE_SCHEMA = "code string, path string, questions array<string>, subscales array<string>, final_score string"


class Catalog:
    """Ordered set of instruments plus the name of the subject key."""

    def __init__(self, instruments: Iterable[Instrument], key: str):
        self.key = key
        self._by_code = {i.code: i for i in instruments}

    def __iter__(self):
        return iter(self._by_code.values())

    @property
    def codes(self) -> list[str]:
        return list(self._by_code)

    def from_code(self, code: str) -> Instrument:
        """Look an instrument up by code, ignoring case."""
        try:
            return self._by_code[code.upper()]
        except KeyError:
            raise ValueError(f"unknown instrument code {code!r}; known: {', '.join(self.codes)}") from None

    def resolved(self, columns: Mapping[str, Iterable[str]]) -> Catalog:
        """Catalog with the question roles filled from the given table columns."""
        return Catalog([i.resolve(columns[i.code]) if i.code in columns else i for i in self], self.key)

    def feature_set(self, name: str, codes: Iterable[str]) -> list[Feature]:
        """Concatenate one role over instruments: ``questions`` or ``final_score``."""
        roles = {
            "questions": lambda i: i.question_features or [],
            "final_score": lambda i: [i.final_score_feature] if i.final_score else [],
        }
        if name not in roles:
            raise ValueError(f"unknown feature set {name!r}; known: {', '.join(roles)}")
        return [f for code in codes for f in roles[name](self.from_code(code))]

    def score_pairs(self, codes: Iterable[str] | None = None) -> list[tuple[Instrument, Instrument]]:
        """Ordered (question instrument, score instrument) pairs that can be modelled.

        The catalog is a handful of rows of metadata, so the pairs are listed on the driver.
        """
        chosen = [self.from_code(c) for c in (codes or self.codes)]
        return [
            (x, y)
            for x, y in itertools.permutations(chosen, 2)
            if x.questions is not None and y.final_score is not None
        ]

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i.code, i.path, list(i.questions) if i.questions else None,
             list(i.subscales) if i.subscales else None, i.final_score)
            for i in self
        ]
        return spark.createDataFrame(rows, ROLE_SCHEMA)

    def roles_df(self, spark: SparkSession) -> DataFrame:
        """Long form: one row per (instrument, role, feature); an instrument without a role keeps a null row."""
        wide = self.to_df(spark).select(
            "code",
            F.explode(
                F.create_map(
                    F.lit("question"), F.col("questions"),
                    F.lit("subscale"), F.col("subscales"),
                    F.lit("final_score"), F.when(F.col("final_score").isNotNull(), F.array("final_score")),
                )
            ).alias("role", "members"),
        )
        return wide.select("code", "role", F.explode_outer("members").alias("source_col"))


def features_from_columns(code: str, columns: Iterable[str], key: str, taken: Iterable[str] = ()) -> list[Feature]:
    """Feature list of a table, leaving out the key and columns already taken from another table."""
    skip = {key, *taken}
    return [Feature(code, c) for c in columns if c not in skip]


def feature_table(spark: SparkSession, tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Catalog DataFrame of every feature, read from the table schemas."""
    rows = [
        (code, f.name, Feature(code, f.name).col, Feature(code, f.name).name, f.dataType.simpleString())
        for code, df in tables.items()
        for f in df.schema.fields
        if f.name != key
    ]
    return spark.createDataFrame(rows, "inst_code string, source_col string, col string, feature string, type string")
