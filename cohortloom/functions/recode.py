"""Recoding of categorical text, and labels for reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.catalog import Feature
from cohortloom.functions import fixed_values as fixed

RecodeRule = tuple[Sequence[str], Mapping[str, int | None]]


def recode_column(col: Column, mapping: Mapping[str, int | None]) -> Column:
    """Simultaneous dictionary lookup on text; unmapped text passes through.

    The key test comes first, so a code mapped to None becomes NULL instead of
    falling back to itself.
    """
    pairs = [F.lit(x) for k, v in mapping.items() for x in (k, None if v is None else str(v))]
    table = F.create_map(*pairs).cast("map<string,string>")
    return F.when(F.map_contains_key(table, col), table[col]).otherwise(col)


def recode(df: DataFrame, rules: Sequence[RecodeRule]) -> DataFrame:
    """Apply every rule to its text columns in one projection; other types never match a text code."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    known, changed = set(df.columns), {}
    for cols, mapping in rules:
        for c in cols:
            if c not in known:
                raise ValueError(f"cannot recode unknown column {c!r}")
            if c in text:
                changed[c] = recode_column(changed.get(c, F.col(c)), mapping)
    return df.withColumns(changed) if changed else df


def release_rules(cbcl_columns: Sequence[str]) -> list[RecodeRule]:
    """Recode rules of the cohort preparation, on qualified column names."""
    bhc = lambda *names: [Feature("BHC", n).col for n in names]
    return [
        (bhc("child_lives_with_v2"), fixed.LIVES_WITH_V2),
        (bhc("father_highest_education", "mother_highest_education"), fixed.EDUCATION),
        (bhc("child_lives_with"), fixed.LIVES_WITH),
        (bhc("annual_household_income"), fixed.INCOME),
        (bhc("hand"), fixed.HAND),
        (list(cbcl_columns), fixed.SOCIAL_COMPETENCE),
        (bhc("gender"), fixed.GENDER),
        (bhc("twin_mult_birth"), fixed.MULTIPLE_BIRTH),
        (bhc("child_grade_school"), fixed.GRADE),
        ([Feature("SCQ", "sex").col], fixed.SEX),
    ]


def metric_label(col: Column) -> Column:
    """``davies_bouldin_score`` to ``Davies Bouldin Score``."""
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def display_label(col: Column, labels: Mapping[str, str] = fixed.DISPLAY_LABELS) -> Column:
    """Label of a code, or the code itself."""
    if not labels:
        return col
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(table, col), col)


def in_thousands(col: Column) -> Column:
    """Thousands with one decimal.

    ``format_number`` rounds the binary value half to even; ``format_string``
    would round its shortest decimal text up.
    """
    return F.replace(F.format_number(col / F.lit(1000.0), 1), F.lit(","), F.lit(""))
