"""Readers for dated release directories and identifier lists."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.catalog import Catalog, Instrument

# Cell texts a release uses for "missing".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# End of fixed values.


def release_date(directory: str) -> str:
    """Text after the last underscore of a release directory name."""
    return directory.rstrip("/").rsplit("_", 1)[-1]


def instrument_path(directory: str, base: str, fmt: str = "csv") -> str:
    """``<directory>/<base>-<date>.<fmt>``; the base may contain a sub-directory."""
    return f"{directory.rstrip('/')}/{base}-{release_date(directory)}.{fmt}"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL, because Spark orders NaN above every number."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns]
    )


# What counts as a whole number, a number or a truth value; Spark's casts accept more (y, t, 1d).
_FORMS = (
    (T.LongType(), r"^\s*[+-]?\d{1,18}\s*$"),
    (T.DoubleType(), r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|Inf|Infinity)\s*$"),
    (T.BooleanType(), r"^(true|True|TRUE|false|False|FALSE)$"),
)


def _typed_columns(df: DataFrame) -> dict[str, T.DataType]:
    """Narrowest of bigint, double, boolean or string whose form every non-null cell of a text column has."""
    checks = [
        F.bool_and(F.col(f"`{c}`").rlike(form) | F.col(f"`{c}`").isNull()).alias(f"{i}_{j}")
        for i, c in enumerate(df.columns)
        for j, (_, form) in enumerate(_FORMS)
    ]
    filled = [F.count(f"`{c}`").alias(f"{i}_n") for i, c in enumerate(df.columns)]
    row = df.agg(*checks, *filled).first()
    types: dict[str, T.DataType] = {}
    for i, c in enumerate(df.columns):
        fits = [t for j, (t, _) in enumerate(_FORMS) if row[f"{i}_n"] and row[f"{i}_{j}"]]
        types[c] = fits[0] if fits else T.StringType()
    return types


def read_csv(spark: SparkSession, path: str, key: str, schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """Read one instrument with a header row.

    A cell may stand in double quotes, with doubled quotes inside; ``multi_line`` allows line breaks in such cells, at the price of a
    file per task.  A row with more or fewer cells than the header fails.  Cells are read as text, missing-value texts become
    NULL, then columns are cast.  With a schema this is one lazy scan; without one, a single profiling pass over the whole
    file picks the types (the key always stays text), so give schemas where files are large.
    """
    reader = spark.read.options(header=True, escape='"', multiLine=multi_line, mode="FAILFAST")
    header = reader.csv(path)
    text = header.select(
        *[F.when(~F.col(f"`{c}`").isin(*NULL_TOKENS), F.col(f"`{c}`")).alias(c) for c in header.columns]
    )
    if schema is not None:
        missing = [f.name for f in schema.fields if f.name not in text.columns]
        if missing:
            raise ValueError(f"{path} lacks columns {missing}")
        return text.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    types = _typed_columns(text.drop(key))
    return text.select(*[F.col(c) if c == key else F.col(c).cast(types[c]).alias(c) for c in text.columns])


def read_instrument(
    spark: SparkSession,
    directory: str,
    instrument: Instrument,
    key: str,
    schema: T.StructType | None = None,
    fmt: str = "csv",
) -> DataFrame:
    path = instrument_path(directory, instrument.path, fmt)
    if fmt == "csv":
        return read_csv(spark, path, key, schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return nan_to_null(reader.format(fmt).load(path))


def read_release(
    spark: SparkSession,
    directory: str,
    catalog: Catalog,
    codes: Iterable[str] | None = None,
    schemas: Mapping[str, T.StructType] | None = None,
    fmt: str = "csv",
) -> dict[str, DataFrame]:
    """Lazy frames of the chosen instruments; every instrument of the catalog when ``codes`` is None."""
    chosen = [catalog.from_code(c) for c in (catalog.codes if codes is None else codes)]
    return {
        i.code: read_instrument(spark, directory, i, catalog.key, (schemas or {}).get(i.code), fmt) for i in chosen
    }


def convert_release(
    spark: SparkSession,
    directory: str,
    target: str,
    catalog: Catalog,
    codes: Iterable[str] | None = None,
    schemas: Mapping[str, T.StructType] | None = None,
) -> None:
    """Rewrite a CSV release as Parquet once, so later scans prune columns and push filters down."""
    for code, df in read_release(spark, directory, catalog, codes, schemas).items():
        df.write.mode("overwrite").parquet(instrument_path(target, catalog.from_code(code).path, "parquet"))


def clean_ids(lines: DataFrame, column: str, key: str) -> DataFrame:
    """Trim, drop blanks, de-duplicate."""
    ids = lines.select(F.trim(F.col(column)).alias(key))
    return ids.filter(F.length(key) > 0).distinct()


def read_id_list(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Identifier file, one id per line."""
    return clean_ids(spark.read.text(path), "value", key)
