"""Result tables: compute-or-load, partitioned result matrices, fitted models, checkpoints."""

from __future__ import annotations

import hashlib
import json
import tempfile
import threading
from collections.abc import Callable, Mapping
from types import CodeType
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system the cluster uses for it."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def cache_path(root: str, analysis: str, params: Mapping[str, Any]) -> str:
    """Folder of a cached result; the name carries every parameter that shapes it."""
    digest = hashlib.md5(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]
    return f"{root.rstrip('/')}/{analysis}/{digest}"


def fingerprint(df: DataFrame) -> str:
    """Count and content sum of a frame's rows; independent of their order and partitioning. One scan."""
    cells = ", ".join(f"`{c}`" for c in df.columns)
    row = df.selectExpr(f"pmod(xxhash64({cells}), 1000000007) AS a", f"pmod(hash({cells}), 1000003) AS b").selectExpr("count(*)", "sum(a)", "sum(b)").first()
    return f"{','.join(df.columns)}:{row[0]}:{row[1]}:{row[2]}"


def described(model: Any) -> str:
    """A model's class and every parameter, without the identifiers Spark makes up."""
    if hasattr(model, "extractParamMap"):
        values = sorted((p.name, repr(v)) for p, v in model.extractParamMap().items() if not p.name.endswith("Col"))
        return f"{type(model).__name__}{values}"
    return repr(model)


def code_digest(function: Callable) -> str:
    """Digest of what a function does: its code, constants, names, defaults and what it closes over."""

    def parts(code: CodeType) -> list:
        inner = [parts(c) if isinstance(c, CodeType) else repr(c) for c in code.co_consts]
        return [code.co_code.hex(), inner, list(code.co_names), list(code.co_varnames)]

    code = getattr(function, "__code__", None)
    if code is None:
        return described(function)
    closed = [repr(c.cell_contents) for c in function.__closure__ or ()]
    return hashlib.md5(json.dumps([parts(code), repr(function.__defaults__), closed]).encode()).hexdigest()[:16]


def materialize(
    spark: SparkSession,
    build: Callable[[], DataFrame],
    root: str,
    analysis: str,
    params: Mapping[str, Any],
) -> DataFrame:
    """Read the stored result when its write was committed, else compute, store and read it back.

    ``_SUCCESS`` is written after all parts, so a half-written result is rebuilt.
    """
    path = cache_path(root, analysis, params)
    if not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_matrices(df: DataFrame, path: str, partition_by: str = "model") -> None:
    """Tidy result matrices, one folder per model or metric."""
    df.write.mode("overwrite").partitionBy(partition_by).parquet(path)


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model: Any, path: str) -> None:
    """Persist a fitted Spark ML model."""
    model.write().overwrite().save(path)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the session; a temporary one only where none is set (tests)."""
    context = spark.sparkContext
    current = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        current = tempfile.mkdtemp(prefix="cohortloom-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(current)
    return current


# Whether the shuffles of a plan go once it has run; a plan is bound to what holds when it is built.
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_building = threading.Lock()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint that survives the loss of executors.

    The shuffles behind it are not read again, so they leave the disk at once instead of when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    with _building:
        before = spark.conf.get(_SHUFFLES_GO, None)
        spark.conf.set(_SHUFFLES_GO, "true")
        try:
            own = df.select("*")
        finally:
            spark.conf.unset(_SHUFFLES_GO) if before is None else spark.conf.set(_SHUFFLES_GO, before)
    return own.checkpoint(eager=True)
