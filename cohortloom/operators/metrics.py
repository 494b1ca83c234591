"""Cluster quality metrics and information criteria.

Every metric takes a frame with a ``labels`` array holding one label per trial,
so a whole sweep is scored in the same scans.  ``with_labels`` wraps a plain
label column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.sql import double_array
from cohortloom.operators.silhouette import cluster_names, silhouette
from cohortloom.session import ship_package
from cohortloom.sources.store import checkpointed

# Most centroid values shipped to the tasks (64 MB of doubles), and most sums that a task holds before it passes them on.
CENTROID_VALUES = 8_000_000
TASK_SUMS = 4_000_000
# Clusters of a block where all pairs of clusters are compared.
BLOCK_CLUSTERS = 512


def with_labels(df: DataFrame, *label_cols: str) -> DataFrame:
    return df.withColumn("labels", F.array(*[F.col(c).cast("int") for c in label_cols]))


def _labelled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(double_array(cols).alias("x"), "labels")


def _cluster_sums(frame: DataFrame, statistics: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Sum one vector per (trial, cluster) over all rows, in one scan for all trials: trial, label, sums.

    ``statistics(x, names, members, index)`` gets the points of a batch, the clusters present in a trial and each point's place
    among them, and returns one row per cluster. A task sends a row per cluster and passes them on before they are too
    many; equal clusters are added as they arrive, so no cluster and no list of clusters is ever held as a whole.
    """
    ship_package(frame.sparkSession)

    def rows(names: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(np.arange(0, sums.size + 1, sums.shape[1]), pa.int32())
        arrays = [pa.array(names), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))]
        return pa.RecordBatch.from_arrays(arrays, names=["name", "sums"])

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, np.ndarray] = {}
        held = 0
        for b in batches:
            if b.num_rows == 0:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            every = cluster_names(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            for trial in range(every.shape[1]):
                members, index = np.unique(every[:, trial], return_inverse=True)
                for name, row in zip(members.tolist(), statistics(x, members, index), strict=True):
                    if name in acc:
                        acc[name] += row
                    else:
                        acc[name] = row.copy()
                        held += len(row)
            if held > TASK_SUMS:
                yield rows(np.array(list(acc), np.int64), np.stack(list(acc.values())))
                acc, held = {}, 0
        if acc:
            yield rows(np.array(list(acc), np.int64), np.stack(list(acc.values())))

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, total = None, None
        for b in batches:
            if b.num_rows == 0:
                continue
            names, sums = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
            own, sums = names[first], np.add.reduceat(sums, first, axis=0)
            if name == own[0]:
                sums[0] += total
            elif name is not None:
                yield rows(np.array([name]), total[None])
            if len(own) > 1:
                yield rows(own[:-1], sums[:-1])
            name, total = int(own[-1]), sums[-1].copy()
        if name is not None:
            yield rows(np.array([name]), total[None])

    schema = "name long, sums array<double>"
    summed = frame.mapInArrow(partial, schema).repartition("name").sortWithinPartitions("name").mapInArrow(added, schema)
    return summed.selectExpr("CAST(name >> 32 AS INT) AS trial", "CAST(CASE WHEN name & 4294967295 >= 2147483648 THEN (name & 4294967295) - 4294967296 ELSE name & 4294967295 END AS INT) AS label", "sums")


def _counts_and_sums(x: np.ndarray, members: np.ndarray, index: np.ndarray) -> np.ndarray:
    order = np.argsort(index, kind="stable")
    first = np.searchsorted(index[order], np.arange(len(members)))
    return np.column_stack([np.bincount(index, minlength=len(members)), np.add.reduceat(x[order], first, axis=0)])


def cluster_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per trial and cluster: size, centroid, within sum of squares and mean distance to the centroid.

    Two scans serve all trials: the first gives the centroids, the second the spreads around them. Centroids go to the tasks
    where there are at most ``CENTROID_VALUES`` numbers of them; else rows and centroids meet by their cluster.
    """
    frame = _labelled(df, cols)
    sums = _cluster_sums(frame, _counts_and_sums)
    centroids = checkpointed(sums.selectExpr("trial", "label", "CAST(sums[0] AS BIGINT) AS n", "transform(slice(sums, 2, size(sums) - 1), v -> v / sums[0]) AS centroid"))
    if centroids.count() * len(cols) <= CENTROID_VALUES:
        spreads = _spreads_by_task(frame, centroids)
    else:
        rows = frame.select("x", F.posexplode("labels").alias("trial", "label")).join(centroids.select("trial", "label", "centroid"), ["trial", "label"])
        squares = rows.select("trial", "label", _squared_norm(_difference(F.col("x"), F.col("centroid"))).alias("s"))
        spreads = squares.groupBy("trial", "label").agg(F.sum("s").alias("within"), F.sum(F.sqrt("s")).alias("far"))
    joined = centroids.join(spreads, ["trial", "label"])
    return joined.select("trial", "label", "n", "centroid", "within", (F.col("far") / F.col("n")).alias("scatter"))


def _spreads_by_task(frame: DataFrame, centroids: DataFrame) -> DataFrame:
    """within, far (sum of distances) per cluster, with the centroids in every task."""
    table = centroids.toArrow()
    names = (table["trial"].to_numpy().astype(np.int64) << 32) | (table["label"].to_numpy().astype(np.int64) & 0xFFFFFFFF)
    order = np.argsort(names)
    values = table["centroid"].combine_chunks().flatten().to_numpy().reshape(len(names), -1)[order] if len(names) else np.zeros((0, 0))
    shared = frame.sparkSession.sparkContext.broadcast((names[order], values))

    def spreads(x: np.ndarray, members: np.ndarray, index: np.ndarray) -> np.ndarray:
        known, values = shared.value
        squares = ((x - values[np.searchsorted(known, members)][index]) ** 2).sum(1)
        return np.column_stack([np.bincount(index, squares, len(members)), np.bincount(index, np.sqrt(squares), len(members))])

    return _cluster_sums(frame, spreads).selectExpr("trial", "label", "sums[0] AS within", "sums[1] AS far")


def _squared_norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)


def _difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def inertia(moments: DataFrame) -> DataFrame:
    """Within-cluster sum of squares per trial."""
    return moments.groupBy("trial").agg(F.sum("within").alias("inertia"))


def calinski_harabasz(moments: DataFrame) -> DataFrame:
    """Between over within dispersion per trial, from the cluster moments alone."""
    centroid = array_to_vector("centroid")
    total = moments.groupBy("trial").agg(
        vector_to_array(Summarizer.mean(centroid, F.col("n").cast("double"))).alias("centre")
    )
    # One row per trial on the right.
    joined = moments.join(F.broadcast(total), "trial")
    between = F.sum(F.col("n") * _squared_norm(_difference(F.col("centroid"), F.col("centre"))))
    parts = joined.groupBy("trial").agg(
        between.alias("b"), F.sum("within").alias("w"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")
    )
    score = F.when(F.col("w") == 0, F.lit(1.0)).otherwise(
        F.try_divide(F.col("b") * (F.col("n") - F.col("k")), F.col("w") * (F.col("k") - 1))
    )
    return parts.select("trial", score.alias("calinski_harabasz_score"))


def davies_bouldin(moments: DataFrame) -> DataFrame:
    """Mean over clusters of the worst (scatter + scatter) / centroid distance, from the cluster moments.

    Every cluster is held against every other of its trial: clusters are dealt into blocks of ``BLOCK_CLUSTERS``, and pairs of
    blocks are bounded groups.
    """
    ship_package(moments.sparkSession)
    block = F.pmod(F.xxhash64("label"), F.col("blocks"))
    sizes = moments.groupBy("trial").agg(F.count(F.lit(1)).alias("k")).select("trial", "k", F.ceil(F.col("k") / BLOCK_CLUSTERS).alias("blocks"))
    dealt = moments.select("trial", "label", "scatter", "centroid").join(sizes, "trial").withColumn("block", block)
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    paired = other.select("trial", "label", "scatter", "centroid", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    worst = paired.groupBy("trial", "low", "high").applyInArrow(_worst_ratios, "trial int, label int, worst double")
    per_cluster = worst.groupBy("trial", "label").agg(F.max("worst").alias("worst"))
    return per_cluster.groupBy("trial").agg(F.avg("worst").alias("davies_bouldin_score"))


def _worst_ratios(key: tuple, table: pa.Table) -> pa.Table:
    """Worst ratio of every cluster of two blocks to those of the other one; 0 where there is none."""
    low, high = key[1].as_py(), key[2].as_py()
    x = table["centroid"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    scatter, block = table["scatter"].to_numpy(), table["block"].to_numpy()
    sides = [np.flatnonzero(block == low), np.flatnonzero(block == high)]
    worst = np.zeros(table.num_rows)
    for own, far in ((sides[0], sides[1]), (sides[1], sides[0])):
        for i in own:
            gap = np.sqrt(((x[far] - x[i]) ** 2).sum(1))
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where((far != i) & (gap > 0), (scatter[far] + scatter[i]) / gap, 0.0)
            worst[i] = max(worst[i], ratio.max(initial=0.0))
    return pa.table({"trial": table["trial"], "label": table["label"], "worst": worst})


def silhouette_squared(df: DataFrame, cols: Sequence[str], moments: DataFrame) -> DataFrame:
    """Silhouette under squared Euclidean distance: exact for that distance and linear in the rows.

    The mean squared distance to a cluster follows from its centroid and
    within sum of squares, which travel as one array per trial.
    """
    stats = moments.groupBy("trial").agg(F.collect_list(F.struct("label", "n", "centroid", "within")).alias("cs"))
    points = _labelled(df, cols).select("x", F.posexplode("labels").alias("trial", "label"))
    # One row per trial, k centroids in it.
    joined = points.join(F.broadcast(stats), "trial")
    spread = F.transform(
        F.col("cs"),
        lambda c: F.struct(
            c["label"].alias("label"),
            c["n"].alias("n"),
            (c["n"] * _squared_norm(_difference(F.col("x"), c["centroid"])) + c["within"]).alias("total"),
        ),
    )
    j = joined.select("trial", "label", spread.alias("d"))
    own = F.filter("d", lambda c: c["label"] == F.col("label"))[0]
    rest = F.transform(F.filter("d", lambda c: c["label"] != F.col("label")), lambda c: c["total"] / c["n"])
    a = F.try_divide(own["total"], own["n"] - 1)
    b = F.array_min(rest)
    score = F.when(own["n"] <= 1, 0.0).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    return j.groupBy("trial").agg(F.avg(score).alias("silhouette_squared"))


def partition_scores(df: DataFrame, cols: Sequence[str], with_inertia: bool = True) -> DataFrame:
    """All label-based scores of every trial: one row per trial."""
    moments = checkpointed(cluster_moments(df, cols))
    out = silhouette(df, cols, moments=moments).join(davies_bouldin(moments), "trial")
    out = out.join(calinski_harabasz(moments), "trial")
    return out.join(inertia(moments), "trial") if with_inertia else out


def gaussian_parameters(k: int, d: int) -> int:
    """Free parameters of a full-covariance mixture."""
    return k * d * (d + 1) // 2 + k * d + k - 1


def information_criteria(ll: Column, n_params: Column, n: Column) -> dict[str, Column]:
    """AIC, BIC and CAIC from a total log-likelihood."""
    return {
        "aic": -2.0 * ll + 2.0 * n_params,
        "bic": -2.0 * ll + n_params * F.ln(n),
        "caic": -2.0 * ll + n_params * (F.ln(n) + 1.0),
    }


def posterior_entropy(df: DataFrame, probabilities: str, k: int) -> DataFrame:
    """Entropy of the class posteriors and its value relative to a uniform assignment."""
    terms = F.aggregate(
        F.col(probabilities), F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.ln(p)).otherwise(0.0)
    )
    return df.agg(F.sum(terms).alias("entropy"), F.count(F.lit(1)).alias("n")).select(
        "entropy", (1.0 - F.col("entropy") / (F.col("n") * F.ln(F.lit(float(k))))).alias("scaled_entropy")
    )
