"""Layouts of parts put together: affine least squares, divide and conquer, batches that overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissimap.functions.vectors import mixed
from dissimap.model import POINTS, dense_index
from dissimap.operators.distance import matrix_of
from dissimap.operators.majorize import weighted_scaling
from dissimap.operators.spectral import center, classical_scaling, local_layout, square
from dissimap.session import cut


def affine_fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The (d+1) x p matrix A for which [x | 1] A is nearest to y; of several, the smallest."""
    return np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]), y, rcond=1e-10)[0]


def affine_apply(points: DataFrame, a: np.ndarray) -> DataFrame:
    """points under x -> x A + t, t being the last row of a."""
    d, p = a.shape[0] - 1, a.shape[1]
    new = F.array(*[sum((F.get(F.col("x"), F.lit(k)) * float(a[k, c]) for k in range(d)), F.lit(float(a[d, c]))) for c in range(p)])
    return points.select("id", new.alias("x"))


def _triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The triangular factor of a partition's rows [a | 1 | b], which has the same least squares."""
    r, d = None, 0
    for t in batches:
        if t.num_rows:
            x, y = matrix_of(t.column(0)), matrix_of(t.column(1))
            m, d = np.column_stack([x, np.ones(len(x)), y]), x.shape[1]
            r = np.linalg.qr(m if r is None else np.vstack([r, m]), mode="r")
    if r is not None:
        yield pa.RecordBatch.from_arrays([pa.array([d] * len(r), pa.int32()), pa.array(list(r), pa.list_(pa.float64()))], ["d", "row"])


def affine_between(old: DataFrame, new: DataFrame) -> np.ndarray:
    """affine_fit() from one layout to another over all points that both have. Of each partition only the triangular factor, d + 1 + p rows at
    most, is collected."""
    both = old.select("id", F.col("x").alias("a")).join(new.select("id", F.col("x").alias("b")), "id").select("a", "b")
    got = both.mapInArrow(_triangles, "d int, row array<double>").collect()
    if not got:
        raise ValueError("the layouts have no point in common")
    d, m = got[0].d, np.array([r.row for r in got], float)
    return np.linalg.lstsq(m[:, : d + 1], m[:, d + 1 :], rcond=1e-10)[0]


def _block_layout(p: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, r = square(np.asarray(left["i"]), np.asarray(left["j"]), np.asarray(left["r"]))
        x = local_layout(center(r), p, "singular", None)
        at, y = np.searchsorted(ids, np.asarray(right["id"])), matrix_of(right["x"])
        ok = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == np.asarray(right["id"]))
        out = np.column_stack([x, np.ones(len(x))]) @ affine_fit(x[at[ok]], y[ok])
        return pa.table({"block": pa.array([key[0].as_py()] * len(ids), pa.int32()), "id": ids, "x": pa.array(list(out), pa.list_(pa.float64()))})

    return run


def block_scaling(pairs: DataFrame, p: int, subdivisions: int, seed: int = 7) -> DataFrame:
    """points in p dimensions by divide and conquer. Points are numbered by id and cut into blocks of ceil(n/s) at floor(k n/s); 2p hashed
    points of each block are scaled together; each block is scaled by itself, in one task, and moved by the
    affine map that fits its sampled points. A point of two blocks takes the later block's place.

    Needs the pairs within blocks and between sampled points only; others are not read past the joins. Raises ValueError if blocks
    are narrower than 2p.
    """
    ids = dense_index(pairs.select(F.explode(F.array("i", "j")).alias("id")).distinct(), "id", "k")
    n = ids.count()
    width = -(-n // subdivisions) if n else 0
    if n and width < 2 * p:
        raise ValueError("blocks are narrower than twice the dimensions")
    if not n:
        return pairs.sparkSession.createDataFrame([], POINTS)
    starts = F.array(*[F.lit(k * n // subdivisions) for k in range(subdivisions)])
    blocks = F.filter(F.sequence(F.lit(0).cast("int"), F.lit(subdivisions - 1).cast("int")), lambda b: (F.col("k") >= F.get(starts, b)) & (F.col("k") < F.get(starts, b) + width))
    placed = cut(ids.select("id", F.explode(blocks).alias("block")))
    rank = F.row_number().over(_by_block(seed))
    sample = cut(placed.withColumn("rank", rank).where(F.col("rank") <= 2 * p).select("id", "block"))  # 2p of each block
    names = sample.select("id").distinct()
    among = pairs.join(names.withColumnRenamed("id", "i"), "i").join(names.withColumnRenamed("id", "j"), "j").select("i", "j", "r")
    frame = cut(classical_scaling(among, p))
    a, b = placed.toDF("i", "block"), placed.toDF("j", "block2")
    inside = pairs.join(a, "i").join(b, "j").where("block = block2").select("block", "i", "j", "r")
    anchors = sample.join(frame, "id").select("block", "id", "x")
    got = inside.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(_block_layout(p), "block int, id bigint, x array<double>")
    return got.groupBy("id").agg(F.max_by("x", "block").alias("x"))


def _by_block(seed: int):
    from pyspark.sql import Window

    return Window.partitionBy("block").orderBy(mixed("id", seed=seed), "id")


def incremental_scaling(pairs: DataFrame, batches: DataFrame, p: int, fit_tolerance: float = 1e-5, max_iterations: int = 100) -> DataFrame:
    """points from batches (id, batch) that overlap, in the order of batch: each batch is scaled by itself, and what was laid out before is moved by the affine
    map that fits the batch's layout on the points both have; then the batch's own places hold. The state from one batch to the
    next is the layout; the driver goes over the batches' numbers. Raises ValueError if a batch has no point of those before."""
    pairs, batches = cut(pairs.select("i", "j", "r")), cut(batches.select("id", "batch").distinct())
    done: DataFrame | None = None
    for r in batches.select("batch").distinct().orderBy("batch").collect():  # a row for each batch
        ids = batches.where(F.col("batch") == r.batch).select("id")
        own = pairs.join(ids.withColumnRenamed("id", "i"), "i", "left_semi").join(ids.withColumnRenamed("id", "j"), "j", "left_semi").select("i", "j", "r")
        new = cut(weighted_scaling(own, p, variance_tolerance=0.0, fit_tolerance=fit_tolerance, max_iterations=max_iterations))
        if done is not None:
            moved = affine_apply(done, affine_between(done, new))
            new = cut(moved.join(new.select("id"), "id", "left_anti").unionByName(new), new)
        done = new
    return done if done is not None else pairs.sparkSession.createDataFrame([], POINTS)
