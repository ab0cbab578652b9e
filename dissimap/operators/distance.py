"""Pairs of points: distances, squares, triplets, submatrices."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissimap.functions.vectors import distance, mixed
from dissimap.model import PAIRS, dense_index


def matrix_of(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _block(key: tuple, t: pa.Table) -> pa.Table:
    a, b = key[0].as_py(), key[1].as_py()
    ids, x, block = np.asarray(t["id"], np.int64), matrix_of(t["x"]), np.asarray(t["block"])
    p, q = np.flatnonzero(block == a), np.flatnonzero(block == b)
    out_i, out_j, out_r = [], [], []
    for s in range(0, len(p), 256):
        rows = p[s : s + 256]
        d = np.zeros((len(rows), len(q)))
        for k in range(x.shape[1]):
            d += (x[rows, k][:, None] - x[q, k][None]) ** 2
        keep = ids[rows][:, None] > ids[q][None] if a == b else np.ones(d.shape, bool)
        i, j = np.nonzero(keep)
        big, small = np.maximum(ids[rows][i], ids[q][j]), np.minimum(ids[rows][i], ids[q][j])
        out_i.append(big), out_j.append(small), out_r.append(np.sqrt(d[i, j]))
    z = np.empty(0)
    return pa.table({"i": np.concatenate(out_i or [z]).astype(np.int64), "j": np.concatenate(out_j or [z]).astype(np.int64), "r": np.concatenate(out_r or [z])})


def euclidean_distance(points: DataFrame, blocks: int | None = None, rows: int = 1000) -> DataFrame:
    """All pairs of points with their distance: (i > j, r). A point's id must be unique; one point gives no pairs.

    Points go to hashed blocks of about `rows`; each pair of blocks is a task of array arithmetic over at most
    2 * rows points (blocks are hashed, so none is hot). The result has n(n-1)/2 rows by its meaning.
    """
    return block_pairs(points, _block, PAIRS, blocks, rows)


def block_pairs(points: DataFrame, run, schema: str, blocks: int | None = None, rows: int = 1000) -> DataFrame:
    """run(key (p, q), table (p, q, id, x, block)) for every pair p <= q of hashed blocks of about `rows` points."""
    b = blocks or max(1, math.ceil(points.count() / rows))
    p = points.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(b)).cast("int").alias("block"))
    every = F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    meet = p.withColumn("other", every).select(F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "id", "x", "block")
    return meet.groupBy("p", "q").applyInArrow(run, schema)


def squared(pairs: DataFrame) -> DataFrame:
    """(i, j, r2)."""
    return pairs.select("i", "j", (F.col("r") * F.col("r")).alias("r2"))


def triplets_to_pairs(triplets: DataFrame, i: str, j: str, r: str, order: str) -> DataFrame:
    """Triplets in either orientation as pairs (i > j, r): of several of a pair, the one with the greatest `order` holds.
    Triplets with a null id or value, a NaN value, or two equal ids do not count."""
    a, b = F.col(i).cast("bigint"), F.col(j).cast("bigint")
    ok = triplets.where(a.isNotNull() & b.isNotNull() & (a != b) & F.col(r).isNotNull() & ~F.isnan(r))
    last = ok.groupBy(F.greatest(a, b).alias("i"), F.least(a, b).alias("j")).agg(F.max_by(F.col(r).cast("double"), F.col(order)).alias("r"))
    return last.select("i", "j", "r")


def submatrix_range(pairs: DataFrame, low: int, high: int) -> DataFrame:
    """The pairs of points with low <= id < high."""
    return pairs.where(F.col("i").between(low, high - 1) & F.col("j").between(low, high - 1))


def sample_size(n: int) -> int:
    return 10 + math.isqrt(n)


def distinct_sample(points: DataFrame, m: int, seed: int = 1) -> DataFrame:
    """m different points, those with the least hash: (id). All of them, if there are no more."""
    return points.select("id").orderBy(mixed("id", seed=seed), "id").limit(m).orderBy("id")


def sampled_submatrix(pairs: DataFrame, sample: DataFrame) -> DataFrame:
    """The pairs of a sample, its points numbered from 0 in the order of their ids: (i > j, r)."""
    s = dense_index(sample.select("id"), "id", "k")
    a, b = s.select(F.col("id").alias("i"), F.col("k").alias("ki")), s.select(F.col("id").alias("j"), F.col("k").alias("kj"))
    return pairs.join(a, "i").join(b, "j").select(F.col("ki").alias("i"), F.col("kj").alias("j"), "r")


def with_points(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """pairs with the coordinates of both points, xi and xj, and their distance d."""
    a = points.select(F.col("id").alias("i"), F.col("x").alias("xi"))
    b = points.select(F.col("id").alias("j"), F.col("x").alias("xj"))
    return pairs.join(a, "i").join(b, "j").withColumn("d", distance("xi", "xj"))
