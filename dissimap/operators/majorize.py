"""Majorization: the matrices and steps of SMACOF and of diagonal majorization, and their solvers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissimap.functions.vectors import minus, norm, plus, sum_of_vectors, times
from dissimap.model import both_ways
from dissimap.operators.distance import with_points
from dissimap.operators.scoring import stress
from dissimap.operators.spectral import classical_scaling, sparse_scaling
from dissimap.session import cut

#: A normalised stress at or below this is zero but for rounding.
FLOOR = 1e-24


def _with_diagonal(off: DataFrame, name: str) -> DataFrame:
    diag = both_ways(off).groupBy("i").agg((-F.sum(name)).alias(name)).select("i", F.col("i").alias("j"), name)
    return off.unionByName(diag)


def guttman_transform(pairs: DataFrame, points: DataFrame, weight: Column | None = None) -> DataFrame:
    """(i >= j, g): off the diagonal w - r w / d (w where d is 0), on it minus the sum of the row."""
    w = F.lit(1.0) if weight is None else weight
    g = w - F.when(F.col("d") != 0, F.col("r") * w / F.nullif(F.col("d"), F.lit(0.0))).otherwise(0.0)
    return _with_diagonal(with_points(pairs, points).select("i", "j", g.alias("g")), "g")


def smacof_matrix(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """(i >= j, b): off the diagonal -r / d (0 where d is 0), on it minus the sum of the row."""
    b = F.when(F.col("d") != 0, -F.col("r") / F.nullif(F.col("d"), F.lit(0.0))).otherwise(0.0)
    return _with_diagonal(with_points(pairs, points).select("i", "j", b.alias("b")), "b")


def weight_sums(pairs: DataFrame, weight: Column | None = None) -> DataFrame:
    """(i, v): the sum of the weights of a point's pairs."""
    w = F.lit(1.0) if weight is None else weight
    return both_ways(pairs.select("i", "j", w.alias("w"))).groupBy("i").agg(F.sum("w").alias("v"))


def product(matrix: DataFrame, points: DataFrame, dims: int) -> DataFrame:
    """points (id, x): the rows of a symmetric matrix (i >= j, value), diagonal included, times the coordinates of points. An entry meets one point for each of its
    two places; sums are combined on the map side."""
    name = next(c for c in matrix.columns if c not in ("i", "j"))
    off = matrix.where("i <> j").select("i", "j", F.col(name).alias("m"))
    both = both_ways(off).unionByName(matrix.where("i = j").select("i", "j", F.col(name).alias("m")))
    e = both.join(points.select(F.col("id").alias("j"), "x"), "j").select("i", times("x", F.col("m")).alias("f"))
    return e.groupBy("i").agg(sum_of_vectors("f", dims).alias("x")).select(F.col("i").alias("id"), "x")


def smacof_step(pairs: DataFrame, points: DataFrame, n: int, dims: int) -> DataFrame:
    """points after X <- B(X) X / n: a point's pairs each add (r/d)(x_i - x_j) / n; the matrix itself is not needed."""
    k = F.when(F.col("d") != 0, F.col("r") / F.nullif(F.col("d"), F.lit(0.0))).otherwise(0.0)
    e = with_points(both_ways(pairs.select("i", "j", "r")), points).select("i", times(minus("xi", "xj"), k / n).alias("f"))
    moved = e.groupBy("i").agg(sum_of_vectors("f", dims).alias("x")).select(F.col("i").alias("id"), "x")
    return moved


def weighted_step(pairs: DataFrame, points: DataFrame, dims: int, weight: Column | None = None) -> DataFrame:
    """points after X <- X + G(X) X / (2 v), row by row: G X adds (w r/d - w)(x_i - x_j) for each pair. A point of weight 0 stays."""
    w = F.lit(1.0) if weight is None else weight
    p = both_ways(pairs.withColumn("w", w).select("i", "j", "r", "w"))
    k = F.when(F.col("d") != 0, F.col("r") * F.col("w") / F.nullif(F.col("d"), F.lit(0.0))).otherwise(0.0) - F.col("w")
    e = with_points(p, points).select("i", "w", times(minus("xi", "xj"), k).alias("f"))
    s = e.groupBy("i").agg(sum_of_vectors("f", dims).alias("f"), F.sum("w").alias("v"))
    move = F.when(F.col("v") > 0, times("f", F.try_divide(F.lit(0.5), F.col("v")))).otherwise(times("f", 0.0))
    return points.join(s.select(F.col("i").alias("id"), move.alias("m")), "id").select("id", plus("x", "m").alias("x"))


def _dims(points: DataFrame) -> int:
    return points.agg(F.max(F.size("x"))).first()[0] or 0


def smacof(pairs: DataFrame, p: int, stress_tolerance: float = 1e-4, max_iterations: int = 100, init: DataFrame | None = None, record: list | None = None) -> DataFrame:
    """points in p dimensions by SMACOF from classical scaling (or init): steps until the normalised stress falls by less than the
    tolerance, as a share of what it was, or is zero. One table is written, and one action run, for each step. record: gets (step, stress), from step 0."""
    record = [] if record is None else record
    pairs = cut(pairs.select("i", "j", "r"))
    x = cut(init if init is not None else classical_scaling(pairs, p))
    n, dims = x.count(), _dims(x)
    before = stress(pairs, x).first()[0]
    record.append((0, before))
    for k in range(max_iterations):
        if before is None or before <= FLOOR:
            break
        x = cut(smacof_step(pairs, x, n, dims), x)
        now = stress(pairs, x).first()[0]
        record.append((k + 1, now))
        done, before = abs(before - now) / before < stress_tolerance, now
        if done:
            break
    return x


def weighted_scaling(
    pairs: DataFrame, max_p: int, weight: Column | None = None, variance_tolerance: float = 1e-3, fit_tolerance: float = 1e-4, max_iterations: int = 100, init: DataFrame | None = None
) -> DataFrame:
    """points by diagonal majorization from sparse scaling (or init): steps until the largest move is less than fit_tolerance of the
    largest coordinate, both without regard to sign."""
    w = F.lit(1.0) if weight is None else weight
    pairs = cut(pairs.withColumn("w", w).select("i", "j", "r", "w"))
    x = cut(init if init is not None else sparse_scaling(pairs.select("i", "j", "r"), max_p, variance_tolerance))
    dims = _dims(x)
    for _ in range(max_iterations):
        y = cut(weighted_step(pairs, x, dims, F.col("w")))
        m = y.alias("a").join(x.alias("b"), "id").agg(F.max(norm(minus("a.x", "b.x"))).alias("move"), F.max(F.array_max(F.transform("a.x", F.abs))).alias("size")).first()
        x = y
        if m.size is None or m.move <= fit_tolerance * max(m.size, 1e-300):
            break
    return x
