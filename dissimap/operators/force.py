"""Force-directed layout: the kernel, its parts, and the solver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dissimap.functions.vectors import minus, norm, plus, sum_of_vectors, times, total, uniform
from dissimap.model import POINTS, both_ways
from dissimap.operators import local as kernels
from dissimap.operators.distance import with_points
from dissimap.operators.local import solve
from dissimap.operators.spectral import LOCAL, square
from dissimap.session import cut


def random_points(ids: DataFrame, dims: int, seed: int = 1) -> DataFrame:
    """points with hashed coordinates in [0, 1): the same for an id wherever it is computed."""
    return ids.select("id", F.array(*[uniform("id", F.lit(k), seed=seed) for k in range(dims)]).alias("x"))


def unit(d: Column, dx: Column) -> Column:
    """dx / d; where points lie on each other, the first axis."""
    first = F.transform(dx, lambda e, k: F.when(k == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return F.when(d > 0, times(dx, F.try_divide(F.lit(1.0), d))).otherwise(first)


def cap(f: Column, most: float) -> Column:
    """f no longer than `most`."""
    n = norm(f)
    return F.when(n > most, times(f, F.lit(most) / F.nullif(n, F.lit(0.0)))).otherwise(f)


def planar_pull(f: Column, x: Column, dims: int, strength: float) -> Column:
    """f with a pull of the last coordinate towards 0."""
    return F.transform(F.zip_with(f, x, lambda a, b: F.struct(a.alias("f"), b.alias("x"))), lambda e, k: F.when(k == dims - 1, e["f"] - e["x"] * strength).otherwise(e["f"]))


def spring_forces(directed: DataFrame, points: DataFrame, dims: int, spring: float, others: Column | None = None) -> DataFrame:
    """(id, f): the mean over a point's directed pairs (i, j, r) of spring * (r - d) * (x_i - x_j) / d; others: the number to divide by instead of the number of pairs."""
    e = with_points(directed, points)
    f = times(unit(F.col("d"), minus("xi", "xj")), (F.col("r") - F.col("d")) * spring)
    s = e.select("i", f.alias("f")).groupBy("i").agg(sum_of_vectors("f", dims).alias("f"), F.count(F.lit(1)).alias("n"))
    by = F.col("n") if others is None else others
    return s.select(F.col("i").alias("id"), times("f", F.lit(1.0) / by).alias("f"))


def integrate(state: DataFrame, dampening: float) -> DataFrame:
    """(id, x, v) of (id, x, v, f): v <- v (1 - dampening) + f, x <- x + v."""
    v = plus(times("v", 1 - dampening), "f")
    return state.withColumn("v", v).select("id", plus("x", "v").alias("x"), "v")


def kinetic_energy(state: DataFrame) -> DataFrame:
    """One row (energy): the sum of |v|^2."""
    return state.agg(F.sum(total(F.transform("v", lambda e: e * e))).alias("energy"))


def force_step(pairs: DataFrame, state: DataFrame, dims: int, spring: float = 0.5, dampening: float = 0.5, force_cap: float = 0.5, pull: float = 0.0) -> DataFrame:
    """One step of state (id, x, v) over complete pairs, all points moving at once from where they were."""
    f = spring_forces(both_ways(pairs), state.select("id", "x"), dims, spring)
    s = state.join(f, "id")
    g = planar_pull(F.col("f"), F.col("x"), dims, pull) if pull else F.col("f")
    return integrate(s.withColumn("f", cap(g, force_cap)), dampening)


def in_one_task(pairs: DataFrame, init: DataFrame | None, run) -> DataFrame:
    """points by run(ids, r, start) over the whole matrix, in one task; for a bounded number of points."""
    f = solve(run)
    start = pairs.sparkSession.createDataFrame([], POINTS) if init is None else init.select("id", "x")
    left, right = pairs.select("i", "j", "r").withColumn("one", F.lit(1)), start.withColumn("one", F.lit(1))
    return left.groupBy("one").cogroup(right.groupBy("one")).applyInArrow(lambda a, b: f(a, b), POINTS)


def force_layout(
    pairs: DataFrame, p: int = 2, iterations: int | None = None, planar: bool = True, dampening: float = 0.5, force_cap: float = 0.5, spring: float = 0.5, init: DataFrame | None = None, seed: int = 1, every: int = 3,
    local: int = LOCAL, sequential: bool = False,
) -> DataFrame:
    """points in p dimensions after so many steps (by default the number of points), from hashed places or from init (id, x). With planar, a further coordinate
    gives points room to pass, is pulled to 0 with growing strength, and is dropped.

    Up to `local` points one task holds the matrix; beyond, each step is joins and an aggregate, the lineage being cut every few steps. Both give the
    same layout. sequential (one task only): each point moves before the next one's force is taken. Raises ValueError beyond `local` points then.
    """
    dims = p + 1 if planar else p
    pairs = cut(pairs.select("i", "j", "r"))
    ids = pairs.select(F.explode(F.array("i", "j")).alias("id")).distinct()
    n = ids.count()
    rounds = n if iterations is None else iterations
    start = init.select("id", F.concat("x", F.array(F.lit(0.0))).alias("x")) if planar and init is not None else init
    if n <= local:
        return in_one_task(pairs, start, lambda i, r, x: kernels.force(r, kernels.uniform(i, dims, seed) if x is None else x, rounds, planar, dampening, force_cap, spring, sequential)[:, :p])
    if sequential:
        raise ValueError(f"the sequential layout is for {local} points at most")
    x = random_points(ids, dims, seed) if start is None else start
    s, old = cut(x.withColumn("v", times("x", 0.0))), None
    for k in range(1, rounds + 1):
        s = force_step(pairs, s, dims, spring, dampening, force_cap, spring * k / rounds if planar else 0.0)
        if k % every == 0:
            s = cut(s, old)
            old = s
    return s.select("id", F.slice("x", 1, p).alias("x"))


def force_energies(
    pairs: DataFrame, p: int = 2, iterations: int | None = None, planar: bool = True, dampening: float = 0.5, force_cap: float = 0.5, spring: float = 0.5, seed: int = 1, local: int = LOCAL
) -> DataFrame:
    """(iteration, energy): the kinetic energy of force_layout() after each of its steps, for `local` points at most; ValueError beyond."""
    n = pairs.select(F.explode(F.array("i", "j")).alias("id")).distinct().count()
    if n > local:
        raise ValueError(f"the record is for {local} points at most")
    rounds, dims = n if iterations is None else iterations, p + 1 if planar else p

    def run(t: pa.Table) -> pa.Table:
        ids, r = square(np.asarray(t["i"]), np.asarray(t["j"]), np.asarray(t["r"]))
        energies: list[float] = []
        kernels.force(r, kernels.uniform(ids, dims, seed), rounds, planar, dampening, force_cap, spring, False, energies)
        return pa.table({"iteration": pa.array(range(1, rounds + 1), pa.int32()), "energy": pa.array(energies, pa.float64())})

    return pairs.select("i", "j", "r").groupBy().applyInArrow(run, "iteration int, energy double")


def nearest_k(directed: DataFrame, k: int) -> DataFrame:
    """The k pairs of each i with the least r, equal ones by j: (i, j, r, rank). Spark keeps k of each i before the exchange."""
    w = Window.partitionBy("i").orderBy("r", "j")
    return directed.select("i", "j", "r", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
