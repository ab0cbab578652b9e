"""Classical scaling and its sparse variant."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dissimap.functions.vectors import uniform
from dissimap.model import POINTS, both_ways, check_complete
from dissimap.operators.scoring import double_center
from dissimap.session import cut

#: The most points whose centred matrix one task decomposes; more are decomposed by distributed subspace iteration.
LOCAL = 3000


def square(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids = np.unique(np.concatenate([i, j]))
    m = np.zeros((len(ids), len(ids)))
    a, b = np.searchsorted(ids, i), np.searchsorted(ids, j)
    m[a, b] = v
    m[b, a] = v
    return ids, m


def canonical(vectors: np.ndarray) -> np.ndarray:
    """Eigenvectors with their largest entry positive (the first of equal ones)."""
    at = np.abs(vectors).argmax(0)
    s = np.sign(vectors[at, np.arange(vectors.shape[1])])
    return vectors * np.where(s == 0, 1, s)


def center(r: np.ndarray) -> np.ndarray:
    s = r * r
    m = s.mean(1)
    return -0.5 * (s - m[:, None] - m[None] + m.mean())


def kept(values: np.ndarray, most: int, tolerance: float) -> int:
    """How many leading values (descending) are kept: while the share before them is under 1 - tolerance, none from the first negative, `most` at most."""
    total, part, k = values.sum(), 0.0, 0
    while k < min(most, len(values)) and values[k] > 0 and (total <= 0 or part / total < 1 - tolerance):
        part += values[k]
        k += 1
    return k


def local_layout(b: np.ndarray, p: int, spectrum: str, tolerance: float | None) -> np.ndarray:
    values, vectors = np.linalg.eigh(b)
    order = np.argsort(-np.abs(values) if spectrum == "singular" else -values, kind="stable")
    values, vectors = values[order], canonical(vectors[:, order])
    if tolerance is not None:
        p = kept(values, p, tolerance)
    values = np.abs(values[:p]) if spectrum == "singular" else np.maximum(values[:p], 0)
    return vectors[:, :p] * np.sqrt(values)


def _solve(p: int, spectrum: str, tolerance: float | None):
    def run(t: pa.Table) -> pa.Table:
        ids, r = square(np.asarray(t["i"]), np.asarray(t["j"]), np.asarray(t["r"]))
        x = local_layout(center(r), p, spectrum, tolerance)
        return pa.table({"id": ids, "x": pa.array(list(x), pa.list_(pa.float64()))})

    return run


def _subspace(pairs: DataFrame, n: int, p: int, spectrum: str, tolerance: float | None, rounds: int, seed: int) -> DataFrame:
    """The leading eigenpairs by subspace iteration: a product with the centred matrix is a join and an aggregate of its entries; only
    the k x k Gram matrices come to the driver."""
    k = p + 4
    b = both_ways(double_center(pairs, n)).unionByName(double_center(pairs, n, diagonal=True).where("i = j"))
    b = cut(b)
    y = b.select("i").distinct().select(F.col("i").alias("id"), *[(uniform("i", F.lit(c), seed=seed) - 0.5).alias(f"y{c}") for c in range(k)])
    old = None
    names = [f"y{c}" for c in range(k)]

    def times(df: DataFrame, m: np.ndarray) -> DataFrame:
        return df.select("id", *[sum((F.col(names[a]) * float(m[a, c]) for a in range(k)), F.lit(0.0)).alias(names[c]) for c in range(m.shape[1])])

    def gram(df: DataFrame, other: DataFrame | None = None) -> np.ndarray:
        o = df if other is None else df.join(other.select("id", *[F.col(c).alias(f"o{c}") for c in names]), "id")
        pre = "" if other is None else "o"
        row = o.agg(*[F.sum(F.col(names[a]) * F.col(pre + names[c])).alias(f"g{a}_{c}") for a in range(k) for c in range(k)]).first()
        return np.array(row, float).reshape(k, k)

    def orthonormal(df: DataFrame) -> DataFrame:
        e, v = np.linalg.eigh(gram(df))
        use = e > 1e-22 * max(e.max(), 1e-300)  # directions that are already spanned become 0
        return times(df, v * np.where(use, 1 / np.sqrt(np.where(use, e, 1)), 0))

    last = None
    for _ in range(rounds):
        q = cut(orthonormal(y), old)
        old = q
        y = cut(b.join(q, b.j == q.id).groupBy("i").agg(*[F.sum(F.col("b") * F.col(c)).alias(c) for c in names]).withColumnRenamed("i", "id"))
        t = gram(q, y)
        values, w = np.linalg.eigh((t + t.T) / 2)
        order = np.argsort(-np.abs(values) if spectrum == "singular" else -values)
        values, w = values[order], w[:, order]
        if last is not None and np.allclose(values[:p], last[:p], rtol=1e-12, atol=1e-12 * abs(values[0])):
            break
        last = values
    else:
        raise RuntimeError(f"the leading eigenvalues have not settled within {rounds} rounds")
    m = p if tolerance is None else kept(values, p, tolerance)
    use = np.sqrt(np.abs(values[:m]) if spectrum == "singular" else np.maximum(values[:m], 0))
    out = times(q, w)
    return out.select("id", F.array(*[F.col(names[c]) * float(use[c]) for c in range(m)]).cast("array<double>").alias("x"))


def classical_scaling(
    pairs: DataFrame, p: int, spectrum: str = "singular", tolerance: float | None = None, local: int = LOCAL, rounds: int = 200, seed: int = 3
) -> DataFrame:
    """points in p dimensions from complete pairs: the leading eigenvectors of the double-centred squares, times the roots of their
    eigenvalues. spectrum 'singular' orders by size without regard to sign (large negative ones count as if positive);
    'eigen' by value, negative ones as 0. With tolerance, as many dimensions (p at most) as hold 1 - tolerance of the sum.

    Up to `local` points, one task holds the matrix; beyond, the matrix stays distributed. Raises ValueError if pairs are missing or hold
    a null, NaN or infinite value. No pairs, no points.
    """
    if spectrum not in ("singular", "eigen"):
        raise ValueError("spectrum is 'singular' or 'eigen'")
    n = check_complete(pairs)
    if pairs.where("r is null or isnan(r) or r = double('inf')").limit(1).count():
        raise ValueError("a dissimilarity is null, NaN or infinite (unreachable)")
    if not n:
        return pairs.sparkSession.createDataFrame([], POINTS)
    if n <= local:
        return pairs.select("i", "j", "r").groupBy().applyInArrow(_solve(p, spectrum, tolerance), POINTS)
    return _subspace(pairs, n, p, spectrum, tolerance, rounds, seed)


def sparse_scaling(pairs: DataFrame, most: int, tolerance: float = 1e-3, **kw) -> DataFrame:
    """classical_scaling() by signed eigenvalues, with as many dimensions as the tolerance asks, `most` at most."""
    return classical_scaling(pairs, most, "eigen", tolerance, **kw)


def variance_cutoff(values: DataFrame, most: int, tolerance: float) -> DataFrame:
    """(component, value, share_before, kept) of values(component, value), a row for each component of a solver (a bounded number)."""
    order = Window.orderBy(F.desc("value"), "component")
    v = values.withColumns({"upto": F.sum("value").over(order), "total": F.sum("value").over(Window.partitionBy()), "k": F.row_number().over(order)})
    before = F.coalesce(F.try_divide(F.col("upto") - F.col("value"), "total"), F.lit(0.0))
    return v.select("component", "value", before.alias("share_before"), ((before < 1 - tolerance) & (F.col("value") > 0) & (F.col("k") <= most)).alias("kept"))
