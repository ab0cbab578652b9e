"""Double centring and stress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissimap.model import both_ways
from dissimap.operators.distance import with_points
from dissimap.session import cut

KINDS = ("raw", "normalised", "kruskal")


def double_center(pairs: DataFrame, n: int, diagonal: bool = False) -> DataFrame:
    """b = -(r^2 - m_i - m_j + m) / 2 with row means m_i and grand mean m of the squares over n points: (i, j, b); with
    diagonal, i = j too. No n x n matrix is formed: two aggregates and two joins on a point's id."""
    rows = cut(both_ways(pairs).groupBy("i").agg((F.sum(F.col("r") * F.col("r")) / n).alias("m")))  # used three times
    grand = rows.agg(F.avg("m") * F.count(F.lit(1)) / n).first()[0] or 0.0
    a, b = rows.select("i", F.col("m").alias("mi")), rows.select(F.col("i").alias("j"), F.col("m").alias("mj"))
    value = (F.col("r") * F.col("r") - F.col("mi") - F.col("mj") + F.lit(grand)) * -0.5
    out = pairs.join(a, "i").join(b, "j").select("i", "j", value.alias("b"))
    return out.unionByName(rows.select("i", F.col("i").alias("j"), (F.col("m") - grand / 2).alias("b"))) if diagonal else out


def stress(pairs: DataFrame, points: DataFrame, kind: str = "normalised", weight: Column | None = None) -> DataFrame:
    """One row (stress): over pairs of weight w (1 by default), sum w(d-r)^2 (raw), that over sum w r^2 (normalised), or the root of
    that over sum w d^2 (kruskal). Null if there are no pairs, or nothing to divide by. Raises ValueError for another kind."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    w = F.lit(1.0) if weight is None else weight
    e = F.col("d") - F.col("r")
    s = with_points(pairs, points).agg(F.sum(w * e * e).alias("raw"), F.sum(w * F.col("r") * F.col("r")).alias("r2"), F.sum(w * F.col("d") * F.col("d")).alias("d2"))
    value = {"raw": F.col("raw"), "normalised": F.try_divide("raw", "r2"), "kruskal": F.sqrt(F.try_divide("raw", "d2"))}[kind]
    return s.select(value.alias("stress"))
