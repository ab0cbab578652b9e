"""The engine's tables and their checks.

points (id bigint, x array<double>); pairs (i bigint, j bigint, r double[, w double]) with i > j, the diagonal being 0;
edges (src bigint, dst bigint, weight double[, flow bigint]).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissimap.session import cut

POINTS = "id bigint, x array<double>"
PAIRS = "i bigint, j bigint, r double"


def as_points(df: DataFrame, key: str, x: str, dims: int | None = None) -> DataFrame:
    """points of a table's key and array column; with dims, its first coordinates. Rows without key or with a null, NaN or missing
    coordinate are left out."""
    v = F.transform(F.col(x), lambda e: e.cast("double"))
    p = df.select(F.col(key).cast("bigint").alias("id"), (F.slice(v, 1, dims) if dims else v).alias("x"))
    p = p.where(F.col("id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda e: e.isNull() | F.isnan(e)))
    return p.where(F.size("x") == dims) if dims else p


def planar_points(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("id"), F.array(F.col(x).cast("double"), F.col(y).cast("double")).alias("x")).where(
        F.col("id").isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    )


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair in either order. The pairs are read once."""
    rest = [c for c in pairs.columns if c not in ("i", "j")]
    there, back = (F.struct(F.col(a).alias("i"), F.col(b).alias("j")) for a, b in (("i", "j"), ("j", "i")))
    return pairs.select(F.explode(F.array(there, back)).alias("_e"), *rest).select("_e.i", "_e.j", *rest)


def check_complete(pairs: DataFrame, n: int | None = None) -> int:
    """The number of points of complete pairs. Raises ValueError if a pair is missing, repeated, or not i > j."""
    ids = pairs.select(F.explode(F.array("i", "j")).alias("id")).distinct().count()
    got = pairs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("i") <= F.col("j")).cast("int")), F.lit(0)).alias("bad")).first()
    n = ids if n is None else n
    if got.bad or ids not in (n, 0) or got.n != n * (n - 1) // 2:
        raise ValueError(f"pairs of {n} points are not complete: {got.n} rows, {got.bad} of them not i > j")
    return n


def dense_index(df: DataFrame, by: str, name: str = "idx") -> DataFrame:
    """df with name: 0, 1, ... in the order of `by` (unique). Range partitions are sorted and counted, so that no task sees
    all rows; the order is written down once, for it must not change."""
    s = cut(df.repartitionByRange(by).sortWithinPartitions(by).withColumns({"_p": F.spark_partition_id(), "_k": F.monotonically_increasing_id()}))
    counts = s.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_k").alias("k")).orderBy("_p").collect()  # a row for each partition
    rows, at = [], 0
    for r in counts:
        rows.append((r["_p"], at - r.k))
        at += r.n
    if not rows:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    shift = df.sparkSession.createDataFrame(rows, "_p int, _s bigint")
    return s.join(F.broadcast(shift), "_p").withColumn(name, F.col("_k") + F.col("_s")).drop("_p", "_k", "_s")  # a row for each partition
