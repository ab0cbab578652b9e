"""Top N items within every group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dissimap.operators.skew import join_hot
from dissimap.session import cut

#: Rows that a task gathers before it keeps the best of them.
GATHERED = 1 << 16


def _best(rows: list[tuple[np.ndarray, ...]], n: int) -> tuple[np.ndarray, ...]:
    """Of rows (g, s, t), the first n of each group by (s, t), in the order of (g, s, t)."""
    g, s, t = (np.concatenate([r[c] for r in rows]) for c in range(3))
    order = np.lexsort((t, s, g))
    g, s, t = g[order], s[order], t[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, int)
    keep = np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)])) < n
    return g[keep], s[keep], t[keep]


def _added(g: np.ndarray, n: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups and their rows, with those of one more batch."""
    own, count = np.unique(more, return_counts=True)
    both, at = np.unique(np.r_[g, own], return_inverse=True)
    return both, np.bincount(at.ravel(), np.r_[n, count], len(both)).astype(np.int64)


def _bounds(n: int):
    """The n-th best of a partition's groups of at least n rows, with the group's rows in the partition. Only the n best rows of each group so far are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        groups, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        pending, size = [held], 0
        for b in batches:
            pending.append(tuple(np.asarray(b.column(c)) for c in range(3)))
            groups, counts = _added(groups, counts, pending[-1][0])
            size += b.num_rows
            if size > max(GATHERED, len(pending[0][0])):
                pending, size = [_best(pending, n)], 0
        g, s, t = _best(pending, n)
        last = np.flatnonzero(np.r_[g[1:] != g[:-1], True]) if len(g) else np.empty(0, int)
        many = counts >= n
        at = last[many[np.searchsorted(groups, g[last])]] if len(g) else last
        yield pa.RecordBatch.from_arrays([pa.array(g[at], pa.int64()), pa.array(s[at], pa.float64()), pa.array(t[at], pa.int64()), pa.array(counts[many], pa.int64())], ["g", "s", "t", "rows"])

    return run


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int, largest: bool = False) -> DataFrame:
    """The n rows of each group with the smallest score (largest=True: the largest), equal scores by the smaller item:
    (group bigint, item bigint, score double, rank int from 1) under the names given.

    Rows whose group, item or score is null, or whose score is NaN, do not take part. Rows equal in all three are rows of
    their own. A group of fewer than n rows is kept whole; empty input gives no rows.

    Each partition's n-th best of a group bounds that group's n-th best from above. The least bound of each group meets
    its rows, and what lies beyond goes before anything is ranked; bounds of hot groups, of which there are MOST_HOT at most, come to their rows by a
    broadcast (join_hot), so these rows are not exchanged. Only survivors of a group come together: n, and those of other
    partitions that beat the best partition's n-th.
    """
    sign = F.lit(-1.0 if largest else 1.0)
    rows = df.select(F.col(group).cast("bigint").alias("g"), (F.col(score).cast("double") * sign).alias("s"), F.col(item).cast("bigint").alias("t"))
    rows = cut(rows.where("g is not null and t is not null and s is not null and not isnan(s)"))
    local = rows.mapInArrow(_bounds(n), "g bigint, s double, t bigint, rows bigint")
    bound = cut(local.groupBy("g").agg(F.min(F.struct("s", "t")).alias("bound"), F.sum("rows").alias("rows")))
    left = join_hot(rows, bound, "g", "rows", "left").where(F.col("bound").isNull() | (F.struct("s", "t") <= F.col("bound")))
    rank = F.row_number().over(Window.partitionBy("g").orderBy("s", "t"))
    return (
        left.select("g", "t", "s", rank.alias("rank"))
        .where(F.col("rank") <= n)
        .select(F.col("g").alias(group), F.col("t").alias(item), (F.col("s") * sign).alias(score), "rank")
    )
