"""Readers of the map: items with their details, boxes, the hull."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissimap.session import cut, input_partitions


def placed_items(item: DataFrame) -> DataFrame:
    """Items whose location is neither null nor NaN."""
    return item.where("x is not null and y is not null and not isnan(x) and not isnan(y)")


def get_items(item: DataFrame, detail: DataFrame) -> DataFrame:
    """(id, x, y, sample_count, value_mean, title) of items with details. A NaN place, which means not placed, is null."""
    at = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("x", "y")]
    return item.join(detail.select("id", "title"), "id").select("id", *at, "sample_count", "value_mean", "title")


def get_items_box(item: DataFrame, detail: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float) -> DataFrame:
    """get_items() in a box, its sides included; the predicate reaches the scan."""
    return get_items(item.where(F.col("x").between(min_x, max_x) & F.col("y").between(min_y, max_y)), detail)


def dense_locations(item: DataFrame) -> DataFrame:
    """(id, x, y) for every id from 0 to the greatest: null places where there is no item."""
    top = item.agg(F.max("id")).first()[0]
    ids = item.sparkSession.range(0, (top if top is not None else -1) + 1)
    return ids.join(item.select("id", "x", "y"), "id", "left")


def chain(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positions of the hull's corners, counter-clockwise from the leftmost lowest; points on its sides are not corners, and of equal
    points the least id stands for all."""
    order = np.lexsort((ids, y, x))
    order = order[np.r_[True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)]] if len(order) else order
    if len(order) < 3:
        return order
    if len(order) > 64:  # points well inside the polygon of the extremes in eight directions are no corners
        px, py = x[order], y[order]
        ends = [int(np.argmax(a * px + b * py)) for a, b in ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))]
        slack = 1e-9 * (np.ptp(px) + np.ptp(py)) ** 2
        inside = np.ones(len(order), bool)
        for u, v in zip(ends, ends[1:] + ends[:1]):
            if u != v:
                inside &= (px[v] - px[u]) * (py - py[u]) - (py[v] - py[u]) * (px - px[u]) > slack
        order = order[~inside]

    def half(seq: np.ndarray) -> list[int]:
        h: list[int] = []
        for k in seq:
            while len(h) > 1 and (x[h[-1]] - x[h[-2]]) * (y[k] - y[h[-2]]) - (y[h[-1]] - y[h[-2]]) * (x[k] - x[h[-2]]) <= 0:
                h.pop()
            h.append(int(k))
        return h[:-1]

    return np.array(half(order) + half(order[::-1]))


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [[np.asarray(b.column(c)) for c in range(3)] for b in batches if b.num_rows]
    if got:
        ids, x, y = (np.concatenate([g[c] for g in got]) for c in range(3))
        h = chain(ids, x, y)
        yield pa.RecordBatch.from_arrays([pa.array(ids[h]), pa.array(x[h]), pa.array(y[h])], ["id", "x", "y"])


def _order(t: pa.Table) -> pa.Table:
    ids, x, y = (np.asarray(t[c]) for c in ("id", "x", "y"))
    h = chain(ids, x, y)
    return pa.table({"point_id": ids[h], "cyclic_order": pa.array(np.arange(len(h)), pa.int32()), "x": x[h], "y": y[h]})


def convex_hull(item: DataFrame, fan_in: int = 16) -> DataFrame:
    """(point_id, cyclic_order, x, y): the corners of the placed items' hull, counter-clockwise from the leftmost lowest. Partitions are reduced
    to their hulls, fan_in of them at a time to the hull of both, until one task orders what is left, which is no more than hull corners."""
    p = placed_items(item).select(F.col("id").cast("bigint").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    p = cut(p.mapInArrow(_local, "id bigint, x double, y double"))
    parts = input_partitions(p)
    while parts > fan_in:
        parts = -(-parts // fan_in)
        p = p.coalesce(parts).mapInArrow(_local, "id bigint, x double, y double")
    return p.groupBy().applyInArrow(_order, "point_id bigint, cyclic_order int, x double, y double")


def get_hull(hull: DataFrame, item: DataFrame) -> DataFrame:
    """(point_id, cyclic_order, x, y): stored hull points with their items' locations, in order."""
    return hull.join(item.select(F.col("id").alias("point_id"), "x", "y"), "point_id").select("point_id", "cyclic_order", "x", "y").orderBy("cyclic_order")
