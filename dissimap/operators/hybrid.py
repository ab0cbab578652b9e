"""Sampled and hybrid layouts: neighbour sets, sample and interpolate, pivots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dissimap.functions.vectors import mixed, plus, times
from dissimap.model import POINTS, both_ways, dense_index
from dissimap.operators import local as kernels
from dissimap.operators.distance import distinct_sample, sample_size
from dissimap.operators.force import cap, in_one_task, integrate, planar_pull, random_points, spring_forces
from dissimap.operators.spectral import LOCAL
from dissimap.session import cut


def random_candidates(points: DataFrame, pairs: DataFrame, s_max: int, seed: int) -> DataFrame:
    """(i, j, r): s_max different hashed others of each point (all, if there are fewer), with their dissimilarity.

    Points are numbered in the order of their ids; the n - 1 places after a point are cut into s_max runs, and a place is drawn from each by hash, the
    whole being turned by a hash of the point. So n * s_max pairs are made and looked up, and no point's pairs are sorted."""
    return drawn_candidates(dense_index(points.select("id"), "id", "at"), pairs, s_max, seed)


def drawn_candidates(numbered: DataFrame, pairs: DataFrame, s_max: int, seed: int) -> DataFrame:
    """random_candidates() of points (id, at) that are numbered."""
    n = numbered.count()
    s = min(s_max, n - 1)
    if s < 1:
        return pairs.select("i", "j", "r").limit(0)
    runs = F.array(*[F.struct(F.lit(k + 1).cast("bigint").alias("k"), F.lit(k * (n - 1) // s).cast("bigint").alias("low"), F.lit((k + 1) * (n - 1) // s - k * (n - 1) // s).cast("bigint").alias("wide")) for k in range(s)])
    d = numbered.select("id", "at", mixed("at", seed=seed).alias("turn"), F.explode(runs).alias("run"))
    place = F.pmod(F.col("at") + 1 + F.pmod(F.col("turn") + F.col("run.low") + F.pmod(mixed("at", "run.k", seed=seed), F.col("run.wide")), F.lit(n - 1)), F.lit(n))
    d = d.select(F.col("id").alias("p"), place.alias("at")).join(numbered.select("at", F.col("id").alias("q")), "at").select("p", "q")
    found = d.join(pairs.select("i", "j", "r"), (F.greatest("p", "q") == F.col("i")) & (F.least("p", "q") == F.col("j")))
    return found.select(F.col("p").alias("i"), F.col("q").alias("j"), "r")


def neighbour_sets(known: DataFrame | None, candidates: DataFrame, v_max: int) -> DataFrame:
    """(i, j, r, near): known neighbours and candidates, each once, near being whether j is among the v_max nearest of them (equal ones by j)."""
    every = candidates.select("i", "j", "r") if known is None else known.select("i", "j", "r").unionByName(candidates.select("i", "j", "r"))
    w = Window.partitionBy("i").orderBy("r", "j")
    return every.distinct().withColumn("near", F.row_number().over(w) <= v_max)


def neighbour_step(sets: DataFrame, state: DataFrame, dims: int, spring: float = 0.2, dampening: float = 0.3, force_cap: float = 0.5, pull: float = 0.0) -> DataFrame:
    """One step of state (id, x, v): the mean force over each point's neighbour set. A point without a set stays."""
    f = spring_forces(sets.select("i", "j", "r"), state.select("id", "x"), dims, spring)
    s = state.join(f, "id", "left").withColumn("f", F.coalesce("f", times("x", 0.0)))
    g = planar_pull(F.col("f"), F.col("x"), dims, pull) if pull else F.col("f")
    return integrate(s.withColumn("f", cap(g, force_cap)), dampening)


def neighbour_layout(
    pairs: DataFrame, p: int = 2, v_max: int = 5, s_max: int = 10, planar: bool = True, iterations: int | None = None, init: DataFrame | None = None, seed: int = 1, every: int = 3,
    local: int = LOCAL,
) -> DataFrame:
    """points in p dimensions by a force layout linear in the points for each iteration: each point keeps its v_max best neighbours so far and
    meets s_max hashed others. iterations: by default the number of points. Raises ValueError unless there are more than v_max + 1 points."""
    pairs = cut(pairs.select("i", "j", "r"))
    ids = cut(pairs.select(F.explode(F.array("i", "j")).alias("id")).distinct())
    n = ids.count()
    if n <= v_max + 1:
        raise ValueError("there must be more than v_max + 1 points")
    rounds = n if iterations is None else iterations
    dims = p + 1 if planar else p
    start = init.select("id", F.concat("x", F.array(F.lit(0.0))).alias("x") if planar else F.col("x")) if init is not None else None
    if n <= local:
        return in_one_task(pairs, start, lambda i, r, x: kernels.neighbours(r, kernels.uniform(i, dims, seed) if x is None else x, rounds, planar, v_max, s_max, seed)[:, :p])
    x = random_points(ids, dims, seed) if start is None else start
    ids = cut(dense_index(ids, "id", "at"))
    s, old, known, before = cut(x.withColumn("v", times("x", 0.0))), None, None, None
    for k in range(1, rounds + 1):
        sets = neighbour_sets(known, drawn_candidates(ids, pairs, s_max, seed * 1009 + k), v_max)
        s = neighbour_step(sets, s, dims, pull=0.2 * k / rounds if planar else 0.0)
        known = sets.where("near").drop("near")
        if k % every == 0:
            s, known = cut(s, old), cut(known, before)
            old, before = s, known
    return s.select("id", F.slice("x", 1, p).alias("x"))


def nearest_sample(to_sample: DataFrame) -> DataFrame:
    """(i, j, r): the nearest sampled point j of each i, of directed pairs to the sample; equal ones by j."""
    return to_sample.groupBy("i").agg(F.min(F.struct("r", "j")).alias("m")).select("i", "m.j", "m.r")


def subset_of_sample(to_sample: DataFrame, sample_n: int, seed: int = 1) -> DataFrame:
    """(i, j, r): 3 + floor(sqrt(sample_n)) hashed sampled points of each i."""
    w = Window.partitionBy("i").orderBy(mixed("i", "j", seed=seed), "j")
    m = 3 + math.isqrt(sample_n)
    return to_sample.withColumn("k", F.row_number().over(w)).where(F.col("k") <= m).select("i", "j", "r")


def polar_place(nearest: DataFrame, subset: DataFrame, layout: DataFrame, depth: int = 7) -> DataFrame:
    """points for each i on the circle of radius r about its nearest sampled point, in the plane: an angle from 0 is bisected `depth` times from
    steps of pi/2 down, each time to the side of the smaller sum of (d - r)^2 over the subset (the first side, if equal). The point is
    placed at the final angle. Raises ValueError unless the layout is planar."""
    if (layout.agg(F.max(F.size("x"))).first()[0] or 2) != 2:
        raise ValueError("the polar search needs two dimensions")
    centre = layout.select(F.col("id").alias("j"), F.col("x").alias("c"))
    other = layout.select(F.col("id").alias("j"), F.col("x").alias("s"))
    near = nearest.select("i", "j", F.col("r").alias("radius")).join(centre, "j").select("i", "radius", F.col("c")[0].alias("cx"), F.col("c")[1].alias("cy"))
    sub = subset.join(other, "j").groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", F.col("s")[0].alias("x"), F.col("s")[1].alias("y"), "r"))).alias("t"))
    p = near.join(sub, "i").select("i", "radius", "cx", "cy", *[F.col(f"t.{c}").alias(c) for c in "xyr"])
    return p.mapInArrow(_bisect(depth), POINTS)


def _bisect(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            radius, cx, cy = (np.asarray(b.column(c), np.float64) for c in range(1, 4))
            n = np.asarray(b.column(4).value_lengths())
            row, start = np.repeat(np.arange(len(n)), n), np.concatenate([[0], np.cumsum(n)[:-1]])
            x, y, r = (np.asarray(b.column(c).flatten(), np.float64) for c in range(4, 7))
            angle = np.zeros(len(n))

            def loss(a: np.ndarray) -> np.ndarray:
                px, py = cx + radius * np.cos(a), cy + radius * np.sin(a)
                return np.add.reduceat((np.sqrt((px[row] - x) ** 2 + (py[row] - y) ** 2) - r) ** 2, start)

            for k in range(depth):
                step = math.pi / 2 / 2**k
                angle = np.where(loss(angle - step) < loss(angle + step), angle - step, angle + step)
            place = pa.array(list(np.column_stack([cx + radius * np.cos(angle), cy + radius * np.sin(angle)])), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), place], ["id", "x"])

    return run


def force_refine(placed: DataFrame, subset: DataFrame, layout: DataFrame, dims: int = 2) -> DataFrame:
    """placed points after one step of the mean spring force (of strength 1) to their subsets."""
    f = spring_forces(subset, layout.unionByName(placed), dims, 1.0)
    return placed.join(f, "id").select("id", plus("x", "f").alias("x"))


def pivot_buckets(to_pivot: DataFrame, size: int) -> DataFrame:
    """(pivot, bucket, key, member, r) of directed pairs (i = pivot, j = sampled point, r): a pivot's sampled points in descending distance,
    `size` to a bucket; the first bucket's key is infinite, a later one's the largest distance in it. Points of equal distance
    all stay (by id)."""
    w = Window.partitionBy("i").orderBy(F.desc("r"), "j")
    b = to_pivot.withColumn("bucket", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    key = F.when(F.col("bucket") == 0, F.lit(float("inf"))).otherwise(F.max("r").over(Window.partitionBy("i", "bucket")))
    return b.select(F.col("i").alias("pivot"), "bucket", key.alias("key"), F.col("j").alias("member"), "r")


def pivot_nearest(buckets: DataFrame, points_to_pivots: DataFrame, points_to_sample: DataFrame) -> DataFrame:
    """(i, j, r): for each i, of all pivots' buckets with the smallest key at or above its distance to the pivot, the nearest member j.
    Approximate. The buckets of one pivot become an array of keys, so the lookup is a join on the pivot with a binary
    choice in an expression, not a range join."""
    keys = buckets.select("pivot", "key", "bucket").distinct().groupBy("pivot").agg(F.array_sort(F.collect_list(F.struct("key", "bucket"))).alias("keys"))
    at = points_to_pivots.select("i", F.col("j").alias("pivot"), F.col("r").alias("rp")).join(F.broadcast(keys), "pivot")  # 2p pivots by sqrt(n) keys
    at = at.select("i", "pivot", F.get(F.filter("keys", lambda e: e["key"] >= F.col("rp")), F.lit(0))["bucket"].alias("bucket"))
    found = at.join(buckets.select("pivot", "bucket", F.col("member").alias("j")), ["pivot", "bucket"]).select("i", "j").distinct()
    return nearest_sample(found.join(points_to_sample, ["i", "j"]))


def _sampled(pairs: DataFrame, p: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    pairs = cut(pairs.select("i", "j", "r"))
    ids = pairs.select(F.explode(F.array("i", "j")).alias("id")).distinct()
    n = ids.count()
    m = sample_size(n)
    if n < 13:
        raise ValueError("the sampled layouts need at least 13 points")
    sample = cut(distinct_sample(ids, m, seed))
    a, b = sample.withColumnRenamed("id", "i"), sample.withColumnRenamed("id", "j")
    among = pairs.join(a, "i", "left_semi").join(b, "j", "left_semi")
    to = cut(both_ways(pairs).join(b, "j", "left_semi").join(a, "i", "left_anti"))
    return pairs, among, to, n


def _rest(pairs: DataFrame, among: DataFrame, to: DataFrame, nearest: DataFrame, n: int, p: int, seed: int) -> DataFrame:
    layout = cut(neighbour_layout(among, p, planar=True, seed=seed))
    subset = cut(subset_of_sample(to, layout.count(), seed))
    placed = cut(polar_place(nearest, subset, layout))
    every = layout.unionByName(force_refine(placed, subset, layout, p))
    return neighbour_layout(pairs, p, planar=False, iterations=math.isqrt(n), init=every, seed=seed + 1)


def sampled_layout(pairs: DataFrame, p: int = 2, seed: int = 1) -> DataFrame:
    """points in the plane: a sample of 10 + floor(sqrt(n)) is laid out by neighbour_layout(), the others are placed about their nearest sampled
    point and refined, then floor(sqrt(n)) iterations run over all."""
    if p != 2:
        raise ValueError("the polar search needs two dimensions")
    pairs, among, to, n = _sampled(pairs, p, seed)
    return _rest(pairs, among, to, nearest_sample(to), n, p, seed)


def pivot_layout(pairs: DataFrame, p: int = 2, seed: int = 1) -> DataFrame:
    """As sampled_layout(), the nearest sampled point being looked up in the distance buckets of 2p pivots."""
    if p != 2:
        raise ValueError("the polar search needs two dimensions")
    pairs, among, to, n = _sampled(pairs, p, seed)
    names = among.select(F.explode(F.array("i", "j")).alias("id")).distinct()
    pivots = cut(distinct_sample(names, 2 * p, seed + 1))
    sampled = both_ways(among)
    buckets = cut(pivot_buckets(sampled.join(pivots.withColumnRenamed("id", "i"), "i", "left_semi"), max(1, int(n**0.25))))
    to_pivots = to.join(pivots.withColumnRenamed("id", "j"), "j", "left_semi")
    return _rest(pairs, among, to, pivot_nearest(buckets, to_pivots, to), n, p, seed)
