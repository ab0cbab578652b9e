"""Neighbourhood graphs, geodesics and robust pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissimap.model import PAIRS, both_ways
from dissimap.operators.distance import block_pairs, matrix_of
from dissimap.operators.force import nearest_k
from dissimap.session import cut

#: Edges that every task may hold (24 bytes each); larger graphs are relaxed by joins.
HELD = 5_000_000


def knn_edges(pairs: DataFrame, k: int) -> DataFrame:
    """(src, dst, weight, rank): from each point to its k nearest, equal ones by id."""
    return nearest_k(both_ways(pairs.select("i", "j", "r")), k).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("r").alias("weight"), "rank")


def knn_points(points: DataFrame, k: int, rows: int = 1000) -> DataFrame:
    """knn_edges() of the Euclidean distances of points: each tile of two blocks of points keeps k of each point, and the pairs themselves are never written."""
    return nearest_k(block_pairs(points, _tile_nearest(k), PAIRS, rows=rows), k).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("r").alias("weight"), "rank")


def _tile_nearest(k: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        ids, x, block = np.asarray(t["id"], np.int64), matrix_of(t["x"]), np.asarray(t["block"])
        p, q = (np.flatnonzero(block == key[c].as_py()) for c in (0, 1))
        out = []
        for a, b in ((p, q), (q, p)) if key[0].as_py() != key[1].as_py() else ((p, p),):
            for s in range(0, len(a), 256):
                rows = a[s : s + 256]
                d = np.zeros((len(rows), len(b)))
                for c in range(x.shape[1]):
                    d += (x[rows, c][:, None] - x[b, c][None]) ** 2
                d = np.sqrt(d)
                d[ids[rows][:, None] == ids[b][None]] = np.inf
                order = np.lexsort((np.broadcast_to(ids[b], d.shape), d), axis=1)[:, :k]
                i, j, r = np.repeat(ids[rows], order.shape[1]), ids[b][order].ravel(), np.take_along_axis(d, order, axis=1).ravel()
                ok = i != j
                out.append((i[ok], j[ok], r[ok]))
        i, j, r = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"i": i, "j": j, "r": r})

    return run


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): edges in both directions, each once."""
    e = edges.select("src", "dst", "weight")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).distinct()


def directed(edges: DataFrame, m: float = 2.0) -> DataFrame:
    """(src, dst, weight, flow): edges with weights r^m and no flow yet."""
    return edges.select("src", "dst", F.pow("weight", F.lit(m)).alias("weight"), F.lit(0).cast("bigint").alias("flow"))


def knn_undirected(pairs: DataFrame, k: int) -> DataFrame:
    """(src, dst, weight): knn_edges() in both directions, each once."""
    return undirected(knn_edges(pairs, k))


def knn_directed(pairs: DataFrame, k: int, m: float = 2.0) -> DataFrame:
    """(src, dst, weight, flow): knn_edges() with weights r^m and no flow yet."""
    return directed(knn_edges(pairs, k), m)


#: Distances and edge ends of a block of sources that a task relaxes together.
RELAXED = 4_000_000


def _shortest(sources: np.ndarray, n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Distances from a block of sources (positions) to all n points: all edges, ordered by dst, relaxed together until nothing changes."""
    dist = np.full((len(sources), n), np.inf)
    dist[np.arange(len(sources)), sources] = 0.0
    if not len(src):
        return dist
    start = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
    ends, open_ = dst[start], np.arange(len(sources))
    while len(open_):
        old = dist[open_]
        new = np.minimum(np.minimum.reduceat(old[:, src] + w, start, axis=1), old[:, ends])
        changed = (new < old[:, ends]).any(1)
        old[:, ends] = new
        dist[open_] = old
        open_ = open_[changed]
    return dist


def _last_edges(sources: np.ndarray, dist: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> np.ndarray:
    """How many of the shortest paths from the sources each edge is the last of; of equal paths, that over the least predecessor. Edges by (dst, src, w)."""
    count = np.zeros(len(src), np.int64)
    if not len(src):
        return count
    start = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
    own = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(dst)]))
    for s, row in zip(sources, dist):
        on = np.flatnonzero((row[src] + w == row[dst]) & np.isfinite(row[dst]) & (dst != s))
        first = np.unique(own[on], return_index=True)[1]
        count[on[first]] += 1
    return count


def _held(edges: DataFrame, nodes: DataFrame | None = None) -> tuple:
    """The graph as arrays: ids, and the edges' ends by position and weights, ordered by (dst, src, weight). HELD edges at most."""
    t = edges.select("src", "dst", "weight").toArrow()  # counted before
    src, dst, w = (np.asarray(t[c]) for c in ("src", "dst", "weight"))
    order = np.lexsort((w, src, dst))
    src, dst, w = src[order], dst[order], w[order]
    own = np.asarray(nodes.select("src").toArrow()["src"]) if nodes is not None else np.empty(0, np.int64)
    ids = np.unique(np.concatenate([src, dst, own]))
    return ids, np.searchsorted(ids, src), np.searchsorted(ids, dst), w


def _paths(shared, flows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, src, dst, w = shared.value
        count = np.zeros(len(src), np.int64)
        block = max(1, RELAXED // max(1, len(src), len(ids)))
        for b in batches:
            sources = np.searchsorted(ids, np.asarray(b.column(0), np.int64))
            for k in range(0, len(sources), block):
                part = sources[k : k + block]
                dist = _shortest(part, len(ids), src, dst, w)
                if flows:
                    count += _last_edges(part, dist, src, dst, w)
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[part], len(ids))), pa.array(np.tile(ids, len(part))), pa.array(dist.ravel())], ["src", "dst", "distance"])
        if flows:
            e = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(ids[src[e]]), pa.array(ids[dst[e]]), pa.array(count[e])], ["src", "dst", "flow"])

    return run


def _sources(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    every = edges.select(F.explode(F.array("src", "dst")).alias("src"))
    nodes = (every if nodes is None else every.unionByName(nodes.select("src"))).distinct()
    return nodes.repartition(max(8, nodes.sparkSession.sparkContext.defaultParallelism * 2), "src")


def geodesics(edges: DataFrame, held: int = HELD, nodes: DataFrame | None = None) -> DataFrame:
    """(src, dst, distance) of all ordered pairs of an edge table's nodes, and of nodes (src) without edges: the shortest directed path, infinite if there is none, 0 to
    itself. Weights are not negative.

    Up to `held` edges every task holds the graph as arrays (24 bytes an edge) and relaxes it for blocks of its share of the sources; a larger graph is relaxed by joins until
    nothing changes, the distances staying distributed.
    """
    edges = edges.select("src", "dst", "weight")
    if edges.count() > held:
        return _relaxed(edges, nodes)
    got = edges.sparkSession.sparkContext.broadcast(_held(edges, nodes))
    return _sources(edges, nodes).mapInArrow(_paths(got, False), "src bigint, dst bigint, distance double")


def _relaxed(edges: DataFrame, own: DataFrame | None = None, most: int = 10_000) -> DataFrame:
    edges = cut(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    nodes = cut((ends if own is None else ends.unionByName(own.select(F.col("src").alias("id")))).distinct())
    dist = cut(edges.select("src", "dst", F.col("weight").alias("distance")).unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("distance"))).groupBy("src", "dst").agg(F.min("distance").alias("distance")))
    size = None
    for _ in range(most):
        step = dist.alias("d").join(edges.alias("e"), F.col("d.dst") == F.col("e.src")).select("d.src", "e.dst", (F.col("d.distance") + F.col("e.weight")).alias("distance"))
        dist = cut(dist.unionByName(step).groupBy("src", "dst").agg(F.min("distance").alias("distance")), dist)
        now = dist.agg(F.count(F.lit(1)), F.sum("distance")).first()
        if size == now:
            break
        size = now
    n = nodes.count()
    if size[0] == n * n:
        return dist
    every = nodes.select(F.col("id").alias("src")).join(nodes.select(F.col("id").alias("dst")), F.lit(True))  # the result has n x n rows
    return every.join(dist, ["src", "dst"], "left").select("src", "dst", F.coalesce("distance", F.lit(float("inf"))).alias("distance"))


def isomap(pairs: DataFrame, k: int) -> DataFrame:
    """pairs (i > j, r) of geodesics over the undirected graph of k nearest neighbours; infinite where parts are not connected."""
    return geodesics(knn_undirected(pairs, k)).where("src > dst").select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("distance").alias("r"))


def largest_component(pairs: DataFrame) -> DataFrame:
    """The pairs among the points that reach the most others (of several such parts, that of the least id)."""
    near = both_ways(pairs.where("r < double('inf')"))
    ids = pairs.select(F.explode(F.array("i", "j")).alias("i")).distinct()
    part = ids.join(near.groupBy("i").agg(F.min("j").alias("m"), F.count(F.lit(1)).alias("n")), "i", "left").select("i", F.least("i", F.coalesce("m", "i")).alias("part"))
    best = part.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "part").limit(1)
    own = part.join(best.select("part"), "part", "left_semi").select("i")
    return pairs.join(own, "i", "left_semi").join(own.withColumnRenamed("i", "j"), "j", "left_semi").select("i", "j", "r")


def edge_flow(edges: DataFrame, held: int = HELD) -> DataFrame:
    """(src, dst, weight, flow): for each edge, over how many shortest paths of ordered pairs it is the last; of equal paths that over the
    predecessor of the least id counts. Counts are summed in each task before the exchange. Raises ValueError beyond `held` edges."""
    if edges.count() > held:
        raise ValueError(f"the flow needs a graph of {held} edges at most")
    got = edges.sparkSession.sparkContext.broadcast(_held(edges))
    flow = _sources(edges).mapInArrow(_paths(got, True), "src bigint, dst bigint, flow bigint").groupBy("src", "dst").agg(F.sum("flow").alias("flow"))
    return edges.select("src", "dst", "weight").join(flow, ["src", "dst"], "left").select("src", "dst", "weight", F.coalesce("flow", F.lit(0)).cast("bigint").alias("flow"))


def flow_gamma_fit(flows: DataFrame) -> DataFrame:
    """One row (flow_mean, flow_variance, shape, scale): a gamma distribution of the edges' flows by moments (sample variance), edges without
    flow included."""
    m = flows.agg(F.avg("flow").alias("flow_mean"), F.var_samp("flow").alias("flow_variance"))
    return m.withColumns({"shape": F.try_divide(F.col("flow_mean") * F.col("flow_mean"), "flow_variance"), "scale": F.try_divide("flow_variance", "flow_mean")})


def critical_flow(spark, shape: float, scale: float, intolerance: float, flow_scale: str = "gamma") -> float:
    """The flow above which an edge is an outlier. flow_scale 'gamma' takes the fitted scale; 'reference' its inverse, for results as
    they were."""
    if flow_scale not in ("gamma", "reference"):
        raise ValueError("flow_scale is 'gamma' or 'reference'")
    if not shape or not scale or shape != shape or scale != scale:
        return float("inf")
    s = scale if flow_scale == "gamma" else 1 / scale
    return spark._jvm.org.apache.commons.math3.distribution.GammaDistribution(float(shape), float(s)).inverseCumulativeProbability(1 - intolerance)


def prune(flows: DataFrame, degrees: DataFrame, critical: float) -> DataFrame:
    """Edges to remove: (src, dst) of flow above critical whose two ends both have more than one edge out in degrees (src, n)."""
    many = degrees.where("n > 1").select("src")
    out = flows.where(F.col("flow") > critical).select("src", "dst")
    return out.join(many, "src", "left_semi").join(many.withColumnRenamed("src", "dst"), "dst", "left_semi")


def robust_isomap(pairs: DataFrame, k: int, m: float = 2.0, intolerance: float = 0.05, flow_scale: str = "gamma", rounds: int = 4, mutual: bool = False) -> DataFrame:
    """pairs (i > j, r): geodesics of p-norm m from i to j over the directed graph of k nearest neighbours, after rounds in which edges of
    outlying flow are removed (the distances being those before the last removal, as soon as a round removes none or the rounds are over).
    Infinite where there is no path; mutual: only the pairs among the largest set of points that reach each other both ways."""
    edges = cut(knn_directed(pairs, k, m).drop("flow"))
    degrees = cut(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")))
    used = edges
    for _ in range(rounds):
        flows = cut(edge_flow(edges))
        fit = flow_gamma_fit(flows).first()
        critical = critical_flow(pairs.sparkSession, fit["shape"], fit["scale"], intolerance, flow_scale)
        gone = cut(prune(flows, degrees, critical))
        used = edges
        if not gone.limit(1).count():
            break
        edges = cut(edges.join(gone, ["src", "dst"], "left_anti"))
    g = geodesics(used, nodes=degrees.select("src"))  # every point has edges before any are removed
    if mutual:
        g = cut(g)
        there = g.where("distance < double('inf')").select("src", "dst")
        back = there.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        part = there.join(back, ["src", "dst"]).groupBy("src").agg(F.min("dst").alias("part"))
        best = part.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "part").limit(1)
        own = part.join(best.select("part"), "part", "left_semi").select("src")
        g = g.join(own, "src", "left_semi").join(own.withColumnRenamed("src", "dst"), "dst", "left_semi")
    g = g.where("src > dst")
    return g.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.pow("distance", F.lit(1.0 / m)).alias("r"))
