"""Grouping records into similarity clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissimap.functions.vectors import dot, sum_of_vectors, times
from dissimap.llm.neighbours import BLOCK, Grid, Heaps, _matrix, _threshold, cells, clean_vectors, meetings, tile
from dissimap.operators.skew import join_hot
from dissimap.session import cut, drop

#: Nearest linked balls that a ball keeps a link to, from each task, for the walk; the links that join parts come besides.
KEPT = 8
#: Links that one task may hold (24 bytes each); larger graphs are walked by joins.
HELD = 1_000_000
#: Levels of the distributed walk, at most: each at least halves what is not yet settled, about.
MOST_LEVELS = 60


def _cover(radius: float):
    """Balls of a block: the first vector not yet in one, by id, becomes the centre of the next."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, x = np.asarray(t["id"], np.int64), _matrix(t["x"])
        ball, far, free = np.full(len(ids), -1, np.int64), np.zeros(len(ids)), np.ones(len(ids), bool)
        for i in range(len(ids)):
            if free[i]:
                rest = i + np.flatnonzero(free[i:])
                d = np.sqrt(((x[rest] - x[i]) ** 2).sum(1))
                own = d <= radius
                ball[rest[own]], far[rest[own]], free[rest[own]] = ids[i], d[own], False
        return t.append_column("ball", pa.array(ball)).append_column("far", pa.array(far))

    return run


class Parts:
    """Connected parts of n nodes; add() gives the links that joined two parts."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        used, at = [], np.arange(len(i))
        while len(at):
            a, b = self.of[i[at]], self.of[j[at]]
            at = at[a != b]
            if not len(at):
                break
            a, b = self.of[i[at]], self.of[j[at]]
            high, first = np.unique(np.maximum(a, b), return_index=True)
            used.append(at[first])
            to = np.arange(len(self.of))
            to[high] = np.minimum(a, b)[first]
            while (to != to[to]).any():
                to = to[to]
            self.of = to[self.of]
        return np.concatenate(used) if used else np.empty(0, int)


def _rows(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The rows of runs that begin at start."""
    return np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def _touch(x: np.ndarray, start: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, reach: float) -> np.ndarray:
    """Whether balls i and j, pair by pair, hold vectors within reach."""
    (bi, ai), (bj, aj) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
    y, z = x[_rows(start[bi], size[bi])], x[_rows(start[bj], size[bj])]
    middle = y.mean(0)
    y, z = y - middle, z - middle
    yy, zz = (y * y).sum(1), (z * z).sum(1)
    d2 = yy[:, None] - 2 * y @ z.T + zz[None]
    d2 = np.minimum.reduceat(np.minimum.reduceat(d2, np.r_[0, np.cumsum(size[bj])[:-1]], axis=1), np.r_[0, np.cumsum(size[bi])[:-1]], axis=0)[ai, aj]
    slack = 1e-12 * (yy.max() + zz.max() + reach**2)
    out = d2 < reach**2 - slack
    for k in np.flatnonzero(np.abs(d2 - reach**2) <= slack):  # too near to the limit for the product
        a, b = (x[start[n] : start[n] + size[n]] for n in (i[k], j[k]))
        out[k] = any(np.sqrt(((a[h : h + 64, None] - b[None]) ** 2).sum(-1)).min() <= reach for h in range(0, len(a), 64))
    return out


def _links(reach: float, grid: Grid):
    """Of two sides, balls that hold vectors within reach: links to the KEPT nearest balls, and enough others that whatever is
    connected by any links stays so."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        p, q = key[0].as_py(), key[1].as_py()
        t = t.sort_by([("block", "ascending"), ("ball", "ascending"), ("id", "ascending")])
        ids, x, ball, far = np.asarray(t["id"], np.int64), _matrix(t["x"]), np.asarray(t["ball"], np.int64), np.asarray(t["far"])
        start = np.flatnonzero(np.r_[True, ball[1:] != ball[:-1]])  # a ball lies in one block
        size = np.diff(np.r_[start, len(ball)])
        names, wide = ball[start], np.maximum.reduceat(far, start)
        lead = start + np.array([np.argmax(ids[s : s + n] == b) for s, n, b in zip(start, size, names)])
        c, block, side, cell = x[lead], *(np.asarray(t[n])[lead] for n in ("block", "side", "cell"))
        parts, heaps = Parts(len(names)), Heaps(len(names), KEPT, np.inf)
        out: list[tuple] = []
        s = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        e = np.r_[s[1:], len(block)]
        for a in range(len(s)):
            for b in range(a, len(s)):
                if p != q and side[s[a]] == side[s[b]] or a != b and grid.gap(cell[s[a]], cell[s[b]]) > reach:
                    continue
                A, B = np.arange(s[a], e[a]), np.arange(s[b], e[b])
                d2, ca, cb = tile(c[A], c[B])
                limit = _threshold(reach + wide[A] + wide[B].max(), ca.rest, cb.rest.max(), ca.step)
                i, j = np.nonzero(d2 <= limit[:, None])
                i, j = A[i], B[j]
                if a == b:
                    i, j = i[i < j], j[i < j]
                d = np.sqrt(((c[i] - c[j]) ** 2).sum(1))
                sure = d <= reach
                i1, j1, d1 = i[sure], j[sure], d[sure]
                heaps.push(i1, j1, d1)
                heaps.push(j1, i1, d1)
                open_ = ~sure & (d <= reach + wide[i] + wide[j])
                if open_.any():
                    i2, j2, d2 = i[open_], j[open_], d[open_]
                    near = _touch(x, start, size, i2, j2, reach)
                    i1, j1, d1 = np.r_[i1, i2[near]], np.r_[j1, j2[near]], np.r_[d1, d2[near]]
                u = parts.add(i1, j1)
                out.append((i1[u], j1[u], d1[u]))
        have = heaps.id >= 0
        out.append((np.repeat(np.arange(len(names)), have.sum(1)), heaps.id[have], heaps.d[have]))
        i, j, d = (np.concatenate(m) for m in zip(*out))
        pairs, first = np.unique(np.column_stack([np.minimum(names[i], names[j]), np.maximum(names[i], names[j])]), axis=0, return_index=True)
        i, j, d = i[first], j[first], d[first]
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1], "w": np.exp(-((d / reach) ** 2)) * size[i] * size[j]})

    return run


def balls_and_links(vectors: DataFrame, reach: float, block: int = BLOCK) -> tuple[DataFrame, DataFrame] | None:
    """members(id, ball) and links(a < b, w) of balls of radius reach/2, whose ids are those of their centres: any two vectors of a ball are within
    reach. Balls with vectors within reach are connected by links (at once or over others), and a link only joins such balls. w is the affinity:
    exp(-(d/reach)^2) of the centres, times the balls' sizes. vectors: (id, x), no two x equal."""
    got = cells(vectors, block)
    if got is None:
        return None
    placed, grid = got
    covered = cut(
        placed.groupBy("block").applyInArrow(_cover(reach / 2 * (1 - 1e-12)), "side int, block int, cell int, id bigint, x array<double>, ball bigint, far double")
    )
    links = meetings(covered, grid, grid.near(reach)).groupBy("p", "q").applyInArrow(_links(reach, grid), "a bigint, b bigint, w double")
    return covered.select("id", "ball"), links.groupBy("a", "b").agg(F.max("w").alias("w"))


def _both_ways(graph: DataFrame) -> DataFrame:
    """(i, j, w): the affinities of a graph (a <= b, w) from either end; those of a node to itself once."""
    ends = F.when(F.col("a") < F.col("b"), F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j"))))
    return graph.select(F.explode(F.coalesce(ends, F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j"))))).alias("e"), "w").select("e.i", "e.j", "w")


def power_embedding(graph: DataFrame, vectors: int = 4, steps: int = 6, seed: int = 5) -> DataFrame:
    """(id, self, y array<double>): `vectors` hashed start vectors after `steps` rounds of the random walk on the affinities graph(a <= b, w), where a = b
    is a node's affinity to itself (`self`): y <- D^-1 A y. Where the walk mixes, y comes to be the same all over a connected part, and to differ
    between parts."""
    e = _both_ways(graph)
    names = [f"y{k}" for k in range(vectors)]
    hashed = [(F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), F.col("id")), 11).cast("double") / F.lit(float(1 << 53))).alias(names[k]) for k in range(vectors)]
    nodes = graph.where("a = b").select(F.col("a").alias("id"), F.col("w").alias("self"))
    y = nodes.select("id", *hashed)
    for _ in range(steps):
        y = e.join(y, e.j == y.id).groupBy("i").agg(*[(F.sum(F.col("w") * F.col(n)) / F.sum("w")).alias(n) for n in names]).withColumnRenamed("i", "id")
    return nodes.join(y, "id").select("id", "self", F.array(*names).alias("y"))


def _apart(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, e: s + e)


def spectral_labels(graph: DataFrame, steps: int = 6, rounds: int = 1, seed: int = 5) -> DataFrame:
    """(id, label): k-means on the walk's embedding of the nodes of graph(a <= b, w). A node only knows the centres it has an affinity to, so that no
    task holds all centres, and a label is never given over a gap.

    Centres are nodes whose hash is the least among their neighbours'. A node goes to the nearest centre in the embedding (equal ones by id); then,
    `rounds` times, a centre moves to the weighted mean of its members, and nodes go to the nearest once more. A node without a centre beside it
    labels itself."""
    y = cut(power_embedding(graph, steps=steps, seed=seed))
    hashed = F.struct(F.xxhash64(F.lit(seed + 1), "id").alias("h"), F.col("id"))
    e = _both_ways(graph.where("a < b")).select("i", "j")
    least = e.join(y.select(F.col("id").alias("j"), hashed.alias("h")), "j").groupBy("i").agg(F.min("h").alias("h"))
    own = y.join(least, y.id == least.i, "left")
    centres = own.where(F.col("h").isNull() | (hashed < F.col("h"))).select(F.col("id").alias("c"))
    # (id, c): the centres a node may go to, itself not being one.
    may = e.join(centres, e.j == centres.c).join(centres.select(F.col("c").alias("i")), "i", "left_anti").select(F.col("i").alias("id"), "c")
    may = cut(may.join(y, "id").select("id", "self", "y", "c"))
    at = y.select(F.col("id").alias("c"), F.col("y").alias("m"))
    for k in range(rounds + 1):
        label = may.join(at, "c").groupBy("id").agg(F.min(F.struct(_apart("y", "m").alias("d"), F.col("c"))).alias("t"), F.first("self").alias("self"), F.first("y").alias("y")).select("id", "self", "y", F.col("t.c").alias("label"))
        if k < rounds:
            every = label.unionByName(y.join(centres, y.id == centres.c, "left_semi").select("id", "self", "y", F.col("id").alias("label")))
            dims = y.select(F.size("y")).first()
            mean = every.select("label", "self", times("y", F.col("self")).alias("y")).groupBy("label").agg(sum_of_vectors("y", dims[0] if dims else 0).alias("s"), F.sum("self").alias("n"))
            at = mean.select(F.col("label").alias("c"), times("s", F.lit(1.0) / F.col("n")).alias("m"))
    out = cut(y.select("id").join(label.select("id", "label"), "id", "left").select("id", F.coalesce("label", "id").alias("label")))
    drop(y)
    drop(may)
    return out


def contract(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """graph(a <= b, w) with the nodes of equal label made one: affinities add up, those within a label being its affinity to itself."""
    a, b = labels.toDF("a", "la"), labels.toDF("b", "lb")
    within = (F.col("a") < F.col("b")) & (F.col("la") == F.col("lb"))
    g = graph.join(a, "a").join(b, "b").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"), F.when(within, 2 * F.col("w")).otherwise(F.col("w")).alias("w"))
    return g.groupBy("a", "b").agg(F.sum("w").alias("w"))


def _open(graph: DataFrame) -> DataFrame:
    """The part of a graph whose nodes have links to others."""
    ends = graph.where("a < b").select(F.explode(F.array("a", "b")).alias("a")).distinct()
    return graph.where("a < b").unionByName(graph.where("a = b").join(ends, "a", "left_semi").select("a", "b", "w"))


def _level(a: np.ndarray, b: np.ndarray, w: np.ndarray, alone: np.ndarray, steps: int, rounds: int, r: np.random.Generator) -> np.ndarray:
    """spectral_labels() on arrays: links a < b of nodes 0 .. n-1 with affinities w, and each node's affinity to itself."""
    n = len(alone)
    i, j, u = np.r_[a, b, np.arange(n)], np.r_[b, a, np.arange(n)], np.r_[w, w, alone]
    y, degree = r.random((n, 4)), np.bincount(i, u, n)
    for _ in range(steps):
        y = np.column_stack([np.bincount(i, u * c[j], n) for c in y.T]) / degree[:, None]
    order = r.permutation(n)
    least = np.full(n, n)
    np.minimum.at(least, i, order[j])
    centre = least == order
    i, j = np.r_[a, b], np.r_[b, a]
    ok = centre[j] & ~centre[i]
    i, j, label, m = i[ok], j[ok], np.arange(n), y
    for k in range(rounds + 1):
        at = np.lexsort((j, ((y[i] - m[j]) ** 2).sum(1), i))
        first = at[np.r_[True, np.diff(i[at]) != 0]] if len(at) else at
        label[i[first]] = j[first]
        if k < rounds:
            total = np.maximum(np.bincount(label, alone, n), 1e-300)
            m = np.column_stack([np.bincount(label, alone * c, n) for c in y.T]) / total[:, None]
    return label


def _all_levels(steps: int, seed: int):
    """cluster_graph() of a graph that one task holds."""

    def run(t: pa.Table) -> pa.Table:
        a, b, w = (np.asarray(t[c]) for c in ("a", "b", "w"))
        ids = np.unique(a[a == b])
        a, b, r = np.searchsorted(ids, a), np.searchsorted(ids, b), np.random.default_rng(seed)
        label = np.arange(len(ids))
        while (a != b).any():
            open_ = np.unique(np.r_[a[a != b], b[a != b]])  # nodes with links to others
            own = np.isin(a, open_)
            a, b, w = np.searchsorted(open_, a[own]), np.searchsorted(open_, b[own]), w[own]
            same = a == b
            to = _level(a[~same], b[~same], w[~same], np.bincount(a[same], w[same], len(open_)), steps, 1, r)
            whole = np.arange(len(ids))
            whole[open_] = open_[to]
            label = whole[label]
            within = (a != b) & (to[a] == to[b])
            a, b, w = open_[to[a]], open_[to[b]], np.where(within, 2 * w, w)
            pairs, at = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0, return_inverse=True)
            a, b, w = pairs[:, 0], pairs[:, 1], np.bincount(at.ravel(), w, len(pairs))
        return pa.table({"id": ids, "label": ids[label]})

    return run


def cluster_graph(graph: DataFrame, steps: int = 6, seed: int = 5, held: int = HELD) -> DataFrame:
    """(id, label) of the nodes of graph(a <= b, w) by power-iteration spectral clustering at every scale: nodes of equal spectral label are
    contracted and the walk goes on over the contracted graph, where it mixes over greater distances, until no link joins two labels. Then the
    walk's limit is constant on each label, which is its cluster. Levels of more than `held` links are joins and aggregates; from there on one task
    goes through the levels that are left. Raises RuntimeError if that takes more than MOST_LEVELS levels."""
    g, levels, old = graph, [], None
    kind = "id bigint, label bigint"
    while g.where("a < b").count() > held:
        if len(levels) == MOST_LEVELS:
            raise RuntimeError("links between labels are left")
        labels = spectral_labels(g, steps, seed=seed + 2 * len(levels))
        levels.append(labels)
        g = cut(_open(contract(g, labels)), old)
        old = g
    out = cut(g.groupBy().applyInArrow(_all_levels(steps, seed), kind))
    for labels in reversed(levels):
        out = labels.join(out.toDF("label", "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    if levels:
        every = graph.where("a = b").select(F.col("a").alias("id"))
        out = cut(every.join(out, "id", "left").select("id", F.coalesce("label", "id").alias("label")))
    return out


def similarity_clusters(vectors: DataFrame, reach: float, steps: int = 6, block: int = BLOCK) -> DataFrame:
    """Clusters of at least two vectors of (id, x), two belonging together if they are within reach or joined by a chain of
    such steps: (cluster_id bigint, the least id of the cluster; point_id bigint; affinity double).

    Rows that clean_vectors() leaves out are in no cluster; equal vectors are in one. No vectors, no rows.

    1. Equal vectors become one; vectors are covered by balls of radius reach/2, whose sparse affinities the block matrix join gives.
    2. Power-iteration spectral clustering of the balls (cluster_graph): the normalised affinities are applied `steps` times to several
       vectors, k-means divides the embedding, balls of equal label are contracted, and so on, until no link joins two labels.
       The labels are the clusters.
    3. affinity ranks the members: 1 / (1 + m / reach^2), m being the mean squared distance from a point to all members of its cluster, so it does
       not depend on how the collection was cut. It comes from the cluster's sums: no pairs are made.
    """
    empty = "cluster_id bigint, point_id bigint, affinity double"
    v = cut(clean_vectors(vectors))
    kinds = cut(v.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    got = balls_and_links(kinds.select("id", "x"), reach, block)
    if got is None:
        return vectors.sparkSession.createDataFrame([], empty)
    members, links = got
    sizes = members.groupBy("ball").agg(F.count(F.lit(1)).alias("size"))
    graph = cut(links.unionByName(sizes.select(F.col("ball").alias("a"), F.col("ball").alias("b"), (F.col("size") * F.col("size")).cast("double").alias("w"))))
    labels = cut(sizes.join(cluster_graph(graph, steps).toDF("ball", "label"), "ball"))
    m = cut(join_hot(members, labels, "ball", "size").select("id", "label").join(kinds, "id"))
    dims = m.select(F.size("x")).first()[0]
    n = F.sum("n")
    sums = m.withColumn("nx", times("x", F.col("n").cast("double"))).groupBy("label").agg(
        n.alias("whole"), F.min("id").alias("cluster_id"), sum_of_vectors("nx", dims).alias("s"), F.sum(F.col("n") * dot("x", "x")).alias("s2")
    )
    sums = cut(sums.select("label", "whole", "cluster_id", times("s", F.lit(1.0) / F.col("whole")).alias("mean"), (F.col("s2") / F.col("whole")).alias("square")).where("whole > 1"))
    far = _apart("x", "mean") + F.greatest(F.col("square") - dot("mean", "mean"), F.lit(0.0))
    placed = cut(join_hot(m, sums, "label", "whole").select("x", "n", "cluster_id", (1.0 / (1.0 + far / F.lit(reach * reach))).alias("affinity")))
    return join_hot(v, placed, "x", "n").select("cluster_id", F.col("id").alias("point_id"), "affinity")


def describe_clusters(clusters: DataFrame, typical: int = 5) -> DataFrame:
    """(cluster_id, size, typical array<bigint>): the `typical` members of the highest affinity of each cluster, equal ones by id."""
    from dissimap.llm.topn import top_n_per_group

    size = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    top = top_n_per_group(clusters, "cluster_id", "point_id", "affinity", typical, largest=True)
    best = top.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "point_id"))).alias("t"))
    return size.join(best, "cluster_id").select("cluster_id", "size", F.col("t.point_id").alias("typical"))
