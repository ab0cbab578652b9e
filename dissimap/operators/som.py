"""Stages of a self-organising map on a graph of triangles; vectors are sparse, as rows (vertex, prop, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissimap.session import cut

#: The most vertices of a map, each of which every item is compared with by the meaning of the stage.
MOST_VERTICES = 10_000


def face_edges(faces: DataFrame) -> DataFrame:
    """(src, dst): the sides of faces (a, b, c), in both directions, each once."""
    e = faces.select(F.explode(F.expr("array(named_struct('s', a, 't', b), named_struct('s', b, 't', c), named_struct('s', c, 't', a))")).alias("e"))
    e = e.select(F.col("e.s").alias("src"), F.col("e.t").alias("dst")).where("src <> dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def hops(faces: DataFrame, radius: int) -> DataFrame:
    """(vertex, other, hop): the number of sides between two vertices, up to radius; 0 to itself. A level is a join of the last one
    with the edges."""
    e = cut(face_edges(faces))
    seen = e.select("src").distinct().select(F.col("src").alias("vertex"), F.col("src").alias("other"), F.lit(0).alias("hop"))
    last = seen
    for k in range(1, radius + 1):
        step = last.join(e, last.other == e.src).select("vertex", F.col("dst").alias("other")).distinct()
        last = cut(step.join(seen, ["vertex", "other"], "left_anti").withColumn("hop", F.lit(k)))
        seen = seen.unionByName(last)
    return seen


def sparse_distances(items: DataFrame, weights: DataFrame) -> DataFrame:
    """(item, vertex, distance): the sum of x (x - 2 w) over an item's properties, w being 0 where the vertex has none: the squared distance less
    |w|^2. items (item, prop, value), weights (vertex, prop, value).

    x's own squares are summed once for each item, so only matching properties meet: an equi-join, and an aggregate with
    map-side sums. Every vertex counts, matching or not: the vertices (the map's, a bounded number) are joined to the items last.
    """
    own = items.groupBy("item").agg(F.sum(F.col("value") * F.col("value")).alias("own"))
    both = items.alias("x").join(weights.alias("w"), F.col("x.prop") == F.col("w.prop")).groupBy("x.item", "w.vertex").agg(F.sum(F.col("x.value") * F.col("w.value")).alias("s"))
    vertices = weights.select("vertex").distinct().orderBy("vertex").limit(MOST_VERTICES + 1)
    names = [r[0] for r in vertices.collect()]
    if len(names) > MOST_VERTICES:
        raise ValueError(f"a map of more than {MOST_VERTICES} vertices")
    every = own.withColumn("vertex", F.explode(F.array(*map(F.lit, names)).cast("array<bigint>")))
    return every.join(both, ["item", "vertex"], "left").select("item", "vertex", (F.col("own") - 2 * F.coalesce("s", F.lit(0.0))).alias("distance"))


def winners(items: DataFrame, weights: DataFrame, shift_by_norm: bool = False) -> DataFrame:
    """(item, vertex, distance): the vertex of the least sparse distance, equal ones by id; shift_by_norm adds |w|^2, so that vertices are compared by
    their full distance."""
    d = sparse_distances(items, weights)
    if shift_by_norm:
        n = weights.groupBy("vertex").agg(F.sum(F.col("value") * F.col("value")).alias("nn"))
        d = d.join(n, "vertex").select("item", "vertex", (F.col("distance") + F.col("nn")).alias("distance"))
    return d.groupBy("item").agg(F.min(F.struct("distance", "vertex")).alias("m")).select("item", "m.vertex", "m.distance")


def neighbourhood(hop: DataFrame, radius: float, least: float = 0.01) -> DataFrame:
    """(vertex, other, weight): exp(-hop^2 / radius^2), where it is over `least`."""
    w = F.exp(-(F.col("hop") * F.col("hop")) / F.lit(float(radius) * float(radius)))
    return hop.select("vertex", "other", w.alias("weight")).where(F.col("weight") > least)


def affection(items: DataFrame, won: DataFrame, near: DataFrame) -> DataFrame:
    """(vertex, prop, value): each vertex's new vector, the mean of the items' vectors by the neighbourhood weight of their winners, over all
    contributions. Items are summed by winner before they are sent to the neighbours."""
    own = won.select("item", F.col("vertex").alias("winner"))
    sums = items.join(own, "item").groupBy("winner", "prop").agg(F.sum("value").alias("value"))
    count = own.groupBy("winner").agg(F.count(F.lit(1)).alias("n"))
    to = near.select(F.col("vertex").alias("winner"), F.col("other").alias("vertex"), "weight")
    top = sums.join(to, "winner").groupBy("vertex", "prop").agg(F.sum(F.col("weight") * F.col("value")).alias("s"))
    low = count.join(to, "winner").groupBy("vertex").agg(F.sum(F.col("weight") * F.col("n")).alias("n"))
    return top.join(low, "vertex").select("vertex", "prop", (F.col("s") / F.col("n")).alias("value"))


def train(items: DataFrame, weights: DataFrame, faces: DataFrame, epochs: int, radius: float) -> DataFrame:
    """The vertices' vectors after so many epochs: winners, then affections, with a radius that shrinks to 1."""
    hop = cut(hops(faces, max(1, int(radius))))
    for k in range(epochs):
        r = max(1.0, radius * (1 - k / max(1, epochs)))
        won = winners(items, weights, True)
        weights = cut(affection(items, won, neighbourhood(hop, r)))
    return weights
