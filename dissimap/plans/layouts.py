"""Layouts by name, with their scores, and layouts of manifolds."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissimap.operators import align, force, graph, hybrid, majorize, scoring, spectral
from dissimap.operators.distance import euclidean_distance
from dissimap.session import cut

#: A layout of complete pairs in p dimensions, by the method's name.
METHODS = {
    "classical": spectral.classical_scaling,
    "sparse": spectral.sparse_scaling,
    "smacof": majorize.smacof,
    "weighted": majorize.weighted_scaling,
    "blocks": lambda pairs, p, subdivisions=4, **o: align.block_scaling(pairs, p, subdivisions, **o),
    "force": force.force_layout,
    "neighbours": hybrid.neighbour_layout,
    "sampled": hybrid.sampled_layout,
    "pivots": hybrid.pivot_layout,
}


@dataclass
class Layout:
    """points (id, x), and the stress of each kind; null where there is nothing to divide by."""

    points: DataFrame
    stress: dict[str, float | None] = field(default_factory=dict)

    def flat(self) -> DataFrame:
        """(id, x, y, stress) of a layout in the plane, with its normalised stress."""
        return self.points.select("id", F.get("x", F.lit(0)).alias("x"), F.get("x", F.lit(1)).alias("y"), F.lit(self.stress["normalised"]).cast("double").alias("stress"))


def lay_out(pairs: DataFrame, method: str = "classical", p: int = 2, **options) -> Layout:
    """A layout of complete pairs (i > j, r) and its scores. The pairs are written down once, for solver and scores. Raises ValueError
    for an unknown method, and what the method raises."""
    if method not in METHODS:
        raise ValueError(f"method is one of {sorted(METHODS)}")
    pairs = cut(pairs.select("i", "j", "r"))
    points = cut(METHODS[method](pairs, p, **options))
    s = {kind: scoring.stress(pairs, points, kind).first()[0] for kind in scoring.KINDS}
    return Layout(points, s)


def lay_out_points(points: DataFrame, method: str = "classical", p: int = 2, **options) -> Layout:
    """lay_out() of the Euclidean distances of points."""
    return lay_out(euclidean_distance(points), method, p, **options)


def unroll(pairs: DataFrame, k: int, p: int = 2, robust: bool = False, component: str = "raise", method: str = "classical", **options) -> Layout:
    """A layout of geodesics over the graph of k nearest neighbours (robust: with edges of outlying flow removed; options m, intolerance, flow_scale).
    Where parts of the graph are not connected: component 'raise' raises ValueError, 'largest' lays out the largest part alone
    (of the directed robust graph, the largest set of points that reach each other)."""
    if component not in ("raise", "largest"):
        raise ValueError("component is 'raise' or 'largest'")
    own = {o: options.pop(o) for o in ("m", "intolerance", "flow_scale", "rounds") if o in options}
    largest = component == "largest"
    g = cut(graph.robust_isomap(pairs, k, mutual=largest, **own) if robust else graph.isomap(pairs, k))
    if largest and not robust:
        g = cut(graph.largest_component(g))
    return lay_out(g, method, p, **options)
