"""Whole solvers: on planar input the layout's distances must be the input's, or its stress be low; majorization step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from dissimap.model import dense_index
from dissimap.operators import align, force, majorize, spectral
from dissimap.operators.distance import euclidean_distance
from dissimap.plans import layouts
from dissimap.queries.graphs import LARGEST, K
from dissimap.queries.inputs import FULL_PAIRS, PLANE, PLANE_PAIRS, full, full_pairs, plane, plane_pairs, weight
from dissimap.queries.relational import B, G, N, coordinates
from dissimap.queries.rounding import near, near_sql
from dissimap.session import cut


def _distances(points):
    return euclidean_distance(points).select("i", "j", near(F.col("r")).alias("r"))


def cmds(spark, d):
    return _distances(spectral.classical_scaling(plane_pairs(spark, d), 2))


def cmds_distributed(spark, d):
    """The same without a task that holds the matrix."""
    return _distances(cut(spectral.classical_scaling(plane_pairs(spark, d), 2, local=0)))


def smds(spark, d):
    return _distances(spectral.sparse_scaling(plane_pairs(spark, d), 5))


def smds_variance_cutoff(spark, d):
    """The variances of the embeddings' dimensions as a solver's values."""
    p = full(spark, d).select(F.posexplode("x").alias("component", "v")).groupBy("component").agg(F.var_pop("v").alias("value"))
    out = spectral.variance_cutoff(p, 40, 0.5)
    return out.select("component", near(F.col("value")).alias("value"), near(F.col("share_before")).alias("share_before"), "kept")


#: Steps of the majorization queries, which their SQL unrolls.
STEPS = 4


def smacof(spark, d):
    """Dissimilarities of all dimensions, from the places in the plane."""
    return coordinates(majorize.smacof(full_pairs(spark, d), 2, stress_tolerance=0.0, max_iterations=STEPS, init=plane(spark, d)))


def wmds(spark, d):
    """The same by diagonal majorization with weights."""
    return coordinates(majorize.weighted_scaling(full_pairs(spark, d), 2, weight(), fit_tolerance=0.0, max_iterations=STEPS, init=plane(spark, d)))


def lmds(spark, d):
    return _distances(align.block_scaling(plane_pairs(spark, d), 2, 4))


def imds(spark, d):
    """Four batches that share ten points each."""
    ids = dense_index(plane(spark, d).select("id"), "id", "k")
    step = -(-ids.count() // 4)
    first = F.floor(F.col("k") / step).cast("int")
    both = F.when((F.col("k") % step >= step - 10) & (first < 3), F.array(first, first + 1)).otherwise(F.array(first))
    return _distances(align.incremental_scaling(plane_pairs(spark, d), ids.select("id", F.explode(both).alias("batch")), 2))


def _good(points, bound):
    """(id, placed, good): whether a point's place is two finite numbers, and the layout's normalised stress within the bound."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return points.select("id", (ok("x") & ok("y")).alias("placed"), (F.col("stress") <= bound).alias("good"))


#: Normalised stress that the layouts of the plane stay under.
BOUNDS = {"force": 1e-3, "neighbours": 1e-3, "sampled": 1e-3, "pivots": 1e-3, "isomap": 5e-3}


def isomap_layout(spark, d):
    """The largest connected part of the plane's neighbourhood graph, unrolled."""
    return _good(layouts.unroll(cut(plane_pairs(spark, d)), K, component="largest").flat(), BOUNDS["isomap"])


def _scored(method, **options):
    return lambda spark, d: _good(layouts.lay_out(plane_pairs(spark, d), method, 2, **options).flat(), BOUNDS[method])


def fdmds_energy(spark, d):
    """The kinetic energy after each step of fdmds."""
    return force.force_energies(cut(plane_pairs(spark, d)))


def rkisomap_layout(spark, d):
    """The largest part of the robust neighbourhood graph, with the layout's stress against the geodesics."""
    return layouts.unroll(cut(plane_pairs(spark, d)), K, robust=True, component="largest").flat()


def flagship(spark, d):
    """The embeddings laid out in the plane by classical scaling, each with the layout's stress."""
    return layouts.lay_out_points(full(spark, d)).flat()


QUERIES = {f.__name__: f for f in (flagship, cmds, cmds_distributed, smds, smds_variance_cutoff, smacof, wmds, lmds, imds, isomap_layout, rkisomap_layout, fdmds_energy)}
QUERIES |= {"fdmds": _scored("force"), "cha96mds": _scored("neighbours"), "sqmds": _scored("sampled"), "sqpmds": _scored("pivots")}



def _steps(x: str, y: str) -> str:
    """STEPS steps from the plane: new places by sums over a point's pairs."""
    parts = [f"{PLANE}, {FULL_PAIRS}, sy AS (SELECT i, j, r, 1 / (1 + r) AS w FROM fp UNION ALL SELECT j, i, r, 1 / (1 + r) FROM fp), p0 AS (SELECT id, x, y FROM pl)"]
    for k in range(STEPS):
        e = f"SELECT sy.i, sy.r, sy.w, a.x AS xi, a.y AS yi, b.x AS xj, b.y AS yj, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM sy JOIN p{k} a ON sy.i = a.id JOIN p{k} b ON sy.j = b.id"
        parts.append(f"p{k + 1} AS (SELECT i AS id, {x} AS x, {y} AS y FROM ({e}) GROUP BY i)")
    return f"WITH {', '.join(parts)} SELECT id, {near_sql('x')} AS x, {near_sql('y')} AS y FROM p{STEPS}"


_SAME = f"WITH {PLANE_PAIRS} SELECT i, j, {near_sql('r')} AS r FROM pr"
SQL = {
    **{k: _SAME for k in ("cmds", "cmds_distributed", "smds", "lmds", "imds")},
    **{k: "SELECT vec_id AS id, TRUE AS placed, TRUE AS good FROM embeddings" for k in ("fdmds", "cha96mds", "sqmds", "sqpmds")},
    "isomap_layout": f"{LARGEST} SELECT id, TRUE AS placed, TRUE AS good FROM lc",
    "smacof": _steps(f"sum(-({B}) * (xi - xj)) / {N}", f"sum(-({B}) * (yi - yj)) / {N}"),
    "wmds": _steps(f"any_value(xi) - sum(({G}) * (xi - xj)) / (2 * sum(w))", f"any_value(yi) - sum(({G}) * (yi - yj)) / (2 * sum(w))"),
    "smds_variance_cutoff": f"""WITH v AS (SELECT CAST(k - 1 AS INT) AS component, var_pop(CAST(embedding[k] AS DOUBLE)) AS value FROM embeddings, range(1, 65) t(k) GROUP BY 1),
        c AS (SELECT *, sum(value) OVER (ORDER BY value DESC, component) AS upto, row_number() OVER (ORDER BY value DESC, component) AS k, sum(value) OVER () AS total FROM v)
        SELECT component, {near_sql('value')} AS value, {near_sql('(upto - value) / total')} AS share_before, (upto - value) / total < 0.5 AND value > 0 AND k <= 40 AS kept FROM c""",
}
