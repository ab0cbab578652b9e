"""Neighbourhood graphs, geodesics and flows over the embeddings, with all their dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dissimap.operators import graph
from dissimap.queries.inputs import FULL_PAIRS, PLANE_PAIRS, full, full_pairs
from dissimap.queries.relational import rounded
from dissimap.queries.rounding import near, near_sql
from dissimap.session import cut

K = 8


def knn_edges(spark, d):
    return rounded(graph.knn_points(full(spark, d), K), "weight")


def knn_edges_of_pairs(spark, d):
    """The same from a table of dissimilarities."""
    return rounded(graph.knn_edges(full_pairs(spark, d), K), "weight")


def knn_graph_undirected(spark, d):
    return rounded(graph.undirected(graph.knn_points(full(spark, d), K)), "weight")


def knn_graph_directed(spark, d):
    return rounded(graph.directed(graph.knn_points(full(spark, d), K), 2.0), "weight")


def geodesic_distance(spark, d):
    g = graph.geodesics(cut(graph.undirected(graph.knn_points(full(spark, d), K))))
    return g.where("src <> dst and distance < double('inf')").select("src", "dst", near(F.col("distance")).alias("distance"))


def p_norm_geodesic(spark, d):
    """Over the directed graph of squared distances, the roots of the shortest paths from the greater id to the smaller."""
    g = graph.geodesics(cut(graph.directed(graph.knn_points(full(spark, d), K), 2.0))).where("src > dst and distance < double('inf')")
    return g.select(F.col("src").alias("i"), F.col("dst").alias("j"), near(F.sqrt("distance")).alias("r"))


def _flow(spark, d):
    return graph.edge_flow(cut(graph.directed(graph.knn_points(full(spark, d), K), 2.0)))


def edge_flow(spark, d):
    return _flow(spark, d).select("src", "dst", "flow")


def flow_gamma_fit(spark, d):
    return rounded(graph.flow_gamma_fit(_flow(spark, d)), "flow_mean", "flow_variance", "shape", "scale")


def isomap(spark, d):
    """Geodesics of the pairs that are connected."""
    return graph.isomap(cut(full_pairs(spark, d)), K).where("r < double('inf')").select("i", "j", near(F.col("r")).alias("r"))


def rkisomap(spark, d):
    """Whether each pair's robust geodesic is a positive number (infinite where there is no path)."""
    return graph.robust_isomap(cut(full_pairs(spark, d)), K).select("i", "j", ((F.col("r") > 0) & ~F.isnan("r")).alias("positive"))


QUERIES = {f.__name__: f for f in (knn_edges, knn_edges_of_pairs, knn_graph_undirected, knn_graph_directed, geodesic_distance, p_norm_geodesic, edge_flow, flow_gamma_fit, isomap, rkisomap)}

def _knn(pairs: str, name: str) -> str:
    return f"{pairs}, sp AS (SELECT i, j, r FROM {name} UNION ALL SELECT j, i, r FROM {name}), kn AS (SELECT i AS src, j AS dst, r AS weight, CAST(row_number() OVER (PARTITION BY i ORDER BY r, j) AS INT) AS rank FROM sp QUALIFY rank <= {K})"


_KNN = _knn(FULL_PAIRS, "fp")
_BOTH_ENDS = "ed AS (SELECT src, dst, weight AS w FROM kn UNION SELECT dst, src, weight FROM kn)"
_UNDIRECTED = f"{_KNN}, {_BOTH_ENDS}"
_DIRECTED = f"{_KNN}, ed AS (SELECT src, dst, weight * weight AS w FROM kn)"
_PATHS = """ge(s, t, d) USING KEY (s, t) AS (SELECT DISTINCT src, src, CAST(0 AS DOUBLE) FROM ed UNION
  SELECT ge.s, ed.dst, min(ge.d + ed.w) FROM ge JOIN ed ON ge.t = ed.src LEFT JOIN recurring.ge AS o ON o.s = ge.s AND o.t = ed.dst WHERE o.d IS NULL OR ge.d + ed.w < o.d GROUP BY 1, 2)"""
#: The largest connected part of the plane's graph: of several, that of the least id.
LARGEST = f"WITH RECURSIVE {_knn(PLANE_PAIRS, 'pr')}, {_BOTH_ENDS}, {_PATHS}, lp AS (SELECT s AS id, min(t) AS part, count(*) AS n FROM ge GROUP BY 1), lc AS (SELECT id FROM lp WHERE part = (SELECT part FROM lp ORDER BY n DESC, part LIMIT 1))"
_FLOW = f"""WITH RECURSIVE {_DIRECTED}, {_PATHS}, la AS (SELECT ge.s, ed.dst AS t, arg_min(ed.src, struct_pack(d := ge.d + ed.w, u := ed.src)) AS u FROM ge JOIN ed ON ge.t = ed.src WHERE ed.dst <> ge.s GROUP BY 1, 2),
  fl AS (SELECT src, dst, (SELECT count(*) FROM la WHERE la.u = ed.src AND la.t = ed.dst) AS flow FROM ed)"""

SQL = {
    "knn_edges": f"WITH {_KNN} SELECT src, dst, {near_sql('weight')} AS weight, rank FROM kn",
    "knn_edges_of_pairs": f"WITH {_KNN} SELECT src, dst, {near_sql('weight')} AS weight, rank FROM kn",
    "isomap": f"WITH RECURSIVE {_UNDIRECTED}, {_PATHS} SELECT s AS i, t AS j, {near_sql('d')} AS r FROM ge WHERE s > t",
    "rkisomap": f"WITH {FULL_PAIRS} SELECT i, j, TRUE AS positive FROM fp",
    "knn_graph_undirected": f"WITH {_UNDIRECTED} SELECT src, dst, {near_sql('w')} AS weight FROM ed",
    "knn_graph_directed": f"WITH {_DIRECTED} SELECT src, dst, {near_sql('w')} AS weight, CAST(0 AS BIGINT) AS flow FROM ed",
    "geodesic_distance": f"WITH RECURSIVE {_UNDIRECTED}, {_PATHS} SELECT s AS src, t AS dst, {near_sql('d')} AS distance FROM ge WHERE s <> t",
    "p_norm_geodesic": f"WITH RECURSIVE {_DIRECTED}, {_PATHS} SELECT s AS i, t AS j, {near_sql('sqrt(d)')} AS r FROM ge WHERE s > t",
    "edge_flow": f"{_FLOW} SELECT src, dst, flow FROM fl",
    "flow_gamma_fit": f"""{_FLOW} SELECT {near_sql('avg(flow)')} AS flow_mean, {near_sql('var_samp(flow)')} AS flow_variance, {near_sql('avg(flow) * avg(flow) / var_samp(flow)')} AS shape,
        {near_sql('var_samp(flow) / avg(flow)')} AS scale FROM fl""",
}
