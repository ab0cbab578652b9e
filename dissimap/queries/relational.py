"""Distances, centring, stress and majorization steps, on the embeddings and on the dissimilarity triplets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dissimap.functions.vectors import mixed_sql
from dissimap.operators import distance, majorize, scoring
from dissimap.queries.inputs import BOTH, BOTH_WAYS, FULL_PAIRS, PLANE_PAIRS, PLANE_WAYS, full_pairs, plane, plane_pairs, weight
from dissimap.queries.rounding import near, near_sql
from dissimap.session import shared_dir
from dissimap.sources.matrix_csv import read_matrix, write_matrix
from dissimap.sources.tables import table


def rounded(df, *cols):
    return df.withColumns({c: near(F.col(c)) for c in cols})


def euclidean_distance(spark, d):
    return rounded(full_pairs(spark, d), "r")


def squared_dissimilarity(spark, d):
    return rounded(distance.squared(full_pairs(spark, d)), "r2")


def coo_to_pairs(spark, d):
    return rounded(distance.triplets_to_pairs(table(spark, d, "rk"), "c0", "c1", "c2", "line_no"), "r")


def matrix_csv(spark, d):
    path = f"{shared_dir(spark)}/csv/{uuid.uuid4().hex}"
    write_matrix(plane(spark, d), path)
    p = read_matrix(spark, path, 2)
    return p.select("id", near(F.col("x")[0], 8).alias("x"), near(F.col("x")[1], 8).alias("y"))


def submatrix_range(spark, d):
    top = plane(spark, d).agg(F.max("id")).first()[0]
    return rounded(distance.submatrix_range(plane_pairs(spark, d), top // 4, top // 2), "r")


def sampled_submatrix(spark, d):
    p = plane(spark, d)
    return rounded(distance.sampled_submatrix(plane_pairs(spark, d), distance.distinct_sample(p, distance.sample_size(p.count()))), "r")


def distinct_sample(spark, d):
    p = plane(spark, d)
    return distance.distinct_sample(p, distance.sample_size(p.count()))


def double_center(spark, d):
    p = plane(spark, d)
    return rounded(scoring.double_center(plane_pairs(spark, d), p.count(), diagonal=True), "b")


def _stress(kind, weighted=False):
    return lambda spark, d: rounded(scoring.stress(full_pairs(spark, d), plane(spark, d), kind, weight() if weighted else None), "stress")


def guttman_transform(spark, d):
    return rounded(majorize.guttman_transform(full_pairs(spark, d), plane(spark, d), weight()), "g")


def smacof_b_matrix(spark, d):
    return rounded(majorize.smacof_matrix(full_pairs(spark, d), plane(spark, d)), "b")


def weight_row_sums(spark, d):
    return rounded(majorize.weight_sums(full_pairs(spark, d), weight()), "v")


def coordinates(points):
    return points.select("id", near(F.col("x")[0]).alias("x"), near(F.col("x")[1]).alias("y"))


def smacof_step(spark, d):
    p = plane(spark, d)
    return coordinates(majorize.smacof_step(full_pairs(spark, d), p, p.count(), 2))


def wmds_step(spark, d):
    return coordinates(majorize.weighted_step(full_pairs(spark, d), plane(spark, d), 2, weight()))


def matrix_product(spark, d):
    """The matrix of SMACOF times the places in the plane."""
    p = plane(spark, d)
    return coordinates(majorize.product(majorize.smacof_matrix(full_pairs(spark, d), p), p, 2))


QUERIES = {
    "euclidean_distance": euclidean_distance, "squared_dissimilarity": squared_dissimilarity, "coo_to_pairs": coo_to_pairs, "matrix_csv": matrix_csv, "submatrix_range": submatrix_range,
    "sampled_submatrix": sampled_submatrix, "distinct_sample": distinct_sample, "double_center": double_center, "stress_raw": _stress("raw"), "stress_normalised": _stress("normalised"),
    "stress_kruskal": _stress("kruskal"), "stress_weighted": _stress("normalised", True), "guttman_transform": guttman_transform, "smacof_b_matrix": smacof_b_matrix,
    "weight_row_sums": weight_row_sums, "smacof_step": smacof_step, "wmds_step": wmds_step, "matrix_product": matrix_product,
}

_SAMPLE = f"sm AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT id FROM pl ORDER BY {mixed_sql('id', seed=1)}, id LIMIT (SELECT 10 + CAST(floor(sqrt(count(*))) AS BIGINT) FROM pl)))"
N = "(SELECT count(*) FROM embeddings)"
G = "w - CASE WHEN d <> 0 THEN r * w / d ELSE 0 END"
B = "CASE WHEN d <> 0 THEN -r / d ELSE 0 END"


def _diagonal(value: str, name: str) -> str:
    return f"WITH {BOTH_WAYS} SELECT i, j, {near_sql(value)} AS {name} FROM wd UNION ALL SELECT i, i, {near_sql(f'-sum({value})')} FROM sy GROUP BY i"


SQL = {
    "euclidean_distance": f"WITH {FULL_PAIRS} SELECT i, j, {near_sql('r')} AS r FROM fp",
    "squared_dissimilarity": f"WITH {FULL_PAIRS} SELECT i, j, {near_sql('r * r')} AS r2 FROM fp",
    "coo_to_pairs": f"SELECT greatest(c0, c1) AS i, least(c0, c1) AS j, {near_sql('arg_max(c2, line_no)')} AS r FROM rk WHERE c0 <> c1 AND c2 IS NOT NULL AND NOT isnan(c2) GROUP BY 1, 2",
    "matrix_csv": f"""SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, {near_sql("CAST(printf('%.6g', CAST(embedding[1] AS DOUBLE)) AS DOUBLE)", 8)} AS x,
        {near_sql("CAST(printf('%.6g', CAST(embedding[2] AS DOUBLE)) AS DOUBLE)", 8)} AS y FROM embeddings""",
    "submatrix_range": f"""WITH {PLANE_PAIRS} SELECT i, j, {near_sql('r')} AS r FROM pr WHERE i >= (SELECT max(id) // 4 FROM pl) AND i < (SELECT max(id) // 2 FROM pl)
        AND j >= (SELECT max(id) // 4 FROM pl) AND j < (SELECT max(id) // 2 FROM pl)""",
    "sampled_submatrix": f"WITH {PLANE_PAIRS}, {_SAMPLE} SELECT a.k AS i, b.k AS j, {near_sql('r')} AS r FROM pr JOIN sm a ON i = a.id JOIN sm b ON j = b.id",
    "distinct_sample": f"WITH {PLANE_PAIRS}, {_SAMPLE} SELECT id FROM sm",
    "double_center": f"""WITH {PLANE_WAYS}, m AS (SELECT i, sum(r * r) / {N} AS m FROM sp GROUP BY i), g AS (SELECT sum(m) / {N} AS g FROM m)
        SELECT i, j, {near_sql('-0.5 * (r * r - a.m - b.m + g)')} AS b FROM pr JOIN m a USING (i) JOIN m b ON j = b.i, g UNION ALL SELECT i, i, {near_sql('m - g / 2')} FROM m, g""",
    "stress_raw": f"WITH {BOTH} SELECT {near_sql('sum((d - r) * (d - r))')} AS stress FROM wd",
    "stress_normalised": f"WITH {BOTH} SELECT {near_sql('sum((d - r) * (d - r)) / sum(r * r)')} AS stress FROM wd",
    "stress_kruskal": f"WITH {BOTH} SELECT {near_sql('sqrt(sum((d - r) * (d - r)) / sum(d * d))')} AS stress FROM wd",
    "stress_weighted": f"WITH {BOTH} SELECT {near_sql('sum(w * (d - r) * (d - r)) / sum(w * r * r)')} AS stress FROM wd",
    "guttman_transform": _diagonal(G, "g"),
    "smacof_b_matrix": _diagonal(B, "b"),
    "weight_row_sums": f"WITH {BOTH_WAYS} SELECT i, {near_sql('sum(w)')} AS v FROM sy GROUP BY i",
    "smacof_step": f"""WITH {BOTH_WAYS} SELECT i AS id, {near_sql(f'sum(-({B}) * (xi - xj)) / {N}')} AS x, {near_sql(f'sum(-({B}) * (yi - yj)) / {N}')} AS y FROM sy GROUP BY i""",
    "matrix_product": f"""WITH {BOTH_WAYS}, b AS (SELECT i, j, {B} AS b FROM sy UNION ALL SELECT i, i, -sum({B}) FROM sy GROUP BY i)
        SELECT i AS id, {near_sql('sum(b * x)')} AS x, {near_sql('sum(b * y)')} AS y FROM b JOIN pl ON j = pl.id GROUP BY i""",
    "wmds_step": f"""WITH {BOTH_WAYS} SELECT i AS id, {near_sql(f'any_value(xi) - sum(({G}) * (xi - xj)) / (2 * sum(w))')} AS x,
        {near_sql(f'any_value(yi) - sum(({G}) * (yi - yj)) / (2 * sum(w))')} AS y FROM sy GROUP BY i""",
}
