"""Inputs that several queries share, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dissimap.model import as_points
from dissimap.operators.distance import euclidean_distance
from dissimap.operators.ratings import latest_relations
from dissimap.sources.tables import table


def full(spark, d):
    """The embeddings with all their dimensions."""
    return as_points(table(spark, d, "embeddings"), "vec_id", "embedding")


def plane(spark, d):
    """The embeddings' first two dimensions."""
    return as_points(table(spark, d, "embeddings"), "vec_id", "embedding", 2)


def full_pairs(spark, d):
    return euclidean_distance(full(spark, d))


def plane_pairs(spark, d):
    return euclidean_distance(plane(spark, d))


def relations(spark, d):
    return latest_relations(table(spark, d, "relation"))


def weight():
    return 1.0 / (1.0 + F.col("r"))

PLANE = "pl AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
PLANE_PAIRS = f"{PLANE}, pr AS (SELECT a.id AS i, b.id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS r FROM pl a JOIN pl b ON a.id > b.id)"
FULL_PAIRS = "fp AS (SELECT a.vec_id AS i, b.vec_id AS j, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS r FROM embeddings a JOIN embeddings b ON a.vec_id > b.vec_id)"
#: Dissimilarities of all dimensions beside distances in the plane, weights 1 / (1 + r).
BOTH = f"""{PLANE}, {FULL_PAIRS}, wd AS (SELECT i, j, r, 1 / (1 + r) AS w, a.x AS xi, a.y AS yi, b.x AS xj, b.y AS yj,
  sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM fp JOIN pl a ON i = a.id JOIN pl b ON j = b.id)"""
#: The same in both directions.
BOTH_WAYS = f"{BOTH}, sy AS (SELECT i, j, r, w, xi, yi, xj, yj, d FROM wd UNION ALL SELECT j, i, r, w, xj, yj, xi, yi, d FROM wd)"
PLANE_WAYS = f"{PLANE_PAIRS}, sp AS (SELECT i, j, r FROM pr UNION ALL SELECT j, i, r FROM pr)"
RELATIONS = """rl AS (SELECT a, b, distance_mean, sample_count FROM (SELECT least(first_item_id, second_item_id) AS a, greatest(first_item_id, second_item_id) AS b, distance_mean, sample_count,
  row_number() OVER (PARTITION BY least(first_item_id, second_item_id), greatest(first_item_id, second_item_id) ORDER BY updated_at DESC, distance_mean, sample_count) AS k
  FROM relation WHERE first_item_id <> second_item_id AND distance_mean >= 0 AND isfinite(distance_mean)) WHERE k = 1)"""
PLACED = "it AS (SELECT * FROM item WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y))"
USABLE = "ur AS (SELECT user_id, item_id, item_value AS v FROM rating WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND item_value BETWEEN 0 AND 100 AND NOT isnan(item_value))"
