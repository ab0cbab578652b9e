"""Queries of this subpackage over the test tables, and the same in SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from dissimap.llm import clusters, cooccurrence, encoding, mixing, neighbours, percentiles, subjects, topn
from dissimap.operators.ratings import latest_relations
from dissimap.operators.skew import usable
from dissimap.queries.rounding import near, near_sql
from dissimap.session import cut
from dissimap.sources.tables import table


def p1_items_together(spark, d):
    out = cooccurrence.items_together(table(spark, d, "rating"), "user_id", "item_id", min_count=20, min_lift=5.0)
    return out.withColumn("lift", near(F.col("lift"))).withColumn("pmi", near(F.col("pmi")))


def p1_found(spark, d):
    return cooccurrence.items_together(table(spark, d, "rating"), "user_id", "item_id", min_count=20, min_lift=5.0).select("first_item_id", "second_item_id")


#: The distance within which points are near, in problems 2 and 3.
NEAR = 0.12


def _vectors(spark, d):
    return neighbours.landmark_vectors(table(spark, d, "rk"), table(spark, d, "landmark"))


def p2_nearest(spark, d):
    out = neighbours.nearest_vectors(_vectors(spark, d), 5)
    return out.withColumn("distance", near(F.col("distance")))


def p2_found(spark, d):
    n = neighbours.nearest_vectors(_vectors(spark, d), 5, NEAR)
    return n.select(F.least("id", "neighbour_id").alias("first_id"), F.greatest("id", "neighbour_id").alias("second_id")).distinct()


def p3_found(spark, d):
    return clusters.similarity_clusters(_vectors(spark, d), NEAR).select("cluster_id", "point_id")


def p3_clusters(spark, d):
    """Affinities are rounded, so that ties are ties; typical members as text."""
    c = clusters.similarity_clusters(_vectors(spark, d), NEAR).withColumn("affinity", F.round("affinity", 9))
    return clusters.describe_clusters(c).withColumn("typical", F.array_join("typical", ","))


def p4_closest_relations(spark, d):
    r = latest_relations(table(spark, d, "relation")).select("a", "b", "distance_mean").toDF("first_item_id", "second_item_id", "distance_mean")
    return topn.top_n_per_group(r, "first_item_id", "second_item_id", "distance_mean", 10)


def p4_found(spark, d):
    return p4_closest_relations(spark, d).select("first_item_id", "second_item_id")


#: The parameter of the summaries of problem 6.
K6 = 512


def _values(spark, d):
    r = table(spark, d, "rating").where(F.col("item_id").isNotNull() & usable(F.col("item_value"), 0, 100))
    # A rating sent again has the same item and value; were they not the same, the smallest of each would count.
    return r.groupBy("rating_id").agg(F.min("item_id").alias("item_id"), F.min("item_value").alias("item_value"))


#: The percentiles of problem 6.
P6 = {"p50": 0.5, "p90": 0.9, "p95": 0.95}


def p6_percentiles(spark, d):
    """Median, 90th and 95th percentile by item, from summaries by month of receipt that are put together."""
    r = table(spark, d, "rating").where(F.col("item_id").isNotNull() & usable(F.col("item_value"), 0, 100))
    r = r.groupBy("rating_id").agg(F.min("item_id").alias("item_id"), F.min("item_value").alias("item_value"), F.min(F.trunc("received_at", "MM")).alias("month"))
    s = percentiles.merge_summaries(percentiles.summaries(r, ["item_id", "month"], "item_value", K6), ["item_id"])
    return percentiles.quantiles(s, P6).drop("sketch")


def p6_rank_errors(spark, d):
    """Whether each of these percentiles is as near to its share as the summaries' bound says, WIDE times over."""
    e = percentiles.rank_errors(_values(spark, d), cut(p6_percentiles(spark, d)), "item_id", "item_value", P6)
    return e.select("item_id", "n_values", *[(F.col(m) <= percentiles.WIDE * percentiles.rank_error(K6)).alias(m) for m in P6])


def p6_found(spark, d):
    """Summaries name the items that can be cases and bracket their percentiles; the exact percentiles of these decide."""
    v = _values(spark, d)
    e = percentiles.WIDE * percentiles.rank_error(K6)
    s = percentiles.quantiles(percentiles.summaries(v, ["item_id"], "item_value", K6), {"m_low": 0.5 - e, "m_high": 0.5 + e, "p_low": 0.95 - e, "p_high": min(1.0, 0.95 + e)})
    s = cut(s.drop("sketch").withColumn("wanted", (F.col("n_values") >= 40) & (F.col("p_high") >= 2 * F.col("m_low"))))
    exact = percentiles.exact_quantiles(v, s, "item_id", "item_value", {"m": 0.5, "p": 0.95})
    return exact.where(F.col("p") >= 2 * F.col("m")).select("item_id")


def p7_ids(spark, d):
    return encoding.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def _mix(spark, d):
    targets = table(spark, d, "mix_target")
    sizes = mixing.document_sizes(table(spark, d, "documents"), targets)
    return sizes, mixing.source_plan(sizes, targets)


def p8_found(spark, d):
    sizes, plan = _mix(spark, d)
    return mixing.short_sources(mixing.mix(sizes, plan), plan).select("source")


def p8_mix(spark, d):
    sizes, plan = _mix(spark, d)
    return mixing.mix(sizes, plan)


def p8_shares(spark, d):
    sizes, plan = _mix(spark, d)
    return mixing.report(mixing.mix(sizes, plan), plan)


def _areas(spark, d):
    return subjects.subject_areas(table(spark, d, "documents"), table(spark, d, "subject_area"), table(spark, d, "subject_label"))


def p9_found(spark, d):
    return _areas(spark, d).select("doc_id", "subject")


def p9_composition(spark, d):
    """How many documents deal with each area, and in how many words."""
    return _areas(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("n_documents"), F.round(F.sum("weight"), 3).alias("n_words"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_items_together, p2_found, p2_nearest, p3_found, p3_clusters, p4_found, p4_closest_relations, p6_found, p6_percentiles, p6_rank_errors, p7_ids, p8_found, p8_mix, p8_shares, p9_found, p9_composition)
}

_UI = "ui AS (SELECT DISTINCT user_id AS u, item_id AS i FROM rating WHERE user_id IS NOT NULL AND item_id IS NOT NULL), it AS (SELECT i, count(*) AS n FROM ui GROUP BY 1)"
_P1 = f"""WITH {_UI}, p AS (SELECT a.i AS a, b.i AS b, count(*) AS n FROM ui a JOIN ui b ON a.u = b.u AND a.i < b.i GROUP BY 1, 2 HAVING count(*) >= 20),
  q AS (SELECT a AS first_item_id, b AS second_item_id, p.n AS n_both, x.n AS n_first, y.n AS n_second, (SELECT count(DISTINCT u) FROM ui) AS n_baskets
        FROM p JOIN it x ON p.a = x.i JOIN it y ON p.b = y.i),
  r AS (SELECT *, n_both::DOUBLE * n_baskets / (n_first::DOUBLE * n_second) AS lift FROM q)"""
_P4 = """WITH u AS (SELECT least(first_item_id, second_item_id) AS first_item_id, greatest(first_item_id, second_item_id) AS second_item_id, distance_mean, updated_at
    FROM relation WHERE first_item_id <> second_item_id AND distance_mean >= 0 AND isfinite(distance_mean)),
  l AS (SELECT *, row_number() OVER (PARTITION BY first_item_id, second_item_id ORDER BY updated_at DESC, distance_mean) AS k FROM u),
  t AS (SELECT first_item_id, second_item_id, distance_mean, CAST(row_number() OVER (PARTITION BY first_item_id ORDER BY distance_mean, second_item_id) AS INT) AS rank FROM l WHERE k = 1)"""

_VECTORS = """u AS (SELECT least(c0, c1) AS a, greatest(c0, c1) AS b, arg_max(c2, line_no) AS c2 FROM rk WHERE c2 >= 0 AND c2 <= 2 GROUP BY 1, 2),
  e AS (SELECT CASE WHEN l.ordinal IS NULL THEN a ELSE b END AS id, coalesce(l.ordinal, m.ordinal) AS o, c2 FROM u
        LEFT JOIN landmark l ON a = l.landmark_id LEFT JOIN landmark m ON b = m.landmark_id WHERE (l.ordinal IS NULL) <> (m.ordinal IS NULL)),
  v AS (SELECT id, list(c2 ORDER BY o) AS x FROM e GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM landmark)),
  p AS (SELECT a.id, b.id AS neighbour_id, list_distance(a.x, b.x) AS distance FROM v a JOIN v b ON a.id <> b.id),
  k AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, neighbour_id) AS INT) AS rank FROM p)"""
_P3 = f"""WITH RECURSIVE {_VECTORS}, s AS (SELECT id, neighbour_id FROM p WHERE distance <= 0.12),
  r(root, id) AS (SELECT id, id FROM s UNION SELECT r.root, s.neighbour_id FROM r JOIN s ON r.id = s.id),
  cl AS (SELECT min(root) AS cluster_id, id AS point_id FROM r GROUP BY id)"""

SQL = {
    "p2_found": f"WITH {_VECTORS} SELECT DISTINCT least(id, neighbour_id) AS first_id, greatest(id, neighbour_id) AS second_id FROM k WHERE rank <= 5 AND distance <= 0.12",
    "p2_nearest": f"WITH {_VECTORS} SELECT id, neighbour_id, {near_sql('distance')} AS distance, rank FROM k WHERE rank <= 5",
    "p3_found": f"{_P3} SELECT cluster_id, point_id FROM cl",
    "p3_clusters": f"""{_P3}, ms AS (SELECT a.cluster_id, a.point_id, sum(list_distance(x.x, y.x) * list_distance(x.x, y.x)) / count(*) AS m
        FROM cl a JOIN cl b USING (cluster_id) JOIN v x ON a.point_id = x.id JOIN v y ON b.point_id = y.id GROUP BY 1, 2),
      ty AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(1 / (1 + m / 0.0144), 9) DESC, point_id) AS k FROM ms)
      SELECT cluster_id, count(*) AS size, string_agg(CAST(point_id AS VARCHAR), ',' ORDER BY k) FILTER (k <= 5) AS typical FROM ty GROUP BY 1""",
    "p1_found": f"{_P1} SELECT first_item_id, second_item_id FROM r WHERE lift >= 5",
    "p1_items_together": f"{_P1} SELECT first_item_id, second_item_id, n_both, n_first, n_second, n_baskets, {near_sql('lift')} AS lift, {near_sql('ln(lift)')} AS pmi FROM r WHERE lift >= 5",
    "p4_found": f"{_P4} SELECT first_item_id, second_item_id FROM t WHERE rank <= 10",
    "p4_closest_relations": f"{_P4} SELECT first_item_id, second_item_id, distance_mean, rank FROM t WHERE rank <= 10",
    "p6_rank_errors": """SELECT item_id, count(DISTINCT rating_id) AS n_values, TRUE AS p50, TRUE AS p90, TRUE AS p95 FROM rating
        WHERE item_id IS NOT NULL AND item_value BETWEEN 0 AND 100 AND NOT isnan(item_value) GROUP BY 1""",
    "p6_found": """WITH v AS (SELECT rating_id, min(item_id) AS item_id, min(item_value) AS v FROM rating
        WHERE item_id IS NOT NULL AND item_value BETWEEN 0 AND 100 AND NOT isnan(item_value) GROUP BY 1),
      r AS (SELECT item_id, v, row_number() OVER (PARTITION BY item_id ORDER BY v) AS k, count(*) OVER (PARTITION BY item_id) AS n FROM v)
      SELECT item_id FROM r GROUP BY item_id, n HAVING n >= 40 AND min(v) FILTER (k * 100 >= n * 95) >= 2 * min(v) FILTER (k * 2 >= n)""",
}
