"""Rating and relation statistics, their validation, distances, views and the hull."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from dissimap.operators import layout, ratings, views
from dissimap.queries.inputs import PLACED, RELATIONS, USABLE, relations
from dissimap.queries.relational import rounded
from dissimap.queries.rounding import near_binary, near_sql
from dissimap.session import cut, shared_dir
from dissimap.sources.tables import table
from dissimap.streaming.ratings import AdjustmentQueue, RatingMap


def _usable(spark, d):
    return ratings.usable_ratings(table(spark, d, "rating"))


def rating_queue_depth(spark, d):
    """The rating table queued: how many ratings wait."""
    m = _map(spark)
    m.queue_ratings(table(spark, d, "rating").withColumnRenamed("item_value", "value"))
    return spark.createDataFrame([(m.queue_depth(),)], "depth bigint")


def item_stats(spark, d):
    return rounded(ratings.item_statistics(_usable(spark, d)), "value_mean", "value_variance")


def item_validation(spark, d):
    return ratings.validate_items(table(spark, d, "item"), ratings.item_statistics(_usable(spark, d)))


def relation_stats(spark, d):
    return rounded(ratings.relation_statistics(_usable(spark, d)), *ratings.RELATION[1:])


def relation_validation(spark, d):
    return ratings.relation_faults(ratings.stored_relations(table(spark, d, "relation")), _usable(spark, d))


def _model(model):
    def run(spark, d):
        # A relation whose values hardly vary has no correlation: the variances are compared with 0 at six digits.
        s = ratings.relation_distances(_usable(spark, d), model, least_variance=1e-6)
        return s.withColumn("distance", near_binary(F.col("distance")))

    return run


def shrunk_distance(spark, d):
    """Each relation's distance drawn to its first item's mean distance."""
    m = table(spark, d, "item").select(F.col("id").alias("a"), F.when(~F.isnan("distance_mean"), F.col("distance_mean")).alias("mean"))
    j = relations(spark, d).join(m, "a")
    return rounded(j.select("a", "b", ratings.shrunk_distance(F.col("sample_count"), F.col("distance_mean"), F.col("mean")).alias("distance")), "distance")


def get_items(spark, d):
    return views.get_items(table(spark, d, "item"), table(spark, d, "item_detail"))


def get_items_viewport(spark, d):
    return views.get_items_box(table(spark, d, "item"), table(spark, d, "item_detail"), -10.0, -10.0, 10.0, 15.0)


def item_locations(spark, d):
    return views.dense_locations(views.placed_items(table(spark, d, "item")))


def convex_hull(spark, d):
    return views.convex_hull(table(spark, d, "item"))


def get_hull(spark, d):
    item = table(spark, d, "item")
    return views.get_hull(views.convex_hull(item).select("point_id", "cyclic_order"), item)


def comparison_set(spark, d):
    return layout.comparison_set(table(spark, d, "item"), relations(spark, d))


def adjust_step(spark, d):
    item = table(spark, d, "item")
    return rounded(layout.adjust_step(item, layout.comparison_set(item, relations(spark, d))), "x", "y")


def adjust_items(spark, d):
    """Every placed item queued for adjustment, through the queue."""
    item = table(spark, d, "item")
    folder = f"{shared_dir(spark)}/map/{uuid.uuid4().hex}"
    q = AdjustmentQueue(spark, folder)
    q.queue_adjustments(item)
    q.process_adjustment_queue(item, cut(relations(spark, d)), f"{folder}/moved")
    return rounded(q.moved(f"{folder}/moved"), "x", "y", "vx", "vy")


def locate_items(spark, d):
    return rounded(layout.locate_unplaced(table(spark, d, "item"), relations(spark, d)), "x", "y")


def _map(spark, **kw):
    return RatingMap(spark, f"{shared_dir(spark)}/map/{uuid.uuid4().hex}", **kw)


def _stream(spark, d, **kw):
    """The rating table through the queue in at least two batches."""
    m, r = _map(spark, **kw), _usable(spark, d)
    m.queue_ratings(r.repartition(2, "user_id"))
    m.process_rating_queue(batch_size=m.file_rows)
    return m


def process_ratings_items(spark, d):
    """The items' running statistics."""
    return rounded(_stream(spark, d, relations=False, file_rows=1_000_000).items(), "value_mean", "value_variance")


def process_ratings_relations(spark, d):
    """The relations' running statistics, besides the items'."""
    return rounded(_stream(spark, d, file_rows=1_000_000).relations(), *ratings.RELATION[1:])


def item_distances(spark, d):
    return rounded(ratings.item_distances(relations(spark, d).withColumnRenamed("distance_mean", "distance")), "distance_mean")


QUERIES = {
    **{f.__name__: f for f in (rating_queue_depth, item_stats, item_validation, relation_stats, relation_validation, shrunk_distance, get_items, get_items_viewport, item_locations, convex_hull, get_hull)},
    "distance_model_abs": _model("abs_difference"), "distance_model_correlation": _model("correlation"),
    **{f.__name__: f for f in (comparison_set, adjust_step, adjust_items, locate_items, item_distances, process_ratings_items, process_ratings_relations)},
}

_ITEM_STATS = f"{USABLE}, st AS (SELECT item_id, count(*) AS sample_count, avg(v) AS value_mean, var_pop(v) AS value_variance FROM ur GROUP BY 1)"
#: The moments by their definition.
_RELATION_STATS = f"""{USABLE}, rs AS (SELECT a.item_id AS first_item_id, b.item_id AS second_item_id, count(*) AS sample_count, avg(abs(a.v - b.v)) AS value_abs_diff_mean, var_pop(abs(a.v - b.v)) AS value_abs_diff_variance,
  avg(a.v) AS first_value_mean, avg(b.v) AS second_value_mean, var_pop(a.v) AS first_value_variance, var_pop(b.v) AS second_value_variance, covar_pop(a.v, b.v) AS value_covariance
  FROM ur a JOIN ur b ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY 1, 2)"""
_REL_COLS = ", ".join(f"{near_sql(c)} AS {c}" for c in ratings.RELATION[1:])


def _off(s: str, t: str) -> str:
    return f"(s.{s} IS NULL OR isnan(s.{s}) OR abs(s.{s} - t.{t}) > 0.001 * abs(t.{t}))"


def _own(c: str) -> str:
    """A stored column as seen from the smaller id."""
    other = c.replace("first_", "second_") if c.startswith("first_") else c.replace("second_", "first_")
    return f"CASE WHEN first_item_id < second_item_id THEN {c} ELSE {other} END AS {c}"


#: Of the stored rows of a pair, in either order, the latest one, whole.
_STORED = f"""sr AS (SELECT least(first_item_id, second_item_id) AS a, greatest(first_item_id, second_item_id) AS b, {', '.join(_own(c) for c in ratings.RELATION)} FROM relation WHERE first_item_id <> second_item_id
    QUALIFY row_number() OVER (PARTITION BY least(first_item_id, second_item_id), greatest(first_item_id, second_item_id) ORDER BY updated_at DESC, distance_mean, sample_count) = 1)"""
_COMPARE = f"""{PLACED}, {RELATIONS}, rd AS (SELECT a AS id, b AS other, distance_mean AS distance, sample_count FROM rl UNION ALL SELECT b, a, distance_mean, sample_count FROM rl),
  lr AS (SELECT rd.* FROM rd JOIN it x ON rd.id = x.id JOIN it y ON rd.other = y.id),
  rk2 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS n, row_number() OVER (PARTITION BY id ORDER BY distance DESC, other) AS f FROM lr),
  hf AS (SELECT id, 2 * min(distance) AS half FROM lr GROUP BY 1),
  bx AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y), b.id) AS k
         FROM it a JOIN hf ON a.id = hf.id JOIN it b ON b.id <> a.id AND abs(b.x - a.x) <= half AND abs(b.y - a.y) <= half WHERE half > 0)"""


def _compare(closest: int, furthest: int, local: int) -> str:
    return f"""{_COMPARE}, cs AS (SELECT id, other, distance, sample_count FROM rk2 WHERE n <= {closest} OR f <= {furthest}
      UNION SELECT bx.id, bx.other, lr.distance, lr.sample_count FROM bx LEFT JOIN lr ON bx.id = lr.id AND bx.other = lr.other WHERE k <= {local}),
      fm AS (SELECT cs.id, a.x, a.y, a.x - b.x AS dx, a.y - b.y AS dy, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, CASE WHEN NOT isnan(a.distance_mean) THEN a.distance_mean END AS mean, distance, cs.sample_count
             FROM cs JOIN it a ON cs.id = a.id JOIN it b ON cs.other = b.id),
      fa AS (SELECT *, coalesce(mean / (1 + sample_count) + (1 - 1 / (1 + sample_count)) * distance, mean, distance) AS aim FROM fm),
      ff AS (SELECT *, coalesce(aim - CASE WHEN d = 0 THEN 1 ELSE d END, 0) AS pull FROM fa),
      mv AS (SELECT id, x AS px, y AS py, avg(CASE WHEN d = 0 THEN pull ELSE pull * dx / d END) AS fx, avg(CASE WHEN d = 0 THEN 0 ELSE pull * dy / d END) AS fy FROM ff GROUP BY ALL)"""


def _locate(depth: int) -> str:
    """Items not placed, of enough placed relations: bisected angles on the circle about the closest."""
    parts = [f"""{PLACED}, {RELATIONS}, rd AS (SELECT a AS id, b AS other, distance_mean AS distance, sample_count FROM rl UNION ALL SELECT b, a, distance_mean, sample_count FROM rl),
      lr AS (SELECT rd.*, it.x AS ox, it.y AS oy FROM rd JOIN it ON rd.other = it.id), nn AS (SELECT sqrt(count(*)) AS q FROM lr),
      td AS (SELECT id, CASE WHEN NOT isnan(distance_mean) THEN distance_mean END AS mean FROM item WHERE id NOT IN (SELECT id FROM it)),
      wr AS (SELECT id, other, ox, oy, coalesce(mean / (1 + sample_count) + (1 - 1 / (1 + sample_count)) * distance, mean, distance) AS want FROM lr JOIN td USING (id)),
      g0 AS (SELECT id, arg_min(struct_pack(x := ox, y := oy), struct_pack(r := want, o := other)) AS c, min(want) AS radius, CAST(0 AS DOUBLE) AS angle FROM wr GROUP BY id
        HAVING count(*) >= (SELECT greatest(1, least(floor(q), floor(log10(q) + 1))) FROM nn))"""]
    for k in range(depth):
        step = repr(math.pi / 2 / 2**k)
        loss = lambda s: f"sum(power(sqrt(power(c.x + radius * cos(angle {s} {step}) - ox, 2) + power(c.y + radius * sin(angle {s} {step}) - oy, 2)) - want, 2))"  # noqa: E731, B023
        parts.append(f"g{k + 1} AS (SELECT id, c, radius, CASE WHEN {loss('-')} < {loss('+')} THEN angle - {step} ELSE angle + {step} END AS angle FROM g{k} JOIN wr USING (id) GROUP BY id, c, radius, angle)")
    return f"WITH {', '.join(parts)} SELECT id, {near_sql('c.x + radius * cos(angle)')} AS x, {near_sql('c.y + radius * sin(angle)')} AS y FROM g{depth}"


_HULL = f"""WITH RECURSIVE {PLACED}, pt AS (SELECT min(id) AS id, x, y FROM it GROUP BY x, y), s AS (SELECT id, x, y FROM pt ORDER BY x, y LIMIT 1),
  h(id, x, y, k, t) AS (SELECT id, x, y, 0, -pi() / 2 FROM s UNION ALL
    SELECT q.n.id, q.n.x, q.n.y, k + 1, q.n.a FROM (SELECT k, arg_min(struct_pack(id := p.id, x := p.x, y := p.y, a := atan2(p.y - h.y, p.x - h.x)),
      struct_pack(turn := round(CASE WHEN atan2(p.y - h.y, p.x - h.x) < t - 1e-12 THEN atan2(p.y - h.y, p.x - h.x) - t + 2 * pi() ELSE atan2(p.y - h.y, p.x - h.x) - t END, 10), far := -((p.x - h.x) * (p.x - h.x) + (p.y - h.y) * (p.y - h.y)))) AS n
      FROM h, pt p WHERE (p.x <> h.x OR p.y <> h.y) AND k < 10000 GROUP BY k) q WHERE q.n.id <> (SELECT id FROM s))
  SELECT id AS point_id, CAST(k AS INT) AS cyclic_order, x, y FROM h"""

SQL = {
    "rating_queue_depth": "SELECT count(*) AS depth FROM rating",
    "item_stats": f"WITH {_ITEM_STATS} SELECT item_id, sample_count, {near_sql('value_mean')} AS value_mean, {near_sql('value_variance')} AS value_variance FROM st",
    "item_validation": f"""WITH {_ITEM_STATS} SELECT t.item_id FROM st t LEFT JOIN item s ON s.id = t.item_id
        WHERE s.sample_count IS NULL OR s.sample_count <> t.sample_count OR {_off('value_mean', 'value_mean')} OR {_off('value_variance', 'value_variance')}""",
    "relation_stats": f"WITH {_RELATION_STATS} SELECT first_item_id, second_item_id, sample_count, {_REL_COLS} FROM rs",
    "relation_validation": f"""WITH {_RELATION_STATS}, {_STORED}
        SELECT t.first_item_id, t.second_item_id FROM rs t LEFT JOIN sr s ON s.a = t.first_item_id AND s.b = t.second_item_id
        WHERE s.sample_count IS NULL OR s.sample_count <> t.sample_count OR {' OR '.join(_off(c, c) for c in ratings.RELATION[1:])}""",
    "distance_model_abs": f"WITH {_RELATION_STATS} SELECT first_item_id, second_item_id, {near_sql('value_abs_diff_mean')} AS distance FROM rs",
    "distance_model_correlation": f"""WITH {_RELATION_STATS} SELECT first_item_id, second_item_id,
        {near_sql('CASE WHEN first_value_variance >= 1e-6 AND second_value_variance >= 1e-6 THEN 1 - value_covariance / sqrt(first_value_variance * second_value_variance) END')} AS distance FROM rs""",
    "shrunk_distance": f"""WITH {RELATIONS}, m AS (SELECT id, CASE WHEN NOT isnan(distance_mean) THEN distance_mean END AS mean FROM item)
        SELECT a, b, {near_sql('coalesce(mean / (1 + sample_count) + (1 - 1 / (1 + sample_count)) * distance_mean, mean)')} AS distance FROM rl JOIN m ON a = id""",
    "get_items": "SELECT id, CASE WHEN NOT isnan(x) THEN x END AS x, CASE WHEN NOT isnan(y) THEN y END AS y, sample_count, value_mean, title FROM item JOIN item_detail USING (id)",
    "get_items_viewport": "SELECT id, x, y, sample_count, value_mean, title FROM item JOIN item_detail USING (id) WHERE x BETWEEN -10 AND 10 AND y BETWEEN -10 AND 15",
    "item_locations": f"WITH {PLACED} SELECT r.id, it.x, it.y FROM (SELECT unnest(range(0, (SELECT max(id) + 1 FROM it))) AS id) r LEFT JOIN it ON r.id = it.id",
    "convex_hull": _HULL,
    "get_hull": _HULL,
    "comparison_set": f"WITH {_compare(10, 10, 10)} SELECT id, other, distance, sample_count FROM cs",
    "adjust_step": f"WITH {_compare(10, 10, 10)} SELECT id, {near_sql('px + fx')} AS x, {near_sql('py + fy')} AS y FROM mv",
    "adjust_items": f"WITH {_compare(10, 5, 5)} SELECT id, {near_sql('px + fx')} AS x, {near_sql('py + fy')} AS y, {near_sql('fx')} AS vx, {near_sql('fy')} AS vy FROM mv",
    "item_distances": f"""WITH {RELATIONS} SELECT id AS item_id, count(*) AS relation_count, {near_sql('avg(distance_mean)')} AS distance_mean
        FROM (SELECT a AS id, distance_mean FROM rl UNION ALL SELECT b, distance_mean FROM rl) GROUP BY 1""",
    "locate_items": _locate(5),
    "process_ratings_items": f"WITH {_ITEM_STATS} SELECT item_id, sample_count, {near_sql('value_mean')} AS value_mean, {near_sql('value_variance')} AS value_variance FROM st",
    "process_ratings_relations": f"WITH {_RELATION_STATS} SELECT first_item_id, second_item_id, sample_count, {_REL_COLS} FROM rs",
}
