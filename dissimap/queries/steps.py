"""Single steps of the force and hybrid layouts, and the map's stages: dissimilarities of all dimensions, places in the plane."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from dissimap.functions.vectors import mixed_sql, times, uniform, uniform_sql
from dissimap.model import both_ways, dense_index
from dissimap.operators import distance, force, hybrid, som
from dissimap.queries.inputs import BOTH_WAYS, PLANE_WAYS, full, full_pairs, plane, plane_pairs
from dissimap.queries.relational import coordinates, rounded
from dissimap.queries.rounding import near, near_sql
from dissimap.session import cut
from dissimap.sources.tables import table


def _state(spark, d):
    """Places in the plane with hashed velocities in [-0.5, 0.5)."""
    return plane(spark, d).withColumn("v", F.array(uniform("id", F.lit(0), seed=3) - 0.5, uniform("id", F.lit(1), seed=3) - 0.5))


def _moved(s):
    return s.select("id", *[near(F.col(c)[k]).alias(n) for c, k, n in (("x", 0, "x"), ("x", 1, "y"), ("v", 0, "vx"), ("v", 1, "vy"))])


def random_points(spark, d):
    return coordinates(force.random_points(plane(spark, d), 2, 1))


def force_step(spark, d):
    return _moved(force.force_step(full_pairs(spark, d), _state(spark, d), 2))


def planar_force(spark, d):
    p = plane(spark, d)
    f = force.spring_forces(both_ways(full_pairs(spark, d)), p, 2, 0.5).join(p, "id")
    return coordinates(f.select("id", force.planar_pull(F.col("f"), F.col("x"), 2, 0.3).alias("x")))


def force_cap(spark, d):
    f = force.spring_forces(both_ways(full_pairs(spark, d)), plane(spark, d), 2, 0.5)
    return coordinates(f.select("id", force.cap(F.col("f"), 0.02).alias("x")))


def _sets(spark, d):
    p, r = cut(dense_index(plane(spark, d).select("id"), "id", "at")), cut(full_pairs(spark, d))
    return hybrid.neighbour_sets(hybrid.drawn_candidates(p, r, 5, 1), hybrid.drawn_candidates(p, r, 10, 2), 5)


def neighbour_sets(spark, d):
    return rounded(_sets(spark, d), "r")


def cha96_step(spark, d):
    return _moved(hybrid.neighbour_step(_sets(spark, d), _state(spark, d), 2))


def velocity_step(spark, d):
    return _moved(force.integrate(_state(spark, d).withColumn("f", times("x", -0.1)), 0.5))


def kinetic_energy(spark, d):
    return rounded(force.kinetic_energy(_state(spark, d)), "energy")


def _sample(spark, d):
    p = plane(spark, d)
    s = cut(distance.distinct_sample(p, distance.sample_size(p.count())))
    to = both_ways(plane_pairs(spark, d)).join(s.withColumnRenamed("id", "j"), "j", "left_semi").join(s.withColumnRenamed("id", "i"), "i", "left_anti")
    return p, s, cut(to.select("i", "j", "r"))


def nearest_sample(spark, d):
    return rounded(hybrid.nearest_sample(_sample(spark, d)[2]), "r")


def interp_subset(spark, d):
    _, s, to = _sample(spark, d)
    return rounded(hybrid.subset_of_sample(to, s.count()), "r")


def _placed(spark, d):
    p, s, to = _sample(spark, d)
    subset = cut(hybrid.subset_of_sample(to, s.count()))
    layout = p.join(s, "id")
    return hybrid.polar_place(hybrid.nearest_sample(to), subset, layout), subset, layout


def polar_place(spark, d):
    return coordinates(_placed(spark, d)[0])


def force_refine(spark, d):
    placed, subset, layout = _placed(spark, d)
    return coordinates(hybrid.force_refine(cut(placed), subset, layout))


def scatter_layout(spark, d):
    """The sample's places among all points; null where a point is not sampled."""
    p, s, _ = _sample(spark, d)
    return p.select("id").join(p.join(s, "id"), "id", "left").select("id", near(F.col("x")[0]).alias("x"), near(F.col("x")[1]).alias("y"))


def _pivots(spark, d):
    p, s, to = _sample(spark, d)
    pivots = cut(distance.distinct_sample(s, 4, 2))
    among = both_ways(plane_pairs(spark, d)).join(s.withColumnRenamed("id", "j"), "j", "left_semi").join(pivots.withColumnRenamed("id", "i"), "i", "left_semi")
    return hybrid.pivot_buckets(among, int(p.count() ** 0.25)), pivots, to


def pivot_buckets(spark, d):
    return _pivots(spark, d)[0].select("pivot", "bucket", F.when(F.col("bucket") > 0, near(F.col("key"))).alias("key"), "member")


def pivot_nearest(spark, d):
    b, pivots, to = _pivots(spark, d)
    return rounded(hybrid.pivot_nearest(cut(b), to.join(pivots.withColumnRenamed("id", "j"), "j", "left_semi"), to), "r")


def _items(spark, d):
    return full(spark, d).select(F.col("id").alias("item"), F.posexplode("x").alias("prop", "value"))


def _weights(spark, d):
    """A vertex for each label: the mean of its vectors."""
    label = table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("label").cast("bigint").alias("vertex"))
    return _items(spark, d).join(label, "item").groupBy("vertex", "prop").agg(F.avg("value").alias("value"))


def _faces(spark, d):
    """A strip of triangles over the labels."""
    v = table(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("a")).distinct()
    top = v.agg(F.max("a")).first()[0]
    return v.where(F.col("a") <= top - 2).select("a", (F.col("a") + 1).alias("b"), (F.col("a") + 2).alias("c"))


def som_hops(spark, d):
    return som.hops(_faces(spark, d), 3)


def som_distance(spark, d):
    return rounded(som.sparse_distances(_items(spark, d), cut(_weights(spark, d))), "distance")


def som_winner(spark, d):
    return rounded(som.winners(_items(spark, d), cut(_weights(spark, d)), True), "distance")


def som_weights(spark, d):
    return rounded(som.neighbourhood(som.hops(_faces(spark, d), 3), 1.5), "weight")


def som_affection(spark, d):
    won = som.winners(_items(spark, d), cut(_weights(spark, d)), True)
    return rounded(som.affection(_items(spark, d), won, som.neighbourhood(som.hops(_faces(spark, d), 3), 1.5)), "value")


#: Epochs of som_train and its first radius.
EPOCHS, RADIUS = 3, 2.0


def som_train(spark, d):
    return rounded(som.train(cut(_items(spark, d)), cut(_weights(spark, d)), _faces(spark, d), EPOCHS, RADIUS), "value")


QUERIES = {
    f.__name__: f
    for f in (random_points, force_step, planar_force, force_cap, neighbour_sets, cha96_step, velocity_step, kinetic_energy, nearest_sample, interp_subset, polar_place, force_refine, scatter_layout,
              pivot_buckets, pivot_nearest, som_hops, som_distance, som_winner, som_weights, som_affection, som_train)
}

_STATE = f"st AS (SELECT id, x, y, {uniform_sql('id', '0', seed=3)} - 0.5 AS vx, {uniform_sql('id', '1', seed=3)} - 0.5 AS vy FROM pl)"


def _force(pairs: str, spring: float) -> str:
    e = lambda c: f"{spring} * avg(CASE WHEN d > 0 THEN (r - d) * ({c}i - {c}j) / d ELSE {'r - d' if c == 'x' else '0'} END)"
    return f"fo AS (SELECT i AS id, {e('x')} AS fx, {e('y')} AS fy FROM {pairs} GROUP BY i)"


def _capped(most: float) -> str:
    k = f"CASE WHEN sqrt(fx * fx + fy * fy) > {most} THEN {most} / sqrt(fx * fx + fy * fy) ELSE 1 END"
    return f"ca AS (SELECT id, fx * ({k}) AS fx, fy * ({k}) AS fy FROM fo)"


def _integrated(keep: float) -> str:
    return f"""iv AS (SELECT id, x, y, vx * {keep} + coalesce(fx, 0) AS vx, vy * {keep} + coalesce(fy, 0) AS vy FROM st LEFT JOIN ca USING (id))
      SELECT id, {near_sql('x + vx')} AS x, {near_sql('y + vy')} AS y, {near_sql('vx')} AS vx, {near_sql('vy')} AS vy FROM iv"""


def _candidates(seed: int, s: int) -> str:
    """Of each of s runs of the places after a point, one by hash."""
    low = f"k * (n - 1) // {s}"
    wide = f"(k + 1) * (n - 1) // {s} - k * (n - 1) // {s}"
    place = f"(pos + 1 + ({mixed_sql('pos', seed=seed)} + {low} + {mixed_sql('pos', 'k + 1', seed=seed)} % ({wide})) % (n - 1)) % n"
    return f"""SELECT sy.i, sy.j, sy.r FROM (SELECT nu.id, {place} AS to_ FROM nu, range(0, {s}) t(k)) c JOIN nu o ON c.to_ = o.pos JOIN sy ON sy.i = c.id AND sy.j = o.id"""


_SETS = f"{BOTH_WAYS}, nu AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos, count(*) OVER () AS n FROM pl), ns AS (SELECT i, j, r, row_number() OVER (PARTITION BY i ORDER BY r, j) <= 5 AS near FROM ({_candidates(1, 5)} UNION {_candidates(2, 10)}))"
_SM = f"sm AS (SELECT id FROM pl ORDER BY {mixed_sql('id', seed=1)}, id LIMIT (SELECT 10 + CAST(floor(sqrt(count(*))) AS BIGINT) FROM pl))"
_TO = f"{PLANE_WAYS}, {_SM}, ts AS (SELECT * FROM sp WHERE j IN (SELECT id FROM sm) AND i NOT IN (SELECT id FROM sm))"
_NEAR = "nr AS (SELECT i, arg_min(struct_pack(j := j, r := r), struct_pack(r := r, j := j)) AS m FROM ts GROUP BY i)"
_SUB = f"su AS (SELECT i, j, r FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY {mixed_sql('i', 'j', seed=1)}, j) AS k FROM ts) WHERE k <= 3 + (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) FROM sm))"


def _polar() -> str:
    parts = ["g0 AS (SELECT i, m.r AS radius, pl.x AS cx, pl.y AS cy, CAST(0 AS DOUBLE) AS angle FROM nr JOIN pl ON m.j = pl.id)"]
    for k in range(7):
        step = repr(math.pi / 2 / 2**k)
        loss = lambda s: f"sum(power(sqrt(power(cx + radius * cos(angle {s} {step}) - o.x, 2) + power(cy + radius * sin(angle {s} {step}) - o.y, 2)) - su.r, 2))"  # noqa: E731, B023
        parts.append(f"g{k + 1} AS (SELECT g{k}.i, radius, cx, cy, CASE WHEN {loss('-')} < {loss('+')} THEN angle - {step} ELSE angle + {step} END AS angle FROM g{k} JOIN su ON su.i = g{k}.i JOIN pl o ON su.j = o.id GROUP BY g{k}.i, radius, cx, cy, angle)")
    return ", ".join([*parts, "po AS (SELECT i AS id, cx + radius * cos(angle) AS x, cy + radius * sin(angle) AS y FROM g7)"])


_POLAR = f"{_TO}, {_NEAR}, {_SUB}, {_polar()}"
_PIVOT = f"""{_TO}, pv AS (SELECT id FROM sm ORDER BY {mixed_sql('id', seed=2)}, id LIMIT 4), pa AS (SELECT i AS pvt, j AS member, r FROM sp WHERE i IN (SELECT id FROM pv) AND j IN (SELECT id FROM sm)),
  pb AS (SELECT *, CAST((row_number() OVER (PARTITION BY pvt ORDER BY r DESC, member) - 1) // (SELECT CAST(floor(power(count(*), 0.25)) AS BIGINT) FROM pl) AS INT) AS bucket FROM pa),
  bu AS (SELECT *, CASE WHEN bucket = 0 THEN CAST('inf' AS DOUBLE) ELSE max(r) OVER (PARTITION BY pvt, bucket) END AS key FROM pb)"""
_SOM = """sv AS (SELECT vec_id AS item, label, CAST(k - 1 AS INT) AS prop, CAST(embedding[k] AS DOUBLE) AS value FROM embeddings, range(1, 65) t(k)),
  we AS (SELECT CAST(label AS BIGINT) AS vertex, prop, avg(value) AS value FROM sv GROUP BY 1, 2),
  sd AS (SELECT sv.item, we.vertex, sum(sv.value * (sv.value - 2 * we.value)) AS distance, sum(we.value * we.value) AS nn FROM sv JOIN we USING (prop) GROUP BY 1, 2),
  wi AS (SELECT item, arg_min(struct_pack(vertex := vertex, distance := distance + nn), struct_pack(d := distance + nn, v := vertex)) AS m FROM sd GROUP BY 1),
  lb AS (SELECT DISTINCT CAST(label AS BIGINT) AS v FROM embeddings), fc AS (SELECT v AS a, v + 1 AS b, v + 2 AS c FROM lb WHERE v <= (SELECT max(v) - 2 FROM lb)),
  se AS (SELECT a AS s, b AS t FROM fc UNION SELECT b, c FROM fc UNION SELECT c, a FROM fc), ee AS (SELECT s, t FROM se UNION SELECT t, s FROM se),
  h1 AS (SELECT DISTINCT s AS vertex, s AS other, 0 AS hop FROM ee UNION ALL SELECT s, t, 1 FROM ee),
  h2 AS (SELECT vertex, other, hop FROM h1 UNION ALL SELECT vertex, t, 2 FROM h1 JOIN ee ON other = s WHERE hop = 1),
  h3 AS (SELECT vertex, other, hop FROM h2 UNION ALL SELECT vertex, t, 3 FROM h2 JOIN ee ON other = s WHERE hop = 2),
  ho AS (SELECT vertex, other, min(hop) AS hop FROM h3 GROUP BY 1, 2),
  nw AS (SELECT vertex, other, exp(-(hop * hop) / 2.25::DOUBLE) AS weight FROM ho WHERE exp(-(hop * hop) / 2.25::DOUBLE) > 0.01)"""


def _trained() -> str:
    """EPOCHS epochs: winners by full distance, then affections by the neighbourhood of that epoch's radius."""
    parts = [f"{_SOM}, w0 AS (SELECT vertex, prop, value FROM we)"]
    for k in range(EPOCHS):
        r = max(1.0, RADIUS * (1 - k / EPOCHS))
        near = f"exp(-(hop * hop) / {r * r!r}::DOUBLE)"
        parts += [
            f"d{k} AS (SELECT sv.item, w{k}.vertex, sum(power(sv.value - w{k}.value, 2)) AS d FROM sv JOIN w{k} USING (prop) GROUP BY 1, 2)",
            f"b{k} AS (SELECT item, arg_min(vertex, struct_pack(d := d, v := vertex)) AS vertex FROM d{k} GROUP BY 1)",
            f"n{k} AS (SELECT vertex, other, {near} AS weight FROM ho WHERE hop <= {int(RADIUS)} AND {near} > 0.01)",
            f"c{k} AS (SELECT b{k}.item, n{k}.other AS vertex, n{k}.weight FROM b{k} JOIN n{k} ON b{k}.vertex = n{k}.vertex), t{k} AS (SELECT vertex, sum(weight) AS n FROM c{k} GROUP BY 1)",
            f"w{k + 1} AS (SELECT c{k}.vertex, prop, sum(weight * value) / any_value(n) AS value FROM c{k} JOIN sv USING (item) JOIN t{k} USING (vertex) GROUP BY 1, 2)",
        ]
    return f"WITH {', '.join(parts)} SELECT vertex, prop, {near_sql('value')} AS value FROM w{EPOCHS}"


SQL = {
    "som_train": _trained(),
    "random_points": f"SELECT vec_id AS id, {near_sql(uniform_sql('vec_id', '0', seed=1))} AS x, {near_sql(uniform_sql('vec_id', '1', seed=1))} AS y FROM embeddings",
    "force_step": f"WITH {BOTH_WAYS}, {_STATE}, {_force('sy', 0.5)}, {_capped(0.5)}, {_integrated(0.5)}",
    "planar_force": f"WITH {BOTH_WAYS}, {_force('sy', 0.5)} SELECT id, {near_sql('fx')} AS x, {near_sql('fy - pl.y * 0.3')} AS y FROM fo JOIN pl USING (id)",
    "force_cap": f"WITH {BOTH_WAYS}, {_force('sy', 0.5)}, {_capped(0.02)} SELECT id, {near_sql('fx')} AS x, {near_sql('fy')} AS y FROM ca",
    "neighbour_sets": f"WITH {_SETS} SELECT i, j, {near_sql('r')} AS r, near FROM ns",
    "cha96_step": f"WITH {_SETS}, {_STATE}, nd AS (SELECT sy.* FROM ns JOIN sy USING (i, j)), {_force('nd', 0.2)}, {_capped(0.5)}, {_integrated(0.7)}",
    "velocity_step": f"WITH {PLANE_WAYS}, {_STATE}, ca AS (SELECT id, -0.1 * x AS fx, -0.1 * y AS fy FROM pl), {_integrated(0.5)}",
    "kinetic_energy": f"WITH {PLANE_WAYS}, {_STATE} SELECT {near_sql('sum(vx * vx + vy * vy)')} AS energy FROM st",
    "nearest_sample": f"WITH {_TO}, {_NEAR} SELECT i, m.j AS j, {near_sql('m.r')} AS r FROM nr",
    "interp_subset": f"WITH {_TO}, {_SUB} SELECT i, j, {near_sql('r')} AS r FROM su",
    "polar_place": f"WITH {_POLAR} SELECT id, {near_sql('x')} AS x, {near_sql('y')} AS y FROM po",
    "force_refine": f"""WITH {_POLAR}, fd AS (SELECT su.i, su.j, su.r, p.x AS xi, p.y AS yi, o.x AS xj, o.y AS yj, sqrt(power(p.x - o.x, 2) + power(p.y - o.y, 2)) AS d FROM su JOIN po p ON su.i = p.id JOIN pl o ON su.j = o.id),
        {_force('fd', 1.0)} SELECT id, {near_sql('po.x + fx')} AS x, {near_sql('po.y + fy')} AS y FROM po JOIN fo USING (id)""",
    "scatter_layout": f"WITH {_TO} SELECT pl.id, {near_sql('CASE WHEN sm.id IS NOT NULL THEN pl.x END')} AS x, {near_sql('CASE WHEN sm.id IS NOT NULL THEN pl.y END')} AS y FROM pl LEFT JOIN sm ON pl.id = sm.id",
    "pivot_buckets": f"WITH {_PIVOT} SELECT pvt AS \"pivot\", bucket, CASE WHEN bucket > 0 THEN {near_sql('key')} END AS key, member FROM bu",
    "pivot_nearest": f"""WITH {_PIVOT}, ke AS (SELECT DISTINCT pvt, bucket, key FROM bu), pk AS (SELECT ts.i, pvt, arg_min(bucket, struct_pack(k := key, b := bucket)) AS bucket FROM ts JOIN ke ON ts.j = pvt AND key >= r GROUP BY 1, 2),
        fd AS (SELECT DISTINCT pk.i, member FROM pk JOIN bu USING (pvt, bucket)), be AS (SELECT i, arg_min(struct_pack(j := ts.j, r := ts.r), struct_pack(r := ts.r, j := ts.j)) AS m FROM fd JOIN ts USING (i) WHERE member = ts.j GROUP BY 1)
        SELECT i, m.j AS j, {near_sql('m.r')} AS r FROM be""",
    "som_hops": f"WITH {_SOM} SELECT vertex, other, hop FROM ho",
    "som_distance": f"WITH {_SOM} SELECT item, vertex, {near_sql('distance')} AS distance FROM sd",
    "som_winner": f"WITH {_SOM} SELECT item, m.vertex AS vertex, {near_sql('m.distance')} AS distance FROM wi",
    "som_weights": f"WITH {_SOM} SELECT vertex, other, {near_sql('weight')} AS weight FROM nw",
    "som_affection": f"""WITH {_SOM}, co AS (SELECT wi.item, nw.other AS vertex, nw.weight FROM wi JOIN nw ON wi.m.vertex = nw.vertex), to_ AS (SELECT vertex, sum(weight) AS n FROM co GROUP BY 1)
        SELECT vertex, prop, {near_sql('sum(weight * value) / any_value(n)')} AS value FROM co JOIN sv USING (item) JOIN to_ USING (vertex) GROUP BY 1, 2""",
}
