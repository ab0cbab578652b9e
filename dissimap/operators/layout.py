"""Placing items by their relations: comparison sets, adjustment steps, and the event-by-event map."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dissimap.operators.ratings import shrunk_distance
from dissimap.operators.views import placed_items
from dissimap.session import cut

#: Powers of two that a double may have.
MOST_LEVELS = 2100


def located_relations(item: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, other, distance, sample_count): relations (a, b, distance_mean, sample_count) from either side towards placed items."""
    at = placed_items(item).select(F.col("id").alias("other"))
    r = relations.select(F.col("a").alias("id"), F.col("b").alias("other"), F.col("distance_mean").alias("distance"), "sample_count")
    both = r.unionByName(r.select(F.col("other").alias("id"), F.col("id").alias("other"), "distance", "sample_count"))
    return both.join(at, "other").select("id", "other", "distance", "sample_count")


def box_neighbours(boxes: DataFrame, item: DataFrame, most: int) -> DataFrame:
    """(id, other): of the placed items in the square of half-size `half` about each of boxes (id, x, y, half), sides included and itself not, the `most`
    nearest, equal ones by id.

    An equi-join on grid cells. A box belongs to the level of the power of two at or above its half-size, whose cells are that wide, so it covers nine cells
    at most; an item is in one cell of each level that any box has (a few dozen at most, for sizes of one scale). The `most` nearest of each box and cell are
    picked before those of the whole box.
    """
    boxes = boxes.where("half > 0 and half < double('inf')")
    boxes = boxes.withColumn("level", F.ceil(F.log2("half")).cast("int"))
    levels = [r[0] for r in boxes.select("level").distinct().limit(MOST_LEVELS).collect()]  # doubles have no more
    cell = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("level")))
    span = lambda c: F.explode(F.sequence(cell(F.col(c) - F.col("half")), cell(F.col(c) + F.col("half"))))
    b = boxes.select("id", "x", "y", "half", "level", span("x").alias("cx")).withColumn("cy", span("y"))
    p = placed_items(item).select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level"))
    p = p.withColumns({"cx": cell(F.col("ox")), "cy": cell(F.col("oy"))})
    j = b.join(p, ["level", "cx", "cy"]).where((F.col("id") != F.col("other")) & (F.abs(F.col("ox") - F.col("x")) <= F.col("half")) & (F.abs(F.col("oy") - F.col("y")) <= F.col("half")))
    far = (F.col("ox") - F.col("x")) * (F.col("ox") - F.col("x")) + (F.col("oy") - F.col("y")) * (F.col("oy") - F.col("y"))
    inner = F.row_number().over(Window.partitionBy("id", "level", "cx", "cy").orderBy("far", "other"))
    j = j.withColumn("far", far).withColumn("inner", inner).where(F.col("inner") <= most)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("far", "other"))
    return j.withColumn("rank", rank).where(F.col("rank") <= most).select("id", "other")


def comparison_set(item: DataFrame, relations: DataFrame, ids: DataFrame | None = None, closest: int = 10, furthest: int = 10, local: int = 10, boundary: float = 2.0) -> DataFrame:
    """(id, other, distance, sample_count): what each placed item (of ids) is compared with: its closest and its furthest located relations, and the nearest
    placed items in the square of half-size boundary * its closest relation's distance. Each other once; distance and count are null without a relation.
    Equal distances by id."""
    own = placed_items(item).select("id", "x", "y")
    if ids is not None:
        own = own.join(ids.select("id").distinct(), "id", "left_semi")
    rel = located_relations(item, relations).join(own.select("id"), "id", "left_semi").where("id <> other")
    near = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
    far = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("distance"), "other"))
    a = rel.withColumn("k", near).where(F.col("k") <= closest)
    b = rel.withColumn("k", far).where(F.col("k") <= furthest)
    first = rel.groupBy("id").agg((F.min("distance") * boundary).alias("half"))
    box = box_neighbours(own.join(first, "id"), item, local)
    c = box.join(rel, ["id", "other"], "left").select("id", "other", "distance", "sample_count")
    return a.drop("k").unionByName(b.drop("k")).unionByName(c).distinct()


def adjust_step(item: DataFrame, compared: DataFrame, spring: float = 1.0) -> DataFrame:
    """(id, x, y): each compared item's place after the mean spring force of its comparison set, all moving at once. The distance aimed at is the
    relation's, drawn to the item's mean distance by 1 / (1 + count), or that mean alone; where neither is known the pair exerts none. Items on the
    same place push along the first axis."""
    own = placed_items(item).select("id", "x", "y", F.when(~F.isnan("distance_mean"), F.col("distance_mean")).alias("mean"))
    other = placed_items(item).select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    j = compared.join(own, "id").join(other, "other")
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    d = F.sqrt(dx * dx + dy * dy)
    aim = F.coalesce(shrunk_distance(F.col("sample_count"), F.col("distance"), F.col("mean")), F.col("distance"))
    same = d == 0
    pull = F.lit(float(spring)) * F.coalesce(aim - F.when(same, 1.0).otherwise(d), F.lit(0.0))
    fx = F.when(same, pull).otherwise(pull * F.try_divide(dx, d))
    fy = F.when(same, F.lit(0.0)).otherwise(pull * F.try_divide(dy, d))
    s = j.select("id", "x", "y", fx.alias("fx"), fy.alias("fy")).groupBy("id", "x", "y").agg(F.avg("fx").alias("fx"), F.avg("fy").alias("fy"))
    return s.select("id", (F.col("x") + F.col("fx")).alias("x"), (F.col("y") + F.col("fy")).alias("y"))


def adjust_items(item: DataFrame, relations: DataFrame, ids: DataFrame, closest: int = 10, furthest: int = 5, local: int = 5, boundary: float = 2.0, dampening: float = 0.5, velocity: DataFrame | None = None) -> DataFrame:
    """(id, x, y, vx, vy): queued items after one step with velocities (id, vx, vy), 0 if not given: v <- v (1 - dampening) + step."""
    own = placed_items(item).select("id", F.col("x").alias("px"), F.col("y").alias("py"))
    to = adjust_step(item, comparison_set(item, relations, ids, closest, furthest, local, boundary)).join(own, "id")
    if velocity is not None:
        to = to.join(velocity.select("id", "vx", "vy"), "id", "left")
    else:
        to = to.withColumns({"vx": F.lit(0.0), "vy": F.lit(0.0)})
    keep = lambda c: F.coalesce(c, F.lit(0.0)) * (1 - dampening)
    vx, vy = keep(F.col("vx")) + F.col("x") - F.col("px"), keep(F.col("vy")) + F.col("y") - F.col("py")
    return to.select("id", (F.col("px") + vx).alias("x"), (F.col("py") + vy).alias("y"), vx.alias("vx"), vy.alias("vy"))


def placement_threshold(relations: int) -> int:
    """How many located relations an item waits for before it is placed."""
    root = math.sqrt(relations)
    return max(1, min(int(root), int(math.log10(root) + 1))) if relations > 0 else 1


def locate_unplaced(item: DataFrame, relations: DataFrame, depth: int = 5) -> DataFrame:
    """(id, x, y) of items not yet placed that have enough placed relations: on the circle of its shrunk distance about the closest of them, at the angle
    that bisection finds (polar search over all its placed relations, at the final angle). If no item is placed, the least id with a relation goes to (0, 0)."""
    placed = placed_items(item)
    rel = located_relations(item, relations)
    n = rel.count()
    todo = item.join(placed.select("id"), "id", "left_anti").select("id", F.when(~F.isnan("distance_mean"), F.col("distance_mean")).alias("mean"))
    if not placed.limit(1).count():
        linked = relations.select(F.explode(F.array("a", "b")).alias("id"))
        return todo.join(linked, "id", "left_semi").orderBy("id").limit(1).select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    at = placed.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    aim = F.coalesce(shrunk_distance(F.col("sample_count"), F.col("distance"), F.col("mean")), F.col("distance"))
    r = rel.join(todo, "id").join(at, "other").select("id", "other", "ox", "oy", aim.alias("r"))
    r = cut(r)  # used in every step
    near = r.groupBy("id").agg(F.min(F.struct("r", "other", "ox", "oy")).alias("m"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= placement_threshold(n))
    p = near.select("id", F.col("m.r").alias("radius"), F.col("m.ox").alias("cx"), F.col("m.oy").alias("cy"), F.lit(0.0).alias("angle"))
    # The loss is a sum over a plain join at each step, so an item of very many relations is combined on the map side.
    for k in range(depth):
        step = math.pi / 2 / 2**k
        j = p.join(r.select("id", "ox", "oy", F.col("r").alias("want")), "id")

        def loss(a: Column) -> Column:
            px, py = F.col("cx") + F.col("radius") * F.cos(a), F.col("cy") + F.col("radius") * F.sin(a)
            return F.sum(F.pow(F.sqrt(F.pow(px - F.col("ox"), 2) + F.pow(py - F.col("oy"), 2)) - F.col("want"), 2))

        g = j.groupBy("id", "radius", "cx", "cy", "angle").agg(loss(F.col("angle") + step).alias("lp"), loss(F.col("angle") - step).alias("lm"))
        p = g.select("id", "radius", "cx", "cy", F.when(F.col("lm") < F.col("lp"), F.col("angle") - step).otherwise(F.col("angle") + step).alias("angle"))
    return p.select("id", (F.col("cx") + F.col("radius") * F.cos("angle")).alias("x"), (F.col("cy") + F.col("radius") * F.sin("angle")).alias("y"))
