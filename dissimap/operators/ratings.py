"""Statistics of items and of relations from ratings, and their validation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissimap.operators import rated_pairs
from dissimap.operators.skew import MOST_HOT, join_hot, keyed_moments, usable
from dissimap.session import cut, ship

RELATION = ("sample_count", "value_abs_diff_mean", "value_abs_diff_variance", "first_value_mean", "second_value_mean", "first_value_variance", "second_value_variance", "value_covariance")


def usable_ratings(rating: DataFrame, low: float = 0, high: float = 100) -> DataFrame:
    """(user_id, item_id, value) of rows with both ids and a value that is not null, not NaN and in [low, high]."""
    v = F.col("item_value")
    return rating.where(F.col("user_id").isNotNull() & F.col("item_id").isNotNull() & usable(v, low, high)).select("user_id", "item_id", v.alias("value"))


def latest_relations(relation: DataFrame) -> DataFrame:
    """One row for each unordered pair of different items: (a < b, distance_mean, sample_count) of its usable row (two different ids,
    a finite distance of at least 0) with the latest updated_at; of several such, the smallest distance, then the smallest count."""
    a, b, d = F.col("first_item_id"), F.col("second_item_id"), F.col("distance_mean")
    ok = relation.where((a != b) & ~F.isnan(d) & (d >= 0) & (d < F.lit(float("inf"))))
    key = F.struct(F.unix_micros(F.col("updated_at").cast("timestamp")).alias("at"), (-d).alias("nd"), (-F.col("sample_count")).alias("nc"))
    got = ok.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), key.alias("k")).groupBy("a", "b").agg(F.max("k").alias("k"))
    return got.select("a", "b", (-F.col("k.nd")).alias("distance_mean"), (-F.col("k.nc")).alias("sample_count"))


def stored_relations(relation: DataFrame) -> DataFrame:
    """One row (first_item_id < second_item_id, RELATION) for each unordered pair of different items: its row with the latest updated_at, whole; of
    several such, the smallest distance, then the smallest count. Values of a row in the other order change places."""
    a, b = F.col("first_item_id"), F.col("second_item_id")
    other = {c: c.replace("first_", "second_") if c.startswith("first_") else c.replace("second_", "first_") for c in RELATION}
    values = [F.when(a < b, F.col(c)).otherwise(F.col(other[c])).alias(c) for c in RELATION]
    d = F.when(~F.isnan("distance_mean"), -F.col("distance_mean"))
    key = F.struct(F.unix_micros(F.col("updated_at").cast("timestamp")).alias("at"), d.alias("nd"), (-F.col("sample_count")).alias("nc"), *values)
    got = relation.where(a != b).select(F.least(a, b).alias("first_item_id"), F.greatest(a, b).alias("second_item_id"), key.alias("k"))
    return got.groupBy("first_item_id", "second_item_id").agg(F.max("k").alias("k")).select("first_item_id", "second_item_id", *[F.col(f"k.{c}") for c in RELATION])


def item_statistics(ratings: DataFrame) -> DataFrame:
    """(item_id, sample_count, value_mean, value_variance) of ratings (user_id, item_id, value), population variance. By tree aggregation, so a heavy
    item delays nothing."""
    m = keyed_moments(ratings, ["item_id"], "value").where("key_id is not null")
    return m.select(F.col("key_id").alias("item_id"), F.col("n_values").alias("sample_count"), "value_mean", "value_variance")


def item_distances(relations: DataFrame) -> DataFrame:
    """(item_id, relation_count, distance_mean): an item's relations (a, b, distance) and their mean distance, as part of its running statistics. Summed on the map side, so a
    heavy item delays nothing."""
    e = relations.select(F.explode(F.array("a", "b")).alias("item_id"), "distance").where(F.col("distance").isNotNull() & ~F.isnan("distance"))
    return e.groupBy("item_id").agg(F.count(F.lit(1)).alias("relation_count"), F.avg("distance").alias("distance_mean"))


#: Pairs of ratings, or sums of pairs of items, of a part.
PART_PAIRS = 1_000_000
#: Ratings of a task that pairs them.
TASK_RATINGS = 250_000


def _hot_items(ratings: DataFrame, total: int) -> DataFrame:
    """(i, r): items of more than 1/MOST_HOT of all ratings, of which there are MOST_HOT at most, r being 1 for the coolest of them."""
    spark = ratings.sparkSession
    hot = ratings.groupBy(F.col("item_id").alias("i")).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") * MOST_HOT > total).orderBy("k", "i").collect()
    return spark.createDataFrame([(h.i, r + 1) for r, h in enumerate(hot)], "i bigint, r int")


def pair_pieces(ratings: DataFrame, tile: int = 1 << 18, fresh: bool = False, shift: float = 50.0, parts: int | None = None, wanted: tuple[str, ...] = rated_pairs.SUMS) -> tuple[DataFrame, int, DataFrame | None]:
    """The pairs of ratings of different items by the same user as packed pieces (rated_pairs), in `parts` parts (a power of two; None: as many as their number
    needs), and the items' ranks (_hot_items; all 0 where parts is given, so that the pieces of several calls go together). fresh: only pairs of which at least one
    rating's column `fresh` is true. wanted: the sums that the pieces of sums have.

    A user's ratings meet in one task. Up to rated_pairs.LISTED of them are listed pair by pair; of more, the sums of each pair of items come from sorted values, so that
    a user who rates few items very often costs ratings x items. A user of more than `tile` ratings is cut into that many tiles of two chunks each, which are
    tasks of their own."""
    ship(ratings.sparkSession)
    own = ["fresh"] if fresh else []
    users = cut(ratings.groupBy(F.col("user_id").alias("u")).agg(F.count(F.lit(1)).alias("k")))
    large = users.where(F.col("k") > min(tile, rated_pairs.LISTED))
    listed = F.when(F.col("k") <= rated_pairs.LISTED, F.col("k") * (F.col("k") - 1) / 2)
    t = users.agg(F.sum("k").alias("n"), F.sum(listed).alias("pairs"), F.max("k").alias("k"), F.sum(F.col("k") * F.ceil(F.col("k") / tile)).alias("rows")).first()
    total, pairs = t.n or 0, float(t.pairs or 0)
    ranks = None
    if parts is None:
        if (t.k or 0) > rated_pairs.LISTED:
            few = join_hot(ratings.select(F.col("user_id").alias("u"), "item_id"), large, "u", "k", "left_semi").distinct()
            k = F.col("k").cast("double")
            pairs += few.groupBy("u").agg(F.count(F.lit(1)).alias("k")).agg(F.sum(k * k / 2)).first()[0] or 0.0
        parts = 1 << max(0, math.ceil(math.log2(max(1.0, pairs / PART_PAIRS))))
        ranks = _hot_items(ratings, total)
    r = ratings.select(F.col("user_id").alias("u"), F.col("item_id").alias("i"), F.col("value").alias("v"), *own)
    r = r.withColumn("r", F.lit(0)) if ranks is None else r.join(F.broadcast(ranks), "i", "left").withColumn("r", F.coalesce("r", F.lit(0)))  # MOST_HOT rows at most
    if (t.k or 0) > tile:
        r = r.join(F.broadcast(users.where(F.col("k") > tile)), "u", "left")  # a row for `tile` ratings at most, and the ratings are read once
        r = r.withColumn("m", F.ceil(F.coalesce("k", F.lit(1)) / tile).cast("int"))
        r = r.withColumn("c", F.pmod(F.xxhash64("i", "v"), F.col("m")).cast("int")).withColumn("e", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        r = r.withColumns({"x": F.least("c", "e"), "y": F.greatest("c", "e"), "own_side": F.col("c") <= F.col("e")})
    else:
        r = r.withColumns({"x": F.lit(0), "y": F.lit(0), "own_side": F.lit(True)})
    r = r.select("u", "x", "y", "own_side", "r", "i", "v", *own).repartition(max(1, -(-int(t.rows or 0) // TASK_RATINGS)), "u", "x", "y")
    return r.mapInArrow(rated_pairs.spread(parts, shift, fresh, wanted), rated_pairs.PIECE), parts, ranks


def gather_pieces(pieces: DataFrame, parts: int, finish: str = "sums", shift: float = 50.0, tolerance: float = 0.0, least: float = 0.0) -> DataFrame:
    """The pieces' pairs of items: (first_item_id < second_item_id) and the sums rated_pairs.SUMS, or, finish being 'moments', RELATION, or, 'faults', the ids alone, or, a
    model of rated_pairs.MODEL_SUMS, the distance."""
    names = {"sums": rated_pairs.SUMS, "moments": RELATION, "faults": (), **{m: ("distance",) for m in rated_pairs.MODEL_SUMS}}[finish]
    kind = ", ".join(["first_item_id bigint", "second_item_id bigint", *[f"{c} {'bigint' if c in ('n', 'sample_count') else 'double'}" for c in names]])
    return pieces.repartitionById(parts, F.col("p")).mapInArrow(rated_pairs.gather(shift, list(names), finish, tolerance, least=least), kind)


def relation_sums(ratings: DataFrame, tile: int = 1 << 18, fresh: bool = False, shift: float = 50.0) -> DataFrame:
    """(first_item_id < second_item_id, n, d, dd, a, aa, b, bb, ab): over all pairs of ratings that a user gave the two items, their number and the sums of |a-b|, of
    the values less the shift, and of their squares and product."""
    pieces, parts, _ = pair_pieces(ratings, tile, fresh, shift)
    return gather_pieces(pieces, parts, "sums", shift)


def relation_statistics(ratings: DataFrame, tile: int = 1 << 18) -> DataFrame:
    """(first_item_id < second_item_id, sample_count, mean and population variance of |a-b|, of a and of b, and their covariance) over all pairs of
    ratings a user gave the two items. Values are shifted by 50 to keep their digits."""
    pieces, parts, _ = pair_pieces(ratings, tile)
    return gather_pieces(pieces, parts, "moments")


def relation_faults(stored: DataFrame, ratings: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """validate_relations() against relation_statistics(ratings), whose rows are not exchanged: the stored relations go to their pairs."""
    pieces, parts, ranks = pair_pieces(ratings)
    key = ["first_item_id", "second_item_id"]
    s = stored.select(*key, *[F.col(c).cast("double").alias(c) for c in RELATION])
    for c, name in zip(key, ("ra", "rb")):
        s = s.join(F.broadcast(ranks.select(F.col("i").alias(c), F.col("r").alias(name))), c, "left")  # MOST_HOT rows at most
    ra, rb = F.coalesce("ra", F.lit(0)), F.coalesce("rb", F.lit(0))
    s = s.select(F.when(ra <= rb, F.col(key[0])).otherwise(F.col(key[1])).alias("owner"), *key, *RELATION)
    there = s.mapInArrow(rated_pairs.spread_stored(parts, list(RELATION)), rated_pairs.PIECE)
    return gather_pieces(pieces.unionByName(there), parts, "faults", tolerance=tolerance)


def off(stored: Column, truth: Column, tolerance: float = 0.001) -> Column:
    """True where a stored value is missing or further than the tolerance, as a share, from the truth; a truth of 0 needs 0."""
    return stored.isNull() | F.isnan(stored) | (F.abs(stored - truth) > tolerance * F.abs(truth))


def validate_items(stored: DataFrame, truth: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """The item_ids of truth whose stored (id, sample_count, value_mean, value_variance) is missing, counts otherwise, or is off."""
    s = stored.select(F.col("id").alias("item_id"), *[F.col(c).alias(f"s_{c}") for c in ("sample_count", "value_mean", "value_variance")])
    bad = F.col("s_sample_count").isNull() | (F.col("s_sample_count") != F.col("sample_count")) | off(F.col("s_value_mean"), F.col("value_mean"), tolerance) | off(F.col("s_value_variance"), F.col("value_variance"), tolerance)
    return s.join(truth, "item_id", "right").where(bad).select("item_id")


def validate_relations(stored: DataFrame, truth: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """The pairs of truth whose stored statistics are missing, count otherwise, or are off in any of seven values."""
    key = ["first_item_id", "second_item_id"]
    s = stored.select(*key, *[F.col(c).alias(f"s_{c}") for c in RELATION])
    bad = F.col("s_sample_count").isNull() | (F.col("s_sample_count") != F.col("sample_count"))
    for c in RELATION[1:]:
        bad |= off(F.col(f"s_{c}"), F.col(c), tolerance)
    return s.join(truth, key, "right").where(bad).select(*key)


def model_distance(relations: DataFrame, model: str = "abs_difference") -> DataFrame:
    """(first_item_id, second_item_id, distance): the mean absolute difference, or 1 - correlation (null where a value has no variance)."""
    if model == "abs_difference":
        d = F.col("value_abs_diff_mean")
    elif model == "correlation":
        d = 1 - F.try_divide("value_covariance", F.sqrt(F.col("first_value_variance") * F.col("second_value_variance")))
    else:
        raise ValueError("model is 'abs_difference' or 'correlation'")
    return relations.select("first_item_id", "second_item_id", d.alias("distance"))


def relation_distances(ratings: DataFrame, model: str = "abs_difference", tile: int = 1 << 18, least_variance: float = 0.0) -> DataFrame:
    """model_distance() of relation_statistics(ratings), from the sums that the model needs alone. least_variance: a relation one of whose variances is smaller has no
    correlation."""
    if model not in rated_pairs.MODEL_SUMS:
        raise ValueError("model is 'abs_difference' or 'correlation'")
    pieces, parts, _ = pair_pieces(ratings, tile, wanted=rated_pairs.MODEL_SUMS[model])
    return gather_pieces(pieces, parts, model, least=least_variance)


def shrunk_distance(count: Column, distance: Column, item_mean: Column) -> Column:
    """A relation's distance drawn to the item's mean distance by 1 / (1 + count); the item's mean alone without a relation."""
    k = 1.0 / (1 + count)
    return F.coalesce(k * item_mean + (1 - k) * distance, item_mean)


def merge_statistics(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of two disjoint sets of ratings as those of both: (keys, n, means m_*, sums of squares or products about them c_*_*). Columns
    m_x, c_x_y are found by name."""
    means = [c[2:] for c in old.columns if c.startswith("m_")]
    products = [c[2:].split("_") for c in old.columns if c.startswith("c_")]
    b = new.select(*keys, *[F.col(c).alias(f"b_{c}") for c in new.columns if c not in keys])
    j = old.join(b, keys, "full")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    n, nb = F.coalesce("n", F.lit(0)), F.coalesce("b_n", F.lit(0))
    k = n + nb
    delta = {x: z(f"b_m_{x}") - z(f"m_{x}") for x in means}
    return j.select(
        *keys, k.cast("bigint").alias("n"), *[((n * z(f"m_{x}") + nb * z(f"b_m_{x}")) / k).alias(f"m_{x}") for x in means],
        *[(z(f"c_{x}_{y}") + z(f"b_c_{x}_{y}") + delta[x] * delta[y] * n * nb / k).alias(f"c_{x}_{y}") for x, y in products],
    )
