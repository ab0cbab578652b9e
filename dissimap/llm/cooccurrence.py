"""Items that appear together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissimap.operators.skew import join_hot
from dissimap.session import cut


def _pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.alias("l").join(right.alias("r"), [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on] + [F.col("l.i") < F.col("r.i")]).select(
        F.col("l.i").alias("a"), F.col("r.i").alias("b")
    )


def items_together(df: DataFrame, basket: str, item: str, min_count: int = 20, min_lift: float = 0.0, tile: int = 512) -> DataFrame:
    """Pairs of items in at least min_count common baskets whose lift is at least min_lift:
    (first_item_id < second_item_id bigint, n_both, n_first, n_second, n_baskets bigint, lift, pmi double), pmi being the
    natural logarithm of lift = n_both * n_baskets / (n_first * n_second).

    Rows without basket or item do not count; an item counts once in a basket however often it stands there. n_baskets
    is the number of baskets with any item. Empty input gives no rows.

    Items are deduplicated per basket, then ordered pairs are emitted and their counts combined on the map side. What
    cannot reach the thresholds emits nothing, exactly: n_both <= min(n_first, n_second), so an item in fewer than
    min_count baskets, or in more than n_baskets / min_lift, is in no result pair. A basket of more than `tile` such items
    never pairs in one task: the min_count - 1 largest of these baskets emit no pairs at all, since a result pair must
    then have at least one basket among the others; each item has a bit for each of them, and the common bits are added
    to the pairs that can still reach min_count. The others are cut into tiles of about `tile` x `tile` pairs.
    """
    ui = cut(df.select(F.col(basket).cast("bigint").alias("u"), F.col(item).cast("bigint").alias("i")).where("u is not null and i is not null").distinct())
    n_baskets = ui.select("u").distinct().count()
    keep = F.col("n") >= min_count
    if min_lift > 0:
        keep &= F.col("n") * F.lit(float(min_lift)) <= F.lit(float(n_baskets))
    counts = cut(ui.groupBy("i").agg(F.count(F.lit(1)).alias("n")).withColumn("kept", keep))
    items = counts.where("kept").select("i", "n")
    kept = join_hot(ui, counts, "i", "n").where("kept").select("u", "i")  # hot items, kept or not, are not exchanged
    large = cut(kept.groupBy("u").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > tile))
    bits = [r.u for r in large.orderBy(F.desc("k"), "u").limit(min(min_count - 1, 62)).collect()] if min_count > 1 else []
    n_large = large.count()
    # Baskets with all their items' number, so that large ones are told apart without an exchange of the hottest.
    sized = join_hot(kept, large, "u", "k", "left") if n_large else kept.withColumn("k", F.lit(None).cast("bigint"))
    small = sized.where("k is null").select("u", "i")
    pairs = _pairs(small, small, ["u"])
    if n_large > len(bits):
        rest = sized.where(F.col("k").isNotNull() & ~F.col("u").isin(bits)) if bits else sized.where("k is not null")
        rest = rest.select("u", "i", F.ceil(F.col("k") / tile).cast("int").alias("m")).withColumn("c", F.pmod(F.xxhash64("i"), F.col("m")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
        # A pair of items meets in the tile of their two chunks, in one order of the chunks or the other.
        left = rest.select("u", "i", F.col("c").alias("x"), every.alias("y"))
        right = rest.select("u", "i", F.col("c").alias("y"), every.alias("x"))
        pairs = pairs.unionByName(_pairs(left, right, ["u", "x", "y"]))
    n = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= min_count - len(bits))
    if bits:
        place = F.create_map(*[F.lit(x) for i, u in enumerate(bits) for x in (int(u), i)])
        mask = kept.where(F.col("u").isin(bits)).withColumn("p", place[F.col("u")]).groupBy("i").agg(F.bit_or(F.expr("shiftleft(1L, p)")).alias("mask"))
        items = items.join(mask, "i", "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("bigint")))
    else:
        items = items.withColumn("mask", F.lit(0).cast("bigint"))
    a = items.select(F.col("i").alias("a"), F.col("n").alias("n_first"), F.col("mask").alias("ma"))
    b = items.select(F.col("i").alias("b"), F.col("n").alias("n_second"), F.col("mask").alias("mb"))
    n = n.join(a, "a").join(b, "b").withColumn("n_both", F.col("n_both") + F.bit_count(F.col("ma").bitwiseAND(F.col("mb"))))
    lift = F.col("n_both").cast("double") * F.lit(float(n_baskets)) / (F.col("n_first").cast("double") * F.col("n_second"))
    return (
        n.withColumn("lift", lift)
        .where((F.col("n_both") >= min_count) & (F.col("lift") >= min_lift))
        .select(
            F.col("a").alias("first_item_id"), F.col("b").alias("second_item_id"), "n_both", "n_first", "n_second",
            F.lit(n_baskets).cast("bigint").alias("n_baskets"), "lift", F.log("lift").alias("pmi"),
        )
    )
