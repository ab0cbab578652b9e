"""Percentiles of very large numeric columns from mergeable summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dissimap.operators.skew import join_hot, usable
from dissimap.session import cut

#: Summaries are off by more than their rank error in 1 of 100 cases; brackets are that many times as wide.
WIDE = 3
#: The most distinct values of a key that one task orders, and the rounds that narrow brackets to that; each leaves a twentieth or less.
MOST_ORDERED, MOST_ROUNDS = 100_000, 30
#: Steps of the ranks at which a summary is read when brackets are narrowed.
GRID = 256


def rank_error(k: int) -> float:
    """The error of a rank, as a share of the values, that a summary of parameter k keeps to in at least 99 of 100 cases."""
    return 2.296 / k**0.9021


def summaries(df: DataFrame, keys: list[str], value: str, k: int = 200) -> DataFrame:
    """A compactor hierarchy of `value` for each combination of keys: (keys, sketch binary). Null and NaN values do not
    count; keys without any other value are left out. Null keys are a key.

    Levels hold up to about k values; a full one is sorted and every other value, from a random start, goes one level up.
    Each task summarises its rows, and the partial summaries are merged level by level after the exchange, so a key with
    a third of all rows moves one summary per task.
    """
    v = F.col(value).cast("double")
    return df.where(usable(v)).groupBy(*keys).agg(F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def merge_summaries(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries of days or partitions put together by the keys that are left: (keys, sketch)."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Adds n_values and, for each name, the smallest value at or below which about that share of the values lies."""
    out = sketches.withColumn("n_values", F.kll_sketch_get_n_double("sketch"))
    for name, q in shares.items():
        out = out.withColumn(name, F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))))
    return out


def exact_quantiles(df: DataFrame, brackets: DataFrame, key: str, value: str, shares: dict[str, float], most: int = MOST_ORDERED, k: int = 512) -> DataFrame:
    """The exact percentiles of `value` for keys of brackets(key, n_values, <name>_low, <name>_high[, wanted]): (key, n_values, names). Keys whose `wanted` is false have no
    row, but tell which keys are hot. brackets is read several times: a written table, or cheap.

    A bracket is where a summary places the percentile. Values below it are only counted; those in it are counted by
    value, on the map side first, and only these distinct values are ordered: those of a key in one task, so brackets that may hold more than `most`
    of a key's values are narrowed first, by summaries of parameter k of the values inside them, over and over. Rows of hot keys meet
    their brackets by a broadcast (join_hot). Keys of which a percentile lies outside its bracket (a rare failure of the
    summary's bound) are gone over again without one. Keys without values have no row.
    """
    names = list(shares)
    if "wanted" not in brackets.columns:
        brackets = brackets.withColumn("wanted", F.lit(True))
    brackets = brackets.select(F.col(key).alias("k"), F.col("n_values").alias("size"), "wanted", *[F.col(f"{m}_{e}").cast("double") for m in names for e in ("low", "high")])
    x = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where(usable(F.col("v")))
    inside = 2 * WIDE * rank_error(k)
    brackets = _narrowed(x, brackets, shares, most, k, F.col("size") * F.lit(inside) > F.lit(float(most)))
    out = cut(_within(x, brackets, shares))
    missed = out.where(" or ".join(f"{m} is null" for m in names)).select("k")
    if missed.limit(1).count():
        ends = [F.lit(float(f"{s}inf")).alias(f"{m}_{e}") for m in names for s, e in (("-", "low"), ("+", "high"))]
        again = cut(brackets.join(missed, "k", "left_semi").select("k", "size", "wanted", *ends))
        again = _narrowed(x, again, shares, most, k, F.col("size") > F.lit(float(most)))
        out = out.join(missed, "k", "left_anti").unionByName(cut(_within(x, again, shares)))
    return out.withColumnRenamed("k", key)


def _narrowed(x: DataFrame, brackets: DataFrame, shares: dict[str, float], most: int, k: int, large) -> DataFrame:
    """brackets with those of large keys narrowed until none has more than `most` values between its ends. Each round counts the values below, at and between
    the ends, and sets the ends anew by a summary of those between, of which a twentieth or so is left."""
    todo = cut(brackets.where(F.col("wanted") & large))
    if not todo.limit(1).count():
        return brackets
    rest, e, done = brackets.join(todo, "k", "left_anti"), WIDE * rank_error(k), []
    for _ in range(MOST_ROUNDS):
        sums = [F.count(F.lit(1)).alias("n")]
        for m in shares:
            low, high, v = F.col(f"{m}_low"), F.col(f"{m}_high"), F.col("v")
            mid = (v > low) & (v < high)
            sums += [F.count(F.when(c, 1)).alias(f"{m}_{e}") for e, c in (("below", v < low), ("first", v == low), ("mid", mid), ("last", (v == high) & (low < high)))]
            sums += [F.kll_sketch_agg_double(F.when(mid, v), F.lit(k)).alias(f"{m}_s"), F.first(low).alias(f"{m}_low"), F.first(high).alias(f"{m}_high")]
        s = cut(join_hot(x, todo, "k", "size").groupBy("k").agg(*sums))
        new, wide = [], F.lit(False)
        for m, q in shares.items():
            low, high, mid = F.col(f"{m}_low"), F.col(f"{m}_high"), F.col(f"{m}_mid")
            rank = F.ceil(F.round(F.col("n") * F.lit(float(q)), 6)) - F.col(f"{m}_below")  # of the percentile, from the bracket's first value
            on_low, in_mid, on_high = rank <= F.col(f"{m}_first"), rank - F.col(f"{m}_first") <= mid, rank - F.col(f"{m}_first") - mid <= F.col(f"{m}_last")
            place = (rank - F.col(f"{m}_first")) / F.nullif(mid, F.lit(0))
            # A sketch answers fixed ranks only: a grid of them, of which the next lower and the next higher one are taken.
            grid = F.when(mid > 0, F.kll_sketch_get_quantile_double(f"{m}_s", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])))
            at = lambda p: F.get(grid, F.greatest(F.lit(0), F.least(F.lit(GRID), p.cast("int"))))  # noqa: B023, E731
            out = F.when(rank < 1, "miss").when(on_low, "low").when(in_mid & (mid <= most), "done").when(in_mid, "mid").when(on_high, "high").otherwise("miss")
            new.append(F.when(out == "miss", float("-inf")).when(out == "mid", at(F.floor((place - e) * GRID))).when(out == "high", high).otherwise(low).alias(f"{m}_low"))
            new.append(F.when(out == "miss", float("inf")).when(out == "mid", at(F.ceil((place + e) * GRID))).when(out == "low", low).otherwise(high).alias(f"{m}_high"))
            wide |= out.isin("mid", "miss")
        t = cut(s.select("k", F.col("n").alias("size"), F.lit(True).alias("wanted"), *new, wide.alias("wide")))
        done.append(t.where("not wide").drop("wide"))
        todo = t.where("wide").drop("wide")
        if not todo.limit(1).count():
            break
    else:
        raise RuntimeError("brackets are not narrow within the rounds allowed")
    for t in done:
        rest = rest.unionByName(t.select(rest.columns))
    return cut(rest)


def _within(x: DataFrame, brackets: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(k, n_values, names) of the wanted keys; null where a percentile lies outside its bracket."""
    x = join_hot(x, brackets, "k", "size").where("wanted")
    names = list(shares)
    inside = F.lit(False)
    for m in names:
        inside |= F.col("v").between(F.col(f"{m}_low"), F.col(f"{m}_high"))
    low = F.array_sort(F.array(*[F.col(f"{m}_low") for m in names], *[F.col(f"{m}_high") for m in names]))
    # Outside all brackets only the place between their ends matters: values there stand as the largest end below them.
    ends = F.filter(low, lambda e: e < F.col("v"))
    cell = F.when(inside, F.col("v")).otherwise(F.when(F.size(ends) > 0, F.element_at(ends, -1)).otherwise(F.lit(float("-inf"))))
    got = x.select("k", cell.alias("c"), inside.alias("exact")).groupBy("k", "c", "exact").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("k").orderBy("c", F.desc("exact"))
    cum = got.select("k", "c", "exact", F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy("k")).alias("n_values"))
    pick = []
    for m, q in shares.items():
        need = F.ceil(F.round(F.col("n_values") * F.lit(float(q)), 6))
        pick.append(F.min(F.when(F.col("upto") >= need, F.struct("upto", "c", "exact"))).alias(m))
    out = cum.groupBy("k").agg(F.first("n_values").alias("n_values"), *pick)
    return out.select("k", "n_values", *[F.when(F.col(f"{m}.exact"), F.col(f"{m}.c")).alias(m) for m in names])


def rank_errors(df: DataFrame, quantiles: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, n_values, names): how far each stated percentile of quantiles(key, n_values, names) is from its share, in shares of the key's values; 0 where the
    values equal to it cover the share."""
    x = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where(usable(F.col("v")))
    x = join_hot(x, quantiles.withColumnRenamed(key, "k").select("k", "n_values", *shares), "k", "n_values")
    sums = [s for m in shares for s in (F.count(F.when(F.col("v") < F.col(m), 1)).alias(f"{m}_below"), F.count(F.when(F.col("v") <= F.col(m), 1)).alias(f"{m}_upto"))]
    got = x.groupBy("k").agg(F.count(F.lit(1)).alias("n_values"), *sums)
    far = [F.greatest(F.col(f"{m}_below") / F.col("n_values") - q, q - F.col(f"{m}_upto") / F.col("n_values"), F.lit(0.0)).alias(m) for m, q in shares.items()]
    return got.select(F.col("k").alias(key), "n_values", *far)
