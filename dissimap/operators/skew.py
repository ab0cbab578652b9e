"""Per-key statistics without a slow task for the heavy keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dissimap.session import input_partitions

#: Keys that join_hot() may broadcast.
MOST_HOT = 1000


def usable(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """True where value is neither null nor NaN and lies in [low, high]."""
    ok = value.isNotNull() & ~F.isnan(value)
    if low is not None:
        ok &= value >= low
    if high is not None:
        ok &= value <= high
    return F.coalesce(ok, F.lit(False))


def keyed_moments(
    df: DataFrame,
    keys: list[str],
    value: str,
    low: float | None = None,
    high: float | None = None,
    fan_in: int = 32,
    shift: float | None = None,
) -> DataFrame:
    """Rows, usable values, mean and population variance of `value` for each value of each column of `keys`:
    (key_kind string, key_id bigint, n_rows, n_values bigint, value_mean, value_variance double).

    A tree aggregation. The chunks are the input partitions, whose size spark.sql.files.maxPartitionBytes fixes. A
    chunk is combined where it lies (the map side of the first exchange); its states go to reducers by (key, chunk div
    fan_in), so that no reducer gets more than fan_in states of a key; their results go on by chunk div fan_in**2, and
    so forth, in log_fan_in(chunks) rounds. A key that holds a third of all rows costs each task of each round fan_in
    states, as any other.

    A state is (rows, n, s1, m2): m2 is the sum of squares about the state's own mean, s1 the sum of value - shift.
    Merging adds sum(s1^2/n) - sum(s1)^2/sum(n) to the m2, which loses no digits if shift is near the values; it is
    by default some usable value. The input is read once.

    Null keys are a key of their own (key_id null). Null, NaN and values outside [low, high] count in n_rows only; a key
    without usable values has null moments. No rows, no result rows. Rows that repeat count each time.
    """
    v = F.col("v")
    src = df.select(*[F.col(k).cast("bigint").alias(f"k{i}") for i, k in enumerate(keys)], F.col(value).cast("double").alias("v"))
    src = src.withColumns({"v": F.when(usable(v, low, high), v), "c": F.spark_partition_id()})
    chunks = input_partitions(df)  # were there more, the last round would only get more states
    if shift is None:
        one = src.where("v is not null").select("v").limit(1).collect()
        shift = one[0].v if one else 0.0
    rows = src.select(
        "c",
        "v",
        F.explode(F.array(*[F.struct(F.lit(k).alias("key_kind"), F.col(f"k{i}").alias("key_id")) for i, k in enumerate(keys)])).alias("k"),
    )
    rows = rows.select("k.key_kind", "k.key_id", "c", (v - F.lit(shift)).alias("d"))
    by = ["key_kind", "key_id"]

    def part() -> Column:
        """The reducer of a chunk: one for fan_in of them, and one alone in the last round."""
        return (F.floor(F.col("c") / fan_in).cast("int") if chunks > fan_in else F.lit(0)).alias("c")

    state = rows.groupBy(*by, part()).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("d").alias("n"), F.sum("d").alias("s1"), (F.var_pop("d") * F.count("d")).alias("m2")
    )
    chunks = -(-chunks // fan_in)
    between = F.col("s1") * F.col("s1") / F.nullif(F.col("n"), F.lit(0))
    while chunks > 1:
        state = (
            state.groupBy(*by, part())
            .agg(F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("m2").alias("m"), F.sum(between).alias("b"))
            .withColumn("m2", F.col("m") + F.greatest(F.col("b") - between, F.lit(0.0)))
            .select(*by, "c", "n_rows", "n", "s1", "m2")
        )
        chunks = -(-chunks // fan_in)
    n = F.nullif(F.col("n"), F.lit(0))
    return state.select(
        *by, "n_rows", F.col("n").alias("n_values"), (F.col("s1") / n + F.lit(shift)).alias("value_mean"), (F.col("m2") / n).alias("value_variance")
    )


def heavy_keys(df: DataFrame, keys: list[str], value: str, share: float = 0.015, **kw) -> DataFrame:
    """The non-null keys of keyed_moments() that hold at least `share` of all rows of df, with their statistics and
    row_share. Rows count as they are, null keys and values too."""
    total = df.count()  # of a Parquet table, from its footers
    out = keyed_moments(df, keys, value, **kw).where(F.col("key_id").isNotNull())
    return out.withColumn("row_share", F.col("n_rows") / F.lit(float(max(total, 1)))).where(F.col("n_rows") >= F.lit(share * total))


def join_hot(rows: DataFrame, per_key: DataFrame, key: str, count: str, how: str = "inner", most: int = MOST_HOT) -> DataFrame:
    """rows joined on `key` with per_key, which has one row for each key and, in `count`, how many rows the key has (about). how: inner, left or left_semi.

    Keys of more than 1/most of all counted rows, of which there are `most` at most, meet their rows by a broadcast: their rows are not exchanged.
    The rows of the others, none of which is hot, meet theirs as Spark chooses. Null keys join nothing. per_key is read several times: a
    written table, or cheap.
    """
    total = per_key.agg(F.sum(count)).first()[0] or 0
    hot = F.coalesce(F.col(count) * F.lit(float(most)) > F.lit(float(total)), F.lit(False))
    hot_keys = F.broadcast(per_key.where(hot & F.col(key).isNotNull()))  # `most` rows at most
    if not per_key.where(hot).limit(1).count():
        return rows.join(per_key, key, how)
    rest = rows.join(hot_keys.select(key), key, "left_anti")
    return rows.join(hot_keys, key, "left_semi" if how == "left_semi" else "inner").unionByName(rest.join(per_key.where(~hot), key, how))
