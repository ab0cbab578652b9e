"""Matrices as headerless CSV, and optional JDBC tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dissimap.model import dense_index


def read_matrix(spark: SparkSession, path: str, columns: int, unparsable: float | None = None) -> DataFrame:
    """points (id, x) of a headerless CSV of numbers: id is the line's number from 0, files in the order of their names. Cells that are no numbers are
    null, or `unparsable` (0 as in older readers); 'nan' and 'inf' are numbers. Empty lines do not count.

    Lines are numbered by file and offset, so any number of splits may be read.
    """
    names = [f"c{k}" for k in range(columns)]
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("k"), "value").where(F.trim("value") != "")
    cells = F.split("value", ",")
    low = [F.lower(F.trim(F.get(cells, F.lit(k)))) for k in range(columns)]
    values = [F.coalesce(F.when(c.isin("nan", "-nan"), F.lit(float("nan"))).when(c.isin("inf", "infinity"), F.lit(float("inf"))).when(c.isin("-inf", "-infinity"), F.lit(float("-inf"))).otherwise(c.try_cast("double")), F.lit(unparsable).cast("double")).alias(n) for c, n in zip(low, names)]
    keyed = lines.select(F.struct("f", "s", "k").alias("at"), *values)
    return dense_index(keyed, "at", "id").select("id", F.array(*names).alias("x"))


def write_matrix(points: DataFrame, path: str, digits: int = 6) -> None:
    """Writes points' coordinates as one CSV file in the order of id, with ', ' between cells and so many significant digits."""
    cell = F.transform("x", lambda e: F.when(F.isnan(e), F.lit("nan")).when(e == float("inf"), F.lit("inf")).when(e == float("-inf"), F.lit("-inf")).when(e == 0, F.lit("0")).otherwise(F.format_string(f"%.{digits}g", e)))
    points.orderBy("id").select(F.array_join(cell, ", ").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database, if its driver is on the class path. Credentials come with options, never from here."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
