"""Problem 5: a few keys holding most records."""

from __future__ import annotations

from pyspark.sql import functions as F

from dissimap.operators.skew import heavy_keys, keyed_moments
from dissimap.queries.rounding import near, near_sql
from dissimap.sources.tables import table

KEYS = ["item_id", "user_id"]


def p5_found(spark, d):
    return heavy_keys(table(spark, d, "rating"), KEYS, "item_value", 0.015, low=0, high=100).select("key_kind", "key_id")


def _moments(spark, d, **kw):
    out = keyed_moments(table(spark, d, "rating"), KEYS, "item_value", low=0, high=100, **kw)
    return out.select("key_kind", "key_id", "n_rows", "n_values", near(F.col("value_mean")).alias("value_mean"), near(F.col("value_variance")).alias("value_variance"))


def p5_key_moments(spark, d):
    return _moments(spark, d)


def p5_key_moments_tree(spark, d):
    """The same over a tree of fan-in 2, so that several rounds run."""
    return _moments(spark, d, fan_in=2)


QUERIES = {"p5_found": p5_found, "p5_key_moments": p5_key_moments, "p5_key_moments_tree": p5_key_moments_tree}

_LONG = "(SELECT 'item_id' AS key_kind, item_id AS key_id, item_value AS v FROM rating UNION ALL SELECT 'user_id', user_id, item_value FROM rating)"
_OK = "(v IS NOT NULL AND NOT isnan(v) AND v BETWEEN 0 AND 100)"

SQL = {
    "p5_found": f"SELECT key_kind, key_id FROM {_LONG} WHERE key_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 0.015 * (SELECT count(*) FROM rating)",
    "p5_key_moments": f"""SELECT key_kind, key_id, count(*) AS n_rows, count(*) FILTER ({_OK}) AS n_values,
        {near_sql(f"avg(v) FILTER ({_OK})")} AS value_mean, {near_sql(f"var_pop(v) FILTER ({_OK})")} AS value_variance FROM {_LONG} GROUP BY ALL""",
}
SQL["p5_key_moments_tree"] = SQL["p5_key_moments"]
