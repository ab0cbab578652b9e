import math
import random

import pytest

from dissimap.operators.skew import heavy_keys, join_hot, keyed_moments

SCHEMA = "item_id bigint, user_id bigint, v double, key_kind string, c int"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    out = [(7 if r.random() < 0.35 else r.randrange(40), r.randrange(5) or None, 1e6 + r.random(), "x", 1) for _ in range(3000)]
    return out + [(1, 1, None, None, None), (None, 2, math.nan, "", 2), (3, 3, -5.0, "y", 3), (99, 9, None, "z", 4)]


def brute(rows, k, low):
    by = {}
    for row in rows:
        by.setdefault(row[k], []).append(row[2])
    out = {}
    for key, vs in by.items():
        ok = [v for v in vs if v is not None and not math.isnan(v) and v >= low]
        m = sum(ok) / len(ok) if ok else None
        out[key] = (len(vs), len(ok), m, sum((v - m) ** 2 for v in ok) / len(ok) if ok else None)
    return out


@pytest.mark.parametrize("fan_in, parts", [(2, 17), (32, 5), (2, 1)])
def test_moments_match_brute_force_at_any_fan_in(spark, rows, fan_in, parts):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = keyed_moments(df, ["item_id", "user_id"], "v", low=0, fan_in=fan_in).collect()
    for k, kind in enumerate(["item_id", "user_id"]):
        want = brute(rows, k, 0)
        mine = {r.key_id: r for r in got if r.key_kind == kind}
        assert mine.keys() == want.keys()
        for key, (n, m, mean, var) in want.items():
            r = mine[key]
            assert (r.n_rows, r.n_values) == (n, m)
            assert r.value_mean == (None if mean is None else pytest.approx(mean, rel=1e-12))
            assert r.value_variance == (None if var is None else pytest.approx(var, rel=1e-6, abs=1e-9))


def test_heavy_keys_count_rows_as_they_are(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.key_kind, r.key_id) for r in heavy_keys(df, ["item_id", "user_id"], "v", 0.1).collect()}
    n = len(rows)
    want = {(kind, key) for k, kind in enumerate(["item_id", "user_id"]) for key in {r[k] for r in rows} - {None} if sum(r[k] == key for r in rows) >= 0.1 * n}
    assert got == want


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert keyed_moments(df, ["item_id"], "v").count() == 0
    assert heavy_keys(df, ["item_id"], "v").count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("most", [1, 4, 1000])
def test_hot_keys_join_as_others(spark, how, most):
    r = random.Random(4)
    rows = [(r.choice([1, 1, 1, 2, 3, 4, 5, None]), k) for k in range(300)]
    left = spark.createDataFrame(rows, "k bigint, row bigint").repartition(5)
    per = [(k, sum(a == k for a, _ in rows), f"v{k}") for k in (1, 2, 3, 9)]
    right = spark.createDataFrame(per, "k bigint, n bigint, v string")
    got = join_hot(left, right, "k", "n", how, most)
    want = left.join(right, "k", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
