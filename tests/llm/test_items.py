import itertools
import math
import random

import numpy as np
import pytest

from dissimap.llm import cooccurrence, percentiles, topn


def brute_pairs(rows, min_count, min_lift):
    by = {}
    for u, i in rows:
        if u is not None and i is not None:
            by.setdefault(i, set()).add(u)
    n = len(set().union(*by.values())) if by else 0
    out = {}
    for a, b in itertools.combinations(sorted(by), 2):
        k = len(by[a] & by[b])
        if k >= min_count and k * n / (len(by[a]) * len(by[b])) >= min_lift:
            out[a, b] = (k, len(by[a]), len(by[b]), n)
    return out


@pytest.fixture(scope="module")
def baskets():
    r = random.Random(3)
    rows = [(r.randrange(60), int(r.paretovariate(0.9)) % 40) for _ in range(900)]
    rows += [(1000 + k, i) for k in range(3) for i in range(40)]  # baskets that hold everything
    return rows + rows[:50] + [(None, 1), (5, None), (None, None)]


@pytest.mark.parametrize("min_count, min_lift, tile", [(1, 0.0, 512), (3, 1.2, 512), (5, 0.0, 7), (1, 0.0, 5), (2, 0.0, 4), (20, 1.05, 3)])
def test_pairs_match_brute_force_whatever_the_tiles(spark, baskets, min_count, min_lift, tile):
    df = spark.createDataFrame([(u, i, "x", 0) for u, i in baskets], "user_id bigint, item_id bigint, a string, n bigint")
    got = cooccurrence.items_together(df, "user_id", "item_id", min_count, min_lift, tile).collect()
    assert {(r.first_item_id, r.second_item_id): (r.n_both, r.n_first, r.n_second, r.n_baskets) for r in got} == brute_pairs(baskets, min_count, min_lift)
    assert len(got) == len({(r.first_item_id, r.second_item_id) for r in got})
    assert all(r.pmi == pytest.approx(math.log(r.lift)) for r in got)


def test_no_baskets(spark):
    df = spark.createDataFrame([], "user_id bigint, item_id bigint")
    assert cooccurrence.items_together(df, "user_id", "item_id", 1).count() == 0


@pytest.mark.parametrize("largest", [False, True])
@pytest.mark.parametrize("n", [1, 3, 50])
def test_top_n_matches_brute_force(spark, n, largest, monkeypatch):
    monkeypatch.setattr(topn, "GATHERED", 10)
    r = random.Random(n)
    rows = [(r.choice([1, 1, 1, 2, 3, None]), r.randrange(200) if r.random() < 0.95 else None, r.choice([0.5, 0.25, 1.0, r.random(), None, math.nan]), "q", 1) for _ in range(800)]
    df = spark.createDataFrame(rows, "g bigint, i bigint, s double, bound string, salt int").repartition(7)
    by = {}
    for g, i, s, *_ in rows:
        if None not in (g, i, s) and s == s:
            by.setdefault(g, []).append((-s if largest else s, i))
    want = sorted((g, i, -s if largest else s, k + 1) for g, v in by.items() for k, (s, i) in enumerate(sorted(v)[:n]))
    got = topn.top_n_per_group(df, "g", "i", "s", n, largest)
    assert got.columns == ["g", "i", "s", "rank"]
    assert sorted(map(tuple, got.collect())) == want
    assert topn.top_n_per_group(df.limit(0), "g", "i", "s", n).count() == 0


def test_summaries_keep_their_rank_error_and_merge(spark):
    r = np.random.default_rng(0)
    v = np.concatenate([r.normal(size=20_000), np.full(10_000, 0.5)])
    df = spark.createDataFrame([(1, int(k % 7), float(x)) for k, x in enumerate(v)] + [(2, 0, None), (2, 0, math.nan), (3, 0, 4.0), (None, 0, 1.0)], "item bigint, day int, v double")
    days = percentiles.summaries(df, ["item", "day"], "v", 200)
    s = percentiles.merge_summaries(days, ["item"])
    got = {q.item: q for q in percentiles.quantiles(s, {"p5": 0.05, "p50": 0.5, "p95": 0.95}).collect()}
    assert got.keys() == {1, 3, None} and got[1].n_values == 30_000 and got[3].p50 == 4.0
    e = 2 * percentiles.rank_error(200)
    for name, q in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95)):
        x = got[1][name]
        assert (v < x).mean() - e <= q <= (v <= x).mean() + e
    assert percentiles.summaries(df.limit(0), ["item"], "v").count() == 0


@pytest.mark.parametrize("most", [100_000, 5])
def test_exact_quantiles_in_brackets(spark, most):
    r = random.Random(1)
    rows = [(k, float(r.randrange(30))) for k in range(5) for _ in range(r.randrange(1, 90))] + [(9, 1.0), (9, None), (9, math.nan), (None, 2.0), (7, 1.0)]
    rows += [(11, r.random()) for _ in range(700)] + [(12, float(r.random() < 0.5)) for _ in range(500)]
    df = spark.createDataFrame(rows, "item bigint, v double").repartition(3)
    shares = {"m": 0.5, "p": 0.95}
    want, size = {}, {}
    for k in {k for k, _ in rows} - {None, 7}:
        v = sorted(x for i, x in rows if i == k and x is not None and x == x)
        size[k] = len(v)
        want[k] = tuple(next(x for n, x in enumerate(v, 1) if n * 100 >= len(v) * q) for q in (50, 95))
    schema = "item bigint, n_values bigint, m_low double, m_high double, p_low double, p_high double, wanted boolean"
    for low, high in ((-100.0, 100.0), (None, None), (-9.0, -8.0)):
        ends = lambda x: (x, x) if low is None else (low, high)  # noqa: B023, E731
        brackets = spark.createDataFrame([(k, size[k], *ends(m), *ends(p), True) for k, (m, p) in want.items()] + [(7, 1, 0.0, 0.0, 0.0, 0.0, False)], schema)
        got = percentiles.exact_quantiles(df, brackets, "item", "v", shares, most)
        assert {q.item: (q.m, q.p) for q in got.collect()} == want and {q.item: q.n_values for q in got.collect()} == size


def test_rank_errors(spark):
    df = spark.createDataFrame([(1, float(v)) for v in range(100)] + [(1, math.nan), (2, 5.0)], "item bigint, v double")
    q = spark.createDataFrame([(1, 100, 49.0, 79.0), (2, 1, 5.0, 5.0)], "item bigint, n_values bigint, m double, p double")
    got = {r.item: (r.n_values, r.m, r.p) for r in percentiles.rank_errors(df, q, "item", "v", {"m": 0.5, "p": 0.95}).collect()}
    assert got == {1: (100, 0.0, pytest.approx(0.15)), 2: (1, 0.0, 0.0)}
