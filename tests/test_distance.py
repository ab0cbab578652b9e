import math

import numpy as np
import pytest

from dissimap.model import as_points, check_complete, dense_index
from dissimap.operators import distance, majorize, scoring


def points_of(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, x array<double>")


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(0).normal(size=(23, 3))


def as_matrix(rows, value, n):
    m = np.zeros((n, n))
    for r in rows:
        m[r.i, r.j] = m[r.j, r.i] = r[value]
    return m


@pytest.mark.parametrize("blocks", [1, 2, 5])
def test_distances_are_each_pair_once_in_any_blocks(spark, x, blocks):
    got = distance.euclidean_distance(points_of(spark, x), blocks).collect()
    assert len(got) == 23 * 22 // 2 and all(r.i > r.j for r in got)
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.allclose(as_matrix(got, "r", 23), want)


def test_no_and_one_point(spark):
    assert distance.euclidean_distance(points_of(spark, [])).count() == 0
    assert distance.euclidean_distance(points_of(spark, [[1.0]])).count() == 0


def test_points_leave_out_bad_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 1.0]), (2, None), (3, [math.nan, 1.0]), (4, [1.0]), (5, [None, 1.0])], "k bigint, v array<float>")
    assert [r.id for r in as_points(df, "k", "v", 2).collect()] == [1]


def test_triplets_last_one_holds(spark):
    rows = [(1, 2, 0.5, 1), (2, 1, 0.7, 2), (3, 3, 9.0, 3), (None, 1, 1.0, 4), (1, 4, None, 5), (1, 4, math.nan, 6), (4, 1, 0.1, 0)]
    got = distance.triplets_to_pairs(spark.createDataFrame(rows, "c0 bigint, c1 bigint, r double, n bigint"), "c0", "c1", "r", "n")
    assert sorted(map(tuple, got.collect())) == [(2, 1, 0.7), (4, 1, 0.1)]


def test_dense_index_is_the_rank(spark):
    ids = [5, -3, 10**12, 7, 0, 2]
    got = dense_index(spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(4), "id").collect()
    assert {r.id: r.idx for r in got} == {v: k for k, v in enumerate(sorted(ids))}


def test_incomplete_pairs_raise(spark):
    p = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0)], "i bigint, j bigint, r double")
    with pytest.raises(ValueError):
        check_complete(p)


def test_centred_rows_sum_to_zero(spark, x):
    p = distance.euclidean_distance(points_of(spark, x))
    got = scoring.double_center(p, 23, diagonal=True).collect()
    b = as_matrix(got, "b", 23)
    c = x - x.mean(0)
    assert np.allclose(b, c @ c.T) and np.allclose(b.sum(0), 0)


def test_stress_does_not_change_under_rotation_and_is_null_without_pairs(spark, x):
    p = distance.euclidean_distance(points_of(spark, x))
    y = x[:, :2]
    turn = np.array([[math.cos(1), -math.sin(1)], [math.sin(1), math.cos(1)]])
    for kind in scoring.KINDS:
        a, b = (scoring.stress(p, points_of(spark, z), kind).first()[0] for z in (y, y @ turn + 3))
        assert a == pytest.approx(b) and a > 0
    assert scoring.stress(p.limit(0), points_of(spark, y)).first()[0] is None
    with pytest.raises(ValueError):
        scoring.stress(p, points_of(spark, y), "other")


def test_guttman_rows_sum_to_zero_and_equal_points_count_nothing(spark):
    p = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0), (2, 1, 2.0)], "i bigint, j bigint, r double")
    q = points_of(spark, [[0.0, 0.0], [0.0, 0.0], [3.0, 4.0]])
    g = as_matrix(majorize.guttman_transform(p, q).collect(), "g", 3)
    assert np.allclose(g.sum(0), 0) and g[1, 0] == 1.0 and g[2, 0] == pytest.approx(1 - 1 / 5)


def test_majorization_lowers_stress_and_leaves_exact_layouts(spark, x):
    y = x[:, :2]
    p = distance.euclidean_distance(points_of(spark, y))
    moved = y + np.random.default_rng(1).normal(size=y.shape) * 0.2
    for step in (lambda z: majorize.smacof_step(p, z, 23, 2), lambda z: majorize.weighted_step(p, z, 2)):
        before, after = (scoring.stress(p, z, "raw").first()[0] for z in (points_of(spark, moved), step(points_of(spark, moved))))
        assert after < before
        assert scoring.stress(p, step(points_of(spark, y)), "raw").first()[0] < 1e-20
