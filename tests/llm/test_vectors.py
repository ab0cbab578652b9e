import math

import numpy as np
import pytest

from dissimap.llm import clusters, neighbours


@pytest.fixture(scope="module")
def x():
    r = np.random.default_rng(7)
    c = r.uniform(size=(8, 4))
    a = np.concatenate([c[k % 8] + r.normal(size=(25, 4)) * 0.02 for k in range(8)] + [r.uniform(size=(30, 4))])
    a[5] = a[17]  # copies
    a[180:200] = a[40]
    return a


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    rows = [(int(i), [float(v) for v in row], "t", 1) for i, row in zip(ids, x)]
    return spark.createDataFrame(rows, "id bigint, x array<double>, block string, cell int").repartition(5)


def brute(x, k, reach=math.inf):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = {}
    for i in range(len(x)):
        near = sorted((d[i, j], j) for j in range(len(x)) if j != i)[:k]
        out[i] = [(j, v) for v, j in near if v <= reach]
    return {i: v for i, v in out.items() if v}


@pytest.mark.parametrize("k, reach, block", [(5, None, 1024), (5, None, 16), (3, 0.05, 16), (1, 0.1, 32), (40, None, 8)])
def test_neighbours_match_brute_force(spark, x, k, reach, block):
    got = {}
    for r in neighbours.nearest_vectors(table(spark, x), k, reach, block).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.neighbour_id, r.distance))
    want = brute(x, k, math.inf if reach is None else reach)
    assert got.keys() == want.keys()
    for i in want:
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]]
        assert np.allclose([v for _, v in got[i]], [v for _, v in want[i]])


def test_bad_rows_take_no_part(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 1.0]), (None, [0.0, 0.0]), (3, None), (4, []), (5, [math.nan, 0.0]), (6, [None, 0.0]), (7, [math.inf, 0.0]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id bigint, x array<double>")
    got = neighbours.nearest_vectors(df, 3).collect()
    assert sorted((r.id, r.neighbour_id, r.distance) for r in got) == [(1, 2, 1.0), (2, 1, 1.0)]
    assert neighbours.nearest_vectors(df.limit(0), 3).count() == 0
    assert neighbours.nearest_vectors(df.limit(1), 3).count() == 0
    with pytest.raises(ValueError):
        neighbours.nearest_vectors(spark.createDataFrame([(1, [0.0]), (2, [0.0, 1.0])], "id bigint, x array<double>"), 1)


def test_code_distances_bound_the_true_ones():
    r = np.random.default_rng(0)
    a, b = r.normal(size=(50, 16)), r.normal(size=(60, 16)) * 3
    d2, ca, cb = neighbours.tile(a, b)
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    code = np.sqrt(d2) * ca.step
    assert (np.abs(code - d) <= ca.rest[:, None] + cb.rest[None] + 1e-9).all()
    assert (d2 == np.rint(d2)).all()


def test_landmark_vectors(spark):
    marks = spark.createDataFrame([(10, 0), (20, 1)], "landmark_id bigint, ordinal int")
    rows = [(1, 10, 0.5, 1), (20, 1, 0.25, 2), (10, 1, 0.75, 3), (1, 10, 9.0, 4), (1, 10, None, 5), (2, 10, 0.1, 6), (10, 20, 0.3, 7), (1, 2, 0.4, 8), (3, 10, 0.0, 9), (3, 20, 2.0, 10)]
    rk = spark.createDataFrame(rows, "c0 bigint, c1 bigint, c2 double, line_no bigint")
    assert {r.id: r.x for r in neighbours.landmark_vectors(rk, marks).collect()} == {1: [0.75, 0.25], 3: [0.0, 2.0]}
    assert neighbours.landmark_vectors(rk, marks.limit(0)).count() == 0


def components(x, reach):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= reach
    part = np.arange(len(x))
    while True:
        new = np.array([part[d[i]].min() for i in range(len(x))])
        if (new == part).all():
            break
        part = new
    size = np.bincount(part, minlength=len(x))
    return {(int(part[i]), i) for i in range(len(x)) if size[part[i]] > 1}


@pytest.mark.parametrize("reach, block, held", [(0.05, 1024, 0), (0.12, 16, 10**6), (0.3, 8, 0), (1e-6, 16, 10**6)])
def test_clusters_are_the_chains_of_steps(spark, x, reach, block, held, monkeypatch):
    monkeypatch.setattr(clusters.cluster_graph, "__defaults__", (4, 5, held))
    got = clusters.similarity_clusters(table(spark, x), reach, steps=4, block=block).collect()
    assert {(r.cluster_id, r.point_id) for r in got} == components(x, reach) and len(got) == len({r.point_id for r in got})
    assert all(r.affinity > 0 for r in got)


def test_hashed_labels_are_not_the_clusters(spark, x, monkeypatch):
    monkeypatch.setattr(clusters, "_level", lambda a, b, w, alone, steps, rounds, r: r.integers(0, len(alone), len(alone)))
    got = clusters.similarity_clusters(table(spark, x), 0.05).collect()
    assert {(r.cluster_id, r.point_id) for r in got} != components(x, 0.05)


def test_affinity_is_that_to_all_members_however_the_vectors_are_cut(spark, x):
    reach = 0.2
    whole = {}
    for c, i in components(x, reach):
        whole.setdefault(c, []).append(i)
    square = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = {i: 1 / (1 + square[i, own].mean() / reach**2) for own in whole.values() for i in own}
    for block in (1024, 16):
        got = {r.point_id: r.affinity for r in clusters.similarity_clusters(table(spark, x), reach, block=block).collect()}
        assert got == pytest.approx(want)


def test_a_long_chain_is_one_cluster(spark):
    x = np.column_stack([np.arange(120) * 0.1, np.zeros(120)])
    x[60:] += 0.05
    got = clusters.similarity_clusters(table(spark, x), 0.12, steps=4, block=16).collect()
    assert {(r.cluster_id, r.point_id) for r in got} == components(x, 0.12)


def test_no_vectors_no_clusters_and_descriptions(spark, x):
    empty = spark.createDataFrame([], "id bigint, x array<double>")
    assert clusters.similarity_clusters(empty, 0.1).count() == 0
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.9), (1, 3, 0.9), (4, 4, 1.0), (4, 5, 2.0)], "cluster_id bigint, point_id bigint, affinity double")
    assert sorted(map(tuple, clusters.describe_clusters(df, 2).collect())) == [(1, 3, [2, 3]), (4, 2, [5, 4])]


def test_the_walk_is_the_same_over_a_part_and_differs_between_parts(spark):
    links = [(a, b, 1.0) for part in (range(0, 6), range(6, 12)) for a in part for b in part if a <= b] + [(20, 20, 3.0)]
    graph = spark.createDataFrame(links, "a bigint, b bigint, w double")
    y = {r.id: np.array(r.y) for r in clusters.power_embedding(graph, 3, 12).collect()}
    assert max(np.abs(y[i] - y[0]).max() for i in range(6)) < 1e-6 and np.abs(y[6] - y[0]).max() > 1e-3
    for held in (0, 10**6):
        label = {r.id: r.label for r in clusters.cluster_graph(graph, held=held).collect()}
        assert len({label[i] for i in range(6)}) == len({label[i] for i in range(6, 12)}) == 1 and len(set(label.values())) == 3 and len(label) == 13


def test_contracted_affinities_add_up(spark):
    graph = spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0), (1, 2, 0.5), (2, 3, 0.25), (1, 3, 0.25)], "a bigint, b bigint, w double")
    got = clusters.contract(graph, spark.createDataFrame([(1, 2), (2, 2), (3, 3)], "id bigint, label bigint"))
    assert sorted(map(tuple, got.collect())) == [(2, 2, 3.0), (2, 3, 0.5), (3, 3, 1.0)]


def test_many_sides_meet_where_they_are_near(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SIDE", 16)
    monkeypatch.setattr(neighbours, "LEAST_SIDES", 1)
    z = np.random.default_rng(9).uniform(size=(300, 3))
    for reach in (None, 0.1):
        got = {}
        for r in neighbours.nearest_vectors(table(spark, z), 4, reach, 8).orderBy("id", "rank").collect():
            got.setdefault(r.id, []).append(r.neighbour_id)
        assert got == {i: [j for j, _ in v] for i, v in brute(z, 4, math.inf if reach is None else reach).items()}
