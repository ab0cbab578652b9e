import numpy as np
import pytest

from dissimap.operators import align, force, graph, hybrid, local, majorize, scoring, spectral
from dissimap.operators.distance import euclidean_distance
from tests.test_distance import as_matrix, points_of


@pytest.fixture(scope="module")
def plane():
    return np.random.default_rng(3).uniform(size=(40, 2))


@pytest.fixture(scope="module")
def pairs(spark, plane):
    return euclidean_distance(points_of(spark, plane)).cache()


def gap(points, plane):
    rows = points.collect()
    x = np.zeros((len(plane), len(rows[0].x)))
    for r in rows:
        x[r.id] = r.x
    d = lambda z: np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    return np.abs(d(x) - d(plane)).max()


def test_exact_solvers_return_the_input_distances(spark, pairs, plane):
    assert gap(spectral.classical_scaling(pairs, 2), plane) < 1e-9
    assert gap(spectral.classical_scaling(pairs, 2, local=0), plane) < 1e-6
    assert gap(spectral.sparse_scaling(pairs, 5), plane) < 1e-9
    assert gap(majorize.smacof(pairs, 2), plane) < 1e-9
    assert gap(majorize.weighted_scaling(pairs, 2), plane) < 1e-9
    assert gap(align.block_scaling(pairs, 2, 3), plane) < 1e-9
    batches = spark.createDataFrame([(i, k) for k, (a, b) in enumerate([(0, 20), (12, 30), (22, 40)]) for i in range(a, b)], "id bigint, batch int")
    assert gap(align.incremental_scaling(pairs, batches, 2), plane) < 1e-9
    with pytest.raises(ValueError):
        align.incremental_scaling(pairs, batches.where("batch = 0 and id < 8 or batch = 2 and id > 30"), 2)


def test_eigenvalues_of_a_known_matrix():
    e = np.sort(np.linalg.eigvalsh(np.array([[2.0, 0, 0], [0, 3, 4], [0, 4, 9]])))[::-1]
    assert np.allclose(e, [11, 2, 1])
    assert spectral.kept(e, 3, 0.2) == 2 and spectral.kept(e, 1, 0.0) == 1 and spectral.kept(np.array([3.0, -1.0]), 2, 0.0) == 1


def test_scaling_rejects_bad_input(spark, pairs):
    with pytest.raises(ValueError):
        spectral.classical_scaling(pairs.limit(5), 2)
    bad = spark.createDataFrame([(1, 0, float("inf"))], "i bigint, j bigint, r double")
    with pytest.raises(ValueError):
        spectral.classical_scaling(bad, 2)
    assert spectral.classical_scaling(pairs.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        align.block_scaling(pairs, 3, 20)


def test_local_and_distributed_steps_are_the_same(spark, pairs):
    a = {r.id: r.x for r in force.force_layout(pairs, 2, 3).collect()}
    b = {r.id: r.x for r in force.force_layout(pairs, 2, 3, local=0).collect()}
    assert all(np.allclose(a[k], b[k]) for k in a) and len(a) == 40
    a = {r.id: r.x for r in hybrid.neighbour_layout(pairs, 2, iterations=3).collect()}
    b = {r.id: r.x for r in hybrid.neighbour_layout(pairs, 2, iterations=3, local=0).collect()}
    assert all(np.allclose(a[k], b[k]) for k in a) and len(a) == 40


def test_layouts_lower_stress(spark, pairs):
    def score(x):
        return scoring.stress(pairs, x).first()[0]

    assert score(force.force_layout(pairs, 2, 200, spring=0.2)) < 0.05
    assert score(force.force_layout(pairs, 2, 200, spring=0.2, sequential=True)) < 0.05
    assert score(hybrid.neighbour_layout(pairs, 2, iterations=60)) < 0.1
    assert score(hybrid.sampled_layout(pairs)) < 0.15
    assert score(hybrid.pivot_layout(pairs)) < 0.15


def test_layouts_run_as_many_rounds_as_points_by_default(spark, monkeypatch):
    from dissimap.queries import solvers

    many = euclidean_distance(points_of(spark, np.random.default_rng(5).uniform(size=(70, 2)))).cache()
    for method in (force.force_layout, hybrid.neighbour_layout):
        a, b = ({r.id: r.x for r in x.collect()} for x in (method(many), method(many, iterations=70)))
        assert all(np.allclose(a[k], b[k], atol=1e-12) for k in a) and len(a) == 70
    points, asked = points_of(spark, np.zeros((1, 2))), []
    monkeypatch.setattr(solvers, "plane_pairs", lambda spark, d: many)
    monkeypatch.setattr(solvers.layouts, "lay_out", lambda *a, **options: asked.append(options) or solvers.layouts.Layout(points, {"normalised": 0.0}))
    for name in ("fdmds", "cha96mds", "sqmds", "sqpmds"):
        solvers.QUERIES[name](spark, "")
    assert asked == [{}] * 4


def test_records_of_solvers(spark, pairs):
    got = [r.energy for r in force.force_energies(pairs, iterations=3).orderBy("iteration").collect()]
    ids = pairs.selectExpr("explode(array(i, j)) AS id").distinct()
    s = force.random_points(ids, 3).selectExpr("id", "x", "transform(x, e -> 0d) AS v")
    for k, e in enumerate(got, 1):
        s = force.force_step(pairs, s, 3, pull=0.5 * k / 3).cache()
        assert force.kinetic_energy(s).first().energy == pytest.approx(e)
    record = []
    start = force.random_points(ids, 2)
    majorize.smacof(pairs, 2, init=start, max_iterations=4, stress_tolerance=0.0, record=record)
    assert [k for k, _ in record] == list(range(5)) and all(b < a for (_, a), (_, b) in zip(record, record[1:]))


def test_layout_limits(spark, pairs):
    with pytest.raises(ValueError):
        hybrid.sampled_layout(pairs, 3)
    with pytest.raises(ValueError):
        hybrid.neighbour_layout(pairs.where("i < 6 and j < 6"), 2)
    with pytest.raises(ValueError):
        force.force_layout(pairs, 2, 1, local=10, sequential=True)


def test_hash_is_the_same_in_array_and_column_form(spark):
    from dissimap.functions.vectors import mixed

    ids = [0, 1, 2, 10**12, 77]
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    assert [r[0] for r in df.select(mixed("id", "id", seed=9)).collect()] == list(local.mixed(np.array(ids), np.array(ids), seed=9))


def test_hashes_mix():
    u = local.uniform(np.arange(2000), 3, 1)
    assert np.abs(np.corrcoef(u.T) - np.eye(3)).max() < 0.1
    assert np.linalg.matrix_rank(u - 0.5) == 3
    met = [set() for _ in range(500)]
    for k in range(20):
        got = local.drawn(np.arange(500), 500, 10, 1009 + k)
        assert all(len(set(row)) == 10 and i not in row for i, row in enumerate(got))
        for i, row in enumerate(got):
            met[i] |= set(row.tolist())
    assert min(map(len, met)) >= 150
    assert sorted(local.drawn(np.arange(4), 4, 9, 1)[0]) == [1, 2, 3]


def brute_paths(edges, n):
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for s, t, w in edges:
        d[s, t] = min(d[s, t], w)
    for k in range(n):
        d = np.minimum(d, d[:, [k]] + d[[k]])
    return d


def test_geodesics_match_all_pairs_by_brute_force_held_or_joined(spark, pairs):
    for k in (2, 4):
        e = graph.knn_undirected(pairs, k).cache()
        want = brute_paths([tuple(r) for r in e.collect()], 40)
        for held in (10**6, 0):
            got = np.full((40, 40), -1.0)
            for r in graph.geodesics(e, held).collect():
                got[r.src, r.dst] = r.distance
            assert np.allclose(np.where(np.isinf(got), 99, got), np.where(np.isinf(want), 99, want))


def test_nearest_of_tiles_are_those_of_pairs(spark, plane, pairs):
    at = np.concatenate([plane, plane[:5]])  # with copies
    p = points_of(spark, at)
    want = {tuple(r) for r in graph.knn_edges(euclidean_distance(p), 4).collect()}
    for rows in (1000, 7):
        assert {tuple(r) for r in graph.knn_points(p, 4, rows).collect()} == want
    assert graph.knn_points(p.limit(0), 4).count() == 0 and graph.knn_points(p.limit(1), 4).count() == 0


def test_knn_ties_go_to_the_smaller_id(spark):
    p = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0), (3, 0, 1.0), (2, 1, 5.0), (3, 1, 5.0), (3, 2, 5.0)], "i bigint, j bigint, r double")
    assert {(r.src, r.dst) for r in graph.knn_edges(p, 1).collect()} == {(0, 1), (1, 0), (2, 0), (3, 0)}


def test_isomap_of_all_neighbours_is_the_distances_and_robust_isomap_prunes(spark, pairs, plane):
    assert np.allclose(as_matrix(graph.isomap(pairs, 39).collect(), "r", 40), as_matrix(pairs.collect(), "r", 40))
    s = graph.robust_isomap(pairs, 6, 2.0, 0.3).collect()
    assert len(s) == 780
    # A path of squared steps may undercut the straight one, but never by more than its number of steps allows.
    assert all(r.r > 0 for r in s)
    fewer = graph.robust_isomap(pairs, 6, 2.0, 1e-12).collect()
    assert sum(r.r for r in fewer if r.r < 1e9) > 0


def test_flow_counts_every_reachable_pair_once(spark, pairs):
    e = graph.knn_directed(pairs, 5).cache()
    flow = graph.edge_flow(e).agg({"flow": "sum"}).first()[0]
    d = brute_paths([(r.src, r.dst, r.weight) for r in e.collect()], 40)
    assert flow == np.isfinite(d).sum() - 40
    assert graph.critical_flow(spark, 2.0, 3.0, 0.05) == pytest.approx(14.23, abs=0.01)
    assert graph.critical_flow(spark, 2.0, 3.0, 0.05, "reference") == pytest.approx(14.23 / 9, abs=0.01)


def test_largest_component(spark):
    inf = float("inf")
    p = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0), (2, 1, 1.0), (3, 0, inf), (3, 1, inf), (3, 2, inf)], "i bigint, j bigint, r double")
    assert sorted((r.i, r.j) for r in graph.largest_component(p).collect()) == [(1, 0), (2, 0), (2, 1)]


def test_plans(spark, pairs, plane):
    from dissimap.plans import layouts

    a = layouts.lay_out(pairs, "blocks", 2, subdivisions=2)
    assert gap(a.points, plane) < 1e-9 and all(s < 1e-9 for s in a.stress.values()) and a.flat().count() == 40
    assert gap(layouts.unroll(pairs, 39).points, plane) < 1e-9
    with pytest.raises(ValueError):
        layouts.lay_out(pairs, "other")
    far = euclidean_distance(points_of(spark, np.concatenate([plane[:12], plane[:8] + 50])))
    with pytest.raises(ValueError):
        layouts.unroll(far, 3)
    assert layouts.unroll(far, 3, component="largest").points.count() <= 12


def test_affine_map_is_fitted_to_all_common_points(spark):
    x = np.random.default_rng(2).normal(size=(110_000, 2))
    y = x @ np.array([[2.0, 1.0], [0.0, 3.0]]) + np.abs(x[:, ::-1]) ** 3
    got = align.affine_between(points_of(spark, x), points_of(spark, y))
    assert np.allclose(got, align.affine_fit(x, y), atol=1e-9)
