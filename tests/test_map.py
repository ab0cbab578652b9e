import itertools
import math
import threading
import time

import numpy as np
import pyarrow as pa
import pytest

from dissimap.operators import layout, rated_pairs, ratings, som, views
from dissimap.sources.matrix_csv import read_matrix, write_matrix
from dissimap.streaming.ratings import AdjustmentQueue, RatingMap
from tests.test_distance import points_of

ITEM = "id bigint, x double, y double, sample_count bigint, value_mean double, value_variance double, distance_mean double"


@pytest.fixture(scope="module")
def rated():
    r = np.random.default_rng(5)
    return [(int(u), int(i), float(v)) for u, i, v in zip(r.integers(0, 6, 80), r.integers(0, 5, 80), r.integers(0, 20, 80))]


def truth(rows):
    out = {}
    for (u, i, a), (w, j, b) in itertools.product(rows, rows):
        if u == w and i < j:
            out.setdefault((i, j), []).append((a, b))
    return {k: (len(v), *[f(np.array(v)) for f in (lambda z: abs(z[:, 0] - z[:, 1]).mean(), lambda z: abs(z[:, 0] - z[:, 1]).var(), lambda z: z[:, 0].mean(), lambda z: z[:, 1].mean(), lambda z: z[:, 0].var(), lambda z: z[:, 1].var(), lambda z: ((z[:, 0] - z[:, 0].mean()) * (z[:, 1] - z[:, 1].mean())).mean())]) for k, v in out.items()}


def same(rows, want):
    assert {(r.first_item_id, r.second_item_id) for r in rows} == want.keys()
    for r in rows:
        assert np.allclose(tuple(r)[2:], want[r.first_item_id, r.second_item_id], atol=1e-9)


@pytest.mark.parametrize("tile", [2048, 3])
def test_relation_statistics_match_brute_force_in_any_tiles(spark, rated, tile):
    same(ratings.relation_statistics(spark.createDataFrame(rated, "user_id bigint, item_id bigint, value double"), tile).collect(), truth(rated))


def test_usable_ratings(spark):
    rows = [(1, 1, 5.0, "x"), (None, 1, 5.0, "x"), (1, None, 5.0, "x"), (1, 1, None, "x"), (1, 1, math.nan, "x"), (1, 1, -1.0, "x"), (1, 1, 101.0, None)]
    assert ratings.usable_ratings(spark.createDataFrame(rows, "user_id bigint, item_id bigint, item_value double, value string")).count() == 1


def test_validation_reports_missing_and_off_rows(spark):
    t = spark.createDataFrame([(1, 2, 10.0, 0.0), (2, 3, 5.0, 1.0), (3, 1, 0.0, 0.0)], "item_id bigint, sample_count bigint, value_mean double, value_variance double")
    s = spark.createDataFrame([(1, 0.0, 0.0, 2, 10.005, 0.0, None), (2, 0.0, 0.0, 3, 5.0, 1.1, None)], ITEM)
    assert sorted(r.item_id for r in ratings.validate_items(s, t).collect()) == [2, 3]


def test_stream_equals_batch_statistics_over_several_batches(spark, rated, tmp_path):
    m = RatingMap(spark, f"file://{tmp_path}/map", file_rows=20)
    assert m.queue_depth() == 0 and m.process_rating_queue() == 0
    schema = "user_id bigint, item_id bigint, value double"
    m.queue_ratings(spark.createDataFrame(rated[:45] + [(None, 1, 2.0), (1, 1, math.nan)] + rated[45:], schema).coalesce(1))
    assert m.queue_depth() == 82
    assert m.process_rating_queue(batch_size=30, recursive=False) == 62  # a file of 20
    assert m.process_rating_queue(batch_size=40, validate=True) == 0
    same(m.relations().collect(), truth(rated))
    m.queue_ratings(spark.createDataFrame(rated[:5], schema).coalesce(1))
    assert m.process_rating_queue(recursive=False, validate=True) == 0
    same(m.relations().collect(), truth(rated + rated[:5]))
    assert {r.item_id: r.sample_count for r in m.items().collect()} == {i: sum(x[1] == i for x in rated + rated[:5]) for i in {x[1] for x in rated}}
    few = RatingMap(spark, f"file://{tmp_path}/few", relations=False)
    few.queue_ratings(spark.createDataFrame(rated, schema))
    assert few.process_rating_queue(validate=True) == 0 and few.items().count() == len({x[1] for x in rated})


def test_model_distance(spark, rated):
    s = ratings.relation_statistics(spark.createDataFrame(rated, "user_id bigint, item_id bigint, value double"))
    assert all(0 <= r.distance <= 2 for r in ratings.model_distance(s, "correlation").collect())
    with pytest.raises(ValueError):
        ratings.model_distance(s, "other")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, 0.0, 0.0, 1, 1.0, 0.0, 1.0), (2, 3.0, 4.0, 1, 1.0, 0.0, None), (3, 3.0, 4.0, 1, 1.0, 0.0, 2.0), (4, None, 1.0, 1, 1.0, 0.0, 1.0), (5, math.nan, 1.0, 1, 1.0, 0.0, math.nan), (6, 1.0, 1.0, 1, 1.0, 0.0, 1.0)]
    return spark.createDataFrame(rows, ITEM)


def test_views(spark, items):
    detail = spark.createDataFrame([(1, "a", 5.0), (2, None, 5.0), (9, "z", 5.0)], "id bigint, title string, x double")
    assert sorted((r.id, r.title) for r in views.get_items(items, detail).collect()) == [(1, "a"), (2, None)]
    assert [r.id for r in views.get_items_box(items, detail, 0, 0, 1, 1).collect()] == [1]
    assert views.dense_locations(items).count() == 7 and views.dense_locations(items.limit(0)).count() == 0


def test_hull_matches_half_planes(spark):
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(300, 2)), 2)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(900, None, 1.0)], "id bigint, x double, y double").repartition(40)
    hull = views.convex_hull(df, fan_in=3).orderBy("cyclic_order").collect()
    h = np.array([(p.x, p.y) for p in hull])
    for a, b in zip(h, np.roll(h, -1, 0)):
        cross = (b[0] - a[0]) * (x[:, 1] - a[1]) - (b[1] - a[1]) * (x[:, 0] - a[0])
        assert (cross >= -1e-12).all()
    line = spark.createDataFrame([(i, float(i), float(i)) for i in range(5)], "id bigint, x double, y double")
    assert [p.point_id for p in views.convex_hull(line).orderBy("cyclic_order").collect()] == [0, 4]
    assert views.convex_hull(df.limit(0)).count() == 0
    assert [p.point_id for p in views.get_hull(views.convex_hull(line).select("point_id", "cyclic_order"), line).collect()] == [0, 4]


def test_corners_of_many_points():
    r = np.random.default_rng(8)
    for x in (r.normal(size=(500, 2)), np.round(r.normal(size=(500, 2)), 1), np.column_stack([np.arange(100.0), np.zeros(100)]), r.integers(0, 4, (200, 2)).astype(float)):
        h = x[views.chain(np.arange(len(x)), x[:, 0], x[:, 1])]
        assert len(h) == len(np.unique(h, axis=0)) and (len(h) > 2 or len(np.unique(x[:, 1])) == 1)
        for a, b in zip(h, np.roll(h, -1, 0)):
            side = (b[0] - a[0]) * (x[:, 1] - a[1]) - (b[1] - a[1]) * (x[:, 0] - a[0])
            assert (side >= -1e-12).all()
        assert set(map(tuple, h)) >= {tuple(x[np.lexsort((x[:, 1], x[:, 0]))[k]]) for k in (0, -1)}


def test_boxes_of_any_size_find_their_nearest(spark):
    r = np.random.default_rng(6)
    x = r.uniform(-5, 5, size=(80, 2))
    half = 10 ** r.uniform(-3, 3, size=80)
    half[:4] = [1.0, 2.0, 0.0, math.inf]
    items = spark.createDataFrame([(i, float(a), float(b), 1, 1.0, 0.0, 1.0) for i, (a, b) in enumerate(x)] + [(900, None, 1.0, 1, 1.0, 0.0, 1.0)], ITEM)
    boxes = spark.createDataFrame([(i, float(x[i, 0]), float(x[i, 1]), float(half[i])) for i in range(80)], "id bigint, x double, y double, half double")
    want = set()
    for i in range(80):
        if 0 < half[i] < math.inf:
            inside = [j for j in range(80) if j != i and (np.abs(x[j] - x[i]) <= half[i]).all()]
            want |= {(i, j) for j in sorted(inside, key=lambda j: (((x[j] - x[i]) ** 2).sum(), j))[:5]}
    assert {(r.id, r.other) for r in layout.box_neighbours(boxes, items, 5).collect()} == want
    assert layout.box_neighbours(boxes.limit(0), items, 5).count() == 0


def test_mean_distances_of_items(spark):
    rel = spark.createDataFrame([(1, 2, 4.0), (1, 3, 2.0), (2, 3, None), (3, 4, math.nan)], "a bigint, b bigint, distance double")
    got = {r.item_id: (r.relation_count, r.distance_mean) for r in ratings.item_distances(rel).collect()}
    assert got == {1: (2, 3.0), 2: (1, 4.0), 3: (1, 2.0)}


RELATION = "a bigint, b bigint, distance_mean double, sample_count bigint"


def test_comparison_set_and_steps(spark, items):
    rel = spark.createDataFrame([(1, 2, 5.0, 1), (1, 6, 0.5, 1), (2, 4, 1.0, 1)], RELATION)
    got = {(r.id, r.other) for r in layout.comparison_set(items, rel).collect()}
    assert {(1, 2), (2, 1), (1, 6), (6, 1)} <= got and not any(4 in p for p in got)
    moved = {r.id: (r.x, r.y) for r in layout.adjust_step(items, layout.comparison_set(items, rel)).collect()}
    assert moved.keys() == {1, 2, 6} and all(math.isfinite(c) for p in moved.values() for c in p)
    first = layout.locate_unplaced(items.where("id > 3 and id < 6"), rel).collect()
    assert [(r.id, r.x, r.y) for r in first] == [(4, 0.0, 0.0)]
    placed = {r.id: math.hypot(r.x - 3, r.y - 4) for r in layout.locate_unplaced(items, rel).collect()}
    assert placed == {4: pytest.approx(1.0)}


def test_adjustment_queue(spark, items, tmp_path):
    q = AdjustmentQueue(spark, f"file://{tmp_path}/q")
    q.queue_adjustments([])
    q.queue_adjustments([1, 1, 6])
    q.process_adjustment_queue(items, spark.createDataFrame([(1, 6, 0.5, 1)], RELATION), f"file://{tmp_path}/moved")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/moved").collect()) == [1, 6]
    first = {r.id: r for r in q.moved(f"file://{tmp_path}/moved").collect()}
    q.queue_adjustments(spark.createDataFrame([(6,)], "id bigint"))
    q.process_adjustment_queue(items, spark.createDataFrame([(1, 6, 0.5, 1)], RELATION), f"file://{tmp_path}/moved", batch_size=1)
    second = {r.id: r for r in q.moved(f"file://{tmp_path}/moved").collect()}
    assert second[1] == first[1]
    # From where the first batch left both, with half of the velocity.
    at = items.where("id = 1 or id = 6").drop("x", "y").join(spark.createDataFrame(list(first.values())).select("id", "x", "y"), "id")
    step = {r.id: r for r in layout.adjust_step(at, layout.comparison_set(at, spark.createDataFrame([(1, 6, 0.5, 1)], RELATION))).collect()}
    assert second[6].x == pytest.approx(step[6].x + first[6].vx / 2) and second[6].vx == pytest.approx(step[6].x - first[6].x + first[6].vx / 2)


def test_matrix_csv_round_trip_and_odd_cells(spark, tmp_path):
    x = [[1 / 3, -2e-7], [1e9, 0.0], [math.inf, 5.0]]
    write_matrix(points_of(spark, x), f"{tmp_path}/m")
    got = {r.id: r.x for r in read_matrix(spark, f"{tmp_path}/m", 2).collect()}
    assert np.allclose([got[k] for k in range(3)], x, rtol=1e-5)
    (tmp_path / "odd.csv").write_text("1, nan\n\n x,2\n3\n")
    rows = [r.x for r in read_matrix(spark, f"{tmp_path}/odd.csv", 2).orderBy("id").collect()]
    assert rows[0][0] == 1 and math.isnan(rows[0][1]) and rows[1] == [None, 2.0] and rows[2] == [3.0, None]
    assert [r.x for r in read_matrix(spark, f"{tmp_path}/odd.csv", 2, 0.0).orderBy("id").collect()][1:] == [[0.0, 2.0], [3.0, 0.0]]


def test_map_stages_match_brute_force(spark):
    r = np.random.default_rng(4)
    x, w = r.normal(size=(9, 3)) * (r.random((9, 3)) < 0.6), r.normal(size=(5, 3)) * (r.random((5, 3)) < 0.7)
    long = lambda m, k: spark.createDataFrame([(i, p, float(m[i, p])) for i in range(len(m)) for p in range(3) if m[i, p]] + ([(0, 0, 0.0)] if not m[0].any() else []), f"{k} bigint, prop int, value double")
    items, weights = long(x, "item"), long(w, "vertex")
    want = (x**2).sum(1)[:, None] - 2 * x @ w.T
    for q in som.sparse_distances(items, weights).collect():
        assert q.distance == pytest.approx(want[q.item, q.vertex])
    won = som.winners(items, weights, True)
    full = want + (w**2).sum(1)[None]
    for q in won.collect():
        assert q.distance == pytest.approx(full[q.item].min())
    faces = spark.createDataFrame([(0, 1, 2), (1, 2, 3), (2, 3, 4)], "a bigint, b bigint, c bigint")
    hop = {(q.vertex, q.other): q.hop for q in som.hops(faces, 3).collect()}
    assert hop[0, 0] == 0 and hop[0, 2] == 1 and hop[0, 3] == 2 and hop[0, 4] == 2 and len(hop) == 25
    near = som.neighbourhood(som.hops(faces, 3), 1.5)
    place = {q.item: q.vertex for q in won.collect()}
    for q in som.affection(items, won, near).collect():
        k = {i: math.exp(-(hop[place[i], q.vertex] ** 2) / 2.25) for i in place}
        assert q.value == pytest.approx(sum(k[i] * x[i, q.prop] for i in k) / sum(k.values()))
    assert som.train(items, weights, faces, 2, 2.0).count() > 0


def test_stored_relations_in_either_order_are_validated_by_their_latest_row(spark, tmp_path):
    from dissimap.queries import map_statistics

    spark.createDataFrame([(u, i, float(v)) for u, i, v in [(1, 1, 10), (1, 2, 30), (2, 1, 20), (2, 2, 30)]], "user_id bigint, item_id bigint, item_value double").write.parquet(str(tmp_path / "rating.parquet"))
    right = [15.0, 25.0, 30.0, 15.0, 0.0, 25.0, 0.0]  # |a - b|, its variance, means and variances of items 2 and 1, covariance
    rows = [(2, 1, 15.0, 2, *right, "2024-02-01"), (1, 2, 15.0, 9, *[99.0] * 7, "2024-01-01")]
    names = [*ratings.RELATION]
    kind = "first_item_id bigint, second_item_id bigint, distance_mean double, sample_count bigint, " + ", ".join(f"{c} double" for c in names[1:]) + ", updated_at string"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "relation.parquet"))
    assert map_statistics.relation_validation(spark, str(tmp_path)).count() == 0


@pytest.fixture(scope="module")
def eager():
    """Two users of many ratings, and others of few."""
    r = np.random.default_rng(7)
    u = np.r_[np.zeros(1100), np.ones(700), r.integers(2, 9, 60)]
    return [(int(u), int(i), float(v)) for u, i, v in zip(r.permutation(u), r.integers(0, 6, len(u)), np.round(r.uniform(0, 100, len(u)), 3))]


@pytest.mark.parametrize("tile, most", [(1 << 18, 2000), (600, 200_000), (40, 200_000)])
def test_relation_statistics_of_users_of_many_ratings(spark, eager, tile, most):
    df = spark.createDataFrame(eager, "user_id bigint, item_id bigint, value double")
    same(ratings.relation_statistics(df, tile).collect(), truth(eager))
    entries = ratings.pair_pieces(df, tile)[0].agg({"n": "sum"}).first()[0]
    assert entries < most  # of 850 000 pairs of ratings


def test_stream_of_users_of_many_ratings(spark, eager, tmp_path):
    m = RatingMap(spark, f"file://{tmp_path}/map", file_rows=700)
    m.queue_ratings(spark.createDataFrame(eager, "user_id bigint, item_id bigint, value double").coalesce(1))
    assert m.process_rating_queue(batch_size=700, validate=True) == 0
    same(m.relations().collect(), truth(eager))
    # What a batch adds is kept, not all relations again.
    assert spark.read.parquet(f"{tmp_path}/map/relations").agg({"n": "sum"}).first()[0] < 200_000


@pytest.fixture(scope="module")
def busy(spark, tmp_path_factory):
    """A folder of 400 000 ratings of 7 items by one user, and of a relation of items 1 and 0 that is right but for its places being changed; what holds for each pair."""
    d = tmp_path_factory.mktemp("busy")
    spark.range(400_000).selectExpr("1L as user_id", "id % 7 as item_id", "cast((id * 37 + id % 7 * (id % 5)) % 101 as double) as item_value").write.parquet(f"{d}/rating.parquet")
    k = np.arange(400_000)
    count = np.zeros((7, 101))
    np.add.at(count, (k % 7, (k * 37 + k % 7 * (k % 5)) % 101), 1)
    v = np.arange(101.0)
    want = {}
    for i, j in itertools.combinations(range(7), 2):
        p, q = count[i] / count[i].sum(), count[j] / count[j].sum()
        gap = np.abs(v[:, None] - v)
        mean, var = lambda w: (w * v).sum(), lambda w: (w * v * v).sum() - (w * v).sum() ** 2
        d1 = (np.outer(p, q) * gap).sum()
        want[i, j] = (count[i].sum() * count[j].sum(), d1, (np.outer(p, q) * gap**2).sum() - d1**2, mean(p), mean(q), var(p), var(q), 0.0)
    n, d1, d2, a, b, aa, bb = (float(x) for x in want[0, 1][:7])
    kind = "first_item_id bigint, second_item_id bigint, distance_mean double, sample_count bigint, " + ", ".join(f"{c} double" for c in ratings.RELATION[1:]) + ", updated_at string"
    rows = [(1, 0, 1.0, int(n), d1, d2, b, a, bb, aa, 0.0, "2024-02-01"), (0, 2, 1.0, int(n), *[9.0] * 7, "2024-02-01")]
    spark.createDataFrame(rows, kind).write.parquet(f"{d}/relation.parquet")
    return str(d), want


def within(spark, seconds, run):
    """run() if it ends in time."""
    t = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    t.start()
    try:
        return run()
    finally:
        t.cancel()


@pytest.mark.parametrize("name", ["relation_stats", "process_ratings_relations", "distance_model_correlation", "relation_validation"])
def test_a_user_of_very_many_ratings(spark, busy, name):
    from dissimap.queries import map_statistics

    d, want = busy
    rows = within(spark, 180, lambda: map_statistics.QUERIES[name](spark, d).collect())
    if name == "relation_validation":
        # No covariance is 0 to the last bit, so the right relation may be reported by its covariance alone.
        assert {tuple(r) for r in rows} | {(0, 1)} == want.keys()
    elif name == "distance_model_correlation":
        assert {(r.first_item_id, r.second_item_id) for r in rows} == want.keys() and all(r.distance == pytest.approx(1, abs=1e-6) for r in rows)
    else:
        assert {(r.first_item_id, r.second_item_id) for r in rows} == want.keys()
        for r in rows:
            assert np.allclose(tuple(r)[2:], want[r.first_item_id, r.second_item_id], rtol=1e-7, atol=1e-5)


@pytest.mark.parametrize("model", ["abs_difference", "correlation"])
@pytest.mark.parametrize("tile", [1 << 18, 600, 40])
def test_distances_are_those_of_all_statistics(spark, eager, model, tile):
    rows = eager + [(20, 7, 5.0), (20, 8, 5.0), (20, 9, 6.0), (21, 7, 5.0), (21, 9, 9.0)]  # 7 and 8 do not vary
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, value double")
    got = {tuple(r)[:2]: r.distance for r in ratings.relation_distances(df, model, tile).collect()}
    want = {tuple(r)[:2]: r.distance for r in ratings.model_distance(ratings.relation_statistics(df, tile), model).collect()}
    assert got == pytest.approx(want, abs=1e-9) and got.keys() == truth(rows).keys() and (got[7, 8] is None) == (model == "correlation")
    with pytest.raises(ValueError, match="model"):
        ratings.relation_distances(df, "other")


def test_little_variance_has_no_correlation(spark):
    df = spark.createDataFrame([(u, i, v) for u, v in ((1, 3.0), (2, 3.001)) for i in (1, 2)], "user_id bigint, item_id bigint, value double")
    distance = lambda least: ratings.relation_distances(df, "correlation", least_variance=least).collect()[0].distance
    assert distance(1e-6) is None and distance(0.0) == pytest.approx(0, abs=1e-3)


def test_correlations_of_a_user_of_many_ratings_take_no_work_of_ratings_by_items():
    n = 260_000
    zero, v = np.zeros(n, np.int32), np.random.default_rng(1).integers(0, 10_000, n) / 100
    group = pa.RecordBatch.from_pydict({"u": zero, "x": zero, "y": zero, "own_side": np.ones(n, bool), "r": zero, "i": np.arange(n) % 400, "v": v})
    took, got = {}, {}
    for name, wanted in {"correlation": rated_pairs.MODEL_SUMS["correlation"], "all": rated_pairs.SUMS}.items():
        began = time.process_time()
        made = pa.Table.from_batches(rated_pairs.spread(1, 50.0, False, wanted)(iter([group])))
        took[name] = time.process_time() - began
        c = [np.concatenate(x) for x in zip(*(rated_pairs.unpack(raw.as_py(), data.as_py()) for raw, data in zip(made["raw"], made["data"])))]
        o = np.lexsort(c[1::-1])
        got[name] = dict(zip(("i", "j", *wanted), [x[o] for x in c]))
    assert took["correlation"] < took["all"] / 5
    assert len(got["all"]["i"]) == 400 * 399 // 2 and all(np.allclose(x, got["all"][k], rtol=1e-12, atol=1e-6) for k, x in got["correlation"].items())


def test_rounding_is_that_of_near(spark):
    from dissimap.queries.rounding import near, near_binary

    df = spark.range(1000).selectExpr("case when id > 0 then (id - 500) / 7.0D end as v").selectExpr("v", "v * 1e-4 as w")
    for c in ("v", "w"):
        assert df.where(~near(df[c]).eqNullSafe(near_binary(df[c]))).count() == 0


def test_stored_relations_go_to_their_pairs(spark):
    """relation_faults() is validate_relations() against all statistics, hot items or not."""
    r = np.random.default_rng(3)
    rows = [(int(u), int(i), float(v)) for u, i, v in zip(r.integers(0, 40, 400), np.minimum(r.geometric(0.2, 400), 12), r.integers(0, 5, 400))]
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, value double")
    rel = ratings.relation_statistics(df).collect()
    stored = [tuple(x) if k % 3 else (*tuple(x)[:2], None if k % 2 else x.sample_count + 1, *tuple(x)[3:]) for k, x in enumerate(rel) if k % 5]
    stored += [(*s[:3], *s[3:-1], math.nan) for s in [tuple(rel[0])]] + [(100, 200, 1, *[1.0] * 7)]
    s = spark.createDataFrame(stored, ", ".join(["first_item_id bigint", "second_item_id bigint", *[f"{c} {'double' if k else 'bigint'}" for k, c in enumerate(ratings.RELATION)]]))
    got = {tuple(x) for x in ratings.relation_faults(s, df).collect()}
    assert got == {tuple(x) for x in ratings.validate_relations(s, ratings.relation_statistics(df)).collect()} and 0 < len(got) < len(rel)
