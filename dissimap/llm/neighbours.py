"""Most similar vectors for every vector."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dissimap.operators.skew import join_hot
from dissimap.session import cut

#: Vectors of one block, the side of a product tile.
BLOCK = 1024
#: Vectors on one side of a task, about, and the least sides that a collection is cut into.
SIDE, LEAST_SIDES = 65_536, 8
#: Pivots that divide the space into cells: the most of them, drawn from a hashed sample of the ids.
MOST_PIVOTS = 2048


def landmark_vectors(rk: DataFrame, landmarks: DataFrame, most: int = 1024) -> DataFrame:
    """(id bigint, x array<double>): the dissimilarities of each point to the landmarks, in the order of ordinal. Rows of rk
    count if 0 <= c2 <= 2; of several of an unordered pair the one with the highest line_no holds. A point without all
    landmarks has no vector. No landmarks, no vectors. `most` bounds the landmarks, which become columns."""
    marks = [r[0] for r in landmarks.where("landmark_id is not null").orderBy("ordinal", "landmark_id").select("landmark_id").limit(most + 1).collect()]
    if len(marks) > most:
        raise ValueError(f"more than {most} landmarks")
    if not marks:
        return rk.sparkSession.createDataFrame([], "id bigint, x array<double>")
    a, b = F.col("c0").isin(marks), F.col("c1").isin(marks)
    ok = rk.where((a != b) & F.col("c2").between(0.0, 2.0))
    one = ok.select(F.when(a, F.col("c1")).otherwise(F.col("c0")).alias("id"), F.when(a, F.col("c0")).otherwise(F.col("c1")).alias("m"), "c2", "line_no")
    last = one.groupBy("id", "m").agg(F.max_by("c2", "line_no").alias("c2"))
    wide = last.groupBy("id").agg(*[F.max(F.when(F.col("m") == m, F.col("c2"))).alias(f"v{i}") for i, m in enumerate(marks)])
    return wide.na.drop().select("id", F.array(*[f"v{i}" for i in range(len(marks))]).alias("x"))


def clean_vectors(vectors: DataFrame) -> DataFrame:
    """(id, x array<double>) without rows of null id, null or empty x, or a null, NaN or infinite coordinate. Of rows with
    an id again, the least vector stays."""
    x = F.transform(F.col("x"), lambda e: e.cast("double"))
    v = vectors.select(F.col("id").cast("bigint").alias("id"), x.alias("x")).where("id is not null and x is not null and size(x) > 0")
    v = v.where(~F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    return v.groupBy("id").agg(F.min("x").alias("x"))


@dataclass
class Grid:
    """How a collection is cut: cells about pivots, blocks of BLOCK vectors within a cell, sides of whole blocks, as many as it takes.

    What is held here grows with the pivots alone, of which there are MOST_PIVOTS at most.
    """

    pivots: np.ndarray
    radius: np.ndarray
    sides: np.ndarray  # the first and the last side of each cell; -1 of an empty cell

    def gap(self, a: int, b: int) -> float:
        """A lower bound of the distance between vectors of two cells."""
        return float(np.linalg.norm(self.pivots[a] - self.pivots[b]) - self.radius[a] - self.radius[b])

    def near(self, reach: np.ndarray | float) -> np.ndarray:
        """cells x cells: whether vectors may be within reach of each other; reach: one, or one for each cell, of which the greater counts."""
        p, r = self.pivots, np.broadcast_to(reach, len(self.pivots))
        d2 = ((p[:, None] - p[None]) ** 2).sum(-1) if len(p) <= 256 else (p**2).sum(1)[:, None] + (p**2).sum(1)[None] - 2 * p @ p.T
        return np.sqrt(np.maximum(d2, 0)) - self.radius[:, None] - self.radius[None] <= np.maximum(r[:, None], r[None]) + 1e-6

    def partners(self, near: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each cell, the sides of the cells near it, as disjoint ranges."""
        out = []
        for row in near & (self.sides[:, 0] >= 0)[None]:
            ranges: list[tuple[int, int]] = []
            for low, high in sorted(map(tuple, self.sides[row].tolist())):
                if ranges and low <= ranges[-1][1] + 1:
                    ranges[-1] = (ranges[-1][0], max(high, ranges[-1][1]))
                else:
                    ranges.append((low, high))
            out.append(ranges)
        return out


def _chain(p: np.ndarray) -> np.ndarray:
    """An order of the pivots in which neighbours are near: each is followed by the nearest one left."""
    left, order = list(range(len(p))), []
    at = 0
    while left:
        order.append(left.pop(at))
        if left:
            at = int(np.argmin(((p[left] - p[order[-1]]) ** 2).sum(1)))
    return np.array(order, int)


def _nearest_pivot(pivots: np.ndarray):
    norm = (pivots**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            at, far = np.empty(len(x), np.int32), np.empty(len(x))
            for s in range(0, len(x), 4096):
                d = norm[None] - 2 * x[s : s + 4096] @ pivots.T
                at[s : s + 4096] = d.argmin(1)
                far[s : s + 4096] = np.sqrt(((x[s : s + 4096] - pivots[at[s : s + 4096]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at), pa.array(far)], ["id", "x", "cell", "far"])

    return run


def _matrix(col) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), -1)


def cells(vectors: DataFrame, block: int = BLOCK) -> tuple[DataFrame, Grid] | None:
    """vectors (id, x), of one length, with their place: (side, block, cell, id, x), and the grid; None if there are none.

    A cell of many vectors (a third of all, say) is cut into as many blocks as it needs by a hash of the id, and these are
    spread over several sides.
    """
    n = vectors.count()
    if not n:
        return None
    m = int(min(MOST_PIVOTS, max(1, n // block)))
    drawn = vectors.orderBy(F.xxhash64("id"), "id").limit(m)  # MOST_PIVOTS rows at most
    p = np.unique(np.array([r.x for r in drawn.select("x").collect()], float), axis=0)
    p = p[_chain(p)]
    placed = cut(vectors.select("id", "x").mapInArrow(_nearest_pivot(p), "id bigint, x array<double>, cell int, far double"))
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).collect()  # a row for each pivot
    count, radius = np.zeros(len(p), np.int64), np.zeros(len(p))
    for r in stats:
        count[r.cell], radius[r.cell] = r.n, r.r * (1 + 1e-9) + 1e-12
    blocks = -(-count // block)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    total = int(blocks.sum())
    per_side = max(1, -(-total // max(LEAST_SIDES, -(-n // SIDE))))
    sides = np.column_stack([first // per_side, (first + blocks - 1) // per_side])
    sides[blocks == 0] = -1
    spec = [(i, int(first[i]), int(max(blocks[i], 1))) for i in range(len(p))]
    placed = placed.join(F.broadcast(vectors.sparkSession.createDataFrame(spec, "cell int, f bigint, b bigint")), "cell")  # MOST_PIVOTS rows at most
    at = F.col("f") + F.pmod(F.xxhash64("id"), F.col("b"))
    return placed.select(F.floor(at / per_side).cast("int").alias("side"), at.cast("int").alias("block"), "cell", "id", "x"), Grid(p, radius, sides)


def meetings(placed: DataFrame, grid: Grid, near: np.ndarray, own: bool = True) -> DataFrame:
    """The placed vectors (side, block, cell, ...), each once for every side that holds cells near its own: with p <= q, the two sides. own: also for its own side.
    Of a pair of sides only the vectors of cells near the other side come together."""
    rows = [(c, r) for c, r in enumerate(grid.partners(near))]
    to = placed.sparkSession.createDataFrame(rows, "cell int, ranges array<struct<low:int,high:int>>")  # MOST_PIVOTS rows, and ranges of each, at most
    others = F.flatten(F.transform("ranges", lambda r: F.sequence(r["low"], r["high"])))
    j = placed.join(F.broadcast(to), "cell").withColumn("o", F.explode(others)).drop("ranges")
    j = j if own else j.where("o <> side")
    return j.select(F.least("side", "o").alias("p"), F.greatest("side", "o").alias("q"), *placed.columns)


@dataclass
class Codes:
    """int8 codes of vectors: x = middle + step * q + a rest no longer than `rest`."""

    q: np.ndarray
    rest: np.ndarray
    step: float


def quantise(x: np.ndarray, middle: np.ndarray, step: float) -> Codes:
    q = np.clip(np.rint((x - middle) / step), -127, 127).astype(np.int8)
    rest = np.sqrt(((x - middle - step * q) ** 2).sum(1)) + 1e-12
    return Codes(q, rest, step)


def tile(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, Codes, Codes]:
    """Squared distances between the int8 codes of two blocks, in steps, and the codes. The products of int8 values are
    summed in float32 by BLAS; the sums are integers below 2**24 for up to 250 dimensions, so they are exact (beyond, float64 is used)."""
    low, high = np.minimum(a.min(0), b.min(0)), np.maximum(a.max(0), b.max(0))
    middle = (low + high) / 2
    step = max(float((high - low).max()) / 254, 1e-300)
    ca, cb = quantise(a, middle, step), quantise(b, middle, step)
    kind = np.float32 if a.shape[1] <= 250 else np.float64
    qa, qb = ca.q.astype(kind), cb.q.astype(kind)
    # One product gives |p|^2 - 2 p.q + |q|^2.
    left = np.column_stack([-2 * qa, (qa * qa).sum(1), np.ones(len(qa), kind)])
    right = np.column_stack([qb, np.ones(len(qb), kind), (qb * qb).sum(1)])
    return left @ right.T, ca, cb


def _threshold(t: np.ndarray, rest: np.ndarray, other: float, step: float) -> np.ndarray:
    """The squared code distance beyond which a vector is farther than t for certain."""
    return ((t + rest + other) / step * (1 + 1e-6)) ** 2 + 1e-3


class Heaps:
    """The k nearest found so far of each of n vectors, none beyond its reach."""

    def __init__(self, n: int, k: int, reach: np.ndarray | float):
        self.k, self.d, self.id = k, np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
        self.reach = np.broadcast_to(reach, n)

    def limit(self, rows: np.ndarray) -> np.ndarray:
        return np.minimum(self.d[rows, -1], self.reach[rows])

    def push(self, rows: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        ok = d <= self.limit(rows)
        rows, ids, d = rows[ok], ids[ok], d[ok]
        if not len(rows):
            return
        own = np.unique(rows)
        r = np.concatenate([np.repeat(own, self.k), rows])
        i = np.concatenate([self.id[own].ravel(), ids])
        v = np.concatenate([self.d[own].ravel(), d])
        order = np.lexsort((i, v, r))
        r, i, v = r[order], i[order], v[order]
        start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        place = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
        keep = place < self.k
        self.d[r[keep], place[keep]], self.id[r[keep], place[keep]] = v[keep], i[keep]


def _tiles(t: pa.Table, p: int, q: int, grid: Grid):
    """Of the two sides of a task (or the one): ids, vectors, and the pairs of blocks to meet, as slices, in the order of their cells' gap."""
    ids, x = np.asarray(t["id"], np.int64), _matrix(t["x"])
    block, side, cell = (np.asarray(t[c]) for c in ("block", "side", "cell"))
    start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    end = np.r_[start[1:], len(block)]
    todo = []
    for i in range(len(start)):
        for j in range(i, len(start)):
            if p == q or side[start[i]] != side[start[j]]:
                todo.append((0.0 if i == j else max(0.0, grid.gap(cell[start[i]], cell[start[j]])), i, j))
    return ids, x, [(gap, slice(start[i], end[i]), slice(start[j], end[j]), i == j) for gap, i, j in sorted(todo)]


def _own(k: int, reach: float, grid: Grid):
    """The k nearest on a vector's own side: its place, the list h, and the distance beyond which no other vector matters."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("block", "ascending"), ("id", "ascending")])
        side = key[0].as_py()
        ids, x, tiles = _tiles(t, side, side, grid)
        heaps = Heaps(len(ids), k, reach)
        for gap, a, b, same in tiles:
            _tile_into(heaps, x, ids, a, b, same, gap)
        have = heaps.id >= 0
        ends = np.r_[0, np.cumsum(have.sum(1))].astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(heaps.d[have]), pa.array(heaps.id[have])], ["distance", "neighbour_id"])
        return t.append_column("bound", pa.array(heaps.limit(np.arange(len(ids))))).append_column("h", pa.ListArray.from_arrays(pa.array(ends), pairs))

    return run


def _across(k: int, grid: Grid):
    """Of two sides, each vector's nearest on the other side within its bound."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("block", "ascending"), ("id", "ascending")])
        ids, x, tiles = _tiles(t, key[0].as_py(), key[1].as_py(), grid)
        heaps = Heaps(len(ids), k, np.asarray(t["bound"]))
        for gap, a, b, same in tiles:
            _tile_into(heaps, x, ids, a, b, same, gap)
        n = (heaps.id >= 0).sum(1)
        rows = np.flatnonzero(n)
        have = heaps.id[rows] >= 0
        return pa.table({"id": np.repeat(ids[rows], n[rows]), "neighbour_id": heaps.id[rows][have], "distance": heaps.d[rows][have]})

    return run


def _tile_into(heaps: Heaps, x: np.ndarray, ids: np.ndarray, a: slice, b: slice, same: bool, gap: float) -> None:
    ra, rb = np.arange(a.start, a.stop), np.arange(b.start, b.stop)
    ta, tb = heaps.limit(ra), heaps.limit(rb)
    if max(ta.max(), tb.max()) < gap:
        return
    d2, ca, cb = tile(x[a], x[b])
    if same:
        np.fill_diagonal(d2, np.inf)  # for the k-th smallest
    k = heaps.k
    for t, c, axis in ((ta, ca, 1), (tb, cb, 0)):
        # A vector without k neighbours yet: the k-th smallest upper bound in this tile bounds its k-th neighbour.
        open_ = np.flatnonzero(np.isinf(t))
        if len(open_) and d2.shape[axis] - same >= k:
            part = d2[open_] if axis else d2[:, open_].T
            kth = np.partition(part, k - 1, axis=1)[:, k - 1]
            t[open_] = np.sqrt(kth) * c.step * (1 + 1e-6) + c.rest[open_] + (cb if axis else ca).rest.max()
    la, lb = _threshold(ta, ca.rest, cb.rest.max(), ca.step), _threshold(tb, cb.rest, ca.rest.max(), ca.step)
    if same:
        hit = d2 <= la[:, None]
    else:
        hit = (d2 <= la[:, None]) | (d2 <= lb[None, :])
    if same:
        np.fill_diagonal(hit, False)
    i, j = np.nonzero(hit)
    for s in range(0, len(i), 1 << 20):  # survivors are computed in float
        r, c = ra[i[s : s + (1 << 20)]], rb[j[s : s + (1 << 20)]]
        d = np.sqrt(((x[r] - x[c]) ** 2).sum(1))
        heaps.push(r, ids[c], d)
        if not same:
            heaps.push(c, ids[r], d)


def nearest_vectors(vectors: DataFrame, k: int, max_distance: float | None = None, block: int = BLOCK) -> DataFrame:
    """The k nearest other vectors (Euclidean) of each vector of (id, x): (id, neighbour_id bigint, distance double, rank int
    from 1), equal distances by the smaller neighbour_id; with max_distance, only those within it. Exact: nothing is lost
    to quantisation.

    Rows that clean_vectors() leaves out do not take part; vectors of another length than the first's raise ValueError. A
    collection of one vector gives no rows. Vectors equal in all coordinates are one vector in the search; each of them then gets
    the others of its kind at distance 0.

    A block matrix join: vectors are cut into cells about pivots, blocks and sides. First each side meets itself, which bounds every vector's
    k-th distance and so, by the greatest bound of each cell, the cells that can hold nearer ones; then each pair of sides with
    such cells is a task, which gets only those cells' vectors. A task's product tiles of int8 codes, taken in the order of the
    cells' distance, bound each distance from below by the code distance less the lengths of what quantisation left over;
    pairs whose bound is within either vector's k-th distance so far are computed again in float and go to its heap. The heaps
    of a vector are merged at the end.
    """
    v = cut(clean_vectors(vectors))
    sizes = v.agg(F.min(F.size("x")).alias("a"), F.max(F.size("x")).alias("b")).first()
    if sizes.a != sizes.b:
        raise ValueError("vectors of different lengths")
    # Copies: the class of a vector is its least id.
    kinds = cut(v.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    got = cells(kinds.select("id", "x"), block)
    if got is None:
        return vectors.sparkSession.createDataFrame([], "id bigint, neighbour_id bigint, distance double, rank int")
    placed, grid = got
    reach = math.inf if max_distance is None else float(max_distance)
    kind = "side int, block int, cell int, id bigint, x array<double>, bound double, h array<struct<distance:double,neighbour_id:bigint>>"
    own = cut(placed.groupBy("side").applyInArrow(_own(k, reach, grid), kind))
    bound = np.zeros(len(grid.pivots))
    for r in own.groupBy("cell").agg(F.max("bound").alias("b")).collect():  # a row for each pivot
        bound[r.cell] = r.b
    meet = meetings(own.drop("h"), grid, grid.near(bound), own=False)
    found = meet.groupBy("p", "q").applyInArrow(_across(k, grid), "id bigint, neighbour_id bigint, distance double")
    every = own.select("id", F.explode("h").alias("e")).select("id", "e.neighbour_id", "e.distance").unionByName(found)
    best = every.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))), 1, k).alias("h"))  # k of each task
    copied = kinds.where("n > 1").select("x", F.col("id").alias("rep"), "n")
    if copied.limit(1).count():
        best = _with_copies(v, kinds, copied, best, k)
    return best.select("id", F.posexplode("h").alias("r", "e")).select("id", "e.neighbour_id", "e.distance", (F.col("r") + 1).cast("int").alias("rank"))


def _with_copies(v: DataFrame, kinds: DataFrame, copied: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """(id, h) for every vector of best, the lists of the classes. The neighbours of a class are its own first ids at 0, and the first ids of the classes found;
    k + 1 ids of a class are enough. No task gets all copies of a vector."""
    from dissimap.llm.topn import top_n_per_group

    same = join_hot(v, copied, "x", "n").select("rep", "id", F.lit(0.0).alias("same"))
    few = cut(top_n_per_group(same, "rep", "id", "same", k + 1).select("rep", "id"))
    near = best.select(F.col("id").alias("rep"), F.explode("h").alias("e")).select("rep", F.col("e.neighbour_id").alias("other"), "e.distance")
    ids = few.select(F.col("rep").alias("other"), F.col("id").alias("neighbour_id"))
    wide = near.join(ids, "other", "left").select("rep", F.coalesce("neighbour_id", "other").alias("neighbour_id"), "distance")
    wide = wide.unionByName(few.select("rep", F.col("id").alias("neighbour_id"), F.lit(0.0).alias("distance")))
    lists = wide.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))), 1, k + 1).alias("h"))
    of = cut(kinds.join(lists, kinds.id == lists.rep).select("x", "n", "h"))
    return join_hot(v, of, "x", "n").select("id", F.slice(F.filter("h", lambda e: e["neighbour_id"] != F.col("id")), 1, k).alias("h"))
