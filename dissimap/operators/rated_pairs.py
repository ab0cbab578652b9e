"""Sums over the pairs of ratings that users gave two items, in NumPy: pairs are packed by tasks that hold users, and summed by tasks that hold pairs of items.

A packed piece is (p int, kind int, n bigint, raw bigint, data binary): n entries of part p, `raw` bytes compressed. The part is that of the owner of a pair, the
item of lower (rank, id), so that hot items, of higher rank, own few pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PIECE = "p int, kind int, n bigint, raw bigint, data binary"
SUMS = ("n", "d", "dd", "a", "aa", "b", "bb", "ab")
#: The sums that a model's distance needs.
MODEL_SUMS = {"abs_difference": ("n", "d"), "correlation": ("n", "a", "aa", "b", "bb", "ab")}
#: Pieces of pairs of ratings, of sums of an item pair, of stored relations.
PAIRS, SUMMED, STORED = 0, 1, 2
#: Ratings of a group up to which all their pairs are listed; beyond, the sums come from its sorted values.
LISTED = 512
#: Entries handled at a time.
ENTRIES = 2_000_000
_KINDS = (np.dtype("<f8"), np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"), np.dtype("<i2"))


def part_of(item: np.ndarray, parts: int) -> np.ndarray:
    """The part of an owner, parts being a power of two: the parts of fewer parts are unions of those of more."""
    x = item.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(32)) & np.uint64(parts - 1)).astype(np.int32)


# Packing


def _narrow(c: np.ndarray) -> tuple[int, np.ndarray]:
    """The column in the narrowest kind that gives it back exactly; values of two decimals as hundredths."""
    if c.dtype.kind == "f":
        q = np.rint(c * 100)
        exact = len(c) and np.abs(q).max() < 32768 and (q / 100 == c).all()
        return (4, q.astype(_KINDS[4])) if exact else (0, c.astype(_KINDS[0]))
    low, high = (int(c.min()), int(c.max())) if len(c) else (0, 0)
    for k in (1, 2):
        if np.iinfo(_KINDS[k]).min <= low and high <= np.iinfo(_KINDS[k]).max:
            return k, c.astype(_KINDS[k])
    return 3, c.astype(_KINDS[3])


def pack(columns: list[np.ndarray]) -> tuple[int, bytes]:
    """Columns as bytes, of which the first, second, ... of all values lie together."""
    head, body = [len(columns)], []
    for c in columns:
        k, c = _narrow(c)
        head += [k, len(c)]
        body.append(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() if len(c) else b"")
    whole = np.array(head, "<i8").tobytes() + b"".join(body)
    return len(whole), pa.compress(whole, codec="zstd", asbytes=True)


def unpack(raw: int, data: bytes) -> list[np.ndarray]:
    whole = np.frombuffer(pa.decompress(data, decompressed_size=raw, codec="zstd", asbytes=True), np.uint8)
    n = int(whole[:8].view("<i8")[0])
    head, at, out = whole[8 : 8 + 16 * n].view("<i8"), 8 + 16 * n, []
    for k, size in zip(head[::2].tolist(), head[1::2].tolist()):
        kind = _KINDS[k]
        c = np.ascontiguousarray(whole[at : at + size * kind.itemsize].reshape(kind.itemsize, size).T).view(kind).reshape(size)
        out.append(c / 100 if k == 4 else c.astype(np.int64) if k else c)
        at += size * kind.itemsize
    return out


def _pieces(made: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], ["p", "kind", "n", "raw", "data"])


def _by_part(p: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order by part, and (part, from, to) of each."""
    o = np.argsort(p.astype(np.uint16) if not len(p) or p.max() < 65536 else p, kind="stable")
    at = np.flatnonzero(np.diff(p[o], prepend=-1))
    return o, list(zip(p[o[at]].tolist(), at.tolist(), [*at[1:].tolist(), len(p)]))


def _pack_rows(kind: int, p: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if not len(p):
        return
    o, spans = _by_part(p)
    columns = [c[o] for c in columns]
    yield _pieces([(k, kind, t - f, *pack([c[f:t] for c in columns])) for k, f, t in spans])


# Users' pairs


def _listed(rank, item, value, fresh, ends, parts) -> Iterator[pa.RecordBatch]:
    """Pieces of all pairs of different items within groups; rows are in order of (group, rank, item), `ends` being each row's group's end."""
    new = np.ones(len(item) + 1, bool)
    new[1:-1] = (item[1:] != item[:-1]) | (ends[1:] != ends[:-1])
    at = np.flatnonzero(new)
    start = np.repeat(at[1:], np.diff(at))  # the next item's first row
    count = ends - start
    upto = np.cumsum(count)
    lo = 0
    while lo < len(item):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + ENTRIES, "right")))
        rows = lo + np.flatnonzero(count[lo:hi])
        lo = hi
        if not len(rows):
            continue
        rows = rows[np.argsort(part_of(item[rows], parts), kind="stable")]
        c = count[rows]
        to = np.cumsum(c)
        other = np.arange(to[-1]) + np.repeat(start[rows] - (to - c), c)
        if fresh is not None:
            keep = np.repeat(fresh[rows], c) | fresh[other]
            c = np.add.reduceat(keep.astype(np.int64), to - c)
            other, rows, c = other[keep], rows[c > 0], c[c > 0]
            if not len(rows):
                continue
            to = np.cumsum(c)
        at = [0, *to.tolist()]
        _, spans = _by_part(part_of(item[rows], parts))
        made = []
        for k, f, t in spans:
            e = other[at[f] : at[t]]
            made.append((k, PAIRS, len(e), *pack([item[rows[f:t]], value[rows[f:t]], c[f:t], item[e], value[e]])))
        yield _pieces(made)


def _meet(a: tuple, b: tuple, n_items: int, within: bool, wanted: tuple[str, ...] = SUMS) -> Iterator[tuple[np.ndarray, np.ndarray, dict]]:
    """(owners, others, sums) of the pairs of ratings of a with ratings of b, each (item codes, shifted values); within: a is b, and each pair of items counts once. For
    sorted values the sum of |x - y| over all x of an item follows from how many of them lie below y and their sum, so the work is ratings x items, not ratings squared.
    Where no sum of |x - y| is wanted, it is ratings + pairs of items."""
    (ca, va), (cb, vb) = a, b
    if not len(va) or not len(vb):
        return
    gaps = "d" in wanted or "dd" in wanted
    if gaps:
        o = np.argsort(va, kind="stable")
        ca, va = ca[o], va[o]
        o = np.argsort(cb, kind="stable")
        cb, vb = cb[o], vb[o]
        from_b = np.flatnonzero(np.diff(cb, prepend=-1))
        below = np.searchsorted(va, vb, "right")
        place = np.full(n_items, -1)
    sums = lambda c, v: [np.bincount(c, w, n_items) for w in (np.ones(len(v)), v, v * v)]
    (na, sa, qa), of_b = sums(ca, va), sums(cb, vb)
    items_a, items_b = np.flatnonzero(na), np.flatnonzero(of_b[0])
    nb, sb, qb = [x[items_b] for x in of_b]
    width = max(1, 2 * ENTRIES // max(len(va), len(vb)) if gaps else ENTRIES // len(items_b))
    for f in range(0, len(items_a), width):
        own = items_a[f : f + width]
        y, x = np.nonzero(items_b[:, None] > own[None] if within else items_b[:, None] != own[None])
        n1, s1, q1, n2, s2, q2 = na[own[x]], sa[own[x]], qa[own[x]], nb[y], sb[y], qb[y]
        n = n1 * n2
        first = own[x] < items_b[y]
        side = lambda p, q: (np.where(first, p, q), np.where(first, q, p))  # noqa: B023, E731
        (i, j), (sum_a, sum_b), (sq_a, sq_b) = side(own[x], items_b[y]), side(s1 * n2, s2 * n1), side(q1 * n2, q2 * n1)
        got = {"n": n, "a": sum_a, "aa": sq_a, "b": sum_b, "bb": sq_b, "ab": s1 * s2}
        if gaps:
            place[:] = -1
            place[own] = np.arange(len(own))
            rows = np.flatnonzero(place[ca] >= 0)
            m = np.zeros((len(va) + 1, len(own)))
            m[rows + 1, place[ca[rows]]] = 1
            d = vb[:, None] * (2 * np.cumsum(m, 0)[below] - na[own])
            m[rows + 1, place[ca[rows]]] = va[rows]
            d += sa[own] - 2 * np.cumsum(m, 0)[below]
            d = np.maximum(np.add.reduceat(d, from_b, axis=0), 0.0)[y, x]  # of items of b x own
            got |= {"d": d, "dd": np.where(n == 1, d * d, np.maximum(n2 * q1 - 2 * s1 * s2 + n1 * q2, 0.0))}
        yield i, j, got


def _heavy(rank, item, value, fresh, left, within, parts, shift, wanted) -> Iterator[pa.RecordBatch]:
    """Pieces of the sums of one large group: of the ratings with each other, or, not within, of those of the left with the others."""
    o = np.lexsort((item, rank))
    code = np.empty(len(o), np.int64)
    code[o] = np.cumsum(np.diff(item[o], prepend=item[o[0]]) != 0)
    ids = np.empty(code.max() + 1, np.int64)
    ids[code] = item
    value = value - shift
    every = np.ones(len(item), bool)
    of = lambda rows: (code[rows], value[rows])
    if within:
        meets = [(every, every, True)] if fresh is None else [(fresh, fresh, True), (fresh, ~fresh, False)]
    else:
        meets = [(left, ~left, False)] if fresh is None else [(left & fresh, ~left, False), (left & ~fresh, ~left & fresh, False)]
    for a, b, same in meets:
        for i, j, s in _meet(of(a), of(b), len(ids), same, wanted):
            yield from _pack_rows(SUMMED, part_of(ids[i], parts), [ids[i], ids[j], *(s[k] for k in wanted)])


def spread(parts: int, shift: float, with_fresh: bool, wanted: tuple[str, ...] = SUMS) -> Callable:
    """For mapInArrow over (u, x, y, own_side, r, i, v[, fresh]), all rows of a group (u, x, y) in one partition: pieces of the group's pairs, of rows of the own side with the
    others where x is not y. wanted: the sums in pieces of sums, those of both sides or of none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        u, x, y, left, rank, item, value = (t[c].to_numpy() for c in ("u", "x", "y", "own_side", "r", "i", "v"))
        fresh = t["fresh"].to_numpy() if with_fresh else None
        o = np.lexsort((item, rank, y, x, u)) if y.any() else np.lexsort((item, rank, u))
        u, x, y, left, rank, item, value = (c[o] for c in (u, x, y, left, rank, item, value))
        fresh = None if fresh is None else fresh[o]
        new = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]), True])
        size = np.diff(new)
        each, ends = np.repeat(size, size), np.repeat(new[1:], size)
        rows = np.flatnonzero((each <= LISTED) & (x == y))
        # Rows left out move the ends of the groups behind them.
        ends = np.searchsorted(rows, ends[rows])
        yield from _listed(rank[rows], item[rows], value[rows], None if fresh is None else fresh[rows], ends, parts)
        for g in np.flatnonzero((size > LISTED) | (x[new[:-1]] != y[new[:-1]])).tolist():
            s = slice(new[g], new[g + 1])
            yield from _heavy(rank[s], item[s], value[s], None if fresh is None else fresh[s], left[s], x[new[g]] == y[new[g]], parts, shift, wanted)

    return run


def spread_stored(parts: int, columns: list[str]) -> Callable:
    """For mapInArrow over (owner, first_item_id, second_item_id, columns as doubles): pieces of stored relations. Null becomes NaN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = [b.column(k).to_numpy(zero_copy_only=False) for k in ("owner", "first_item_id", "second_item_id", *columns)]
            yield from _pack_rows(STORED, part_of(c[0], parts), [*c[1:3], *(x.astype(float) for x in c[3:])])

    return run


# Pairs of items


def _grouped(first: np.ndarray, second: np.ndarray, sums: list[np.ndarray]) -> tuple:
    """One row for each pair of items, in order."""
    if not len(first):
        return first, second, sums
    lo, hi, least, most = int(first.min()), int(first.max()), int(second.min()), int(second.max())
    if (hi - lo + 1) * (most - least + 1) < 2**63:
        key = (first - lo) * (most - least + 1) + (second - least)
        o = np.argsort(key)
        key = key[o]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    else:
        o = np.lexsort((second, first))
        at = np.flatnonzero(np.r_[True, (first[o][1:] != first[o][:-1]) | (second[o][1:] != second[o][:-1])])
    return first[o[at]], second[o[at]], [np.add.reduceat(c[o], at) for c in sums]


#: The sums that change places with the items.
_SIDES = {"a": "b", "aa": "bb", "b": "a", "bb": "aa"}


def _one(a: np.ndarray, b: np.ndarray, wanted: tuple[str, ...]) -> list[np.ndarray]:
    """The sums of each pair of ratings alone."""
    d = np.abs(a - b) if "d" in wanted or "dd" in wanted else None
    of = {"n": lambda: np.ones(len(a)), "d": lambda: d, "dd": lambda: d * d, "a": lambda: a, "aa": lambda: a * a, "b": lambda: b, "bb": lambda: b * b, "ab": lambda: a * b}
    return [of[k]() for k in wanted]


def _summed(pieces: list[tuple[int, list[np.ndarray]]], shift: float, state: tuple | None, wanted: tuple[str, ...] = SUMS) -> tuple:
    """state with the sums of pieces."""
    firsts, seconds, sums = ([state[0]], [state[1]], [[c] for c in state[2]]) if state else ([], [], [[] for _ in wanted])
    for kind, c in pieces:
        if kind == PAIRS:
            i, a, j, b = np.repeat(c[0], c[2]), np.repeat(c[1] - shift, c[2]), c[3], c[4] - shift
            swap = i > j
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            one = _one(a, b, wanted)
        else:
            i, j, of = *c[:2], {k: x.astype(float) for k, x in zip(wanted, c[2:])}
            swap = i > j
            one = [np.where(swap, of[_SIDES[k]], x) if k in _SIDES else x for k, x in of.items()]
        firsts.append(np.minimum(i, j))
        seconds.append(np.maximum(i, j))
        for s, x in zip(sums, one):
            s.append(x)
    return _grouped(np.concatenate(firsts), np.concatenate(seconds), [np.concatenate(s) for s in sums])


def _variances(a: np.ndarray, aa: np.ndarray, b: np.ndarray, bb: np.ndarray) -> tuple[Callable, np.ndarray, np.ndarray]:
    """From means and means of squares of both sides: the variance of a mean of squares and a mean, and those of the sides. A variance within the rounding of the squares it
    is the difference of is 0."""
    noise = 1e-13 * (aa + bb)
    var = lambda q, m: np.where(q - m * m > noise, q - m * m, 0.0)
    return var, var(aa, a), var(bb, b)


def moments(sums: list[np.ndarray], shift: float) -> list[np.ndarray]:
    """Sums as count, mean and population variance of |a-b|, means and variances of a and of b, covariance."""
    n, d, dd, a, aa, b, bb, ab = sums
    d, a, b, dd, aa, bb = d / n, a / n, b / n, dd / n, aa / n, bb / n
    var, var_a, var_b = _variances(a, aa, b, bb)
    return [n.astype(np.int64), d, var(dd, d), a + shift, b + shift, var_a, var_b, ab / n - a * b]


def distances(sums: list[np.ndarray], model: str, least: float = 0.0) -> np.ndarray:
    """The sums MODEL_SUMS[model] as distances: the mean of |a-b|, or 1 - correlation, NaN where the variance of a side is 0 or below `least`."""
    n, *rest = sums
    if model == "abs_difference":
        return rest[0] / n
    a, aa, b, bb, ab = (x / n for x in rest)
    _, var_a, var_b = _variances(a, aa, b, bb)
    both = np.where((var_a >= least) & (var_b >= least), np.sqrt(var_a * var_b), 0.0)
    return 1 - np.divide(ab - a * b, both, out=np.full(len(n), np.nan), where=both > 0)


def _off(stored: np.ndarray, truth: np.ndarray, tolerance: float) -> np.ndarray:
    """As ratings.off()."""
    return np.isnan(stored) | (np.abs(stored - truth) > tolerance * np.abs(truth))


def _faults(first, second, truth: list[np.ndarray], stored: list[list[np.ndarray]], tolerance: float) -> np.ndarray:
    """True where a pair has no stored relation, or one that is off."""
    bad = np.ones(len(first), bool)
    if not stored:
        return bad
    s = [np.concatenate(c) for c in zip(*stored)]
    i, j, row = _grouped(np.r_[first, s[0]], np.r_[second, s[1]], [np.r_[np.arange(len(first)) + 1, np.zeros(len(s[0]), np.int64)], np.r_[np.zeros(len(first), np.int64), np.arange(len(s[0])) + 1]])
    both = (row[0] > 0) & (row[1] > 0)
    t, k = row[0][both] - 1, row[1][both] - 1
    off = np.isnan(s[2][k]) | (s[2][k] != truth[0][t])
    for c in range(1, len(truth)):
        off |= _off(s[2 + c][k], truth[c][t], tolerance)
    bad[t] = off
    return bad


def gather(shift: float, names: list[str], finish: str, tolerance: float = 0.0, rows: int = 100_000, least: float = 0.0) -> Callable:
    """For mapInArrow over pieces, all of a part in one partition: (first_item_id, second_item_id, names). finish: 'sums', 'moments', 'faults' (ids alone), or a model of
    MODEL_SUMS, whose sums alone the pieces then have: its distances(), null where NaN."""
    wanted = MODEL_SUMS.get(finish, SUMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, waiting, held, stored = None, [], 0, []
        for b in batches:
            for kind, n, raw, data in zip(*(b.column(c).to_pylist() for c in ("kind", "n", "raw")), b.column("data")):
                c = unpack(raw, data.as_buffer())
                if kind == STORED:
                    stored.append(c)
                    continue
                waiting.append((kind, c))
                held += n
                if held >= max(ENTRIES, len(state[0]) if state else 0):
                    state, waiting, held = _summed(waiting, shift, state, wanted), [], 0
        if waiting:
            state, waiting = _summed(waiting, shift, state, wanted), []
        if state is None:
            return
        first, second, sums = state
        if finish in MODEL_SUMS:
            out = [distances(sums, finish, least)]
        else:
            out = [sums[0].astype(np.int64), *sums[1:]] if finish == "sums" else moments(sums, shift)
        if finish == "faults":
            bad = _faults(first, second, out, stored, tolerance)
            first, second, out = first[bad], second[bad], []
        columns = [first, second, *out]
        for f in range(0, len(first), rows):
            yield pa.RecordBatch.from_arrays([pa.array(c[f : f + rows], from_pandas=finish in MODEL_SUMS) for c in columns], ["first_item_id", "second_item_id", *names])

    return run
