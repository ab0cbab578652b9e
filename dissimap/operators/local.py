"""Force layouts of a bounded number of points in one task: the same steps as the distributed ones, on arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from dissimap.functions.vectors import FACTOR, MOD, PRIME, mixed_seed


def mixed(*ids, seed: int = 0) -> np.ndarray:
    h = np.int64(mixed_seed(seed))
    for c in ids:
        h = h ^ np.asarray(c, np.int64) % PRIME
        for _ in range(2):
            h = (h ^ h >> 16) * FACTOR % MOD
    return h


def uniform(ids: np.ndarray, dims: int, seed: int) -> np.ndarray:
    return mixed(ids[:, None], np.arange(dims)[None], seed=seed) / float(MOD)


def directions(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of x's rows from y's, and unit vectors towards x's; the first axis where they are the same."""
    dx = x - y
    d = np.sqrt((dx * dx).sum(-1))
    u = dx / np.where(d > 0, d, 1)[..., None]
    u[d == 0] = np.eye(x.shape[-1])[0]
    return d, u


def _capped(f: np.ndarray, most: float) -> np.ndarray:
    n = np.sqrt((f * f).sum(-1, keepdims=True))
    return np.where(n > most, f * (most / np.where(n > 0, n, 1)), f)


def force(r: np.ndarray, x: np.ndarray, rounds: int, planar: bool, dampening: float, cap: float, spring: float, sequential: bool, energies: list | None = None) -> np.ndarray:
    """All pairs. energies: gets the sum of |v|^2 of each round. sequential: each point moves before the next one's force is taken; otherwise all at once."""
    n, v = len(x), np.zeros_like(x)
    x = x.copy()
    for k in range(1, rounds + 1):
        blocks = [slice(i, i + 1) for i in range(n)] if sequential else [slice(s, s + 128) for s in range(0, n, 128)]
        old = x if sequential else x.copy()
        for b in blocks:
            own = np.arange(n)[b]
            d = np.zeros((len(own), n))
            for c in range(x.shape[1]):
                dx = np.subtract.outer(old[b, c], old[:, c])
                d += np.multiply(dx, dx, out=dx)
            np.sqrt(d, out=d)
            same = d == 0
            same[np.arange(len(own)), own] = False
            pull = np.subtract(r[b], d) * spring
            d[d == 0] = np.inf
            pull_by_d = pull / d
            f = old[b] * pull_by_d.sum(1)[:, None] - pull_by_d @ old
            f[:, 0] += (pull * same).sum(1) if same.any() else 0.0  # the first axis where places are the same
            f /= max(1, n - 1)
            if planar:
                f[:, -1] -= old[b, -1] * spring * k / rounds
            v[b] = v[b] * (1 - dampening) + _capped(f, cap)
            if sequential:
                x[b] += v[b]
        if not sequential:
            x += v
        if energies is not None:
            energies.append(float((v * v).sum()))
    return x


def drawn(at: np.ndarray, n: int, s_max: int, seed: int) -> np.ndarray:
    """As hybrid.random_candidates(), by position: s_max different others of each."""
    s = min(s_max, n - 1)
    k = np.arange(s)
    low, high = k * (n - 1) // s, (k + 1) * (n - 1) // s
    turn = mixed(at, seed=seed)[:, None]
    return (at[:, None] + 1 + (turn + low + mixed(at[:, None], k[None] + 1, seed=seed) % (high - low)) % (n - 1)) % n


def neighbours(r: np.ndarray, x: np.ndarray, rounds: int, planar: bool, v_max: int, s_max: int, seed: int, spring: float = 0.2, dampening: float = 0.3, cap: float = 0.5) -> np.ndarray:
    """Neighbour sets and hashed candidates."""
    n, v, near = len(x), np.zeros_like(x), None
    x = x.copy()
    at = np.arange(n)
    for k in range(1, rounds + 1):
        cand = drawn(at, n, s_max, seed * 1009 + k)
        every = cand if near is None else np.concatenate([near, cand], axis=1)
        every = np.sort(every, axis=1)
        first = np.column_stack([np.ones(n, bool), every[:, 1:] != every[:, :-1]])  # each other once
        want = r[at[:, None], every]
        d, u = directions(x[:, None], x[every])
        f = (u * (np.where(first, want - d, 0) * spring)[..., None]).sum(1) / first.sum(1, keepdims=True)
        if planar:
            f[:, -1] -= x[:, -1] * 0.2 * k / rounds
        v = v * (1 - dampening) + _capped(f, cap)
        x = x + v
        order = np.lexsort((every, np.where(first, want, np.inf)), axis=1)[:, :v_max]
        near = np.take_along_axis(every, order, axis=1)
    return x


def solve(run):
    """A function of one table of pairs (i, j, r, and x, the start of i, if there is one) to a table of points, around run(ids, r, start)."""
    from dissimap.operators.spectral import square

    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, r = square(np.asarray(left["i"]), np.asarray(left["j"]), np.asarray(left["r"]))
        start = None
        if len(right):
            t = right.sort_by("id")
            start = np.array(t["x"].to_pylist(), float)[np.searchsorted(np.asarray(t["id"]), ids)]
        return pa.table({"id": ids, "x": pa.array(list(run(ids, r, start)), pa.list_(pa.float64()))})

    return f
