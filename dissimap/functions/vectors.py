"""Expressions over array columns, and hashes that any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOD = 4294967296
#: A prime below 2**32, and an odd factor whose products with 32 bits fit a bigint.
PRIME, FACTOR = 4294967291, 73244475


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(x: Column | str) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, e: a + e)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda p, q: p * q))


def norm(x: Column | str) -> Column:
    return F.sqrt(total(F.transform(_c(x), lambda e: e * e)))


def distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(total(F.zip_with(_c(a), _c(b), lambda p, q: (p - q) * (p - q))))


def plus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda p, q: p + q)


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda p, q: p - q)


def times(a: Column | str, k: Column | float) -> Column:
    k = k if isinstance(k, Column) else F.lit(k)
    return F.transform(_c(a), lambda e: e * k)


def sum_of_vectors(x: Column | str, dims: int) -> Column:
    """The element-wise sum of an array column over the rows of a group."""
    x = _c(x)
    return F.array(*[F.sum(F.get(x, F.lit(k))) for k in range(dims)])


def _round(h: Column) -> Column:
    return F.pmod(h.bitwiseXOR(F.shiftright(h, 16)) * F.lit(FACTOR), F.lit(MOD))


def mixed_seed(seed: int) -> int:
    """The start of mixed(): the seed after two rounds."""
    h = (seed + 1) % MOD
    for _ in range(2):
        h = (h ^ h >> 16) * FACTOR % MOD
    return h


def mixed(*ids: Column | str, seed: int = 0) -> Column:
    """A number from 0 to 2**32 - 1, hashed from ids and a seed in plain integer arithmetic: for one id after another, h becomes h xor (id mod PRIME),
    and then twice (h xor (h >> 16)) * FACTOR mod 2**32."""
    h = F.lit(mixed_seed(seed)).cast("bigint")
    for c in ids:
        h = _round(_round(h.bitwiseXOR(F.pmod(_c(c).cast("bigint"), F.lit(PRIME)))))
    return h


def mixed_sql(*ids: str, seed: int = 0) -> str:
    """mixed() in SQL, for ids that are not negative."""
    x = ", ".join(f"({c}) % {PRIME}, 0" for c in ids)
    return f"list_reduce([{mixed_seed(seed)}::BIGINT, {x}], lambda h, x: xor(xor(h, x), xor(h, x) >> 16) * {FACTOR} % {MOD})"


def uniform(*ids: Column | str, seed: int = 0) -> Column:
    """mixed() as a number in [0, 1)."""
    return mixed(*ids, seed=seed).cast("double") / F.lit(float(MOD))


def uniform_sql(*ids: str, seed: int = 0) -> str:
    return f"(CAST({mixed_sql(*ids, seed=seed)} AS DOUBLE) / {MOD}.0::DOUBLE)"
