"""Draws that depend on keys alone, so results are the same however rows are partitioned."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let


def _key(seed, keys) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def _bits(seed, keys) -> Column:
    return F.conv(F.substring(_key(seed, keys), 1, 8), 16, 10).cast("long")


def u(seed, *keys: Column) -> Column:
    """Uniform in [0, 1): the first 32 bits of the md5 of seed:key:..."""
    return _bits(seed, keys).cast("double") / 4294967296.0


def gauss(seed, *keys: Column) -> Column:
    """Standard normal, by Box-Muller over two draws."""
    return F.sqrt(-2 * F.log(1 - u(seed, *keys, F.lit(0)))) * F.cos(2 * F.pi() * u(seed, *keys, F.lit(1)))


def order_key(seed, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


#: Steps of a walk through places outside 0 .. n - 1. At most n ** 0.5 places are outside, so a longer walk has probability below 1e-100.
WALK = 64


def _swap(v: Column, a: int, b: int, seed, back: bool) -> Column:
    """Four Feistel rounds on the grid of a x b places: each half is moved, modulo its size, by a hash of the other."""

    def turn(halves: tuple[Column, Column], rounds: list[int]) -> Column:
        p, q = halves
        if not rounds:
            return q * a + p
        k, *rest = rounds
        own, other, size = (p, q, a) if k % 2 == 0 else (q, p, b)
        step = _bits(seed, [F.lit(k), other])
        moved = F.pmod(own - step if back else own + step, F.lit(size))
        return let(moved, lambda m: turn((m, q) if k % 2 == 0 else (p, m), rest))

    return turn((v % a, F.floor(v / a)), [3, 2, 1, 0] if back else [0, 1, 2, 3])


def permuted(x: Column, n: int, seed, back: bool = False) -> Column:
    """Place of x, in 0 .. n - 1, in an order of 0 .. n - 1 that the seed decides: arithmetic on x alone, without a sort or a shuffle. back: the number at place x. Null where x is null or outside.

    Places are a grid of a x b >= n with a near the square root of n. What lands outside 0 .. n - 1 is moved again until it is inside, so the mapping is one to one.
    """
    if n < 1:
        return F.lit(None).cast("long")
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    outside = a * b - n

    def inside(v: Column) -> Column:
        if not outside:
            return v
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(min(outside, WALK))), v, lambda w, _: F.when(w < n, w).otherwise(_swap(w, a, b, seed, back)))
        found = let(walk, lambda w: F.when(w < n, w).otherwise(F.raise_error(F.lit(f"no place below {n} after {WALK} steps")).cast("long")))
        return F.when(v < n, v).otherwise(found)

    x = x.cast("long")
    return F.when((x >= 0) & (x < n), let(x, lambda v: let(_swap(v, a, b, seed, back), inside)))
