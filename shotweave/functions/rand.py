"""Keyed pseudo-random numbers.

``draw(seed, k1, k2, ...)`` is a uniform number in [0, 1) computed from the
first 32 bits of ``md5(seed|k1|k2|...)``. It replaces unseeded random choices:
the value depends only on the keys, so results do not change with the number
of partitions, with retries after a lost executor, or with row order, and the
same number can be computed in any SQL engine that has md5.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _col(x) -> Column:
    if isinstance(x, Column):
        return x.cast("string")
    return F.lit(str(x))


def draw(seed, *keys) -> Column:
    """Uniform [0,1) double keyed on ``seed`` and ``keys`` (columns or literals)."""
    parts = [_col(seed)] + [_col(k) for k in keys]
    h = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8)
    return F.conv(h, 16, 10).cast("double") / F.lit(TWO_32)


def draw_sql(seed, *keys: str) -> str:
    """DuckDB/Spark SQL text of :func:`draw` (keys are SQL expressions)."""
    parts = [f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys]
    return ("(CAST(('0x' || substr(md5(concat_ws('|', " + ", ".join(parts)
            + ")), 1, 8)) AS UBIGINT) / 4294967296.0)")


# A stream of draws per key: one md5 gives two seeds, and the i-th draw is a fixed function of the seeds and i, in
# whole numbers below 2**31 whose products fit a long. Any engine computes the same, and a caller may start anywhere.
PRIME = 2147483647
STEP, MIX = 1566083941, 48271


def seed_pair(*keys) -> tuple[int, int]:
    """The two seeds of a key, in Python."""
    h = hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()
    return int(h[:7], 16), int(h[7:14], 16)


def stream(seeds: tuple[int, int], first: int, count: int) -> np.ndarray:
    """Draws ``first`` to ``first + count - 1`` of a stream, uniform in [0, 1)."""
    s1, s2 = seeds
    i = np.arange(first, first + count, dtype=np.int64)
    z = (s1 + (i + 1) * STEP) % PRIME
    z = (z * z + s2) % PRIME
    z = (z * MIX + s1) % PRIME
    return (z * z + i) % PRIME / PRIME


def seed_columns(*keys) -> tuple[Column, Column]:
    """``seed_pair`` of columns or literals."""
    h = F.md5(F.concat_ws("|", *[_col(k) for k in keys]))
    return tuple(F.conv(F.substring(h, at, 7), 16, 10).cast("long") for at in (1, 8))


def stream_column(s1: Column, s2: Column, i: Column) -> Column:
    """Draw ``i`` of the stream with the seeds ``s1, s2``."""
    z = (s1 + (i + 1) * F.lit(STEP).cast("long")) % PRIME
    z = (z * z + s2) % PRIME
    z = (z * MIX + s1) % PRIME
    return ((z * z + i) % PRIME).cast("double") / PRIME


def stream_lists(s1: Column, s2: Column, count: Column) -> Column:
    """``array<double>``: the first ``count`` draws of each row's stream, the same as ``stream_column``'s, a batch of rows at once."""
    def draws(s1: pa.Array, s2: pa.Array, count: pa.Array) -> pa.Array:
        s1, s2, size = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (s1, s2, count))
        begin = np.r_[0, np.cumsum(size)]
        i = np.arange(begin[-1]) - np.repeat(begin[:-1], size)
        s1, s2 = np.repeat(s1, size), np.repeat(s2, size)
        z = (s1 + (i + 1) * STEP) % PRIME
        z = (z * z + s2) % PRIME
        z = (z * MIX + s1) % PRIME
        return pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array((z * z + i) % PRIME / PRIME))
    return F.arrow_udf(draws, "array<double>")(s1, s2, count)


def seeds_sql(*keys: str) -> str:
    """SQL text of ``seed_pair`` as two columns ``s1, s2`` (keys are SQL expressions)."""
    h = "md5(concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + "))"
    return ", ".join(f"CAST(('0x' || substr({h}, {1 + 7 * j}, 7)) AS BIGINT) AS s{j + 1}" for j in range(2))


def stream_sql(i: str, s1: str = "s1", s2: str = "s2") -> str:
    """SQL text of draw ``i`` (a BIGINT expression) of the stream with the seeds ``s1, s2``."""
    z = f"(({s1} + (({i}) + 1) * {STEP}) % {PRIME})"
    z = f"(({z} * {z} + {s2}) % {PRIME})"
    z = f"(({z} * {MIX} + {s1}) % {PRIME})"
    return f"(CAST(({z} * {z} + ({i})) % {PRIME} AS DOUBLE) / {PRIME})"
