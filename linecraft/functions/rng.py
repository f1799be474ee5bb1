"""Deterministic randomness as column expressions.

A draw is a pure function of (seed, stream, key...), never of partitioning or task
attempt, so retried tasks and re-planned queries give identical rows.

    h(seed, stream, id...) = first 32 bits of md5("seed:stream:id...") as a non-negative long

``sql_h`` renders the same formula for DuckDB so oracle queries can recompute it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _as_str(c) -> Column:
    if isinstance(c, Column):
        return c.cast("string")
    return F.lit(str(c))


def h(seed, stream: str, *keys) -> Column:
    """32-bit hash in [0, 2^32) of seed, stream name and key columns."""
    s = F.concat_ws(":", _as_str(seed), F.lit(stream), *[_as_str(k) for k in keys])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def randint(lo, hi, seed, stream: str, *keys) -> Column:
    """Uniform integer in [lo, hi] (both inclusive; lo/hi may be columns)."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return (lo_c + F.pmod(h(seed, stream, *keys), hi_c - lo_c + 1)).cast("bigint")


def uniform(seed, stream: str, *keys) -> Column:
    """Uniform double in [0, 1)."""
    return h(seed, stream, *keys) / F.lit(TWO32)


def h_py(seed, stream: str, *keys) -> int:
    """The same hash in plain Python, for small driver-side parameter tables."""
    s = ":".join([str(seed), stream] + [str(k) for k in keys])
    return int(hashlib.md5(s.encode("utf-8")).hexdigest()[:8], 16)


def sql_h(seed, stream: str, *key_sql: str) -> str:
    """DuckDB twin of :func:`h`; ``key_sql`` are SQL expressions."""
    parts = [f"'{seed}'", f"'{stream}'"] + [f"CAST({k} AS VARCHAR)" for k in key_sql]
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT"
