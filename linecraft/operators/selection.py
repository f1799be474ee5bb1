"""The n-th row of an order and the rows before it, without sorting or copying the table.

``nth_key`` narrows an open interval of keys that holds the n-th one. Each round draws a bounded
sample of the keys inside, takes two of them that should lie on either side of the n-th, and
counts the rows below and at both in one aggregate (a row per task is shuffled). The interval
shrinks by about the root of the sample's size a round; once it holds few distinct keys they are
counted one by one. Samples steer the search only: counts are exact, so is the result.

``first_rows`` then is a filter: the rows below the n-th key and as many of those equal to it as
are left, told apart by a hash of the whole row. Rows equal in every column are interchangeable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

SAMPLE = 4_096   # keys drawn a round
FEW = 16_384     # distinct keys counted one by one


@dataclass(frozen=True)
class Cut:
    """The n-th key, the number of rows below it and of rows equal to it."""
    key: Row
    below: int
    equal: int


def _literal(df: DataFrame, key: Row) -> Column:
    """``key`` as a struct of the columns of ``df``; nulls and types as there."""
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(df.schema.fields, key, strict=True)])


def _first_column(df: DataFrame, key: Row) -> Column:
    """What the first column says about rows up to ``key``: a filter that a scan can use."""
    name, kind = df.columns[0], df.schema.fields[0].dataType
    none = F.col(name).isNull()
    return none if key[0] is None else none | (F.col(name) <= F.lit(key[0]).cast(kind))


def nth_key(keys: DataFrame, n: int, sample: int = SAMPLE, few: int = FEW) -> Cut | None:
    """The n-th (from 1) key in Spark's ascending order, nulls first; None if there are fewer rows.

    ``keys`` holds the key's columns only and is evaluated about three times for any number of
    rows; pass a stored table if that is dear. A key that many rows share ends the search early.
    """
    if n < 1:
        raise ValueError("n counts from 1")
    names = keys.columns
    whole = F.struct(*names)
    low = high = None
    below, inside, share = 0, keys.count(), 1.0
    if inside < n:
        return None
    while True:
        rows = keys
        if low is not None:
            rows = rows.where(whole > _literal(keys, low))
        if high is not None:
            rows = rows.where(_first_column(keys, high) & (whole < _literal(keys, high)))
        if inside <= few:
            for r in rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).orderBy(*names).collect():
                if below + r["_n"] >= n:
                    return Cut(Row(*r[:-1]), below, r["_n"])
                below += r["_n"]
            raise RuntimeError("the keys changed while they were counted")
        share = min(1.0, sample / inside)
        drawn = rows.sample(share).orderBy(*names).collect()  # about `sample` keys
        if not drawn:
            continue
        at, slack = (n - below) / inside * len(drawn), 2 * len(drawn) ** 0.5 + 1
        tried = [drawn[max(0, int(at - slack))], drawn[min(len(drawn) - 1, int(at + slack))]]
        sums = [F.coalesce(F.sum(cond.cast("long")), F.lit(0)) for k in tried
                for cond in (whole < _literal(keys, k), whole == _literal(keys, k))]
        counts = rows.agg(*[s.alias(f"c{i}") for i, s in enumerate(sums)]).first()
        left, right, goal = 0, inside, n - below
        for k, less, same in ((tried[0], *counts[:2]), (tried[1], *counts[2:])):
            if less < goal <= less + same:
                return Cut(Row(*k), below + less, same)
            if goal > less + same and less + same >= left:
                low, left = k, less + same
            elif goal <= less and less <= right:
                high, right = k, less
        below, inside = below + left, right - left


def row_hash(df: DataFrame) -> Column:
    """64 bits of a whole row; maps by their sorted entries."""
    return F.xxhash64(*[F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, MapType) else F.col(f.name)
                        for f in df.schema.fields])


def up_to(df: DataFrame, keys: DataFrame, columns: list[Column], cut: Cut, with_equal: bool) -> DataFrame:
    """Rows of ``df`` whose key (``columns``, typed as ``keys``) lies below the cut, or also at it."""
    whole = F.struct(*[c.alias(n) for c, n in zip(columns, keys.columns, strict=True)])
    edge = _literal(keys, cut.key)
    first = columns[0].isNull() if cut.key[0] is None else \
        columns[0].isNull() | (columns[0] <= F.lit(cut.key[0]).cast(keys.schema.fields[0].dataType))
    return df.where(first & ((whole <= edge) if with_equal else (whole < edge)))


def first_rows(df: DataFrame, columns: list[Column], n: int, keys: DataFrame | None = None, **search) -> DataFrame:
    """The first ``n`` rows of ``df`` in the order of ``columns`` (all if there are fewer), in no order.

    ``keys`` may hold the evaluated order columns of all rows, if they are dear to compute. Of rows
    with equal keys those with the smaller row hash come first.
    """
    if n <= 0:
        return df.limit(0)
    if keys is None:
        keys = df.select(*[c.alias(f"_k{i}") for i, c in enumerate(columns)])
    cut = nth_key(keys, n, **search)
    if cut is None:
        return df
    if cut.below + cut.equal == n:
        return up_to(df, keys, columns, cut, True)
    whole = F.struct(*[c.alias(k) for c, k in zip(columns, keys.columns, strict=True)])
    ties = df.where(whole == _literal(keys, cut.key)).withColumn("_tie", row_hash(df))
    left = n - cut.below
    at = nth_key(ties.select("_tie"), left, **search)
    out = up_to(df, keys, columns, cut, False).unionByName(ties.where(F.col("_tie") < at.key[0]).drop("_tie"))
    same = ties.where(F.col("_tie") == at.key[0]).drop("_tie")
    if at.below + at.equal > left:  # equal rows: one of them, as often as needed
        copies = F.explode(F.sequence(F.lit(1), F.lit(left - at.below)))
        same = same.limit(1).select("*", copies.alias("_copy")).drop("_copy")
    return out.unionByName(same)
