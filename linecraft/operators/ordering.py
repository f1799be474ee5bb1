"""Global order without single-task windows.

A bare ``Window.orderBy`` moves every row into one task. Here an index takes three steps:

1. the input is evaluated once and written to the shared checkpoint folder with a row number;
2. its order key and row number (narrow) are dealt out in ranges of the *whole* key and a
   tie-breaker, sorted, numbered within each range and written. The number is stored, so a
   retry or another plan can't move a row. Null keys are ordinary keys in Spark's sort order;
   a key with two values, a common prefix or many equal rows still spreads over all ranges;
3. totals of the ranges (a row each) become offsets, broadcast to the rows.

The index then meets the wide rows on the row number. Tables without wide columns skip that join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, ByteType, DateType, DoubleType, FloatType, IntegerType, LongType,
                               ShortType, TimestampType)

from linecraft.functions.rng import h
from linecraft.operators.selection import first_rows
from linecraft.session import ensure_checkpoint_dir

_ROW, _ID, _RANGE = "_lc_row", "_lc_id", "_lc_range"
_FIXED = (BooleanType, ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType, DateType, TimestampType)


def written(df: DataFrame, name: str = "ordered", compression: str = "snappy") -> DataFrame:
    """Evaluate once: written under the shared checkpoint folder and read back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def _cols(order):
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _ranges(df: DataFrame, n_buckets: int | None) -> int:
    return n_buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _sorted_keys(df: DataFrame, order, weights: dict[str, Column], n_buckets: int | None):
    """(wide rows or None, narrow sorted rows with ``_lc_id``).

    ``_lc_id`` holds the range in its upper bits and the place within it in the lower 33, as
    ``monotonically_increasing_id`` defines it, stored when the sorted rows are written.
    """
    narrow = all(isinstance(f.dataType, _FIXED) for f in df.schema.fields)
    base = df if narrow else written(df.withColumn(_ROW, F.monotonically_increasing_id()))
    keys = [c.alias(f"_lc_o{i}") for i, c in enumerate(_cols(order))]
    carried = df.columns if narrow else [_ROW]
    # equal keys: by a hash of the row, or where that would read wide columns by the stored row number
    tie = F.xxhash64(*df.columns) if narrow else F.col(_ROW)
    k = base.select(*carried, *keys, *[w.cast("long").alias(n) for n, w in weights.items()],
                    tie.alias("_lc_tie"))
    by = [f"_lc_o{i}" for i in range(len(keys))] + ["_lc_tie"]
    out = (k.repartitionByRange(_ranges(df, n_buckets), *by).sortWithinPartitions(*by)
           .withColumn(_ID, F.monotonically_increasing_id()).drop(*by))
    out = written(out)
    return (None if narrow else base), out.withColumn(_RANGE, F.shiftright(_ID, 33).cast("int"))


def _offsets(rows: DataFrame, sums: dict[str, Column], totals: dict[str, str]) -> DataFrame:
    """Per range, the sums over all earlier ranges; ``totals`` are over all. A row per range."""
    per = rows.groupBy(_RANGE).agg(*[c.alias(n) for n, c in sums.items()])
    # One row per range: a table of at most as many rows as ranges were asked for.
    before = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(_RANGE, *[F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long").alias(n) for n in sums],
                      *[F.coalesce(F.sum(n).over(Window.partitionBy()), F.lit(0)).cast("long").alias(t)
                        for t, n in totals.items()])


def _joined(base: DataFrame | None, index: DataFrame, columns, added) -> DataFrame:
    if base is None:
        return index.select(*columns, *added)
    return base.join(index.select(_ROW, *added), _ROW).select(*columns, *added)


def prefix_sum(df: DataFrame, order, weight: Column | str | None = None, out: str = "idx",
               inclusive: bool = False, n_buckets: int | None = None, total: str | None = None) -> DataFrame:
    """Running total of ``weight`` (default 1) over the total order ``order``.

    ``inclusive=False`` gives the sum over strictly earlier rows (an offset / 0-based index).
    ``total`` names an optional column with the grand total. A null weight counts as 0.
    """
    w = F.lit(1) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    base, rows = _sorted_keys(df, list(order), {"_lc_w": F.coalesce(w, F.lit(0))}, n_buckets)
    offs = _offsets(rows, {"_lc_off": F.sum("_lc_w")}, {total: "_lc_off"} if total else {})
    frame = Window.partitionBy(_RANGE).orderBy(_ID).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = F.coalesce(F.sum("_lc_w").over(frame), F.lit(0))
    index = rows.withColumn("_lc_local", local).join(F.broadcast(offs), _RANGE).withColumn(
        "_lc_out", (F.col("_lc_off") + F.col("_lc_local")).cast("long"))
    added = [F.col("_lc_out").alias(out)] + ([total] if total else [])
    return _joined(base, index.select(*[c for c in index.columns if c != "_lc_out"], added[0]),
                   [c for c in df.columns if c not in (out, total)], [out] + added[1:])


def keyed_prefix_sums(df: DataFrame, key: str, seq: str, weights: dict, inclusive: dict | None = None,
                      totals: dict | None = None, n_buckets: int | None = None) -> DataFrame:
    """Running sums of several weights within each key, ordered by ``seq``, skew-safe.

    Rows are dealt out in ranges of (key, seq), so a hot key is split over many tasks and
    ``seq`` may be any ordered value. A window sums within (range, key); what a key has in
    earlier ranges (one row per range and key, an aggregate) is added by a join on the same
    pair, which no hot key can crowd. ``weights`` maps output name -> weight column;
    ``inclusive`` maps output name -> whether the current row counts; ``totals`` maps output
    name -> weight column summed over the whole key. Null keys are one key.
    """
    inclusive, totals = inclusive or {}, totals or {}
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    sums = {f"_lc_w{i}": as_col(w) for i, w in enumerate([*weights.values(), *totals.values()])}
    base, rows = _sorted_keys(df, [key, seq], {**sums, "_lc_one": F.lit(1)}, n_buckets)
    if base is not None:  # the key itself, which may be wide, comes back by the row number
        rows = rows.join(base.select(_ROW, key), _ROW)
    rows = rows.withColumnRenamed(key, "_lc_key") if base is not None else rows.withColumn("_lc_key", F.col(key))
    per = rows.groupBy(_RANGE, "_lc_key").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.partitionBy("_lc_key").orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("_lc_key")
    n = len(weights)
    carry = per.select(
        F.col(_RANGE).alias("_lc_r"), F.col("_lc_key").alias("_lc_k"),
        *[F.coalesce(F.sum(f"_lc_w{i}").over(earlier), F.lit(0)).cast("long").alias(f"_lc_c{i}") for i in range(n)],
        *[F.sum(f"_lc_w{n + i}").over(every).cast("long").alias(t) for i, t in enumerate(totals)])
    local = Window.partitionBy(_RANGE, "_lc_key").orderBy(_ID).rowsBetween(Window.unboundedPreceding, -1)
    named = rows.select("*", *[(F.coalesce(F.sum(f"_lc_w{i}").over(local), F.lit(0))
                               + (F.col(f"_lc_w{i}") if inclusive.get(name) else F.lit(0))).alias(f"_lc_l{i}")
                               for i, name in enumerate(weights)])
    met = named.join(carry, (F.col(_RANGE) == F.col("_lc_r")) & F.col("_lc_key").eqNullSafe(F.col("_lc_k")))
    outs = [(F.col(f"_lc_l{i}") + F.col(f"_lc_c{i}")).cast("long").alias(name) for i, name in enumerate(weights)]
    new = [*weights, *totals]
    index = met.select(*([_ROW] if base is not None else [c for c in df.columns if c not in new]), *outs, *totals)
    return _joined(base, index, [c for c in df.columns if c not in new], new)


def global_index(df: DataFrame, order, out: str = "idx", n_buckets: int | None = None,
                 total: str | None = None) -> DataFrame:
    """0-based position of every row in the total order ``order``.

    Equal keys keep one of their orders. ``total`` names an optional column holding
    the number of rows.
    """
    base, rows = _sorted_keys(df, list(order), {}, n_buckets)
    offs = _offsets(rows, {"_lc_off": F.count(F.lit(1))}, {total: "_lc_off"} if total else {})
    index = rows.join(F.broadcast(offs), _RANGE).withColumn(
        "_lc_out", F.col("_lc_off") + F.col(_ID).bitwiseAND((1 << 33) - 1))
    keep = [c for c in df.columns if c not in (out, total)]
    index = index.drop(out).withColumnRenamed("_lc_out", out)
    return _joined(base, index, keep, [out] + ([total] if total else []))


def hashed_index(df: DataFrame, seed, stream: str, key: str, out: str = "idx",
                 n_buckets: int | None = None, total: str | None = None) -> DataFrame:
    """Index in the seeded shuffled order (h(seed, stream, key), key)."""
    return global_index(df, [h(seed, stream, F.col(key)), key], out, n_buckets, total=total)


def first_n(df: DataFrame, order, n: int, rescan: bool = False) -> DataFrame:
    """The first n rows in ``order`` (a count limit is the feature here), by selection.

    Nothing but the order columns is written, and with ``rescan`` not even these: the input is
    read anew for each of about three counts, which suits tables whose keys are cheap to scan.
    """
    columns = _cols(order)
    keys = None if rescan else written(df.select(*[c.alias(f"_k{i}") for i, c in enumerate(columns)]), "keys")
    return first_rows(df, columns, n, keys)


def prefix_split(df: DataFrame, order, test_split: float, out: str = "split") -> DataFrame:
    """train = first int(n*(1-t)) rows in listing order, eval = the rest."""
    cut = F.floor(F.col("_lc_n") * F.lit(1 - test_split))
    return (global_index(df, order, "_lc_i", total="_lc_n")
            .withColumn(out, F.when(F.col("_lc_i") < cut, "train").otherwise("test"))
            .drop("_lc_i", "_lc_n"))


def seeded_split(df: DataFrame, key: str, test_split: float, seed: int = 42,
                 out: str = "split") -> DataFrame:
    """Exact-size shuffled split; the first ceil(t*n) rows of the seeded order are test."""
    # ceil(t * n) from the range totals of the same index computation (no count job)
    cut = F.ceil(F.col("_lc_n") * F.lit(test_split))
    return (hashed_index(df, seed, "split", key, "_lc_i", total="_lc_n")
            .withColumn(out, F.when(F.col("_lc_i") < cut, "test").otherwise("train"))
            .drop("_lc_i", "_lc_n"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """a uniform sample of exactly n rows when the table is larger, else all rows.

    The sample is the first n rows of the seeded order (h(seed, 'sample', key), key); it is a
    filter of ``df``, nothing is written.
    """
    return first_rows(df, [h(seed, "sample", F.col(key)), F.col(key)], n)


def training_batches(df: DataFrame, key: str, batch_size: int, epoch: int = 0,
                     seed: int = 42, shuffle: bool = True, order=None) -> DataFrame:
    """Per-epoch shuffled (or kept) order cut into batches of ``batch_size``."""
    if shuffle:
        idx = hashed_index(df, seed, f"epoch{epoch}", key, "pos")
    else:
        idx = global_index(df, order or [key], "pos")
    return (idx.withColumn("epoch", F.lit(epoch))
            .withColumn("batch", F.floor(F.col("pos") / batch_size).cast("long")))


def skip_batches(df: DataFrame, epoch: int, n: int) -> DataFrame:
    """On resume, leave out the first n batches of that epoch only."""
    return df.where((F.col("epoch") != epoch) | (F.col("batch") >= n))
