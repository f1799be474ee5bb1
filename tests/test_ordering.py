"""Global index, splits and samples: exact sizes, 0..n-1 and partition invariance."""

import math

import pytest
from pyspark.sql import functions as F

from linecraft.operators import ordering as O


def _ids(spark, n, parts):
    return spark.range(0, n * 3, 3, numPartitions=parts).withColumnRenamed("id", "k")


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_global_index_is_dense_and_ordered(spark, parts):
    df = O.global_index(_ids(spark, 500, parts), ["k"], "idx", n_buckets=7)
    rows = sorted((r.k, r.idx) for r in df.collect())
    assert [i for _, i in rows] == list(range(500))


def test_global_index_string_key(spark):
    words = ["b", "a", "éclair", "zeta", "Z", "aa", "", "ß"]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(3)
    got = {r.w: r.idx for r in O.global_index(df, ["w"], "idx", n_buckets=4).collect()}
    assert [w for w, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(words, key=lambda s: s.encode())


def test_prefix_sum_weights(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(100)], "k long, w long").repartition(5)
    got = {r.k: r.off for r in O.prefix_sum(df, ["k"], "w", "off", n_buckets=6).collect()}
    run = 0
    for k in range(100):
        assert got[k] == run
        run += k % 4


@pytest.mark.parametrize("n", [1, 19, 20, 21, 1000])
@pytest.mark.parametrize("t", [0.05, 0.2])
def test_seeded_split_exact(spark, n, t):
    df = _ids(spark, n, 3)
    out = O.seeded_split(df, "k", t, seed=42).collect()
    n_test = sum(1 for r in out if r.split == "test")
    assert n_test == math.ceil(t * n)
    assert len(out) == n


def test_seeded_split_partition_invariant(spark):
    a = {r.k: r.split for r in O.seeded_split(_ids(spark, 300, 1), "k", 0.1).collect()}
    b = {r.k: r.split for r in O.seeded_split(_ids(spark, 300, 13), "k", 0.1).collect()}
    assert a == b


def test_prefix_split(spark):
    out = {r.k: r.split for r in O.prefix_split(_ids(spark, 21, 4), ["k"], 0.2).collect()}
    cut = int(21 * 0.8)
    assert all((s == "train") == (k // 3 < cut) for k, s in out.items())


def test_sample_rows_exact(spark):
    df = _ids(spark, 100, 4)
    assert O.sample_rows(df, "k", 30).count() == 30
    assert O.sample_rows(df, "k", 300).count() == 100
    a = sorted(r.k for r in O.sample_rows(_ids(spark, 100, 1), "k", 30).collect())
    b = sorted(r.k for r in O.sample_rows(_ids(spark, 100, 7), "k", 30).collect())
    assert a == b


def test_first_n(spark):
    df = _ids(spark, 50, 3)
    assert sorted(r.k for r in O.first_n(df, ["k"], 5).collect()) == [0, 3, 6, 9, 12]


def test_batches_and_skip(spark):
    b = O.training_batches(_ids(spark, 100, 3), "k", 8, epoch=2)
    rows = b.collect()
    assert sorted(r.pos for r in rows) == list(range(100))
    assert max(r.batch for r in rows) == 12
    kept = O.skip_batches(b, 2, 3).collect()
    assert len(kept) == 100 - 24
    other = O.skip_batches(b, 1, 3).count()
    assert other == 100
    keep_order = O.training_batches(_ids(spark, 10, 2), "k", 4, shuffle=False).collect()
    assert {r.k: r.batch for r in keep_order} == {3 * i: i // 4 for i in range(10)}


def test_keyed_prefix_sums_hot_key(spark):
    # key 0 holds more than a third of all rows
    rows = [(0 if i % 2 == 0 else i % 7, i, i % 5, int(i % 3 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, s long, w long, f int").repartition(9)
    out = O.keyed_prefix_sums(df, "k", "s", {"run": "w", "flags_before": "f"},
                              inclusive={"run": True}, totals={"tot": "w"}, n_buckets=8).collect()
    exp = {}
    for k in {r[0] for r in rows}:
        acc_w, acc_f = 0, 0
        tot = sum(r[2] for r in rows if r[0] == k)
        for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            acc_w += r[2]
            exp[(k, r[1])] = (acc_w, acc_f, tot)
            acc_f += r[3]
    assert {(r.k, r.s): (r.run, r.flags_before, r.tot) for r in out} == exp


@pytest.mark.parametrize("n", [1, 3, 37])
def test_sample_rows_is_first_n_of_seeded_order(spark, n):
    from linecraft.functions.rng import h_py
    df = _ids(spark, 1000, 5)
    got = sorted(r.k for r in O.sample_rows(df, "k", n, seed=7).collect())
    exp = sorted(sorted(range(0, 3000, 3), key=lambda k: (h_py(7, "sample", k), k))[:n])
    assert got == exp


def test_spread_only_when_scan_is_narrow(spark):
    from linecraft.session import spread
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == cores
    many = spark.range(0, 100, 1, cores * 2)
    assert spread(many).rdd.getNumPartitions() == cores * 2


def _shares(spark, df, order):
    _, rows = O._sorted_keys(df, order, {}, 16)
    return [r["count"] for r in rows.groupBy(O._RANGE).count().collect()]


def test_null_keys_are_kept_and_first(spark):
    df = spark.createDataFrame([(None if i % 10 == 0 else i, f"t{i}") for i in range(200)], "k long, t string")
    rows = sorted((r.idx, r.k) for r in O.global_index(df.repartition(5), ["k"], "idx").collect())
    assert [i for i, _ in rows] == list(range(200))
    assert all(k is None for _, k in rows[:20]) and [k for _, k in rows[20:]] == sorted(k for _, k in rows[20:])


def test_two_valued_leading_key_spreads(spark):
    df = spark.range(4000).select((F.col("id") % 2).alias("c"), F.col("id").alias("s"))
    counts = _shares(spark, df, ["c", "s"])
    assert len(counts) >= 12 and max(counts) < 4000 / 5
    got = [tuple(r) for r in O.global_index(df, ["c", "s"], "idx").orderBy("idx").select("c", "s").collect()]
    assert got == sorted(got)


def test_long_common_prefix_spreads(spark):
    df = spark.range(1000).select(F.format_string("file:///store/data/part/%06d.txt", "id").alias("path"))
    assert max(_shares(spark, df, ["path"])) < 200
    got = [r.path for r in O.global_index(df, ["path"], "idx").orderBy("idx").collect()]
    assert got == sorted(got)


def test_one_key_with_all_rows_spreads(spark):
    df = spark.range(2000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    assert max(_shares(spark, df, ["k"])) < 400


def test_keyed_prefix_sums_above_two_to_31(spark):
    step = 1 << 33
    rows = [(None if i % 3 == 0 else i % 5, i * step, 1) for i in range(900)]
    df = spark.createDataFrame(rows, "k long, s long, w long").repartition(7)
    out = O.keyed_prefix_sums(df, "k", "s", {"run": "w"}, {"run": True}, {"tot": "w"}).collect()
    seen, exp = {}, {}
    for k, s, _ in rows:
        seen[k] = seen.get(k, 0) + 1
        exp[(k, s)] = seen[k]
    assert {(r.k, r.s): r.run for r in out} == exp
    assert all(r.tot == seen[r.k] for r in out)


def test_keyed_prefix_sums_carries_wide_columns(spark):
    df = spark.createDataFrame([("a", 2, 5, "x"), ("a", 1, 3, "y"), (None, 1, 4, "z")], "k string, s long, w long, t string")
    out = {r.t: r.before for r in O.keyed_prefix_sums(df, "k", "s", {"before": "w"}).collect()}
    assert out == {"x": 3, "y": 0, "z": 0}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k long, t string")
    assert O.global_index(df, ["k"], "idx", total="n").count() == 0
    assert O.prefix_sum(df, ["k"], None, "off").count() == 0
