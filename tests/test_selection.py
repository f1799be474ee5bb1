"""Selection of the first n rows: exact on ties, nulls and any type, without copying the table."""

import datetime
import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from linecraft.operators import generate as GEN
from linecraft.operators import ordering as O
from linecraft.operators import selection as S

SMALL = {"sample": 30, "few": 10}  # several rounds on small tables


@pytest.mark.parametrize("n", [1, 2, 17, 500, 998, 1000])
def test_nth_key_unique(spark, n):
    df = spark.range(0, 3000, 3, numPartitions=7).select(F.reverse(F.col("id").cast("string")).alias("k"))
    keys = sorted(r.k for r in df.collect())
    assert S.nth_key(df, n, **SMALL) == S.Cut(Row(keys[n - 1]), n - 1, 1)


def test_nth_key_ties_nulls_types(spark):
    rnd = random.Random(4)
    day = datetime.date(2024, 1, 1)
    rows = [(rnd.choice([None, 1.5, float("nan"), -2.0, 7.0]), rnd.choice([None, "a", "b", "é"]),
             rnd.choice([None, day, datetime.date(2020, 2, 2)])) for _ in range(900)] + [(1.5, "a", day)] * 600
    df = spark.createDataFrame(rows, "x double, s string, d date").repartition(5)
    order = [tuple(r) for r in df.orderBy("x", "s", "d").collect()]
    for n in (1, 100, 400, 750, 1100, 1500):
        cut = S.nth_key(df, n, **SMALL)
        assert repr(tuple(cut.key)) == repr(order[n - 1])
        assert cut.below < n <= cut.below + cut.equal
    assert S.nth_key(df, 1501) is None
    with pytest.raises(ValueError):
        S.nth_key(df, 0)


@pytest.mark.parametrize("n", [0, 1, 5, 333, 700, 999, 1000, 5000])
def test_first_rows_with_hot_key_and_equal_rows(spark, n):
    rnd = random.Random(9)
    rows = [(rnd.choice([None, 3, 3, 3, 4]), rnd.choice(["p", "q"]), {"m": rnd.randint(0, 1)}, [rnd.randint(0, 1)])
            for _ in range(1000)]
    df = spark.createDataFrame(rows, "k int, t string, m map<string,int>, a array<int>").repartition(6)
    got = S.first_rows(df, [F.col("k")], n, **SMALL)
    assert got.columns == df.columns
    got = got.collect()
    want = df.orderBy("k").limit(n).collect()
    count = lambda rs: sorted(repr(r.k) for r in rs)
    assert count(got) == count(want)
    every = sorted(map(repr, rows))
    for r in {repr(tuple(r)) for r in got}:  # no row more often than it is there
        assert sum(repr(tuple(x)) == r for x in got) <= every.count(r)


def test_first_rows_does_not_depend_on_partitions(spark):
    rows = [(i % 3, i) for i in range(500)]
    a, b = (sorted(map(tuple, S.first_rows(spark.createDataFrame(rows, "k int, v int").repartition(p),
                                           [F.col("k")], 200, **SMALL).collect())) for p in (1, 11))
    assert a == b and len(a) == 200


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs)


def test_samples_write_almost_nothing(spark, tmpdir_path):
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.md5(F.concat("id", i.cast("string")))))
    spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(text, F.lit(". One two three. Four five. "), text).alias("text")) \
        .write.parquet(f"{tmpdir_path}/docs")
    docs = spark.read.parquet(f"{tmpdir_path}/docs")
    size, scratch = _bytes(f"{tmpdir_path}/docs"), spark.conf.get("spark.checkpoint.dir")
    before = _bytes(scratch)
    assert O.sample_rows(docs, "doc_id", 5).count() == 5
    assert _bytes(scratch) == before
    plan = O.sample_rows(docs, "doc_id", 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Filter" in plan  # a filter of the scan
    assert O.first_n(docs, ["doc_id"], 5).count() == 5
    assert _bytes(scratch) - before < 0.01 * size
    assert GEN.article_sentences(docs, 10, min_words=1).count() == 10
    assert _bytes(scratch) - before < 0.08 * size  # 64 articles of 3,000 and the keys


def test_article_sentences_run_out(spark):
    docs = spark.createDataFrame([(i, "one two. three four five. x") for i in range(200)], "doc_id long, text string")
    assert GEN.article_sentences(docs, 10_000, min_words=1).count() == 400
    some = GEN.article_sentences(docs, 300, min_words=1).collect()  # the first 64 articles hold too few
    assert len(some) == 300
    assert max(r.article_rank for r in some) == 149


def test_first_column_reaches_the_scan(spark, tmpdir_path):
    spark.range(1000).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("t")).write.parquet(f"{tmpdir_path}/t")
    out = O.first_n(spark.read.parquet(f"{tmpdir_path}/t"), ["k"], 10)
    assert "LessThanOrEqual(k," in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.k for r in out.collect()) == list(range(10))


def test_cluster_needs_a_shared_folder():
    from linecraft.session import ensure_checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
