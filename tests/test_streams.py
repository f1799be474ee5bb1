"""Streams equal batch: K1 rate samples, K2 running error rates, K3 file recognition."""

import os
import time

import pandas as pd
from pyspark.sql import functions as F

from linecraft.operators.metrics import error_rates
from linecraft.streaming import streams as ST


def test_stream_samples_rate(spark, tmpdir_path):
    strings = spark.createDataFrame([(i, f"s{i}") for i in range(3)], "line_no long, text string")
    fonts = spark.createDataFrame([(0, "f0"), (1, "f1")], "font_no long, font string")
    q = (ST.stream_samples(spark, strings, fonts, rows_per_second=50)
         .writeStream.format("memory").queryName("k1_samples").outputMode("append").start())
    deadline = time.time() + 60
    while time.time() < deadline and spark.table("k1_samples").count() < 20:
        time.sleep(0.5)
    q.stop()
    rows = spark.table("k1_samples").collect()
    assert len(rows) >= 20
    for r in rows:
        assert r.text == f"s{r.idx % 3}" and r.font == f"f{r.idx % 2}"


def test_stream_error_rates_equal_batch(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "pairs")
    pairs = [(e, f"a b c {i}", f"a c {i}" if i % 2 else f"a b c {i}") for i in range(40) for e in (0, 1)]
    df = spark.createDataFrame(pairs, "epoch int, ref string, pred string")
    for k in range(4):
        df.where(F.col("ref").endswith(str(k))).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (ST.stream_error_rates(stream).writeStream.format("memory").queryName("k2_rates")
         .outputMode("complete").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = {r.epoch: (r.cer, r.wer, r.n_pairs) for r in spark.table("k2_rates").collect()}
    batch = {r.epoch: (r.cer, r.wer, r.n_pairs) for r in error_rates(spark.read.parquet(src), ["epoch"]).collect()}
    assert got == batch


def _fake_png_dir(root):
    for label in ("cat", "dog"):
        d = os.path.join(root, label)
        os.makedirs(d)
        for i in range(3):
            with open(os.path.join(d, f"{label}{i}.png"), "wb") as f:
                f.write(bytes([i]) * (10 + i))
    with open(os.path.join(root, "cat", ".hidden"), "wb") as f:
        f.write(b"x")


def test_stream_predict_files(spark, tmpdir_path):
    def recogniser(it):
        # stand-in model: "reads" a file as its size
        for pdf in it:
            yield pd.DataFrame({"path": pdf["path"], "text": pdf["content"].map(lambda b: f"len{len(b)}")})

    root = os.path.join(tmpdir_path, "imgs")
    _fake_png_dir(root)
    files = ST.stream_files(spark, root + "/*/", glob="*.png")
    out = os.path.join(tmpdir_path, "out")
    q = ST.stream_predict(files, recogniser, "path string, text string", out, os.path.join(tmpdir_path, "ck"))
    q.awaitTermination(120)
    got = sorted(r.text for r in spark.read.parquet(out).collect())
    assert got == sorted(["len10", "len11", "len12"] * 2)


def _drop_last_commit(checkpoint):
    """As if the driver was lost after a batch's rows were written and before it was committed."""
    folder = os.path.join(checkpoint, "commits")
    last = max(int(f) for f in os.listdir(folder) if f.isdigit())
    for f in (str(last), f".{last}.crc"):
        if os.path.exists(os.path.join(folder, f)):
            os.remove(os.path.join(folder, f))
    return last


def test_replayed_batch_leaves_no_second_row(spark, tmpdir_path):
    def recogniser(it):
        for pdf in it:
            yield pd.DataFrame({"path": pdf["path"], "text": pdf["content"].map(lambda b: f"len{len(b)}")})

    root, out, ck = (os.path.join(tmpdir_path, x) for x in ("imgs", "out", "ck"))
    _fake_png_dir(root)
    files = ST.stream_files(spark, root + "/*/", glob="*.png", max_files_per_trigger=2)
    ST.stream_predict_once(files, recogniser, "path string, text string", out, ck).awaitTermination(120)
    want = sorted(tuple(r) for r in ST.read_batches(spark, out, "path string, text string").collect())
    assert len(want) == 6 and {b for *_, b in want} == {0, 1, 2}
    assert _drop_last_commit(ck) == 2
    ST.stream_predict_once(files, recogniser, "path string, text string", out, ck).awaitTermination(120)
    assert sorted(tuple(r) for r in ST.read_batches(spark, out, "path string, text string").collect()) == want


def test_rates_go_on_after_a_restart_and_a_replay(spark, tmpdir_path):
    src, out, ck = (os.path.join(tmpdir_path, x) for x in ("pairs", "out", "ck"))
    pairs = spark.createDataFrame([(i % 3, f"a b c {i}", f"a c {i}" if i % 2 else f"a b c {i}") for i in range(60)],
                                  "epoch int, ref string, pred string").repartition(3)

    def go_on():
        stream = spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", 2).parquet(src)
        rates = ST.stream_error_rates(stream)
        ST.each_batch_once(rates, out, ck, "update").awaitTermination(120)
        return ST.latest_by(ST.read_batches(spark, out, rates.schema), ["epoch"])

    pairs.where("ref like '%1'").write.parquet(src)
    first = {r.epoch: r.n_pairs for r in go_on().collect()}
    assert sum(first.values()) == 6
    pairs.where("ref not like '%1'").write.mode("append").parquet(src)
    go_on()
    _drop_last_commit(ck)
    got = sorted(tuple(r) for r in go_on().collect())
    want = error_rates(spark.read.parquet(src), ["epoch"])
    assert got == sorted(tuple(r) for r in want.select(*go_on().columns).collect())


def test_no_batches(spark, tmpdir_path):
    assert ST.read_batches(spark, os.path.join(tmpdir_path, "none"), "a int").count() == 0


def test_samples_by_batch_resume(spark, tmpdir_path):
    strings = spark.createDataFrame([(i, f"s{i}") for i in range(3)], "line_no long, text string")
    fonts = spark.createDataFrame([(0, "f0"), (1, "f1")], "font_no long, font string")
    samples = ST.stream_samples(spark, strings, fonts, rows_per_batch=10).select("idx", "text", "font")
    out, ck = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ck")
    for _ in range(2):
        ST.each_batch_once(samples, out, ck, trigger={"once": True}).awaitTermination(120)
    rows = ST.read_batches(spark, out, samples.schema).collect()
    assert sorted(r.idx for r in rows) == list(range(20))
    assert all(r.text == f"s{r.idx % 3}" and r.font == f"f{r.idx % 2}" for r in rows)


def test_error_rates_of_short_pairs_stay_in_the_jvm(spark):
    rows = [(i % 2, "a b c d", "a x d" if i % 3 else "a b c d") for i in range(12)]
    pairs = spark.createDataFrame(rows, "epoch int, ref string, pred string")
    rates = ST.stream_error_rates(pairs, short=True)
    assert "ArrowEvalPython" not in rates._jdf.queryExecution().toString()
    assert sorted(map(tuple, rates.collect())) == sorted(map(tuple, ST.stream_error_rates(pairs).collect()))


def test_scores_by_lang_read_every_core_a_batch_and_cut_chunks_once(spark, tmpdir_path, monkeypatch):
    from linecraft import catalog_files as CF
    docs = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(40)), "en" if i % 2 else "de") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmpdir_path}/documents.parquet")
    cut, batches = [], []
    once, read = CF.S.chunk_pairs, ST.each_batch_once
    monkeypatch.setattr(CF.S, "chunk_pairs", lambda *a, **k: cut.append(1) or once(*a, **k).repartition(20))

    def counted(*a, **k):
        q = read(*a, **k)
        batches.append(q)
        return q
    monkeypatch.setattr(CF.ST, "each_batch_once", counted)
    got = {r.lang: r.n_pairs for r in CF.q_stream_score_by_lang(spark, tmpdir_path).collect()}
    monkeypatch.undo()
    want = {r.lang: r.n_pairs for r in CF.S.score_by(CF._docs(spark, tmpdir_path), ["lang"]).collect()}
    assert got == want and sum(got.values()) > 20
    assert len(cut) == 1
    assert all(len([p for p in q.recentProgress if p["numInputRows"]]) <= 2 for q in batches)


def test_sample_job_moves_no_strings(spark, tmpdir_path):
    for keys in (range(7), range(3, 24, 3)):  # numbered already, and not
        strings = spark.createDataFrame([(k, f"s{i}") for i, k in enumerate(keys)], "line_no long, text string").repartition(3)
        fonts = spark.createDataFrame([(0, "f0"), (1, "f1"), (2, "f2")], "font_no long, font string")
        job, n = ST.sample_job(strings, fonts)
        assert n == 7
        for idx in (range(0), range(4), range(5, 40), [3, 3, 9], [3, 3, 6, 6]):  # consecutive or not
            batch = spark.createDataFrame([(i,) for i in idx], "idx long")
            out = job(batch).select("idx", "text", "font")
            assert sorted(map(tuple, out.collect())) == [(i, f"s{i % 7}", f"f{i % 3}") for i in sorted(idx)]
        plan = job(spark.range(5, 40).select(F.col("id").alias("idx")))._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan
