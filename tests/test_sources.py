"""Files and sinks: metadata round trip, label files, folder labels, asset catalogue, recogniser."""

import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from linecraft.operators import images as IM
from linecraft.operators.predict import per_worker, predict, recognise_regions
from linecraft.sources import files as FS
from linecraft.sources import textfiles as TF


def test_metadata_round_trip(spark, tmpdir_path):
    rows = [("00000000.jpg", 'a "quoted", label'), ("00000001.jpg", "two\nlines"), ("00000002.jpg", "")]
    df = spark.createDataFrame([(i,) + r for i, r in enumerate(rows)], "idx long, file_name string, text string")
    path = os.path.join(tmpdir_path, "meta")
    TF.write_metadata(df, path, order="idx")
    back = TF.read_metadata(spark, path).collect()
    assert sorted((r.file_name, r.text or "") for r in back) == sorted(rows)
    header = open([os.path.join(path, f) for f in sorted(os.listdir(path)) if f.endswith(".csv")][0]).readline()
    assert header.strip() == "file_name,text"


def test_label_file_and_corpus_writers(spark, tmpdir_path):
    df = spark.createDataFrame([(i, f"w {i}") for i in range(30)], "idx long, text string").repartition(4)
    path = os.path.join(tmpdir_path, "labels")
    TF.write_labels(df, path, space_width=0)
    text = spark.read.text(path, wholetext=False)
    lines = []
    for f in sorted(os.listdir(path)):
        if f.startswith("part-"):
            lines += open(os.path.join(path, f)).read().splitlines()
    assert lines == [f"{i}.jpg w{i}" for i in range(30)]
    corpus = os.path.join(tmpdir_path, "corpus")
    TF.write_corpus(df.withColumnRenamed("idx", "chunk").withColumnRenamed("text", "sentence"), corpus)
    got = []
    for f in sorted(os.listdir(corpus)):
        if f.startswith("part-"):
            got += open(os.path.join(corpus, f)).read().splitlines()
    assert got == [f"w {i}" for i in range(30)]


def test_read_dict_and_file_lines(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "cn.txt")
    with open(p, "w", encoding="utf-8") as f:
        f.write("﻿一\n\n二\r\n三\n")
    d = [tuple(r) for r in TF.read_dict(spark, p, "cn").orderBy("word_no").collect()]
    assert d == [("cn", 0, "﻿一"), ("cn", 1, "二"), ("cn", 2, "三")]
    lines = TF.read_file_lines(spark, p).collect()
    assert [r.text for r in sorted(lines, key=lambda r: r.line_no)] == ["﻿一", "二", "三"]


def test_folder_labels_assets_and_attach(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "hand")
    for label in ("بەفرین", "x"):
        os.makedirs(os.path.join(root, label))
        for i in range(2):
            open(os.path.join(root, label, f"{label}{i}.png"), "wb").write(b"\x01" * (i + 1))
    open(os.path.join(root, "x", ".hidden.png"), "wb").write(b"z")
    got = sorted((r.label, len(r.content)) for r in FS.read_folder_labelled(spark, root).collect())
    assert got == [("x", 1), ("x", 2), ("بەفرین", 1), ("بەفرین", 2)]
    fonts = os.path.join(tmpdir_path, "fonts")
    for lang in ("latin", "ckb"):
        os.makedirs(os.path.join(fonts, lang))
        for n in ("b.ttf", "a.ttf", "c.otf"):
            open(os.path.join(fonts, lang, n), "wb").write(b"f")
    cat = FS.asset_catalog(spark, fonts, lang="ar").orderBy("asset_no").collect()
    assert [os.path.basename(r.path) for r in cat] == ["a.ttf", "b.ttf"] and "latin" in cat[0].path
    labels = spark.createDataFrame([("x0.png", "x"), ("missing.png", "m")], "file_name string, text string")
    att = FS.attach_images(labels, spark, root).collect()
    assert [(r.file_name, r.content) for r in att] == [("x0.png", b"\x01")]
    os.makedirs(os.path.join(root, "y"))
    open(os.path.join(root, "y", "x0.png"), "wb").write(b"y")
    named = spark.createDataFrame([("y/x0.png", "y"), ("z/x0.png", "z")], "file_name string, text string")
    assert [(r.text, r.content) for r in FS.attach_images(named, spark, root).collect()] == [("y", b"y")]


def test_predict_and_recognise_regions(spark):
    def _read_width(it):
        model = per_worker("width-reader", lambda: (lambda img: f"w{img.shape[1]}"))
        for pdf in it:
            yield pd.DataFrame({"image_id": pdf["image_id"], "box_no": pdf["box_no"],
                                "text": [model(IM.from_struct(c)) for c in pdf["crop"]]})

    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType
    img = IM.to_struct(np.zeros((20, 30, 3), np.uint8))
    regions = [[[0.0, 0.0], [5.0, 0.0], [5.0, 4.0], [0.0, 4.0]], [[2.0, 5.0], [12.0, 5.0], [12.0, 9.0], [2.0, 9.0]]]
    schema = StructType([StructField("image_id", LongType()), StructField("image", IM.IMAGE),
                         StructField("points", ArrayType(ArrayType(ArrayType(DoubleType()))))])
    df = spark.createDataFrame([(1, img, regions), (2, img, regions[:1])], schema)
    got = {r.image_id: r.text for r in recognise_regions(df, _read_width).collect()}
    assert got == {1: "w5\nw10", 2: "w5"}

    def shape_of(it):
        for pdf in it:
            yield pd.DataFrame({"image_id": pdf["image_id"], "h": [IM.from_struct(v).shape[0] for v in pdf["image"]]})
    assert predict(df, shape_of, "image_id long, h long").select(F.sum("h")).first()[0] == 40


def test_attached_bytes_are_not_shuffled(spark, tmpdir_path, monkeypatch):
    root = os.path.join(tmpdir_path, "imgs")
    for folder in ("a", "b"):
        os.makedirs(os.path.join(root, folder))
        for name in ("1.png", "2.png"):
            open(os.path.join(root, folder, name), "wb").write((folder + name).encode())
    labels = spark.createDataFrame([("a/1.png", "x"), ("2.png", "y"), ("a/1.png", "z"), ("b/9.png", "no")],
                                   "file_name string, text string")
    want = [("2.png", "y", b"a2.png"), ("2.png", "y", b"b2.png"), ("a/1.png", "x", b"a1.png"), ("a/1.png", "z", b"a1.png")]
    out = FS.attach_images(labels, spark, root)
    assert sorted((r.file_name, r.text, bytes(r.content)) for r in out.collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    monkeypatch.setattr(FS, "MAX_BROADCAST_PATHS", 1)
    out = FS.attach_images(labels, spark, root)
    assert sorted((r.file_name, r.text, bytes(r.content)) for r in out.collect()) == want


def test_samples_are_sorted_before_they_grow_boxes(spark, tmpdir_path):
    from linecraft import catalog_files as CF
    docs = [(1, "ab", "en"), (2, "é😀\n", None), (3, "", "de"), (4, None, "en"), (5, "x", ""), (5, "x", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(2) \
        .write.parquet(f"{tmpdir_path}/documents.parquet")
    plans = []
    old = FS.write_samples

    def kept(df, path, by):
        plans.append(df)
        return old(df, path, by)
    FS.write_samples = kept
    try:
        rows = CF.q_sample_files(spark, tmpdir_path).select("doc_id", "lang", "n_boxes").collect()
    finally:
        FS.write_samples = old
    got = sorted((r.doc_id, r.lang or "", r.n_boxes if r.n_boxes is not None else -2) for r in rows)
    assert got == [(1, "en", 2), (2, "", 3), (3, "de", 0), (4, "en", -2), (5, "", 1), (5, "en", 1)]
    # the order that the write needs is the rows' own, so no sort of boxes is added
    ordering = plans[0]._jdf.queryExecution().optimizedPlan().outputOrdering()
    assert ordering.size() == 1 and not plans[0].schema["lang"].nullable
