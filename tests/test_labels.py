"""Recipes, vocabulary, encoding and padding."""

import pytest

from linecraft.functions.arrays import pad_labels
from linecraft.operators import labels as LB
from linecraft.operators import render as R


@pytest.mark.parametrize("L", [0, 6, 7, 13, 14, 100])
def test_recipe_blocks(spark, L):
    lines = spark.range(L).withColumnRenamed("id", "line_no")
    if L == 0:
        assert R.assign_recipes(lines).count() == 0
        return
    got = {r["line_no"]: (r["block"], r["index"]) for r in R.assign_recipes(lines).collect()}
    n = L // 7
    for i in range(L):
        block = 7 if n == 0 else min(i // n, 7)
        assert got[i] == (block, i - block * n)


def test_draw_params_ranges(spark):
    df = R.assign_recipes(spark.range(700).withColumnRenamed("id", "line_no"))
    rows = R.draw_params(df, text_color="#000000,#888888").collect()
    for r in rows:
        k = r.skew_angle
        assert (-k <= r.angle <= k) if r.random_skew else r.angle == k
        assert 0 <= r.blur_radius < max(r.blur, 1e-9) or (r.blur == 0 and r.blur_radius == 0)
        assert all(0 <= c <= 0x88 for c in r.fill)
        assert list(r.stroke) == [0x28] * 3


def test_pad_labels(spark):
    df = spark.createDataFrame([([0, 5, 2],), ([0, 5, 6, 7, 2],), ([0, 1, 2, 9, 9, 9, 2],)], "ids array<int>")
    got = [r[0] for r in df.select(pad_labels("ids", 5, 1)).collect()]
    assert got == [[0, 5, 2, -100, -100], [0, 5, 6, 7, 2], [0, -100, 2, 9, 9, 9, 2]]


def test_null_texts_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "ab"), (1, "b"), (2, None)], "id long, text string")
    enc = LB.encode(df, LB.build_vocab(df))
    got = sorted((r.id, r.text or "", r.ids) for r in enc.collect())
    assert got == [(1, "ab", [0, 5, 4, 2]), (1, "b", [0, 4, 2]), (2, "", None)]


def test_vocab_encode_decode_roundtrip(spark):
    texts = ["abc", "cab ", "ßé", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    vocab = LB.build_vocab(df)
    v = {r.token: r.token_id for r in vocab.collect()}
    assert [v[s] for s in LB.SPECIALS] == [0, 1, 2, 3]
    assert v["a"] < v["ß"]  # count desc, then token
    enc = LB.label_ids(df, vocab, max_length=6)
    dec = {r.id: r.decoded for r in LB.decode(enc, vocab, "labels", "id").collect()}
    assert dec == dict(enumerate(texts))
    lab = {r.id: r.labels for r in enc.collect()}
    assert lab[3] == [0, 2, -100, -100, -100, -100]


def test_semi_anti_and_renumber(spark):
    labels = spark.createDataFrame([("a.jpg", "x"), ("b.jpg", "y"), ("c.jpg", "z")], "file_name string, text string")
    files = spark.createDataFrame([("a.jpg",), ("c.jpg",)], "file_name string")
    kept = LB.keep_existing(labels, files)
    assert sorted(r.file_name for r in kept.collect()) == ["a.jpg", "c.jpg"]
    assert [r.file_name for r in LB.missing_files(labels, files).collect()] == ["b.jpg"]
    ren = sorted((r.idx, r.file_name, r.text) for r in LB.renumber(kept.withColumnRenamed("file_name", "src"), ["src"]).collect())
    assert ren == [(0, "00000000.jpg", "x"), (1, "00000001.jpg", "z")]


def test_small_vocabularies_need_no_join(spark, monkeypatch):
    texts = ["ab\U0001f600 é", "", None, "zz~", "<s>", "b" * 5000, "ab"]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    vocab = LB.build_vocab(df.where("text <> 'zz~'"))
    holes = vocab.where("token <> 'a'")   # ids that decode doesn't know

    def both():
        enc = LB.label_ids(df, vocab, max_length=4, table=True)
        plan = enc._jdf.queryExecution().optimizedPlan().toString()
        back, lost = LB.decode(enc, vocab, "labels", table=True), LB.decode(enc, holes, "labels", table=True)
        key = lambda rows: sorted(map(repr, rows))
        return plan, [key(d.collect()) for d in (enc, back, lost)], [d.dtypes for d in (enc, back, lost)]
    plan, rows, types = both()
    assert "Join" not in plan and "MapInArrow" in plan
    monkeypatch.setattr(LB, "MAX_TABLE", 2)
    joined, want, want_types = both()
    assert "Join" in joined
    assert rows == want and types == want_types


def test_word_labels_decode_by_table_and_by_join(spark, monkeypatch):
    df = spark.createDataFrame([(1, "to be or not to be"), (2, ""), (3, None), (4, "be new")], "id long, text string")
    vocab = LB.build_vocab(df.where("id < 4"), unit="word")
    dec = lambda: sorted(map(repr, LB.decode(LB.encode(df, vocab, unit="word", out="labels"), vocab, unit="word", table=True).collect()))
    got = dec()
    monkeypatch.setattr(LB, "MAX_TABLE", 2)
    assert got == dec() and "to be or not to be" in str(got)


def test_a_vocabulary_with_a_token_twice_is_not_a_table(spark):
    twice = spark.createDataFrame([("a", 4, 1), ("a", 5, 1)], "token string, token_id long, count long")
    assert LB._table(twice, "token", "token_id") is None
    assert sorted(LB._table(twice, "token_id", "token")) == [(4, "a"), (5, "a")]
