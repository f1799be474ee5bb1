"""String sources: cycles, dictionary, random and article strings."""

import pytest

from linecraft.operators import generate as GEN


def _lines(spark, n):
    return spark.createDataFrame([(i, f"line {i}") for i in range(n)], "line_no long, text string")


@pytest.mark.parametrize("n,count,skip", [(5, 3, 0), (5, 12, 2), (5, 5, 0), (1, 4, 0)])
def test_skip_take_cycle(spark, n, count, skip):
    got = sorted((r.idx, r.line_no) for r in GEN.skip_take_cycle(_lines(spark, n), count, skip).collect())
    rest = list(range(skip, n))
    exp, i = [], 0
    while len(exp) < count:
        exp.append((len(exp), rest[i % len(rest)]))
        i += 1
    assert got == exp


def test_skip_past_end_raises(spark):
    with pytest.raises(ValueError):
        GEN.skip_take_cycle(_lines(spark, 3), 5, 3)


def test_sample_source_round_robin(spark):
    fonts = spark.createDataFrame([(0, "f0"), (1, "f1")], "font_no long, font string")
    got = sorted((r.idx, r.line_no, r.font) for r in GEN.sample_source(spark, _lines(spark, 3), fonts, 5).collect())
    assert got == [(0, 0, "f0"), (1, 1, "f1"), (2, 2, "f0"), (3, 0, "f1"), (4, 1, "f0")]


def test_strings_from_dict(spark):
    words = spark.createDataFrame([(i, w) for i, w in enumerate(["a", "b", "c"])], "word_no long, word string")
    idx = spark.range(50).withColumnRenamed("id", "idx")
    fixed = GEN.strings_from_dict(idx, words, length=3).collect()
    assert all(len(r.text.split(" ")) == 3 and set(r.text.split(" ")) <= {"a", "b", "c"} for r in fixed)
    var = GEN.strings_from_dict(idx, words, length=4, variable=True).collect()
    assert {len(r.text.split(" ")) for r in var} <= {1, 2, 3, 4} and len(var) == 50
    again = GEN.strings_from_dict(idx.repartition(7), words, length=3).collect()
    assert sorted(tuple(r) for r in again) == sorted(tuple(r) for r in fixed)


@pytest.mark.parametrize("lang,lo,hi", [("en", 2, 10), ("cn", 1, 2)])
def test_random_strings(spark, lang, lo, hi):
    idx = spark.range(40).withColumnRenamed("id", "idx")
    df, forced = GEN.random_strings(idx, length=3, num=True, lang=lang)
    assert forced is None
    for r in df.collect():
        ws = r.text.split(" ")
        assert len(ws) == 3 and all(lo <= len(w) <= hi for w in ws)
        if lang == "en":
            assert all(w.isdigit() for w in ws)
    _, forced = GEN.random_strings(idx, sym=True)
    assert forced == 2
    pool = GEN.char_pool()
    assert len(pool) == 52 + 10 + len(GEN.ASCII_SYMBOLS)


def test_article_sentences(spark):
    arts = spark.createDataFrame([(0, "One two three. Four.\nFive six seven. x"), (1, "A b c. D e f")],
                                 "doc_id long, text string")
    got = GEN.article_sentences(arts, 10, min_words=2).collect()
    assert sorted(r.text for r in got) == ["A b c", "D e f", "Five six seven", "One two three"]
    assert GEN.article_sentences(arts, 2, min_words=2).count() == 2


def test_skip_take_cycle_with_gaps(spark):
    df = spark.createDataFrame([(10, "a"), (20, "b"), (30, "c")], "line_no long, text string")
    got = sorted((r.idx, r.line_no) for r in GEN.skip_take_cycle(df, 6, 1).collect())
    assert got == [(0, 20), (1, 30), (2, 20), (3, 30), (4, 20), (5, 30)]
