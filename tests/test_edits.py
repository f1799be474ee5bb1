"""Word edit distance beyond what the JVM numbers, and encoding by a dictionary per row."""

import random

import numpy as np
import pytest

from linecraft.functions import edits as E
from linecraft.operators import labels as LB
from linecraft.operators import metrics as M


def _plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


@pytest.mark.parametrize("strip", [1, 3, 8, 64, 4096])
def test_strips_equal_the_table(strip):
    rnd = random.Random(strip)
    for _ in range(150):
        a, b = (rnd.choices("abcd", k=rnd.randint(0, 40)) for _ in range(2))
        want = _plain(a, b)
        assert E.sequence_edits(a, b, strip) == want and E.sequence_edits(a, b, strip, -1) == want
        for most in (0, 3, want, 50):
            got = E.near_edits(*(np.array([ord(x) for x in s], np.int64) for s in (a, b)), most)
            assert got == (want if want <= most else None)


def test_past_a_million_distinct_words():
    n = 1_048_576 + 5
    a = [str(i) for i in range(n)]
    b = a[:1000] + ["x"] + a[1001:5000] + a[5003:7000] + ["y", "z"] + a[7000:]
    assert E.sequence_edits(a, b) == 1 + 3 + 2


def test_long_pairs_in_a_table(spark, tmpdir_path):
    # more distinct words than there are supplementary code points, beside a short and a null pair
    many = [str(i) for i in range(1_048_600)]
    words = [f"w{i}" for i in range(2000)]
    rows = [("big", " ".join(["a", "b", *many]), " ".join(["a", "c", *many, "d", "e"])),
            ("mid", " ".join(words), " ".join(words[:500] + words[503:] + ["q"])), ("small", "a b c", "a x c d"),
            ("none", None, "a")]
    spark.createDataFrame(rows, "k string, ref string, pred string").repartition(4).write.parquet(f"{tmpdir_path}/p")
    df = spark.read.parquet(f"{tmpdir_path}/p")
    got = {r.k: r.word_edits for r in M.with_error_counts(df, "ref", "pred").select("k", "word_edits").collect()}
    assert got == {"big": 3, "mid": 4, "small": 2, "none": None}
    one = df.where("k <> 'big'").select("k", E.word_edits("ref", "pred").alias("w")).collect()
    assert {r.k: r.w for r in one} == {"mid": 4, "small": 2, "none": None}


@pytest.mark.parametrize("most", [0, 2, 1024])
def test_encoding_by_dictionary_or_position(spark, monkeypatch, most):
    monkeypatch.setattr(LB, "MAX_DICTIONARY", most)
    rows = [(1, "abca"), (1, "b"), (2, None), (3, ""), (4, "zz a?"), (5, "ab" * 400)]
    df = spark.createDataFrame(rows, "id long, text string")
    vocab = spark.createDataFrame([("a", 4, 9), ("b", 5, 8), ("c", 6, 7), (" ", 7, 1)],
                                  "token string, token_id long, count long")
    got = sorted((r.id, r.text or "", r.ids) for r in LB.encode(df, vocab).collect())
    number = {"a": 4, "b": 5, "c": 6, " ": 7}
    want = sorted((i, t or "", None if t is None else [0, *(number.get(c, 3) for c in t), 2]) for i, t in rows)
    assert got == want
    back = {(r.id, r.text): r.decoded for r in LB.decode(LB.label_ids(df, vocab, max_length=8), vocab, "labels").collect()}
    assert back == {(i, t): None if t is None else "".join(c for c in t if c in number) for i, t in rows}


def test_one_row_per_distinct_token_is_shuffled(spark):
    df = spark.createDataFrame([(1, "ab" * 5000), (2, "b" * 3000)], "id long, text string")
    vocab = LB.build_vocab(df)
    plan = LB.encode(df, vocab)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array_distinct(" in plan and "posexplode(regexp_extract_all(text" in plan  # the latter for long rows only


def test_word_edits_by_letters_up_to_the_last_letter(spark):
    assert len(set(E.LETTERS)) == len(E.LETTERS) == E.SHORT
    words = [f"w{i}" for i in range(E.SHORT)]
    for ref, pred in ((words, words[::-1][:300]), (words[:94] + ["é"], words[5:90]), (["a", None, "b"], ["a", "b"]), ([], ["a"])):
        df = spark.createDataFrame([(ref, pred)], "r array<string>, p array<string>")
        out = E.with_word_edits(df, "r", "p", short=True)
        assert "unhex" not in out._jdf.queryExecution().toString()
        want = E.sequence_edits([w for w in ref if w is not None], [w for w in pred if w is not None])
        assert out.first()["word_edits"] == want
