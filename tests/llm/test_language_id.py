"""Language identification against a plain Python version, on odd rows, and held-out accuracy."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF001

from linecraft.llm import language_id as LI
from linecraft.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, score string, lang_pred int"
TRAIN = [("en", "The cat and the dog. The house the cats"), ("de", "Der Hund und die Katze. Das Haus der Katzen"),
         ("fr", "Le chat et le chien. La maison des chats"), ("en", None), (None, "der der der"), ("de", "Straße groß ÄRGER"),
         ("ru", "кошка и собака кошка и дом"), ("en", "the the dog and dog"), ("de", "und das und die groß ärger")]


def _words(text):
    return re.findall(r"[^\W\d_]+", "".join(c.lower() if len(c.lower()) == 1 else c for c in text or ""))


def _grams(word, n):
    w = word if n == 1 else "\0" + word + "\0"
    return [w[i:i + n] for i in range(len(w) - n + 1)]


def _plain(train, texts):
    counts = {k: {} for k in range(6)}
    for lang, text in train:
        if lang is None:
            continue
        for w in _words(text):
            for k in range(6):
                for g in [w] if k == 0 else _grams(w, k):
                    counts[k].setdefault(g, Counter())[lang] += 1
    total = {k: Counter() for k in counts}
    for k, c in counts.items():
        for by in c.values():
            total[k].update(by)
    langs = sorted(total[0], key=lambda x: (-total[0][x], x))
    known = {k: {g: by for g, by in c.items() if sum(by.values()) >= LI.LEAST} for k, c in counts.items()}

    def logs(k, g):
        return [math.log((known[k][g][x] + LI.SMOOTH) / (total[k][x] + LI.SMOOTH * (len(known[k]) + 1))) for x in langs]

    out = []
    for text in texts:
        sums, words = [0.0] * len(langs), _words(text)
        for w in words:
            if w in known[0]:
                sums = [a + b for a, b in zip(sums, logs(0, w), strict=True)]
                continue
            for k in range(5, 0, -1):
                rows = [logs(k, g) for g in _grams(w, k) if g in known[k]]
                if rows:
                    sums = [a + sum(r[i] for r in rows) / len(rows) for i, a in enumerate(sums)]
                    break
        if not words:
            out.append(("und", 0.0))
            continue
        top = max(sums)
        share = [math.exp((x - top) / math.sqrt(len(words))) for x in sums]
        out.append((langs[sums.index(top)], 1 / sum(share)))
    return out


TEXTS = ["the cat", "Die Katze", "un chat noir", "собаки", "", None, "123 ### !", "catzen hundes", "日本語", "x",
         "GROSSE Straße", "des maisons et des chiens " * 400, "́́", "the\tder le\nkatzenhaus", "a" * 3000]


def _model(spark, train, **kw):
    rows = [(i, t, x, None, 1) for i, (x, t) in enumerate(train)]
    return LI.fit(spark.createDataFrame(rows, DOCS).repartition(3), **kw)


@pytest.mark.parametrize("piece", [LI.PIECE, 40])
def test_equals_plain_version(spark, monkeypatch, piece):
    model = _model(spark, TRAIN)
    monkeypatch.setattr(LI, "PIECE", piece)  # long texts in several pieces give the same
    names, score = model.predict(TEXTS)
    want = _plain(TRAIN, TEXTS)
    assert names == [n for n, _ in want]
    assert np.allclose(score, [s for _, s in want], atol=1e-4)


def test_rows_columns_and_nulls(spark):
    model = _model(spark, TRAIN)
    rows = [(1, "the dog", "en", "s", 1), (1, "the dog", "en", "s", 1), (None, "der Hund", None, None, None),
            (2, None, "en", "s", 1), (3, "", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = LI.predict(df, model, carry=tuple(c for c in df.columns if c != "text"))
    assert got.columns == ["doc_id", "lang", "lang_pred", "score"]
    assert sorted((r.doc_id or 0, r.lang_pred) for r in got.collect()) == [
        (0, "de"), (1, "en"), (1, "en"), (2, "und"), (3, "und")]
    assert LI.predict(df.limit(0), model).count() == 0


def test_nothing_learned(spark):
    for train in ([], [(None, "the cat")], [("en", None)]):
        model = LI.fit(spark.createDataFrame([(1, t, x, None, 1) for x, t in train], DOCS))
        assert model.predict(["the cat", None])[0] == ["und", "und"]


def test_model_size_is_bounded_by_count(spark):
    model = _model(spark, TRAIN, max_cells=4 * 5)
    assert 0 < len(model.keys[0]) <= 5 and sum(map(len, model.keys[1:])) <= 5
    full = _model(spark, TRAIN)
    assert set(model.keys[0]) < set(full.keys[0])


def test_flushed_counts_add_up(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, x, None, 1) for i, (x, t) in enumerate(TRAIN)], DOCS).where("lang is not null")
    want = {(r.lang, r.kind, r.key): r.n for r in LI.language_counts(df).groupBy("lang", "kind", "key").sum("n")
            .withColumnRenamed("sum(n)", "n").collect()}
    monkeypatch.setattr(LI, "FLUSH", 1)
    got = {(r.lang, r.kind, r.key): r.n for r in LI.language_counts(df).groupBy("lang", "kind", "key").sum("n")
           .withColumnRenamed("sum(n)", "n").collect()}
    assert got == want


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op11_language_id"](spark, SF001).collect()}
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert all(got[d.doc_id].held_out for d in held) and sum(r.held_out for r in got.values()) == len(held)
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
