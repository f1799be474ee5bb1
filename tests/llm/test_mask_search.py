"""Presence-mask search against scoring every document."""

import math
import random
import re

import duckdb
import numpy as np
from conftest import SF001

from linecraft.llm import mask_search as MS
from linecraft.llm.queries import ORACLE, QUERIES

DOCS = "doc_id long, text string, score long, place int, item_id long"
ITEMS = "item_id long, text string, rank int"


def _terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def _brute(docs, items, top=10):
    held = [(d, _terms(t)) for d, t, *_ in docs]
    held = [(d, t) for d, t in held if t]
    n_all, total = len(held), sum(len(t) for _, t in held)
    out = []
    for item, text in {(i, t or "") for i, t, *_ in items}:
        rows = []
        asked = set(_terms(text))
        w = {t: math.floor(1000 * math.log((2.0 * n_all + 2) / (2.0 * sum(t in x for _, x in held) + 1)))
             for t in asked}
        for d, x in held:
            m = 10 + (90 * len(x) * n_all) // total
            s = sum(w[t] * ((1000000000 * x.count(t)) // (1000 * x.count(t) + 8 * m)) for t in asked)
            if s > 0:
                rows.append((-s, d is None, d or 0, d))
        out += [(item, k, r[3], -r[0]) for k, r in enumerate(sorted(rows)[:top], 1)]
    return sorted(out, key=repr)


def _rows():
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "straße", "a1"]
    docs = [(i, rnd.choice([" ", "-", "\x00"]).join(rnd.choices(words, k=rnd.randint(0, 40))).upper(), 1, 2, 3)
            for i in range(300)]
    docs += [(None, "w1 w2 w3", 1, 2, 3), (5, "w1 w2", 1, 2, 3), (5, "w1 w2", 1, 2, 3), (6, None, 1, 2, 3),
             (7, "", 1, 2, 3), (8, "... !!", 1, 2, 3), (9, " ".join(f"w{i % 61}" for i in range(50_000)), 1, 2, 3)]
    docs += [(1000 + i, "w1 w2 w3 w4", 1, 2, 3) for i in range(50)]
    items = [(1, "W1 w2, w3", 1), (2, " ".join(words * 2), 1), (3, "nothing known", 1), (4, None, 1), (5, "", 1),
             (1, "W1 w2, w3", 1), (6, "é É straße A1 a1", 1), (None, "w9", 1), (7, "w7 w7 w8", 2),
             (8, " ".join(f"w{i}" for i in range(60)) + " " + " ".join(f"none{i}" for i in range(80)), 1)]
    return docs, items


def _search(spark, docs, items, **kw):
    got = MS.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), **kw)
    return sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_search_is_exhaustive_scoring(spark, monkeypatch):
    docs, items = _rows()
    want = _brute(docs, items)
    assert _search(spark, docs, items) == want
    assert _search(spark, docs, items, shard_bytes=100) == want  # items in several shards
    assert _search(spark, docs, items, top=1) == _brute(docs, items, 1)


def test_masks_past_64_terms_and_small_blocks():
    rnd = np.random.default_rng(3)
    for terms, top in ((5, 3), (64, 10), (65, 10), (150, 4)):
        n_docs = 400
        lengths = rnd.integers(0, terms, n_docs)
        which = np.concatenate([rnd.choice(terms, k, replace=False) for k in lengths]).astype(np.int64)
        tfs = rnd.integers(1, 9, len(which))
        n = rnd.integers(1, 300, n_docs)
        block = MS.Block(n, lengths, which, tfs, n_docs, int(n.sum()))
        weight = rnd.integers(0, 5, terms)
        score = np.zeros(n_docs, np.int64)
        m = 10 + 90 * n * n_docs // n.sum()
        doc = np.repeat(np.arange(n_docs), lengths)
        np.add.at(score, doc, weight[which] * (10 ** 9 * tfs // (1000 * tfs + 8 * m[doc])))
        tie = rnd.permutation(n_docs)
        docs, got = block.search([(t, int(weight[t])) for t in range(terms)], top, tie)
        order = np.lexsort((tie, -score))[:top]
        assert list(docs) == list(order) and list(got) == list(score[order])


def test_later_masks_are_not_scored(monkeypatch):
    n = np.full(1000, 10)
    which = np.concatenate([[0, 1, 2] if i < 20 else [2] for i in range(1000)])
    lengths = np.array([3 if i < 20 else 1 for i in range(1000)])
    block = MS.Block(n, lengths, which, np.ones(len(which), np.int64), 1000, 10_000)
    seen = []
    real = np.searchsorted
    monkeypatch.setattr(MS.np, "searchsorted", lambda a, v, *k: seen.append(np.size(v)) or real(a, v, *k))
    docs, _ = block.search([(0, 50), (1, 50), (2, 1)], 10, np.arange(1000))
    assert list(docs) == list(range(10)) and max(seen) <= 20  # the 980 documents of the weak mask: never


def test_empty_tables(spark):
    docs, items = _rows()
    assert _search(spark, [], items) == [] and _search(spark, docs, []) == []
    assert _search(spark, [(1, None, 1, 2, 3)], items) == []


def test_query_equals_statement(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    want = con.execute(ORACLE["op12_ranked_search"]).fetchall()
    got = QUERIES["op12_ranked_search"](spark, SF001).select("item_id", "rank", "doc_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(want)
