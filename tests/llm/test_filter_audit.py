"""The filter audit against a replay of every order, row by row."""

import random
from itertools import permutations

import duckdb
from conftest import SF001

from linecraft.llm import filter_audit as FA
from linecraft.llm.queries import ORACLE, QUERIES

DOCS = "doc_id long, text string, lang string, part string, n long, good int"
LABELS = "doc_id long, quality int, toxic int, part string"


def _failures(rows):
    out = []
    for d, text, *_ in rows:
        t = text or ""
        words = [w for w in t.translate({c: 32 for c in range(9, 14)}).split(" ") if w]
        f = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
             "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in t for c in "#$%&*|"),
             "E": any(e is not None and d is not None and e < d and (u or "") == t for e, u, *_ in rows)}
        out.append({k for k, bad in f.items() if bad})
    return out


def _replay(rows, labels):
    failures, want = _failures(rows), {}
    good = {d for d, q, _, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x, _ in labels if x == 1 and d is not None}
    for part in {r[2] or "" for r in rows}:
        mine = [(r, f) for r, f in zip(rows, failures, strict=True) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [r for r, f in left if name in f]
                left = [(r, f) for r, f in left if name not in f]
                shapley[name] += len(gone)
                want[part, "".join(order), step] = [
                    len(left), len(gone), sum(name in f for _, f in mine) - len(gone),
                    sum(f == {name} for _, f in mine), sum(r[0] in good for r in gone),
                    sum(r[0] in toxic for r in gone), name]
        for key, v in want.items():
            if key[0] == part:
                v[-1] = shapley[v[-1]]
    return {k: tuple(v) for k, v in want.items()}


def _rows():
    rnd = random.Random(5)
    texts = ["", None, "A" * 30, "one two", " ".join(f"w{i}" for i in range(120)), "x " * 150, "x\t" * 99 + "y",
             " ".join(f"W{i}" for i in range(200)), "é#" + " z" * 130, " ".join(f"v{i}" for i in range(40_000)),
             " ".join(f"a{i % 90}" for i in range(112)), " ".join(f"a{i % 90}" for i in range(113)), "   \x0b\f\r\n"]
    rows = [(i, rnd.choice(texts), rnd.choice(["en", "de", None, ""]), "p", 1, 0) for i in range(80)]
    rows += [(None, "one two", "en", "p", 2, 1), (None, "one two", None, "p", 2, 1), (7, "one two", "en", "q", 3, 1),
             (7, "one two", "en", "q", 3, 1), (-5, "one two", "fr", "q", 3, 1), (-5, "one two", "de", "q", 3, 1)]
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0, "x") for i in range(0, 60)] + [
        (7, 0, 1, "x"), (8, None, None, "x"), (None, 1, 1, "x"), (-5, 1, 0, "x")]
    return rows, labels


def test_audit_is_the_replay(spark):
    rows, labels = _rows()
    got = FA.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    want = _replay(rows, labels)
    assert len(got) == len(want) == 600 * 4
    for r in got:
        assert tuple(r[c] for c in FA.STEP_COLUMNS) == want[r.part, r.filter_order, r.step], r
        assert r.filter == r.filter_order[r.step - 1]


def test_potential_differences_are_average_marginals(spark):
    rows, labels = _rows()
    game = FA.play(FA.failure_counts(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)))
    for g in game.collect():
        for s in range(FA.ALL + 1):  # on every coalition: differences of the potential add up to its worth
            parts = [g.potential[s] - g.potential[s & ~(1 << k)] for k in range(5) if s >> k & 1]
            assert sum(parts) == FA.WHOLE * g.v[s]


def test_empty_tables(spark):
    rows, labels = _rows()
    no_docs, no_labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert FA.audit(no_docs, spark.createDataFrame(labels, LABELS)).count() == 0
    got = FA.audit(spark.createDataFrame(rows, DOCS), no_labels)
    assert got.where("good_lost > 0 or toxic_lost > 0").count() == 0 and got.count() == 2400


def test_query_equals_statement(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    want = con.execute(ORACLE["op13_filter_audit"])
    cols = [c[0] for c in want.description]
    got = QUERIES["op13_filter_audit"](spark, SF001)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want.fetchall())
