"""Operators of linecraft.llm on small inputs: brute force, round trips and odd rows."""

import hashlib
import math
import os
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from conftest import SF001
from pyspark.sql import functions as F

from linecraft.llm import chat_format as CF
from linecraft.llm import common
from linecraft.llm import components as CC
from linecraft.llm import decontaminate as DC
from linecraft.llm import doc_fingerprint as DF
from linecraft.llm import html_text as HT
from linecraft.llm import license_scan as LS
from linecraft.llm import line_dedup as LD
from linecraft.llm import lm_score as LM
from linecraft.llm import mixing as MX
from linecraft.llm import quality as Q
from linecraft.llm import simhash_dedup as SD
from linecraft.llm.queries import ORACLE, QUERIES
from linecraft.session import TABLES, ensure_checkpoint_dir

DOCS = "doc_id long, text string, source string, n_near long, labels string"


def _odd(spark):
    """Nulls, empties, ties, repeated rows, a long text and columns with the names of results."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, "the cat sat on the mat today", "a", 1, "x"), (1, "the cat sat on the mat today", "a", 1, "x"),
            (2, None, None, None, None), (3, "", "b", 2, "y"), (None, "no id here at all", "b", 3, "z"),
            (4, long, "a", 4, "q"), (5, "  \n\n ", None, 5, "r"), (4, "same id other text", "c", 6, "s")]
    return spark.createDataFrame(rows, DOCS)


# -- chat formatting ---------------------------------------------------------------------

def test_chat_round_trip():
    rnd = random.Random(1)
    parts = [*CF.RESERVED, "\\", "[", "ok", " ", "é", "\n", "</s", "[/TURN"]
    for _ in range(500):
        turns = [("".join(rnd.choices(parts, k=rnd.randint(0, 3))), "".join(rnd.choices(parts, k=rnd.randint(0, 8))))
                 for _ in range(3)]
        assert CF.parse("".join(CF.render_turn(*t)[0] for t in turns)) == turns
    assert CF.render_turn("user", "plain \\ text")[1] is False
    assert CF.parse("loose text") is None and CF.parse("[TURN]a[TURN]") is None


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (None, 0, None, "x"), (2, 0, "assistant", "é"),
            (2, 0, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in CF.conversation_digests(CF.format_turns(df)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb</s>\n").hexdigest()
    assert (got[1].loss_chars, got[1].n_turns) == (5, 2)
    assert got[2].loss_sha256 == hashlib.sha256("aé".encode()).hexdigest()
    assert got[None].n_turns == 1
    assert CF.conversation_digests(CF.format_turns(df.limit(0))).count() == 0


# -- licence scan ------------------------------------------------------------------------

def test_licence_places(spark):
    texts = ["Licensed under the Apache License, Version 2.0 (c)", "MIT license mit LICENSE", None, "",
             "gnu general public", "x cc by nc 4.0 y", "Gnu General public license, version 3"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in LS.scan(df).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].labels) == (1, 3, "apache,apache-2.0")
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 0, 2, "mit")
    assert got[2].n_words == 0 and got[2].first_word is None and got[3].labels == "" and got[4].n_base == 0
    assert got[5].labels == "cc-by,cc-by-nc" and got[6].base_labels == "gpl" and 0 < got[6].score <= 1
    assert LS.scan(_odd(spark)).count() == 8 and LS.scan(df.limit(0)).count() == 0


# -- fingerprints ------------------------------------------------------------------------

def test_fingerprint_edits(spark):
    rows = [(i, f"text {i} " * (i % 5), ) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in DF.fingerprint_edits(df, buckets=5).collect()}
    for i, t in rows:
        nxt = rows[i - 1][1] if i else rows[-1][1]
        half = len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[:len(t) - half] + nxt[:half]).encode()).hexdigest()
    odd = DF.fingerprint_edits(_odd(spark)).collect()
    assert len(odd) == 8 and DF.fingerprint_edits(df.limit(0)).count() == 0


def test_block_tables_find_all(spark):
    rnd = random.Random(2)
    base = [(rnd.getrandbits(64), rnd.getrandbits(64)) for _ in range(40)]
    fps = base + [(h ^ (1 << rnd.randrange(64)), l ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))) for h, l in base]
    fps += fps[:10]
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(sign(h), sign(l)) for h, l in fps], "high long, low long")
    got = {(r.qh, r.ql): r.n_within for r in DF.near_counts(df, df).collect()}
    for h, l in set(fps):
        assert got[sign(h), sign(l)] == sum((h ^ a).bit_count() + (l ^ b).bit_count() <= 3 for a, b in fps)


# -- html --------------------------------------------------------------------------------

@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<p>", ""), ("plain", "plain"),
    ("<body><nav><a href=x>Home</a></nav><article><h1>T&amp;t</h1><p>One\n two <b>x</b>.<br>y<p>Short.</article>"
     "<div class='comments'><p>great article I think so too</p></div><footer>foot</footer>",
     "T&t\n\nOne two x. y\n\nShort."),
    ("<div id=cookie-notice>We use cookies</div><div><div><p>Alpha beta gamma.</p><p>Delta.</p></div></div>"
     "<form><p>Sign up now please</p></form><script>var a='<p>no</p>'</script>", "Alpha beta gamma.\n\nDelta."),
    ("<article><p>cut of &am", "cut of &am"),
])
def test_html(html, text):
    assert HT.extract(html) == text


ARTICLE = "<p>Alpha beta gamma delta.</p><p>Epsilon zeta eta theta.</p>"
PLAIN = "Alpha beta gamma delta.\n\nEpsilon zeta eta theta."


@pytest.mark.parametrize("html", [
    f"<div class='layout has-sidebar'><article>{ARTICLE}</article></div>",
    f"<div class='post no-comments'><article>{ARTICLE}</article></div>",
    f"<div class='layout sidebar'><main>{ARTICLE}</main></div><div class='sidebar'><p>Other text here</p></div>",
    f"<div class='header'><div>{ARTICLE}</div></div><footer>foot</footer>",
    "<article><section id='related-work'><p>Alpha beta gamma delta.</p></section>"
    "<div id='search-algorithms'><p>Epsilon zeta eta theta.</p></div></article>",
    "<article><div class='article-header'><p>Alpha beta gamma delta.</p></div><p>Epsilon zeta eta theta.</p></article>",
    f"<article>{ARTICLE}</article><div class='comments'><article><p>{'I think so too. ' * 30}</p></article></div>",
    f"<article>{ARTICLE}</article><div class='site-nav'><p>Places to go</p></div><div id='cookie-bar'><p>We use them</p></div>",
    f"<div><article>{ARTICLE}</article></div><div class='related-posts'><p>Read this as well</p></div>",
])
def test_html_names_of_wrappers(html):
    assert HT.extract(f"<body>{html}</body>") == PLAIN


@pytest.mark.parametrize("tag", sorted(HT.WRAPPERS))
def test_html_tags_around_the_page(tag):
    """A form, aside, dialog or noscript around the main text stays, any other goes."""
    for body in (ARTICLE, f"<article>{ARTICLE}</article>"):
        whole = f"<{tag} id=f><div>{body}</div><label>Your name</label><input name=q></{tag}><footer>foot</footer>"
        if "article" in body:
            assert HT.extract(f"<body>{whole}</body>") == PLAIN
        assert HT.extract(f"<body>{whole}</body>").startswith(PLAIN)
        beside = f"<div>{body}</div><{tag}><p>Some news by mail</p></{tag}>"
        assert HT.extract(f"<body>{beside}</body>") == PLAIN
    alone = "<form><p><label>Name</label><input></p><p><label>Mail</label></p><button>Go</button></form>"
    assert HT.extract(f"<body>{alone}</body>") == ""


def _density_sums(node):
    """Density sum of every node by the rule itself, each node from its own subtree: {id: (sum, density)}."""
    def below(n):
        return [c for c in n.children if isinstance(c, HT.Node) and not c.drop]

    def count(n, link):
        """Characters, tags, characters and tags inside links below a node."""
        link = link or n.tag == "a"
        chars = sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
        out = [chars, 0, chars * link, 0]
        for c in below(n):
            sub = count(c, link)
            out = [out[0] + sub[0], out[1] + 1 + sub[1], out[2] + sub[2], out[3] + sub[3] + (link or c.tag == "a")]
        return out

    body = next((n for n in HT._nodes(node) if n.tag == "body"), node)
    b = count(body, False)

    def density(n):
        c, t, lc, lt = count(n, False)
        lt += n.tag == "a"  # a link counts itself
        base = math.log(max(1, c) * max(1, lc) / max(1, c - lc) + b[2] / max(1, b[0]) * max(1, c) + math.e)
        return c / max(1, t) * math.log(max(1.0, max(1, c) * max(1, t) / (max(1, lc) * max(1, lt))) + 1) / math.log(base + math.e)

    return {id(n): (sum(map(density, below(n))) if below(n) else density(n), density(n)) for n in HT._nodes(node)}


def test_html_densities_against_the_rule():
    rnd = random.Random(21)

    def tree(depth):
        text = " ".join(rnd.choices(["river", "town", "a", "of", "mill"], k=rnd.randint(0, 12)))
        if not depth:
            return f"<p>{text} <a href=x>{rnd.choice(['more', '', 'go on'])}</a></p>" if rnd.random() < .5 else f"<p>{text}</p>"
        return f"<div>{text}{''.join(tree(depth - 1) for _ in range(rnd.randint(0, 3)))}</div>"

    for _ in range(40):
        root = HT.parse(f"<body>{tree(3)}{tree(2)}</body>")
        want = _density_sums(root)
        nodes = HT.measure(root)
        for n in nodes:
            assert math.isclose(n.density, want[id(n)][1], abs_tol=1e-9)
            assert math.isclose(n.total, want[id(n)][0], abs_tol=1e-9)


def test_html_odd_tables(spark):
    rows = [(1, "u", "<p>One</p>", "x", 9), (1, "u", "<p>One</p>", "x", 9), (2, None, None, None, None), (None, "v", "", "y", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = HT.extract_pages(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(got.collect(), key=str) == sorted([(1, "u", "One", 3)] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str)
    assert HT.extract_pages(pages.limit(0)).count() == 0


def test_deep_html():
    assert HT.extract("<div>" * 20_000 + "deep") == "deep"


# -- mixing ------------------------------------------------------------------------------

def test_mix_matches_sql_and_limits(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    cur = con.execute(ORACLE["op5_mixing"])
    names = [d[0] for d in cur.description]
    df = QUERIES["op5_mixing"](spark, SF001)
    assert sorted(map(tuple, df.select(names).collect())) == sorted(cur.fetchall())


def test_mix_odd_rows(spark):
    rows = MX.mix(_odd(spark)).collect()
    assert len(rows) == 8 and all(0 <= r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(t - g) <= 1 for t, g in by.values())
    assert MX.mix(_odd(spark).limit(0)).count() == 0


# -- SimHash near-dedup ------------------------------------------------------------------

def _slow_groups(fps, bits):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("chunk", [20_000, 7])
def test_trie_links_and_components(spark, chunk):
    rnd = random.Random(3)
    fps = []
    for _ in range(25):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):
            fps.append(x)
            for _ in range(rnd.randint(1, 5)):
                x ^= 1 << rnd.randrange(64)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    cc = {r.node: r.root for r in CC.connected_components(SD.links(df, 4, chunk)).collect()}
    slow = _slow_groups(fps, 4)
    mine = [cc.get(r.fp, r.fp) for r in df.collect()]
    assert [mine.index(m) for m in mine] == [slow.index(s) for s in slow]


def test_near_dedup(spark):
    df = _odd(spark)
    out = SD.dedup(df)
    assert out.columns == df.columns
    left = out.collect()
    assert sum(r.text == "the cat sat on the mat today" for r in left) == 1
    assert sum(not (r.text or "").split() for r in left) == 1  # null, empty, blank: fingerprint 0
    assert SD.dedup(df.limit(0)).count() == 0


def test_fingerprint_contract():
    import xxhash
    for t in ["", "a", "A b", "x y z w v É", "q " * 40]:
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        assert SD.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


# -- line dedup --------------------------------------------------------------------------

def test_line_dedup(spark):
    base = " ".join(f"word{i}" for i in range(40))
    rows = [(1, f"{base}\nunique one\n\n{base}"), (2, f"{base.replace('word20', 'other')}\nnew line"),
            (3, None), (4, ""), (None, "unique one\nlast"), (5, base), (5, base), (6, "ab" * 60 + "\nx")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = LD.dedup(df)
    assert got.columns == df.columns
    texts = sorted(((r.doc_id or 99), r.text) for r in got.collect() if r.text is not None)
    assert texts == [(1, f"{base}\nunique one\n"), (2, "new line"), (4, ""), (5, ""), (5, ""),
                     (6, "ab" * 60 + "\nx"), (99, "last")]
    assert LD.dedup(df.limit(0)).count() == 0 and got.count() == 8


def _runs(line):
    return {line[k:k + 5] for k in range(max(1, len(line) - 4))}


def _near_lines(seed, count):
    """Lines of 3 to 60 words, each also with one character changed: (number, line)."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyzé", k=rnd.randint(2, 9)))
    out = []
    for _ in range(count):
        line = " ".join(word() for _ in range(rnd.randint(3, 60)))
        k = rnd.randrange(len(line))
        out += [line, line[:k] + "#" + line[k + 1:]]
    return out


def test_line_dedup_against_all_positions(spark):
    lines = _near_lines(6, 150)
    sets = [_runs(x) for x in lines]
    root = list(range(len(lines)))  # union-find over all pairs
    for j in range(len(lines)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    gone = {k for k, r in enumerate(root) if r != k}
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    mine = {r.doc_id for r in LD.dedup(df).collect() if r.text == ""}
    assert len(gone) > 100 and mine <= gone  # the check is exact
    assert len(mine) >= 0.95 * len(gone)     # bands miss few


def test_line_shingles():
    lines = ["a", "abcd", "abcde", "abcdefabcdef", "a\tb c\rd", "\U0001F600bcd\U0001F601f", "é" * 9, "abcdefabcdeg"]
    owner, hashes = LD.shingle_hashes(lines)
    name = {}
    for k, line in enumerate(lines):
        mine = list(hashes[owner == k])
        runs = [line[i:i + 5] for i in range(max(1, len(line) - 4))]
        assert len(mine) == len(runs)
        for h, r in zip(mine, runs):
            assert name.setdefault(h, r) == r
    assert len(name) == len(set().union(*map(_runs, lines)))
    pairs = [(x, y) for x in lines for y in lines]
    expect = [len(_runs(x) & _runs(y)) / len(_runs(x) | _runs(y)) for x, y in pairs]
    assert np.allclose(LD.jaccard([x for x, _ in pairs], [y for _, y in pairs]), expect, atol=1e-15)
    n, keys, _ = LD.band_keys(lines)
    assert list(n) == [len(_runs(x)) for x in lines]
    for k, line in enumerate(lines):  # keys depend on the line only, not on its chunk
        assert (LD.band_keys([line])[1][0] == keys[k]).all()


def test_prefix_pairs(spark):
    rnd = random.Random(12)
    lines = []
    for _ in range(25):
        base = "".join(rnd.choices("abcde ", k=rnd.randint(3, 150)))
        lines += [base, base + "x", base[:len(base) // 2] + "#" + base[len(base) // 2:], base[::-1]]
    lines = sorted(set(lines))
    rows = [(key, k, len(_runs(x)), k if k % 7 else 0) for key in (1, 2) for k, x in enumerate(lines) if k % key == 0]
    members = spark.createDataFrame(rows, "key long, a long, n int, comp long")
    texts = spark.createDataFrame(list(enumerate(lines)), "a long, line string")
    made = LD.prefix_pairs(members, texts)
    sets = [_runs(x) for x in lines]
    comp = {r[1]: r[3] for r in rows}
    near = {(i, j) for j in range(len(lines)) for i in range(j) if comp[i] != comp[j]
            and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(near) > 15 and near <= {(r.a, r.b) for r in made.collect()}
    assert {(r.a, r.b) for r in LD.similar(made, texts).collect()} == near
    sketch = LD.band_keys(lines)[2]
    sketches = spark.createDataFrame([(k, [int(x) for x in v]) for k, v in enumerate(sketch)], "a long, sketch array<long>")
    fewer = {(r.a, r.b) for r in LD.prefix_pairs(members, texts, sketches=sketches).collect()}
    assert near <= fewer and len(fewer) < made.count()


def test_sketches_lose_no_pair(spark):
    lines = sorted(set(_near_lines(17, 60)) | {"a", "ab", "x" * 300, "xy" * 400, "xy" * 400 + "z"})
    n, _, sketch = LD.band_keys(lines)
    for k, line in enumerate(lines):  # a sketch depends on the line only
        assert (LD.band_keys([line])[2][0] == sketch[k]).all()
    texts = spark.createDataFrame([(k, int(n[k]), [int(x) for x in sketch[k]], line) for k, line in enumerate(lines)],
                                  "a long, n int, sketch array<long>, line string")
    every = [(i, j) for j in range(len(lines)) for i in range(j)]
    sets = [_runs(x) for x in lines]
    near = {(i, j) for i, j in every if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    left = {(r.a, r.b) for r in LD.possible(spark.createDataFrame(every, "a long, b long"), texts).collect()}
    assert len(near) > 40 and near <= left and len(left) < len(every) / 20


def test_sketches_of_long_lines(spark):
    """Long lines over few words: the short sketch passes nearly every pair, the wide one next to none but the near."""
    rnd = random.Random(31)
    words = ["".join(rnd.choices("abcdefghijkl", k=4)) for _ in range(4000)]
    lines = [" ".join(rnd.choices(words, k=k)) for k in (20, 60, 90, 130, 200, 260, 400, 410, 500, 520, 640) for _ in range(3)]
    lines += [x[:5] + "#" + x[6:] for x in lines] + [x[:int(len(x) * 0.85)] for x in lines]
    n, _, sketch = LD.band_keys(lines)
    wide, count = LD.wide_sketches(lines)
    assert [c > 0 for c in count] == [k > 256 for k in n] and len(set(count)) > 3
    for k, line in enumerate(lines):  # a sketch depends on the line only
        assert (LD.wide_sketches([line])[0] == wide[count[:k].sum():count[:k + 1].sum()]).all()
    rows = [(k, int(n[k]), [int(x) for x in sketch[k]], line) for k, line in enumerate(lines)]
    texts = spark.createDataFrame(rows, "a long, n int, sketch array<long>, line string")
    sets = [_runs(x) for x in lines]
    every = [(i, j) for j in range(len(lines)) for i in range(j) if min(n[i], n[j]) >= 0.8 * max(n[i], n[j])]
    pairs = spark.createDataFrame(every, "a long, b long")
    near = {(i, j) for i, j in every if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    left = {(r.a, r.b) for r in LD.possible(pairs, LD.with_wide(texts)).collect()}
    assert len(near) > 50 and near <= left and len(left - near) < len(near)
    assert LD.possible(pairs, texts).count() > 2 * len(left)
    # a prefix by the sizes of the pair: fewer candidates, none of the near ones lost
    members = spark.createDataFrame([(1, k, int(n[k]), k) for k in range(len(lines))], "key long, a long, n int, comp long")
    sketches = texts.select("a", "sketch")
    made = {(r.a, r.b) for r in LD.prefix_pairs(members, texts, sketches=sketches).collect()}
    assert near <= made and len(made) < LD.prefix_pairs(members, texts).count()


def test_components_go_on(spark):
    rnd = random.Random(8)
    rounds = [[(rnd.randrange(60), rnd.randrange(60)) for _ in range(k)] for k in (18, 7, 5, 1)]
    at, roots = list(range(60)), None
    for links in rounds:
        for a, b in links:
            low, high = sorted((at[a], at[b]))
            at = [low if r == high else r for r in at]
        found = spark.createDataFrame(links, "a long, b long")
        roots = LD.connected_components(found) if roots is None else LD._merged(roots, found)
        got = dict(map(tuple, roots.collect()))
        assert roots.count() == len(got) and [got.get(k, k) for k in range(60)] == at


def test_line_dedup_frees_what_it_wrote(spark):
    """Of a whole run only the places that its lazy result reads, and small link tables, stay in the shared folder."""
    folder = ensure_checkpoint_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    df = spark.createDataFrame(list(enumerate(_near_lines(6, 20))), "doc_id long, text string")
    got = LD.dedup(df)
    new = [x for x in set(os.listdir(folder)) - before if x.count("-") == 1]  # Spark's own folders have more
    assert "gone" in {x.split("-")[0] for x in new} <= {"gone", "cc", "joined"}
    assert 20 <= got.where("text != ''").count() < 40


def test_materialise_frees_its_shuffles(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for d in manager.localDirsString() for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}

    before, was = files(), spark.conf.get(common.FREE_SHUFFLES)
    made = common.materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "freed")
    for _ in range(50):  # files go shortly after the query ends
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(common.FREE_SHUFFLES) == was
    assert sorted(map(tuple, made.collect())) == [(k, 143 - (k == 6)) for k in range(7)]
    common.discard(made)
    assert not any(x.startswith("freed-") for x in os.listdir(ensure_checkpoint_dir(spark).removeprefix("file://")))


def test_prefix_pairs_in_any_order(spark, monkeypatch):
    """Counts that share one cell order shingles by their hash alone: more candidates at most, none lost."""
    lines = sorted(set(_near_lines(21, 25)) | {"a", "ab", "xy" * 40})
    sets = [_runs(x) for x in lines]
    members = spark.createDataFrame([(1, k, len(x), k) for k, x in enumerate(sets)], "key long, a long, n int, comp long")
    texts = spark.createDataFrame(list(enumerate(lines)), "a long, line string")
    near = {(i, j) for j in range(len(lines)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    for cells in (2, LD.CELLS):
        monkeypatch.setattr(LD, "CELLS", cells)
        for most in (0, LD.SENT_PAIRS):
            monkeypatch.setattr(LD, "SENT_PAIRS", most)
            assert len(near) > 15 and near <= {(r.a, r.b) for r in LD.prefix_pairs(members, texts).collect()}


def test_line_dedup_columns(spark):
    """Columns of any name stay; equal lines go in any order of rows and partitions."""
    rows = [(3, "same line here\nb", 1, "x"), (1, "same line here", 2, "y"), (2, "c\nsame line here\nsame line here", 3, "z")]
    df = spark.createDataFrame(rows, "doc_id int, text string, first int, line string")
    for parts in (1, 3):
        got = LD.dedup(df.repartition(parts))
        assert got.columns == df.columns
        assert sorted(map(tuple, got.collect())) == [(1, "same line here", 2, "y"), (2, "c", 3, "z"), (3, "b", 1, "x")]


def test_line_dedup_long_runs(spark):
    rnd = random.Random(9)
    text = " ".join("".join(rnd.choices("abcdefghijklmnop", k=7)) for _ in range(50)) + " "
    url = "http://x.org/" + "abcdefghi" * 3
    rows = [f"{url}", f"{url}k",                                   # 40 and 41 characters without a space
            f"{text}http://x.org/{'ab' * 20}", f"{text}",          # with and without a long token
            "one two three four five six seven eight\tnine ten eleven", "one two three four five six seven eight nine ten eleven"]
    assert len(rows[0]) == 40
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id for r in LD.dedup(df).collect() if r.text == ""} == {1, 3, 5}


# -- decontamination ---------------------------------------------------------------------

def test_leaks(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefgh", k=3))
    items = [(i, " ".join(word() for _ in range(rnd.randint(3, 50)))) for i in range(60)] + [(60, None), (61, "")]
    rows = [(d, " ".join(word() for _ in range(rnd.randint(0, 300)))) for d in range(80)]
    rows += [(100 + i, f"{word()} {word()} {t.upper() if i % 2 else t}! {word()}") for i, t in items[:60]]
    rows += [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    for size in (DC.SHARD_BYTES, 300):
        got = {(r.doc_id, r.item_id) for r in DC.find_leaks(docs, tests, size).collect()}
        assert {(100 + i, i) for i in range(60)} <= got
        clean = {(d, i) for d, i in got if d < 80}
        for d, i in clean:  # a clean text may hold a very short item
            assert f" {items[i][1]} " in f" {rows[d][1]} "
    kept = {r.doc_id for r in DC.decontaminate(docs, tests).collect()}
    assert kept == {d for d, _ in rows if d < 100 or d >= 900} - {d for d, _ in clean}
    assert DC.find_leaks(docs, tests.limit(0)).count() == 0


def test_leaks_against_exhaustive_scores(spark):
    """Every passage against every item by plain BM25; the shards change neither pairs nor scores."""
    rnd = random.Random(31)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=3)) for _ in range(120)]
    text = lambda n: rnd.choices(vocabulary, k=n)
    items = [text(rnd.randint(4, 40)) for _ in range(50)]
    items += [w[:-1] for w in items[:10]]  # near items
    docs = [text(rnd.randint(0, 120)) for _ in range(30)]
    for w in items[:40]:
        k = rnd.randrange(len(w))
        docs.append(text(rnd.randint(0, 60)) + w[:k] + [rnd.choice(vocabulary)] + w[k + 1:] + text(rnd.randint(0, 60)))
        docs.append(text(rnd.randint(0, 60)) + w + text(rnd.randint(0, 60)))
    n, mean, longest = len(items), sum(map(len, items)) / len(items), max(map(len, items))
    df = {w: sum(w in x for x in items) for w in vocabulary}

    def score(item, words):
        norm = DC.K1 * (1 - DC.B + DC.B * len(item) / mean)
        return sum(math.log(1 + (n - df[w] + .5) / (df[w] + .5)) * item.count(w) * (DC.K1 + 1) / (item.count(w) + norm)
                   for w in set(item) & set(words))

    def overlap(part, passage):
        k = min(5, len(part))
        runs, there = ({tuple(x[i:i + k]) for i in range(len(x) - k + 1)} for x in (part, passage))
        return len(runs & there) / len(runs)

    want = {}
    for d, words in enumerate(docs):
        pieces = max(1, -(-len(words) // longest))
        for s in range(max(1, pieces - 1)):
            passage = words[s * longest:(s + 2) * longest]
            for i, item in enumerate(items):
                cut = -(-3 * len(item) // 4)
                if passage and score(item, passage) >= DC.SCORE_SHARE * score(item, item) - 1e-9 and (
                        overlap(item, passage) >= .8 or cut < len(item)
                        and min(overlap(item[:cut], passage), overlap(item[cut:], passage)) >= .8):
                    want[d, i] = max(want.get((d, i), 0), score(item, passage))
    assert len(want) > 60
    table = lambda x, name: spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(x)], f"{name} long, text string")
    for limit in (DC.SHARD_BYTES, 300):
        rows = DC.find_leaks(table(docs, "doc_id"), table(items, "item_id"), limit).collect()
        got = {(r.doc_id, r.item_id): r.score for r in rows}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    assert DC.find_leaks(table(docs, "doc_id"), table(items, "item_id").limit(0)).count() == 0


def test_leaks_of_edited_items():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abcdefgh", k=4))
    items = [[word() for _ in range(rnd.randint(20, 60))] for _ in range(60)]
    index = DC.build_index([(i, " ".join(w)) for i, w in enumerate(items)])
    number = {i: k for k, i in enumerate(index.ids)}
    runs = lambda w: {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    tried = 0
    for i, w in enumerate(items):
        k = rnd.randrange(len(w))
        for edited in (w[:-1], w[:-2], w[:-3], w[2:], w[:k] + ["other"] + w[k + 1:], w[:k] + w[k + 1:],
                       w[:k] + ["one", "two", "three"] + w[k:], w[:-3] + ["one", "two", "three"]):
            text = " ".join([word() for _ in range(70)] + edited + [word() for _ in range(70)])
            found = number[i] in {h[1] for h in DC.search(index, [text])}
            if len(runs(w) & runs(edited)) >= 0.8 * len(runs(w)):
                tried += 1
                assert found, (i, edited)
    assert tried > 300


# -- quality -----------------------------------------------------------------------------

def test_quality_held_out(spark):
    rows = QUERIES["op10_quality_classifier"](spark, SF001).collect()
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    assert len(rows) == 200 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, quality[r.doc_id]) for r in rows if r.held_out and r.doc_id in quality]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_quality_training_rows(spark):
    """The n rows with the smallest hashes, also where many share one; each copy counts."""
    from pyspark.sql import functions as F
    rnd = random.Random(3)
    rows = [([float(rnd.randint(0, 5))] * 2, rnd.randint(0, 1)) for _ in range(300)] + [([7.0, 7.0], 1)] * 200
    df = spark.createDataFrame(rows, "statistics array<double>, _y int").repartition(7)
    for hashed in (F.xxhash64("statistics", "_y"), F.lit(-5).cast("long"),
                   F.xxhash64("statistics", "_y").bitwiseAND(0xFF) - 128):
        some = df.withColumn("_o", hashed)
        every = sorted((r._o, r._y, r.statistics) for r in some.collect())
        for n in (0, 1, 57, 250, 499, 500, 900):
            assert [r[0] for r in Q.first_by_hash(some, n)] == [r[0] for r in every[:n]]
    some = df.withColumn("_o", F.xxhash64("statistics", "_y"))
    every = sorted((r._o, r._y, r.statistics) for r in some.collect())
    assert Q.first_by_hash(some, 250) == every[:250]
    assert Q.first_by_hash(some.limit(0), 10) == []


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (4, 0)], "doc_id long, quality int")
    assert Q.classify(_odd(spark), labels).count() == 8
    assert {r.score for r in Q.classify(_odd(spark), labels.limit(0)).collect()} == {0.5}
    x = np.array([[k % 7, k] for k in range(200)], float)
    forest = Q.fit(x, (x[:, 0] > 3).astype(float), trees=20, depth=2)
    assert ((forest.score(x) > 0.5) == (x[:, 0] > 3)).all()


# -- language model ----------------------------------------------------------------------

def test_lm_gradients():
    rng = np.random.default_rng(0)
    net = LM.new_net(np.arange(60, 0, -1.0))
    net = LM.Net({k: (v + rng.standard_normal(v.shape) * 0.1).astype(np.float64) for k, v in net.p.items()}, net.first, net.of)
    ids, zero = rng.integers(0, 60, (7, 3)), np.zeros((3, LM.HIDDEN))
    g, _ = LM.gradients(net, ids, zero)
    for name, v in net.p.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), v.shape)
        v[at] += 1e-5
        up = LM.gradients(net, ids, zero)[1]
        v[at] -= 2e-5
        down = LM.gradients(net, ids, zero)[1]
        v[at] += 1e-5
        assert g[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_lm_tiles_and_cells():
    """Tiles of classes give the logs that the classes give one by one; cells find what a search finds."""
    rng = np.random.default_rng(5)
    net = LM.new_net(1000 / np.arange(1, 400.0))
    net = LM.Net({k: v + rng.standard_normal(v.shape) * 0.1 for k, v in net.p.items()}, net.first, net.of)
    for ids in (rng.integers(0, 399, 1500), np.zeros(5, int), np.full(100, 398), rng.integers(300, 399, 70)):
        states = rng.standard_normal((len(ids), LM.HIDDEN))
        g = {k: np.zeros_like(v) for k, v in net.p.items()}
        logs, back = LM.token_gradients(net, states, ids, g)
        assert np.allclose(logs, LM.token_logs(net, states, ids), atol=1e-9)
        up, down = states.copy(), states.copy()
        up[:, 3] += 1e-5
        down[:, 3] -= 1e-5
        slope = (LM.token_logs(net, down, ids) - LM.token_logs(net, up, ids)) / 2e-5
        assert np.allclose(slope, back[:, 3], atol=1e-6)
        assert abs(g["ob"].sum()) < 1e-8
    for size in (1, 2, 3000):
        tokens = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2))
        lexicon = LM.Lexicon(tokens, np.arange(len(tokens)), np.arange(len(tokens), dtype=np.int32), np.zeros(1, np.int32), 0)
        asked = np.concatenate((tokens, tokens + np.uint64(1), [np.uint64(0), ~np.uint64(0)]))
        hit = np.isin(asked, tokens)
        _, c = lexicon.look_up(asked, np.zeros(len(asked), int))
        assert (c == np.where(hit, np.searchsorted(tokens, asked), -1)).all()


def test_lm_scores(spark, monkeypatch):
    monkeypatch.setattr(LM, "TABLE", 500)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = QUERIES["op7_lm_score"](spark, SF001).collect()
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b"\n"]
    c = {}
    for d, t in docs.items():
        if zlib.crc32(str(d).encode()) % 10:
            for w in words(t):
                c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    for r in rows:
        w = words(docs[r.doc_id])
        base = sum(math.log10((c.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in c for x in w), n)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert len(LM.score_documents(_odd(spark)).collect()) == 8
    assert LM.score_documents(_odd(spark).limit(0)).count() == 0


def test_lm_learns_every_token_once():
    sizes = np.array([1, LM.WINDOW, LM.WINDOW + 1, 900])
    ids = np.arange(sizes.sum(), dtype=np.int32)
    w = LM.windows_of(ids, sizes, 7777)
    targets = w[:, 1:]
    assert targets[targets >= 0].tolist() == ids.tolist()
    begin = np.cumsum(sizes) - sizes
    for row in w:  # each behind the token before it, a text's first one behind the start
        assert row[0] == (7777 if row[1] in begin else row[1] - 1)
    assert len(LM.windows_of(ids[:0], sizes[:0], 7777)) == 0


def test_lm_learns_nothing_from_filling():
    rng = np.random.default_rng(1)
    net = LM.new_net(np.arange(60, 0, -1.0))
    net = LM.Net({k: (v + rng.standard_normal(v.shape) * 0.1).astype(np.float64) for k, v in net.p.items()}, net.first, net.of)
    ids, zero = rng.integers(0, 60, (7, 1)), np.zeros((1, LM.HIDDEN))
    filled = np.concatenate((ids, np.full((4, 1), -1)))
    (a, x), (b, y) = LM.gradients(net, ids, zero), LM.gradients(net, filled, zero)
    assert x == pytest.approx(y) and all(np.allclose(a[k], b[k]) for k in a)


def test_lm_trains_behind_openings(spark):
    # after "ask" only "yes" ever follows, but far behind the opening of each text
    opening = " ".join("abcdefgh"[k % 8] for k in range(40))
    rows = [(i, opening + " ask yes no" * 200) for i in range(400)]
    rows = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    counts = LM.token_counts(rows)
    lexicon, masses, _ = LM._lexicon(counts)
    net = LM.train_round(rows, LM.new_net(masses), lexicon)
    h, bucket, _ = LM.tokenise(["ask yes no ask yes"])
    ids = lexicon.look_up(h, bucket)[0][:-1]
    last = lambda n: LM.score_texts(n, [ids], lexicon.end)[0] - LM.score_texts(n, [ids[:-1]], lexicon.end)[0]
    assert last(net) > math.log(0.6) > last(LM.new_net(masses))


# -- pipeline ----------------------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    before = docs.count()
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF001)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = P.materialise(docs, "test")
        assert docs.count() <= before
        before = docs.count()
    mixed = P.mix_sources(spark, docs, SF001)
    assert mixed.count() == before and {"text", "taken"} <= set(mixed.columns)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    marked = [quality[r.doc_id] for r in mixed.collect() if r.doc_id in quality]
    assert sum(marked) >= 0.95 * len(marked)


def test_block_pairs(spark, monkeypatch):
    """Whatever the blocks, each two classes of different components meet once; of these the sketches lose no near pair."""
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghijkl", k=4)) for _ in range(4000)]
    lines = [" ".join(rnd.choices(words, k=k)) for k in (1, 2, 20, 60, 90, 130, 200, 260, 400, 410, 500) for _ in range(3)]
    lines += [x[:5] + "#" + x[6:] for x in lines] + [x[:int(len(x) * 0.85)] for x in lines]
    lines = sorted(set(lines))
    n, _, sketch = LD.band_keys(lines)
    sets = [_runs(x) for x in lines]
    rows = [(k, int(n[k]), k if k % 5 else 0, [int(x) for x in sketch[k]], line) for k, line in enumerate(lines)]
    texts = LD.with_wide(spark.createDataFrame(rows, "a long, n int, comp long, sketch array<long>, line string"))
    near = {(i, j) for j in range(len(lines)) for i in range(j) if (i % 5 or j % 5)
            and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    classes = texts.select("a", "n", "comp", F.when(F.size("wide") > 0, F.col("wide")).otherwise(F.col("sketch")).alias("longs"))
    for block, shingles in ((LD.BLOCK, LD.BLOCK_SHINGLES), (3, LD.BLOCK_SHINGLES), (LD.BLOCK, 2000)):
        monkeypatch.setattr(LD, "BLOCK", block)
        monkeypatch.setattr(LD, "BLOCK_SHINGLES", shingles)
        got = [(r.a, r.b) for r in LD.block_pairs(classes).collect()]
        assert len(near) > 40 and near <= set(got) and len(got) == len(set(got)) < 2 * len(near)
    # few shingles for many lines: the last round compares sketches and makes no row per shingle
    monkeypatch.setattr(LD, "JOINED", 1e9)
    members = spark.createDataFrame([(1, *r[:3]) for r in rows], "key long, a long, n int, comp long")
    made = {(r.a, r.b) for r in LD.prefix_pairs(members, texts, sketches=texts).collect()}
    assert made == set(got)
    assert made < {(r.a, r.b) for r in LD.prefix_pairs(members, texts, sketches=texts.select("a", "sketch")).collect()}


def test_marked_rows_hold_all_that_are_asked(spark):
    rows = spark.range(3000).select(F.xxhash64("id").alias("a"), "id")
    ids = rows.where("id % 7 = 0").select("a")
    got = {r.id for r in LD._marked(rows, ids).collect()}
    assert set(range(0, 3000, 7)) <= got and len(got) < 500
