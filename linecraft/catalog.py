"""Registered queries over the fixture tables and their DuckDB oracle statements.

Each query takes (spark, sf_dir) and reads whole tables. ``ORACLE`` holds, for the
queries that SQL can state, an equivalent DuckDB statement with identical column names
and types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecraft import oracle as O
from linecraft.functions import text as T
from linecraft.operators import metrics as M
from linecraft.operators.chunk import word_positions
from linecraft.plans import corpus as C
from linecraft.plans import scoring as S
from linecraft.session import ship_package, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return run
    return deco


def _docs(spark, sf):
    return spread(table(spark, sf, "documents"))


# ---------------------------------------------------------------------------------------
# F-corpus
# ---------------------------------------------------------------------------------------

@register("clean_text", f"""
SELECT doc_id, {O.clean('text')} AS clean FROM documents
""")
def q_clean_text(spark, sf):
    """Cleaned text of every document."""
    return _docs(spark, sf).select("doc_id", T.clean_text("text", T.LATIN_CHARS, T.LATIN_RANGES, {}).alias("clean"))


@register("word_positions", f"""
WITH {O.chunks_cte()}
SELECT pos, doc_id, word FROM words
""")
def q_word_positions(spark, sf):
    """B7 + D1: every word with its position in the concatenated corpus."""
    return word_positions(C.clean_corpus(_docs(spark, sf)), "doc_id")


@register("corpus_chunks", f"""
WITH {O.chunks_cte()}
SELECT chunk, first_key, sentence, repeated FROM chunks
""")
def q_corpus_chunks(spark, sf):
    """E1 + D10: every complete chunk of the cleaned word stream."""
    return C.corpus_chunks(_docs(spark, sf)).select("chunk", "first_key", "sentence", "repeated")


@register("corpus_sentences", f"""
WITH {O.chunks_cte()},
kept AS (SELECT chunk, sentence FROM chunks WHERE NOT repeated ORDER BY chunk LIMIT 10000)
SELECT chunk, sentence FROM kept WHERE sentence IS NOT NULL AND NOT contains(sentence, 'nan')
""")
def q_corpus_sentences(spark, sf):
    """F-corpus end to end: A3 -> F1 -> B6 -> D1 -> E1 -> D10 -> E6 -> B8."""
    return C.build_corpus(_docs(spark, sf))


# ---------------------------------------------------------------------------------------
# F-score
# ---------------------------------------------------------------------------------------

_PAIRS_SQL = f"""
WITH {O.chunks_cte()},
pairs AS (SELECT chunk, lang, sentence AS ref, {O.corrupt('w')} AS pred FROM chunks),
counted AS (SELECT lang, CAST(length(ref) AS BIGINT) AS ref_chars,
            CAST({O.char_edits('ref', 'pred')} AS BIGINT) AS char_edits,
            CAST(len({O.tokenise('ref')}) AS BIGINT) AS ref_words,
            CAST({O.word_edits(O.tokenise('ref'), O.tokenise('pred'))} AS BIGINT) AS word_edits
            FROM pairs)"""


@register("score_by_lang", _PAIRS_SQL + """
SELECT lang, CAST(count(*) AS BIGINT) AS n_pairs,
       CAST(sum(ref_chars) AS BIGINT) AS ref_chars, CAST(sum(char_edits) AS BIGINT) AS char_edits,
       CAST(sum(ref_words) AS BIGINT) AS ref_words, CAST(sum(word_edits) AS BIGINT) AS word_edits,
       CASE WHEN sum(ref_chars) > 0 THEN CAST(sum(char_edits) AS DOUBLE) / CAST(sum(ref_chars) AS DOUBLE) END AS cer,
       CASE WHEN sum(ref_words) > 0 THEN CAST(sum(word_edits) AS DOUBLE) / CAST(sum(ref_words) AS DOUBLE) END AS wer
FROM counted GROUP BY lang
""")
def q_score_by_lang(spark, sf):
    """F-score: C8 -> D2/D3 (+D9) per language over every chunk pair."""
    return S.score_by(_docs(spark, sf), ["lang"])


@register("pair_documents", """
WITH refs AS (SELECT doc_id, text AS ref FROM documents),
     preds AS (SELECT doc_id, translate(text, 'ae', 'oé') AS pred FROM documents)
SELECT doc_id, CAST(length(ref) AS BIGINT) AS ref_chars, CAST(length(pred) AS BIGINT) AS pred_chars,
       ref = pred AS exact
FROM preds JOIN refs USING (doc_id)
""")
def q_pair_documents(spark, sf):
    """A prediction table joined one to one to a reference table by id."""
    refs = _docs(spark, sf).select("doc_id", F.col("text").alias("ref"))
    preds = _docs(spark, sf).select("doc_id", F.translate("text", "ae", "oé").alias("pred"))
    return M.pair(preds, refs, "doc_id").select(
        "doc_id", F.length("ref").cast("long").alias("ref_chars"),
        F.length("pred").cast("long").alias("pred_chars"), (F.col("ref") == F.col("pred")).alias("exact"))


@register("join_regions", """
SELECT conv_id AS image_id, string_agg(text, chr(10) ORDER BY turn) AS text,
       CAST(count(*) AS BIGINT) AS n_regions
FROM conversations GROUP BY conv_id
""")
def q_join_regions(spark, sf):
    """Region texts of one image (conversation) joined by newline in box (turn) order."""
    conv = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("image_id"), F.col("turn").alias("box_no"), "text")
    return M.join_regions(conv)


# Sums of doubles depend on the summation order, which differs between engines and
# partitionings; loss columns are reported to 9 decimals so results compare exactly.
LOSS_DIGITS = 9


@register("eval_loss", """
SELECT event_type AS epoch, round(avg(value), 9) AS eval_loss FROM events GROUP BY event_type
""")
def q_eval_loss(spark, sf):
    """Mean loss per group (events.value by event_type)."""
    ev = table(spark, sf, "events").select(F.col("event_type").alias("epoch"), F.col("value").alias("loss"))
    return M.mean_eval_loss(ev).withColumn("eval_loss", F.round("eval_loss", LOSS_DIGITS))


@register("train_loss", """
SELECT event_type AS epoch, round(sum(value) / count(*), 9) AS train_loss, CAST(count(*) AS BIGINT) AS steps
FROM events GROUP BY event_type
""")
def q_train_loss(spark, sf):
    """Sum of step losses / number of batches per group."""
    ev = table(spark, sf, "events").select(F.col("event_type").alias("epoch"), F.col("value").alias("loss"))
    return M.mean_train_loss(ev).withColumn("train_loss", F.round("train_loss", LOSS_DIGITS))


# ---------------------------------------------------------------------------------------
# Lines, labels and the render plan (F-plan)
# ---------------------------------------------------------------------------------------

from linecraft.operators import generate as GEN  # noqa: E402
from linecraft.operators import render as R  # noqa: E402
from linecraft.plans import render as PR  # noqa: E402
from linecraft.sources import textfiles as TF  # noqa: E402


def _lines(spark, sf):
    return TF.read_lines(_docs(spark, sf), "doc_id", "text")


@register("read_lines", f"""
WITH {O.lines_cte(max_chars=200)}
SELECT line_no, doc_id, text FROM lines
""")
def q_read_lines(spark, sf):
    """A1: non-empty lines of every document, cut to 200 characters, globally numbered."""
    return TF.read_lines(_docs(spark, sf), "doc_id", "text", 200)


_FONTS_SQL = "(VALUES " + ", ".join(f"({i}, {O.lit(p)})" for i, p in enumerate(PR.FIXTURE_FONTS)) + ") AS f(font_no, font)"
_RECIPES_SQL = "(VALUES " + ", ".join(
    "(" + ", ".join(str(v).lower() if isinstance(v, bool) else str(v) for v in r) + ")" for r in R.RECIPES
) + ") AS r(" + ", ".join(R.RECIPE_COLUMNS) + ")"


@register("render_plan", f"""
WITH {O.lines_cte(max_chars=200)},
cnt AS (SELECT count(*) // 7 AS n FROM lines),
blocked AS (SELECT line_no, text,
            CAST(CASE WHEN (SELECT n FROM cnt) = 0 THEN 7 ELSE least(line_no // (SELECT n FROM cnt), 7) END AS INTEGER) AS block
            FROM lines),
planned AS (SELECT b.line_no, b.block, CAST(b.line_no - b.block * (SELECT n FROM cnt) AS BIGINT) AS "index", b.text,
            r.background, r.distortion, r.distortion_orientation, r.skew_angle, r.random_skew, r.blur, r.random_blur,
            {O.randint('0', str(len(PR.FIXTURE_FONTS) - 1), 42, 'font', 'b.line_no')} AS font_no
            FROM blocked b JOIN {_RECIPES_SQL} ON r.block = b.block)
SELECT p.line_no, p.block, p."index", p.text, f.font, 64 AS size, p.background, p.distortion,
       p.distortion_orientation,
       CAST(CASE WHEN p.random_skew THEN {O.randint('-p.skew_angle', 'p.skew_angle', 42, 'angle', 'p.line_no')}
            ELSE p.skew_angle END AS INTEGER) AS angle,
       CASE WHEN p.random_blur THEN {O.uniform(42, 'blur', 'p.line_no')} * p.blur ELSE CAST(p.blur AS DOUBLE) END AS blur_radius,
       CAST({O.randint('0', '136', 42, 'fill0', 'p.line_no')} AS INTEGER) AS fill_r,
       CAST({O.randint('0', '136', 42, 'fill1', 'p.line_no')} AS INTEGER) AS fill_g,
       CAST({O.randint('0', '136', 42, 'fill2', 'p.line_no')} AS INTEGER) AS fill_b,
       {O.safe_name('CAST(p."index" AS VARCHAR)')} || '.jpg' AS image_name
FROM planned p JOIN {_FONTS_SQL} ON f.font_no = p.font_no
""")
def q_render_plan(spark, sf):
    """F-plan: C3/F7 blocks, F5/C4 fonts, F6 drawn parameters, B14 names for every line."""
    return PR.plan_lines(spark, _docs(spark, sf))


@register("recipe_blocks", f"""
WITH {O.lines_cte()},
cnt AS (SELECT count(*) // 7 AS n FROM lines),
blocked AS (SELECT CAST(CASE WHEN (SELECT n FROM cnt) = 0 THEN 7 ELSE least(line_no // (SELECT n FROM cnt), 7) END AS INTEGER) AS block
            FROM lines)
SELECT block, CAST(count(*) AS BIGINT) AS n_lines FROM blocked GROUP BY block
""")
def q_recipe_blocks(spark, sf):
    """Number of lines per recipe block (seven equal blocks plus the remainder)."""
    return R.assign_recipes(_lines(spark, sf)).groupBy("block").agg(F.count(F.lit(1)).alias("n_lines"))


@register("parse_labels", f"""
WITH {O.lines_cte()},
s AS (SELECT line_no, {O.py_strip('text')} AS s FROM lines)
SELECT line_no, substr(s, 1, strpos(s, ' ') - 1) AS file_name, substr(s, strpos(s, ' ') + 1) AS text
FROM s WHERE s <> '' AND strpos(s, ' ') > 0
""")
def q_parse_labels(spark, sf):
    """A4: label lines split on the first space into file name and label."""
    good, _ = TF.parse_labels(_lines(spark, sf).select("line_no", "text"))
    return good


@register("label_quarantine", f"""
WITH {O.lines_cte()},
s AS (SELECT line_no, {O.py_strip('text')} AS s FROM lines)
SELECT line_no, s AS stripped FROM s WHERE s <> '' AND strpos(s, ' ') = 0
""")
def q_label_quarantine(spark, sf):
    """A4/Q5: label lines without a space, kept aside instead of reusing the previous row."""
    _, bad = TF.parse_labels(_lines(spark, sf).select("line_no", "text"))
    return bad.select("line_no", "stripped")


@register("label_lines", f"""
WITH {O.lines_cte()}
SELECT line_no AS idx, CAST(line_no AS VARCHAR) || '.jpg ' || text AS line FROM lines
""")
def q_label_lines(spark, sf):
    """A5: `<i>.<ext> <label>` line for every string."""
    return TF.label_lines(_lines(spark, sf).withColumnRenamed("line_no", "idx"), "idx", "text")


@register("display_text", f"""
WITH {O.lines_cte()}
SELECT line_no, replace(upper(text), 'ẞ', 'SS') AS upper_text, lower(text) AS lower_text,
       array_to_string(list_reverse(string_split(text, ' ')), ' ') AS rtl_text,
       replace(text, ' ', '') AS no_space_text
FROM lines
""")
def q_display_text(spark, sf):
    """Case change, right-to-left word order and space removal beside the label."""
    ln = _lines(spark, sf)
    return ln.select("line_no", T.change_case("text", "upper").alias("upper_text"),
                     T.change_case("text", "lower").alias("lower_text"),
                     T.reverse_words("text").alias("rtl_text"),
                     T.strip_spaces_if("text", 0).alias("no_space_text"))


@register("sample_names", f"""
WITH {O.lines_cte()}
SELECT line_no, {O.safe_name("text || '_' || CAST(line_no AS VARCHAR)")} AS name0,
       {O.safe_name("CAST(line_no AS VARCHAR) || '_' || text")} AS name1,
       {O.safe_name("CAST(line_no AS VARCHAR)")} AS name2
FROM lines
""")
def q_sample_names(spark, sf):
    """NFKC file names in the three name formats."""
    ln = _lines(spark, sf)
    return ln.select("line_no", *[T.sample_name(F.col("text"), F.col("line_no"), f).alias(f"name{f}")
                                  for f in (0, 1, 2)])


@register("skip_take_cycle", f"""
WITH {O.lines_cte()},
cnt AS (SELECT count(*) AS L FROM lines),
p AS (SELECT L // 7 AS skip, L - L // 7 AS rem, 2 * L AS total FROM cnt),
idx AS (SELECT range AS idx FROM range((SELECT total FROM p)))
SELECT CAST(idx.idx AS BIGINT) AS idx, lines.line_no, lines.text
FROM idx JOIN lines ON lines.line_no = (SELECT skip FROM p) + idx.idx % (SELECT rem FROM p)
""")
def q_skip_take_cycle(spark, sf):
    """E5: skip the first block of lines, then cycle the rest up to twice the line count."""
    ln = _lines(spark, sf).select("line_no", "text")
    L = ln.count()
    return GEN.skip_take_cycle(ln, 2 * L, L // 7).select("idx", "line_no", "text")


@register("sample_source", f"""
WITH {O.lines_cte()},
cnt AS (SELECT count(*) AS L FROM lines),
idx AS (SELECT range AS idx FROM range((SELECT 3 * L // 2 FROM cnt)))
SELECT CAST(idx.idx AS BIGINT) AS idx, lines.line_no, lines.text, f.font
FROM idx JOIN lines ON lines.line_no = idx.idx % (SELECT L FROM cnt)
JOIN {_FONTS_SQL} ON f.font_no = idx.idx % {len(PR.FIXTURE_FONTS)}
""")
def q_sample_source(spark, sf):
    """Bounded round-robin of strings and fonts (1.5 x the number of lines)."""
    ln = _lines(spark, sf).select("line_no", "text")
    L = ln.count()
    return GEN.sample_source(spark, ln, PR.fonts_table(spark), 3 * L // 2).select("idx", "line_no", "text", "font")


_PART_DICT_SQL = f"""
pw AS (SELECT DISTINCT unnest({O.tokenise('p_name')}) AS word FROM part),
dict AS (SELECT CAST(row_number() OVER (ORDER BY word) - 1 AS BIGINT) AS word_no, word FROM pw)"""


@register("dict_from_words", f"""
WITH {_PART_DICT_SQL}
SELECT CAST(NULL AS VARCHAR) AS lang, word_no, word FROM dict
""")
def q_dict_from_words(spark, sf):
    """A2: a word dictionary derived from part names, numbered in word order."""
    return TF.dict_from_words(table(spark, sf, "part"), "p_name")


@register("strings_from_dict", f"""
WITH {_PART_DICT_SQL},
n AS (SELECT count(*) AS n FROM dict),
picks AS (SELECT p.p_partkey AS idx, j FROM part p, range(0, 3) t(j)),
picked AS (SELECT idx, j, {O.sql_h(42, 'dict_word', 'floor(idx / 1000)::BIGINT', 'idx', 'j')} % (SELECT n FROM n) AS w FROM picks)
SELECT picked.idx, string_agg(dict.word, ' ' ORDER BY j) AS text
FROM picked JOIN dict ON dict.word_no = picked.w GROUP BY picked.idx
""")
def q_strings_from_dict(spark, sf):
    """F2 (+E9): three random dictionary words per part row."""
    part = table(spark, sf, "part")
    d = TF.dict_from_words(part, "p_name")
    return GEN.strings_from_dict(part.select(F.col("p_partkey").alias("idx")), d, length=3)


@register("article_sentences", f"""
WITH arts AS (SELECT doc_id, text, {O.sql_h(42, 'article', 'doc_id')} AS hh FROM documents),
ranked AS (SELECT CAST(row_number() OVER (ORDER BY hh, doc_id) - 1 AS BIGINT) AS article_rank, text FROM arts),
sents AS (SELECT article_rank, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS sent_no, unnest(parts) AS raw
          FROM (SELECT article_rank, string_split(replace(text, chr(10), ' '), '. ') AS parts FROM ranked)),
kept AS (SELECT article_rank, sent_no, {O.py_strip('raw')} AS text FROM sents)
SELECT article_rank, sent_no, text FROM kept
WHERE len({O.tokenise('text')}) > 1
ORDER BY article_rank, sent_no LIMIT 10000
""")
def q_article_sentences(spark, sf):
    """sentences of articles taken in a seeded order, more than one word each, first 10,000."""
    return GEN.article_sentences(_docs(spark, sf), 10_000, min_words=1)


# ---------------------------------------------------------------------------------------
# Label set: existence, renumbering, splits, vocabulary, encoding (F-dataset)
# ---------------------------------------------------------------------------------------

from linecraft.operators import labels as LB  # noqa: E402
from linecraft.operators import ordering as ORD  # noqa: E402
from linecraft.plans import dataset as DS  # noqa: E402


@register("keep_existing", """
SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
""")
def q_keep_existing(spark, sf):
    """Documents that have a label row (left semi join)."""
    return LB.keep_existing(_docs(spark, sf).select("doc_id", "n_chars"), table(spark, sf, "labels"), "doc_id")


@register("missing_files", """
SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def q_missing_files(spark, sf):
    """C1 inverse: documents without a label row (left anti join)."""
    return LB.missing_files(_docs(spark, sf).select("doc_id", "n_chars"), table(spark, sf, "labels"), "doc_id")


_META_SQL = f"""
WITH {O.lines_cte()},
kept AS (SELECT * FROM lines WHERE doc_id IN (SELECT doc_id FROM labels)),
meta AS (SELECT CAST(row_number() OVER (ORDER BY line_no) - 1 AS BIGINT) AS idx, line_no, doc_id, text FROM kept)"""


@register("dataset_metadata", _META_SQL + """
SELECT idx, printf('%08d.jpg', idx) AS file_name, text FROM meta
""")
def q_dataset_metadata(spark, sf):
    """C1 -> E2 -> G7: kept lines with their running 8-digit file names (metadata rows)."""
    return DS.merged_labels(_docs(spark, sf), table(spark, sf, "labels")).select("idx", "file_name", "text")


@register("dataset_split", _META_SQL + f""",
n AS (SELECT count(*) AS n FROM meta),
ordered AS (SELECT idx, row_number() OVER (ORDER BY {O.sql_h(42, 'split', 'idx')}, idx) - 1 AS k FROM meta)
SELECT idx, CASE WHEN k < CAST(ceil(0.05 * (SELECT n FROM n)) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM ordered
""")
def q_dataset_split(spark, sf):
    """Exact seeded split, ceil(0.05 n) test rows."""
    meta = DS.merged_labels(_docs(spark, sf), table(spark, sf, "labels")).select("idx")
    return DS.split_labels(meta, 0.05, 42).select("idx", "split")


@register("prefix_split", _META_SQL + """,
n AS (SELECT count(*) AS n FROM meta)
SELECT idx, CASE WHEN idx < CAST(floor((SELECT n FROM n) * (1 - 0.2)) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM meta
""")
def q_prefix_split(spark, sf):
    """Listing-order split, train = first int(n * 0.8) rows."""
    meta = DS.merged_labels(_docs(spark, sf), table(spark, sf, "labels")).select("idx")
    return DS.split_labels(meta, 0.2, seeded=False).select("idx", "split")


@register("training_batches", _META_SQL + f"""
SELECT idx, CAST(row_number() OVER (ORDER BY {O.sql_h(42, 'epoch1', 'idx')}, idx) - 1 AS BIGINT) AS pos,
       1 AS epoch
FROM meta
""".replace("1 AS epoch\nFROM meta", "1 AS epoch FROM meta"))
def q_training_batches(spark, sf):
    """Epoch-1 shuffled order of the label set (batch = pos div 32)."""
    meta = DS.merged_labels(_docs(spark, sf), table(spark, sf, "labels")).select("idx")
    return ORD.training_batches(meta, "idx", 32, epoch=1).select("idx", "pos", "epoch")


@register("skip_batches", _META_SQL + f""",
b AS (SELECT idx, CAST((row_number() OVER (ORDER BY {O.sql_h(42, 'epoch1', 'idx')}, idx) - 1) // 32 AS BIGINT) AS batch FROM meta)
SELECT idx, batch FROM b WHERE batch >= 3
""")
def q_skip_batches(spark, sf):
    """Resume inside epoch 1 after 3 batches."""
    meta = DS.merged_labels(_docs(spark, sf), table(spark, sf, "labels")).select("idx")
    b = ORD.training_batches(meta, "idx", 32, epoch=1)
    return ORD.skip_batches(b, 1, 3).select("idx", "batch")


def _vocab_sql(src: str = "lines") -> str:
    specials = " UNION ALL ".join(f"SELECT {O.lit(t)} AS token, CAST({i} AS BIGINT) AS token_id, CAST(0 AS BIGINT) AS count"
                                  for i, t in enumerate(LB.SPECIALS))
    return f"""
chars AS (SELECT unnest(string_split(text, '')) AS token FROM {src}),
cnt AS (SELECT token, count(*) AS count FROM chars WHERE token NOT IN ({', '.join(O.lit(t) for t in LB.SPECIALS)}) GROUP BY token),
vocab AS ({specials} UNION ALL
  SELECT token, CAST(row_number() OVER (ORDER BY count DESC, token) - 1 + {len(LB.SPECIALS)} AS BIGINT) AS token_id,
         CAST(count AS BIGINT) AS count FROM cnt)"""


@register("char_vocab", f"""
WITH {O.lines_cte()}, {_vocab_sql()}
SELECT token, token_id, count FROM vocab
""")
def q_char_vocab(spark, sf):
    """Character vocabulary of all lines, ids by (count desc, token) after the specials."""
    return LB.build_vocab(_lines(spark, sf), "text", "char")


@register("label_ids", f"""
WITH {O.lines_cte()}, {_vocab_sql()},
toks AS (SELECT line_no, unnest(string_split(text, '')) AS token, generate_subscripts(string_split(text, ''), 1) AS pos FROM lines),
ids AS (SELECT t.line_no, list(CAST(v.token_id AS INTEGER) ORDER BY t.pos) AS ids FROM toks t JOIN vocab v ON v.token = t.token GROUP BY t.line_no),
withends AS (SELECT line_no, [0] || ids || [2] AS ids FROM ids),
padded AS (SELECT line_no, ids || list_transform(range(greatest(0, 128 - len(ids))), lambda x: 1) AS ids FROM withends)
SELECT line_no, array_to_string(list_transform(ids, lambda x: CASE WHEN x = 1 THEN -100 ELSE x END), ',') AS labels,
       CAST(len(ids) AS INTEGER) AS n_labels
FROM padded
""")
def q_label_ids(spark, sf):
    """C6 + G5: <s> ids </s>, padded to 128 (not cut), padding -> -100."""
    ln = _lines(spark, sf)
    vocab = LB.build_vocab(ln, "text", "char")
    out = LB.label_ids(ln, vocab, "text", "line_no", 128, table=True)
    return out.select("line_no", F.array_join("labels", ",").alias("labels"),
                      F.size("labels").alias("n_labels"))


@register("decode_labels", f"""
WITH {O.lines_cte()}
SELECT line_no, text AS decoded FROM lines
""")
def q_decode_labels(spark, sf):
    """G6 + C6 reverse: label ids decoded back (round trip equals the line text)."""
    ln = _lines(spark, sf)
    vocab = LB.build_vocab(ln, "text", "char")
    enc = LB.label_ids(ln, vocab, "text", "line_no", 128, table=True)
    return LB.decode(enc, vocab, "labels", "line_no", table=True).select("line_no", "decoded")


# ---------------------------------------------------------------------------------------
# Layout and boxes (F-boxes)
# ---------------------------------------------------------------------------------------

from linecraft.operators import boxes as BX  # noqa: E402
from linecraft.operators import linelayout as LL  # noqa: E402
from linecraft.plans import layout as LY  # noqa: E402

_THAI_SQL = ", ".join(f"chr({ord(c)})" for c in BX.ZERO_WIDTH_MARKS)
_LAYOUT_SQL = f"""
WITH {O.lines_cte()},
pcs AS (SELECT line_no, doc_id, CAST(generate_subscripts(cs, 1) - 1 AS INTEGER) AS i, unnest(cs) AS piece
        FROM (SELECT line_no, doc_id, string_split(text, '') AS cs FROM lines)),
glyphs AS (SELECT ch, CAST(4 + {O.sql_h(LY.GLYPH_SEED, 'adv', 'ch')} % 9 AS INTEGER) AS advance,
           CAST(10 + {O.sql_h(LY.GLYPH_SEED, 'ht', 'ch')} % 9 AS INTEGER) AS height
           FROM (SELECT DISTINCT piece AS ch FROM pcs)),
sw AS (SELECT CAST(trunc(advance * 1.0) AS INTEGER) AS sw FROM glyphs WHERE ch = ' '),
measured AS (SELECT p.line_no, p.doc_id, p.i, p.piece,
             CAST(CASE WHEN p.piece = ' ' THEN COALESCE((SELECT sw FROM sw), 0)
                       WHEN p.piece IN ({_THAI_SQL}) THEN 0 ELSE g.advance END AS INTEGER) AS w,
             CAST(g.height AS INTEGER) AS h
             FROM pcs p JOIN glyphs g ON g.ch = p.piece),
placed AS (SELECT *, CAST(COALESCE(SUM(w) OVER (PARTITION BY line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                          + i * 1 AS INTEGER) AS x FROM measured),
ext AS (SELECT line_no, any_value(doc_id) AS doc_id, CAST(SUM(w) + (count(*) - 1) * 1 AS INTEGER) AS text_w,
        CAST(max(h) AS INTEGER) AS text_h, CAST(count(*) AS BIGINT) AS n_pieces FROM measured GROUP BY line_no),
pix AS (SELECT line_no AS image_id, CAST(i + 1 AS INTEGER) AS n, x AS minx, x + w - 1 AS maxx, 0 AS miny, h - 1 AS maxy
        FROM placed WHERE piece <> ' ' AND w > 0)"""

_BOXES_SQL = _LAYOUT_SQL + """,
b AS (SELECT p.image_id, p.n, p.minx, p.miny, e.text_h AS H, greatest(0, p.minx - 1) AS x1, greatest(0, p.miny - 1) AS y1,
      least(e.text_w - 1, p.maxx + 1) AS x2, least(e.text_h - 1, p.maxy + 1) AS y2
      FROM pix p JOIN ext e ON e.line_no = p.image_id),
g AS (SELECT *, n - lag(n, 1, 0) OVER w AS gap, lag(n, 1, 0) OVER w AS prev_n, lag(x2) OVER w AS px2,
      lag(y2) OVER w AS py2 FROM b WINDOW w AS (PARTITION BY image_id ORDER BY n)),
s AS (SELECT *, max(CASE WHEN gap >= 3 OR (prev_n = 0 AND gap = 2) THEN 1 ELSE 0 END)
      OVER (PARTITION BY image_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM g),
kept AS (SELECT * FROM s WHERE stop = 0),
boxes AS (
  SELECT image_id, CAST(n AS INTEGER) AS box_no, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1,
         CAST(x2 AS INTEGER) AS x2, CAST(y2 AS INTEGER) AS y2, 'piece' AS kind FROM kept
  UNION ALL
  SELECT image_id, CAST(n - 1 AS INTEGER), CAST(least(px2 + 1, minx - 1) AS INTEGER), CAST(least(py2 + 1, miny - 1) AS INTEGER),
         CAST(greatest(px2 + 1, minx - 2) AS INTEGER), CAST(greatest(py2 + 1, miny - 2) AS INTEGER), 'space' FROM kept WHERE gap = 2)"""


def _glyphs(spark, sf):
    # the rule table over the characters of the source texts (a superset of the lines'
    # characters; unused glyphs change nothing), without the line numbering
    return LY.glyph_table(_docs(spark, sf))


def _strip_images(spark, sf):
    _, ext = _layout(spark, sf)
    return ext.select(F.col("doc_id").alias("line_id"), F.col("line_no").alias("seq"),
                      F.col("text_w").alias("w"), F.col("text_h").alias("h"))


def _layout(spark, sf, carry=("doc_id",)):
    return LY.layout(_lines(spark, sf).select("line_no", "doc_id", "text"), glyphs=_glyphs(spark, sf), carry=carry)


@register("layout_extents", _LAYOUT_SQL + """
SELECT line_no, text_w, text_h, n_pieces FROM ext
""")
def q_layout_extents(spark, sf):
    """C7 + D13: width (sum of advances + spacing) and height (max) of every line."""
    _, ext = _layout(spark, sf)
    return ext.select("line_no", "text_w", "text_h", "n_pieces")


@register("piece_offsets", _LAYOUT_SQL + """
SELECT line_no, i, piece, w, h, x FROM placed
""")
def q_piece_offsets(spark, sf):
    """C7 + E3: x of every character piece (earlier widths + spacing x index)."""
    placed, _ = _layout(spark, sf, carry=())
    return placed.select("line_no", "i", "piece", "w", "h", "x")


@register("layout_boxes", _BOXES_SQL + """
SELECT image_id, box_no, x1, y1, x2, y2, kind FROM boxes
""")
def q_layout_boxes(spark, sf):
    """D7 + E4 + G13: boxes from the line masks, space boxes for single gaps, stop at double gaps."""
    return LY.line_boxes(_lines(spark, sf).select("line_no", "text"), glyphs=_glyphs(spark, sf))


@register("box_file_lines", _BOXES_SQL + """
SELECT image_id, box_no, CAST(x1 AS VARCHAR) || ' ' || CAST(y1 AS VARCHAR) || ' ' || CAST(x2 AS VARCHAR) || ' ' || CAST(y2 AS VARCHAR) AS line
FROM boxes
""")
def q_box_file_lines(spark, sf):
    """`x1 y1 x2 y2` box-file lines."""
    return BX.format_boxes(LY.line_boxes(_lines(spark, sf).select("line_no", "text"), glyphs=_glyphs(spark, sf), by_place=True))


@register("tight_boxes", _LAYOUT_SQL + """
SELECT image_id, min(minx) AS x1, min(miny) AS y1, max(maxx) AS x2, max(maxy) AS y2 FROM pix GROUP BY image_id
""")
def q_tight_boxes(spark, sf):
    """Smallest rectangle of the inked pixels of each line mask."""
    placed, _ = _layout(spark, sf, carry=())
    return BX.tight_box(LY.mask_pixels(placed))


@register("strip_offsets", _LAYOUT_SQL + """
SELECT doc_id AS line_id, CAST(sum(text_w) - 35 * count(*) AS INTEGER) AS total_w, max(text_h) AS max_h
FROM ext GROUP BY doc_id
""")
def q_strip_offsets(spark, sf):
    """Lines of a document joined side by side with a 35-pixel overlap."""
    _, tot = BX.strip_offsets(_strip_images(spark, sf))
    return tot


@register("strip_places", _LAYOUT_SQL + """
SELECT doc_id AS line_id, line_no AS seq,
       CAST(coalesce(sum(text_w - 35) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS x
FROM ext
""")
def q_strip_places(spark, sf):
    """Where each line of a document begins when they stand side by side with a 35-pixel overlap."""
    places, _ = BX.strip_offsets(_strip_images(spark, sf))
    return places.select("line_id", "seq", "x")


_WORDS_SQL = _LAYOUT_SQL + """,
split AS (SELECT line_no, string_split(text, ' ') AS ws FROM lines),
wp AS (SELECT line_no, 2 * (k - 1) AS i, ws[k] AS piece FROM (SELECT line_no, ws, unnest(range(1, len(ws) + 1)) AS k FROM split)
       UNION ALL SELECT line_no, 2 * k - 1, ' ' FROM (SELECT line_no, unnest(range(1, len(ws))) AS k FROM split)),
wc AS (SELECT line_no, i, piece, unnest(string_split(piece, '')) AS ch FROM wp),
wm AS (SELECT line_no, i, piece, CAST(CASE WHEN piece = ' ' THEN any_value(advance) ELSE sum(CASE WHEN wc.ch IN (@THAI@) THEN 0
              ELSE coalesce(advance, 0) END) END AS INTEGER) AS w, CAST(max(coalesce(height, 0)) AS INTEGER) AS h
       FROM wc LEFT JOIN glyphs USING (ch) GROUP BY line_no, i, piece)
SELECT line_no, CAST(i AS INTEGER) AS i, piece, w, h,
       CAST(coalesce(sum(w) OVER (PARTITION BY line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS x,
       CAST(sum(w) OVER (PARTITION BY line_no) AS INTEGER) AS text_w, CAST(max(h) OVER (PARTITION BY line_no) AS INTEGER) AS text_h
FROM wm""".replace("@THAI@", _THAI_SQL)


@register("word_layout", _WORDS_SQL)
def q_word_layout(spark, sf):
    """C7 + E3 + D13 for word pieces: words and the spaces between them, each with its x."""
    out = LL.lay_pieces(_lines(spark, sf).select("line_no", "text"), _glyphs(spark, sf), word_split=True, spacing=1, place="x")
    return out


@register("vertical_layout", _LAYOUT_SQL + """
SELECT line_no, i, piece, w, h,
       CAST(coalesce(sum(h) OVER (PARTITION BY line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + i AS INTEGER) AS y,
       CAST(max(w) OVER (PARTITION BY line_no) AS INTEGER) AS text_w,
       CAST(sum(h) OVER (PARTITION BY line_no) + count(*) OVER (PARTITION BY line_no) AS INTEGER) AS text_h
FROM measured
""")
def q_vertical_layout(spark, sf):
    """E3 + D13 down the line: y of every character, width and height of the column."""
    out = LL.lay_pieces(_lines(spark, sf).select("line_no", "text"), _glyphs(spark, sf), vertical=True, spacing=1, place="y")
    return out


@register("stroke_segments", """
WITH pts AS (SELECT user_id AS word_id, event_id AS seq, CAST(round(value * 100) AS BIGINT) AS dx,
             CAST(1 AS BIGINT) AS dy, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS pen_up FROM events),
w AS (SELECT word_id, seq, CAST(sum(dx) OVER r AS BIGINT) AS x, CAST(sum(dy) OVER r AS BIGINT) AS y,
      CAST(COALESCE(sum(pen_up) OVER b, 0) AS BIGINT) AS stroke, sum(pen_up) OVER (PARTITION BY word_id) AS n_strokes
      FROM pts WINDOW r AS (PARTITION BY word_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                      b AS (PARTITION BY word_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT word_id, seq, x, y, stroke FROM w WHERE stroke < n_strokes
""")
def q_stroke_segments(spark, sf):
    """Pen strokes of each writer (events: value = pen move, 'error' = pen up)."""
    ev = table(spark, sf, "events")
    pts = ev.select(F.col("user_id").alias("word_id"), F.col("event_id").alias("seq"),
                    F.round(F.col("value") * 100).cast("long").alias("dx"), F.lit(1).cast("long").alias("dy"),
                    (F.col("event_type") == "error").cast("int").alias("pen_up"))
    out = BX.stroke_segments(pts)
    return out.select("word_id", "seq", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "stroke")


# ---------------------------------------------------------------------------------------
# Links in stored pages
# ---------------------------------------------------------------------------------------

from linecraft.operators import links as LK  # noqa: E402


def _sql_attr(name: str) -> str:
    """SQL: value of an attribute of ``tag``, null if absent; patterns of its own, not the operator's."""
    pat = O.lit(rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'>\s]+))""")
    value = " || ".join(f"regexp_extract(tag, {pat}, {i})" for i in (1, 2, 3))
    for ref, char in (("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;", "'&'")):
        value = f"replace({value}, '{ref}', {char})"
    return f"CASE WHEN regexp_matches(tag, {pat}) THEN {value} END"


_ANCHORS_SQL = f"""
WITH body AS (SELECT page_id, url,
                     regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', '', 'g') AS b FROM pages),
tags AS (SELECT page_id, url, regexp_extract_all(b, '(?is)<a\\s[^>]*>') AS ts FROM body),
a AS (SELECT page_id, url, CAST(generate_subscripts(ts, 1) - 1 AS INTEGER) AS anchor_no, unnest(ts) AS tag FROM tags),
h AS (SELECT page_id, url, anchor_no, {_sql_attr("href")} AS href FROM a)"""


@register("page_links", _ANCHORS_SQL + """
SELECT page_id, anchor_no, href, string_split(href, '/')[-1] AS file_name FROM h
WHERE href IS NOT NULL AND starts_with(href, '/')
""")
def q_page_links(spark, sf):
    """A15 + B18: anchors whose href starts with '/', with the last path segment as file name."""
    return LK.visible_links(spread(table(spark, sf, "pages")), prefix="/").select("page_id", "anchor_no", "href", "file_name")


@register("follow_links", _ANCHORS_SQL + f""",
c AS (SELECT page_id, anchor_no,
      coalesce(list_filter(regexp_split_to_array(trim({_sql_attr("class")}), '\\s+'), lambda x: x <> ''), []) AS classes FROM a),
hc AS (SELECT h.*, c.classes FROM h JOIN c USING (page_id, anchor_no) WHERE h.href IS NOT NULL),
nf AS (SELECT * REPLACE (regexp_replace(href, '#.*$', '') AS href) FROM hc),
res AS (SELECT page_id AS src, classes, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href
             WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) || href
             WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href
             WHEN href = '' THEN regexp_replace(url, '#.*$', '')
             WHEN starts_with(href, '?') THEN regexp_replace(url, '[?#].*$', '') || href
             ELSE regexp_extract(url, '^([^?#]*/)', 1) || href END AS dst FROM nf),
h1 AS (SELECT DISTINCT r.src AS start_id, p.page_id AS item_id FROM res r JOIN pages p ON p.url = r.dst),
h2 AS (SELECT DISTINCT r.src AS item_id, p.page_id AS target_id FROM res r JOIN pages p ON p.url = r.dst
       WHERE list_contains(r.classes, 'btn-success') AND r.src IN (SELECT item_id FROM h1)),
dl AS (SELECT page_id AS target_id, arg_min(href, anchor_no) AS download_url FROM hc
       WHERE starts_with(href, 'https://') AND page_id IN (SELECT target_id FROM h2) GROUP BY page_id)
SELECT h1.start_id, h1.item_id, h2.target_id, dl.download_url, string_split(dl.download_url, '/')[-1] AS file_name
FROM h1 JOIN h2 USING (item_id) JOIN dl USING (target_id)
""")
def q_follow_links(spark, sf):
    """Listing -> item (class btn-success) -> download link; the fixture has no internal links."""
    return LK.follow_links(spread(table(spark, sf, "pages")))


# ---------------------------------------------------------------------------------------
# More operators over the fixture tables
# ---------------------------------------------------------------------------------------

from linecraft.functions import geometry as GEO  # noqa: E402


@register("union_corpora", """
WITH u AS (SELECT 0 AS corpus_no, doc_id AS src_id, text FROM documents
           UNION ALL SELECT 1 AS corpus_no, item_id AS src_id, text FROM benchmark)
SELECT CAST(row_number() OVER (ORDER BY corpus_no, src_id) - 1 AS BIGINT) AS row_no, corpus_no, src_id, text FROM u
""")
def q_union_corpora(spark, sf):
    """A3/G1: documents then benchmark, concatenated in order and renumbered."""
    docs = _docs(spark, sf).select(F.col("doc_id").alias("src_id"), "text")
    bench = table(spark, sf, "benchmark").select(F.col("item_id").alias("src_id"), "text")
    u = C.union_corpora(docs, bench)
    return ORD.global_index(u, ["corpus_no", "src_id"], "row_no").select("row_no", "corpus_no", "src_id", "text")


@register("sample_rows", f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {O.sql_h(42, 'sample', 'doc_id')}, doc_id) - 1 AS k,
                  count(*) OVER () AS n FROM documents)
SELECT doc_id FROM r WHERE n <= 500 OR k < 500
""")
def q_sample_rows(spark, sf):
    """a seeded uniform sample of exactly 500 documents (all when there are fewer)."""
    return ORD.sample_rows(_docs(spark, sf).select("doc_id"), "doc_id", 500, 42)


def _random_strings_sql() -> str:
    pool = GEN.char_pool()
    plen = len(pool)
    b = "CAST(floor(idx / 1000) AS BIGINT)"
    return f"""
WITH {O.lines_cte()},
w AS (SELECT line_no AS idx, j FROM lines, range(1, 4) t(j)),
wl AS (SELECT idx, j, 2 + {O.sql_h(42, 'rnd_seq', b, 'idx', 'j')} % 9 AS sl FROM w),
c AS (SELECT idx, j, cno FROM wl, LATERAL (SELECT unnest(range(1, sl + 1)) AS cno)),
ch AS (SELECT idx, j, cno, substr({O.lit(pool)}, CAST(1 + {O.sql_h(42, 'rnd_char', b, 'idx', 'j', 'cno')} % {plen} AS INTEGER), 1) AS ch FROM c),
words AS (SELECT idx, j, string_agg(ch, '' ORDER BY cno) AS word FROM ch GROUP BY idx, j)
SELECT idx, string_agg(word, ' ' ORDER BY j) AS text FROM words GROUP BY idx"""


@register("random_strings", _random_strings_sql())
def q_random_strings(spark, sf):
    """F3 (+E9): three random words of 2-10 pool characters for every line index."""
    idx = _lines(spark, sf).select(F.col("line_no").alias("idx"))
    df, _ = GEN.random_strings(idx, length=3)
    return df


@register("epoch_metrics", _PAIRS_SQL.replace(
    "counted AS (SELECT lang,", "counted AS (SELECT CAST(chunk % 4 AS INTEGER) AS epoch,") + """,
rates AS (SELECT epoch, CASE WHEN sum(ref_chars) > 0 THEN CAST(sum(char_edits) AS DOUBLE) / CAST(sum(ref_chars) AS DOUBLE) END AS cer,
                 CASE WHEN sum(ref_words) > 0 THEN CAST(sum(word_edits) AS DOUBLE) / CAST(sum(ref_words) AS DOUBLE) END AS wer
          FROM counted GROUP BY epoch),
tr AS (SELECT CAST(event_id % 4 AS INTEGER) AS epoch, sum(value) / count(*) AS train_loss, CAST(count(*) AS BIGINT) AS steps
       FROM events WHERE event_type <> 'view' GROUP BY 1),
ev AS (SELECT CAST(event_id % 4 AS INTEGER) AS epoch, avg(value) AS eval_loss FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT COALESCE(tr.epoch, ev.epoch, rates.epoch) AS epoch, round(train_loss, 9) AS train_loss,
       round(eval_loss, 9) AS eval_loss, cer, wer, steps
FROM tr FULL OUTER JOIN ev ON ev.epoch = tr.epoch FULL OUTER JOIN rates ON rates.epoch = COALESCE(tr.epoch, ev.epoch)
""")
def q_epoch_metrics(spark, sf):
    """Per epoch train loss, eval loss, CER, WER and steps (epoch = chunk / event id mod 4,
    'view' events are the evaluation losses)."""
    pairs = S.chunk_pairs(_docs(spark, sf), with_words=True).withColumn("epoch", F.pmod("chunk", F.lit(4)).cast("int"))
    ev = table(spark, sf, "events").select(F.pmod("event_id", F.lit(4)).cast("int").alias("epoch"),
                                           F.col("value").alias("loss"), "event_type")
    out = M.epoch_metrics(pairs, ev.where("event_type <> 'view'"), ev.where("event_type = 'view'"),
                          ref_words="ref_words", pred_words="pred_words", short=S.is_short(C.LATIN))
    return (out.withColumn("train_loss", F.round("train_loss", LOSS_DIGITS))
            .withColumn("eval_loss", F.round("eval_loss", LOSS_DIGITS)))


@register("fit_and_paste", _LAYOUT_SQL + """,
fit AS (SELECT line_no, text_w, text_h, CAST(trunc(text_w * (CAST(64 - 10 AS DOUBLE) / text_h)) AS INTEGER) AS new_w FROM ext)
SELECT line_no, new_w AS fit_w, CAST(54 AS INTEGER) AS fit_h, new_w + 10 AS canvas_w, CAST(64 AS INTEGER) AS canvas_h,
       CAST(5 AS INTEGER) AS x_left, CAST(trunc(CAST(new_w + 10 AS DOUBLE) / 2 - CAST(new_w AS DOUBLE) / 2) AS INTEGER) AS x_centre,
       CAST(new_w + 10 - new_w - 5 AS INTEGER) AS x_right,
       CAST(trunc(sin(radians(text_w)) * floor(pow(text_h, 0.5))) AS INTEGER) AS sine_offset,
       CAST(trunc(cos(radians(text_w)) * floor(pow(text_h, 0.5))) AS INTEGER) AS cosine_offset
FROM fit
""")
def q_fit_and_paste(spark, sf):
    """G9 + G10 + G11: resize to height 64 with 5-pixel margins, paste positions of the three
    alignments (fixed width 0 = auto), and the sine/cosine offsets at column text_w."""
    _, ext = _layout(spark, sf)
    fs = GEO.fit_size("text_w", "text_h", 64, (5, 5, 5, 5), 0, 0)
    out = ext.select("line_no", F.col("text_w").alias("src_w"), F.col("text_h").alias("src_h"),
                     fs["text_w"].alias("fit_w"), fs["text_h"].alias("fit_h"),
                     fs["canvas_w"].alias("canvas_w"), fs["canvas_h"].alias("canvas_h"))
    return out.select(
        "line_no", "fit_w", "fit_h", "canvas_w", "canvas_h",
        GEO.paste_x(0, "canvas_w", "fit_w", 5, 5, 0).alias("x_left"),
        GEO.paste_x(1, "canvas_w", "fit_w", 5, 5, 0).alias("x_centre"),
        GEO.paste_x(2, "canvas_w", "fit_w", 5, 5, 0).alias("x_right"),
        GEO.wave_offset(1, "src_w", "src_h").alias("sine_offset"),
        GEO.wave_offset(2, "src_w", "src_h").alias("cosine_offset"))


_TESS_SQL = _LAYOUT_SQL + """,
b AS (SELECT p.image_id, p.n, p.minx, p.miny, e.text_h AS H, greatest(0, p.minx - 1) AS x1,
      greatest(0, e.text_h - p.maxy - 1) AS y1, least(e.text_w - 1, p.maxx + 1) AS x2,
      least(e.text_h - 1, e.text_h - p.miny + 1) AS y2
      FROM pix p JOIN ext e ON e.line_no = p.image_id),
g AS (SELECT *, n - lag(n, 1, 0) OVER w AS gap, lag(n, 1, 0) OVER w AS prev_n, lag(x2) OVER w AS px2,
      lag(y1) OVER w AS py1 FROM b WINDOW w AS (PARTITION BY image_id ORDER BY n)),
s AS (SELECT *, max(CASE WHEN gap >= 3 OR (prev_n = 0 AND gap = 2) THEN 1 ELSE 0 END)
      OVER (PARTITION BY image_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM g),
kept AS (SELECT * FROM s WHERE stop = 0),
boxes AS (
  SELECT image_id, CAST(n AS INTEGER) AS box_no, x1, y1, x2, y2 FROM kept
  UNION ALL
  SELECT image_id, CAST(n - 1 AS INTEGER), least(px2 + 1, minx - 1), least(H - miny + 2, py1 - 1),
         greatest(px2 + 1, minx - 2), greatest(H - miny + 2, py1 - 1) FROM kept WHERE gap = 2)"""


@register("tess_box_lines", _TESS_SQL + """
SELECT b.image_id, b.box_no, COALESCE(p.piece, ' ') || ' ' || CAST(b.x1 AS VARCHAR) || ' ' || CAST(b.y1 AS VARCHAR) || ' '
       || CAST(b.x2 AS VARCHAR) || ' ' || CAST(b.y2 AS VARCHAR) || ' 0' AS line
FROM boxes b LEFT JOIN pcs p ON p.line_no = b.image_id AND p.i + 1 = b.box_no
""")
def q_tess_box_lines(spark, sf):
    """D7 (tess) + A12: `<char> x1 y1 x2 y2 0` lines, y measured from the bottom, labelled by piece."""
    lines = _lines(spark, sf).select("line_no", "text")
    boxes = LY.mask_boxes(lines, tess=True, glyphs=_glyphs(spark, sf))
    labels = BX.line_pieces(lines).select(F.col("line_no").alias("image_id"),
                                          (F.col("i") + 1).cast("int").alias("box_no"), "piece")
    return BX.format_boxes(boxes, tess=True, labels=labels)


@register("region_rects", """
SELECT conv_id AS image_id, CAST(turn AS INTEGER) AS box_no, CAST(0 AS INTEGER) AS x1,
       CAST(trunc(turn * 20.5) AS INTEGER) AS y1, CAST(trunc(length(text) * 1.5 + 0.7) AS INTEGER) AS x2,
       CAST(trunc(turn * 20.5 + 19.6) AS INTEGER) AS y2
FROM conversations
""")
def q_region_rects(spark, sf):
    """Crop rectangles (ints of corners 0 and 2) of detected regions; each conversation is
    an image whose turns are regions laid out as quadrilaterals from the turn and text length."""
    conv = table(spark, sf, "conversations")
    t = F.col("turn").cast("double")
    w = F.length("text").cast("double") * 1.5
    pts = F.array(F.array(F.lit(0.0), t * 20.5), F.array(w, t * 20.5),
                  F.array(w + 0.7, t * 20.5 + 19.6), F.array(F.lit(0.0), t * 20.5 + 19.0))
    rect = GEO.region_rect(pts)
    return conv.select(F.col("conv_id").alias("image_id"), F.col("turn").cast("int").alias("box_no"),
                       *[v.alias(k) for k, v in rect.items()])


from linecraft import catalog_files  # noqa: E402,F401
