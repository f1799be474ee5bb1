"""DuckDB twins of the column expressions, used to write the oracle SQL.

These are independent, straightforward statements of each rule (per-word joins, plain
windows) that DuckDB runs on the same parquet tables; the Spark side is checked against
them. DuckDB's ``levenshtein`` counts bytes, so edit distances are taken after recoding
each pair's distinct symbols to one-byte characters (up to 127 distinct per pair).
"""

from __future__ import annotations

from linecraft.functions import text as T
from linecraft.functions.rng import sql_h
from linecraft.operators.chunk import length_table
from linecraft.plans.corpus import LATIN, CorpusConfig


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean(expr: str, cfg: CorpusConfig = LATIN) -> str:
    e = expr
    mapping = T.DEFAULT_DIGIT_MAP if cfg.mapping is None else cfg.mapping
    if mapping:
        e = f"translate({e}, {lit(''.join(mapping.keys()))}, {lit(''.join(mapping.values()))})"
    keep = f"[^{T.keep_class(cfg.chars, cfg.ranges)}{T.WS_CLASS}]+"
    url = f"http[^{T.WS_CLASS}]+"
    if cfg.urls_first:
        e = f"regexp_replace({e}, {lit(url)}, '', 'g')"
        e = f"regexp_replace({e}, {lit(keep)}, '', 'g')"
    else:
        e = f"regexp_replace({e}, {lit(keep)}, '', 'g')"
        e = f"regexp_replace({e}, {lit(url)}, '', 'g')"
    dels = T.deletion_set(cfg.chars + T.expand_ranges(cfg.ranges))
    if dels:
        e = f"translate({e}, {lit(dels)}, '')"
    return f"replace({e}, chr(8204), '')"


def tokenise(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {lit('[' + T.WS_CLASS + ']+')}), lambda x: x <> '')"


def chunks_cte(cfg: CorpusConfig = LATIN, source: str = "documents") -> str:
    """WITH-list producing ``chunks(chunk, first_key, lang, w, sentence, repeated)``."""
    t = length_table(cfg.seed, cfg.min_length, cfg.max_length)
    span = cfg.max_length - cfg.min_length + 1
    P = t.period
    return f"""
cleaned AS (SELECT doc_id, lang, {tokenise(clean('text', cfg))} AS w FROM {source}),
offs AS (SELECT doc_id, lang, w,
         COALESCE(SUM(len(w)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
         FROM cleaned),
words AS (SELECT doc_id, lang, CAST(off + i - 1 AS BIGINT) AS pos, w[i] AS word
          FROM (SELECT doc_id, lang, off, w, generate_subscripts(w, 1) AS i FROM offs)),
lens AS (SELECT k, {cfg.min_length} + {sql_h(cfg.seed, 'chunk', 'k')} % {span} AS len FROM range({P}) t(k)),
starts AS (SELECT k, len, SUM(len) OVER (ORDER BY k) - len AS st FROM lens),
tab AS (SELECT CAST(st + j AS BIGINT) AS r, k, j, len FROM (SELECT k, len, st, unnest(range(len)) AS j FROM starts)),
assigned AS (SELECT CAST((words.pos // {t.total}) * {P} + tab.k AS BIGINT) AS chunk, tab.j, tab.len,
             words.word, words.doc_id, words.lang
             FROM words JOIN tab ON tab.r = words.pos % {t.total}),
grouped AS (SELECT chunk, list(word ORDER BY j) AS w, arg_min(doc_id, j) AS first_key,
            arg_min(lang, j) AS lang FROM assigned GROUP BY chunk HAVING count(*) = max(len)),
chunks AS (SELECT chunk, first_key, lang, w, array_to_string(w, ' ') AS sentence,
           len(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) <> len(w) - 1
           AS repeated FROM grouped)"""


def recode_pair(a: str, b: str, unit: str) -> tuple[str, str]:
    """Recode two token lists to one-byte strings over their joint distinct symbols."""
    d = f"list_distinct({a} || {b})"
    enc = lambda x: f"array_to_string(list_transform({x}, lambda s: chr(list_position({d}, s))), '')"
    return enc(a), enc(b)


def char_edits(ref: str, pred: str) -> str:
    ra, pa = recode_pair(f"string_split({ref}, '')", f"string_split({pred}, '')", "char")
    return f"levenshtein({ra}, {pa})"


def word_edits(ref_words: str, pred_words: str) -> str:
    ra, pa = recode_pair(ref_words, pred_words, "word")
    return f"levenshtein({ra}, {pa})"


def corrupt(w: str) -> str:
    return f"translate(array_to_string(list_filter({w}, lambda x, i: (i - 1) % 3 <> 2), ' '), 'ae', 'oé')"


def randint(lo: str, hi: str, seed, stream: str, *keys: str) -> str:
    return f"(({lo}) + {sql_h(seed, stream, *keys)} % (({hi}) - ({lo}) + 1))"


def uniform(seed, stream: str, *keys: str) -> str:
    return f"(CAST({sql_h(seed, stream, *keys)} AS DOUBLE) / CAST(4294967296 AS DOUBLE))"


def lines_cte(source: str = "documents", max_chars: int | None = None) -> str:
    """WITH-list producing ``lines(line_no, doc_id, text)``; whole lines unless ``max_chars`` cuts them."""
    line = f"left(ls[i], {max_chars})" if max_chars else "ls[i]"
    return f"""
sp AS (SELECT doc_id, list_filter(regexp_split_to_array(text, {lit(T.LINE_BREAK_RE)}), lambda x: length(x) > 0) AS ls
       FROM {source}),
loffs AS (SELECT doc_id, ls, COALESCE(SUM(len(ls)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
          FROM sp),
lines AS (SELECT CAST(off + i - 1 AS BIGINT) AS line_no, doc_id, {line} AS text
          FROM (SELECT doc_id, off, ls, generate_subscripts(ls, 1) AS i FROM loffs))"""


def py_strip(expr: str) -> str:
    return f"regexp_replace({expr}, {lit('^[' + T.WS_CLASS + ']+|[' + T.WS_CLASS + ']+$')}, '', 'g')"


def safe_name(expr: str) -> str:
    return f"left(regexp_replace(nfc_normalize({expr}), {lit(T.NOT_NAME_CHAR)}, '', 'g'), 200)"
