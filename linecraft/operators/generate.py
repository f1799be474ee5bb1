"""String sources for the image set.

Every draw is ``h(seed, stream, i, ...)`` of the sample index, so a sample's string does
not depend on which task makes it. The reference refreshes strings in batches of at most
1,000 samples (E9); the batch number ``i div 1000`` is part of every key.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecraft.functions import text as T
from linecraft.functions.rng import h, randint
from linecraft.operators.ordering import first_n, global_index, written
from linecraft.operators.selection import first_rows

# Character pools of the random-string generator.
ASCII_SYMBOLS = "!\"#$%&'()*+,-./:;?@[\\]^_`{|}~"
DIGITS = "0123456789"
# Code-point ranges (start inclusive, end exclusive) of the letter pools.
CN_RANGES = ((19968, 40908),)
JA_RANGES = ((12288, 12351), (12352, 12447), (12448, 12543), (65280, 65519), (19968, 40908))
REGEN_BATCH = 1000


def _batch(i):
    return F.floor(i / REGEN_BATCH)


def lookup_by_index(df: DataFrame, table: DataFrame, index_col: str, table_key: str,
                    n_rows: int | None = None) -> DataFrame:
    """C4: equi-join on a computed index; how to join is left to adaptive execution."""
    return df.join(table, df[index_col] == table[table_key], "inner").drop(table[table_key])


def skip_take_cycle(lines: DataFrame, count: int, skip: int = 0, line_no: str = "line_no") -> DataFrame:
    """E5: drop ``skip`` lines, then repeat the rest until ``count`` strings.

    Lines are numbered in the order of ``line_no``, which need not be dense. Output i meets line
    skip + i mod (lines left) by an equi-join. Returns (idx, <line columns>).
    """
    placed = written(global_index(lines, [line_no], "_pos"), "cycle")
    rem = placed.count() - skip
    if rem <= 0:
        raise ValueError("skip_lines is past the end of the input (the reference loops forever)")
    live = placed.where(F.col("_pos") >= skip).withColumn("_p", F.col("_pos") - skip).drop("_pos", "idx")
    asked = lines.sparkSession.range(count).select(F.col("id").alias("idx"), F.pmod("id", F.lit(rem)).alias("_p"))
    return asked.join(live, "_p").drop("_p")


def sample_source(spark: SparkSession, strings: DataFrame, fonts: DataFrame, count: int,
                  str_key: str = "line_no", font_key: str = "font_no") -> DataFrame:
    """A14 (bounded): sample i takes string i mod n and font i mod f (round robin)."""
    s = skip_take_cycle(strings, count, 0, str_key)
    nf = fonts.count()
    s = s.withColumn("_fk", F.pmod(F.col("idx"), F.lit(nf)))
    return lookup_by_index(s, fonts, "_fk", font_key, nf).drop("_fk")


def strings_from_dict(index: DataFrame, words: DataFrame, length: int = 1,
                      variable: bool = False, seed: int = 42, idx: str = "idx",
                      word_no: str = "word_no", word: str = "word") -> DataFrame:
    """for every sample index, `length` (or 1..length) random dictionary words joined by a space.

    ``index`` holds one row per sample (e.g. ``spark.range(count)`` renamed to ``idx``).
    Returns (idx, text).
    """
    n = words.count()
    if n == 0:
        raise ValueError("empty dictionary")
    i = F.col(idx)
    nw = randint(1, length, seed, "dict_len", _batch(i), i) if variable else F.lit(length)
    picks = index.select(idx, F.posexplode(F.sequence(F.lit(1), nw)).alias("j", "_one")) \
        .withColumn("_w", F.pmod(h(seed, "dict_word", _batch(i), i, F.col("j")), F.lit(n)))
    joined = lookup_by_index(picks, words.select(word_no, word), "_w", word_no, n)
    # one group per sample: at most `length` rows each
    return joined.groupBy(idx).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", word))),
                                 lambda s: s[word]), " ").alias("text"))


def char_pool(let: bool = False, num: bool = False, sym: bool = False, lang: str = "en") -> str:
    """The random-string character pool; none chosen means all three."""
    if not (let or num or sym):
        let = num = sym = True
    pool = ""
    if let:
        if lang == "cn":
            pool += "".join(chr(c) for a, b in CN_RANGES for c in range(a, b))
        elif lang == "ja":
            pool += "".join(chr(c) for a, b in JA_RANGES for c in range(a, b))
        else:
            pool += string.ascii_letters
    if num:
        pool += DIGITS
    if sym:
        pool += ASCII_SYMBOLS
    return pool


def random_strings(index: DataFrame, length: int = 1, variable: bool = False,
                   let: bool = False, num: bool = False, sym: bool = False, lang: str = "en",
                   seed: int = 42, idx: str = "idx") -> tuple[DataFrame, int | None]:
    """for every sample index, words of 2-10 (1-2 for cn/ja) characters from the pool.

    Pure per-row expressions: no join and no shuffle. Returns (strings(idx, text),
    forced_name_format): format 2 is forced when symbols are used.
    """
    pool = char_pool(let, num, sym, lang)
    lo, hi = (1, 2) if lang in ("cn", "ja") else (2, 10)
    i = F.col(idx)
    b = _batch(i)
    nw = randint(1, length, seed, "rnd_len", b, i) if variable else F.lit(length)
    plen = len(pool)

    def word(j):
        sl = randint(lo, hi, seed, "rnd_seq", b, i, j)
        chars = F.transform(F.sequence(F.lit(1), sl), lambda c: F.substring(
            F.lit(pool), (F.pmod(h(seed, "rnd_char", b, i, j, c), F.lit(plen)) + 1).cast("int"), 1))
        return F.array_join(chars, "")

    df = index.select(idx, F.array_join(F.transform(F.sequence(F.lit(1), nw), word), " ").alias("text"))
    forced = 2 if (sym or not (let or num or sym)) else None
    return df, forced


def article_sentences(articles: DataFrame, count: int, min_words: int = 1, seed: int = 42,
                      key: str = "doc_id", text: str = "text") -> DataFrame:
    """random articles, newline -> space, split on '. ', strip, keep > min_words words.

    Articles are taken in a seeded order without replacement; when sentences run out,
    fewer than ``count`` rows return. Returns (article_rank, sent_no, text).

    Only the first articles of that order are ranked and split: an eighth of ``count``, four times
    as many if they hold too few sentences, and so on.
    """
    order, total, take = [h(seed, "article", F.col(key)), F.col(key)], articles.count(), max(64, count // 8)
    while True:
        chosen = first_rows(articles.select(key, text), order, take)
        sents = global_index(chosen, order, "article_rank").select(
            "article_rank", F.posexplode(F.split(F.replace(F.col(text), F.lit("\n"), F.lit(" ")), r"\. "))
            .alias("sent_no", "raw"))
        kept = sents.select("article_rank", "sent_no", T.py_strip("raw").alias("text")) \
            .where(T.min_words("text", min_words))
        kept = written(kept, "sentences")
        if take >= total or kept.count() >= count:
            return first_n(kept, ["article_rank", "sent_no"], count, rescan=True)
        take *= 4
