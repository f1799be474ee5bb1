"""Edit distances.

Characters: Spark's ``levenshtein`` counts code points.

Words: each pair's distinct words are numbered and every word is replaced by the letter of that
number in an alphabet of ``SHORT`` letters, so a word sequence becomes a string and the same JVM
``levenshtein`` gives the word edit distance. Numbering takes time with the square of the
distinct words, so pairs with more than ``SHORT`` of them take an Arrow function instead. It first walks the diagonals of the table that up to ``NEAR`` edits can
reach, which takes little for long texts with few edits; beyond that it goes through the
bit-parallel recurrence in strips of the reference, whose memory grows with the length, not its
square. All give the exact distance of whole texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from linecraft.functions.text import tokenise

SHORT = 1_024    # distinct words of a pair that the JVM numbers
STRIP = 4_096    # words of the reference handled at once
NEAR = 128       # edits that are looked for along diagonals
# one letter a word: printable ASCII first, which stands for the words of short texts
LETTERS = "".join(map(chr, [*range(0x21, 0x7F), *range(0x100, 0x100 + SHORT)]))[:SHORT]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _encode(words: Column, vocab: Column) -> Column:
    letter = F.transform(words, lambda w: F.substring(F.lit(LETTERS), F.array_position(vocab, w).cast("int"), F.lit(1)))
    return F.array_join(letter, "")


def char_edits(ref, pred) -> Column:
    return F.levenshtein(_c(ref), _c(pred))


def _equal_run(a: np.ndarray, b: np.ndarray) -> int:
    """How many items two arrays have in common at their start."""
    n, at, step = min(len(a), len(b)), 0, 16
    while at < n:
        stop = min(n, at + step)
        differ = np.flatnonzero(a[at:stop] != b[at:stop])[:1]
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 4
    return n


def near_edits(a: np.ndarray, b: np.ndarray, most: int = NEAR) -> int | None:
    """The edit distance of two arrays if it is at most ``most``: the furthest cell of each diagonal by edits."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    reached = {0: _equal_run(a, b)}     # by diagonal (place in b less place in a): place in a
    for edits in range(most + 1):
        if reached.get(m - n, -1) >= n:
            return edits
        further = {}
        for k in range(-edits - 1, edits + 2):
            at = max(reached.get(k, -2) + 1, reached.get(k + 1, -2) + 1, reached.get(k - 1, -2))
            at = min(at, n, m - k)
            if at >= 0 and at + k >= 0:
                further[k] = at + _equal_run(a[at:], b[at + k:])
        reached = further
    return None


def sequence_edits(a, b, strip: int = STRIP, most: int = NEAR) -> int:
    """Edit distance of two sequences of hashable items.

    A strip of ``a`` is one integer of vertical differences; the horizontal differences at its lower
    edge (a byte per item of ``b``) are what the next strip starts from.
    """
    number: dict = {}
    a, b = (np.array([number.setdefault(x, len(number)) for x in s], np.int64) for s in (a, b))
    few = near_edits(a, b, most)
    if few is not None:
        return few
    a, b = a.tolist(), b.tolist()
    edge = bytearray(b"\x02") * len(b)   # along the top of the table every step adds one; stored plus one
    for at in range(0, len(a), strip):
        part = a[at:at + strip]
        at_item: dict = {}
        for k, item in enumerate(part):
            at_item[item] = at_item.get(item, 0) | 1 << k
        full, last = (1 << len(part)) - 1, len(part) - 1
        up, down = full, 0               # rows where the column grows, falls by one
        for j, item in enumerate(b):
            enter = edge[j] - 1
            same = at_item.get(item, 0)
            if enter < 0:
                same |= 1
            cross = (((same & up) + up) ^ up) | same
            right_up, right_down = (down | ~(cross | up)) & full, up & cross
            leave = (right_up >> last & 1) - (right_down >> last & 1)
            edge[j] = leave + 1
            right_up = (right_up << 1 | (enter > 0)) & full
            right_down = (right_down << 1 | (enter < 0)) & full
            mixed = at_item.get(item, 0) | down
            up, down = (right_down | ~(mixed | right_up)) & full, right_up & mixed
    return len(a) + sum(edge) - len(b)


@F.pandas_udf(IntegerType())
def _long_edits(ref: pd.Series, pred: pd.Series) -> pd.Series:
    return pd.Series([None if r is None or p is None else sequence_edits(r, p) for r, p in zip(ref, pred, strict=True)],
                     dtype="Int32")


def with_word_edits(df, ref_words: str, pred_words: str, out: str = "word_edits", short: bool = False):
    """Add the word edit distance of two array columns.

    The joint vocabulary and the two encodings are separate projections, so each is
    computed once per row (a lambda that referenced an expression would re-evaluate it for
    every element). ``short`` promises pairs of few words and leaves the Arrow function out of
    the plan; else only pairs beyond ``SHORT`` distinct words reach it.
    """
    v, er, ep, lr, lp = (f"_{out}_{x}" for x in ("vocab", "ref", "pred", "long_ref", "long_pred"))
    df = df.withColumn(v, F.array_distinct(F.concat(F.col(ref_words), F.col(pred_words))))
    few = F.lit(True) if short else F.size(v) <= SHORT
    coded = (df.withColumn(er, F.when(few, _encode(F.col(ref_words), F.col(v))))
             .withColumn(ep, F.when(few, _encode(F.col(pred_words), F.col(v)))))
    edits = F.levenshtein(F.col(er), F.col(ep))
    if not short:
        coded = coded.withColumn(lr, F.when(~few, F.col(ref_words))).withColumn(lp, F.when(~few, F.col(pred_words)))
        edits = F.coalesce(edits, _long_edits(lr, lp))
    return coded.withColumn(out, edits).drop(v, er, ep, lr, lp)


def words_of(col) -> Column:
    """Whitespace words (the published WER definition splits on whitespace)."""
    return tokenise(col)


def word_edits(ref, pred) -> Column:
    """Word edit distance of two texts as one expression; see ``with_word_edits`` for tables."""
    rw, pw = words_of(ref), words_of(pred)
    vocab = F.array_distinct(F.concat(rw, pw))
    few = F.size(vocab) <= SHORT
    return F.coalesce(F.levenshtein(F.when(few, _encode(rw, vocab)), F.when(few, _encode(pw, vocab))),
                      _long_edits(F.when(~few, rw), F.when(~few, pw)))
