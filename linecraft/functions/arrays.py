"""Array column expressions: n-grams, padding, masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def word_ngrams(words, n: int = 2) -> Column:
    """Consecutive n-grams of a word array, each as an array (empty when too short)."""
    w = _c(words)
    k = F.size(w) - F.lit(n) + 1
    return F.when(k >= 1, F.transform(F.sequence(F.lit(1), k), lambda i: F.slice(w, i, n))) \
        .otherwise(F.array().cast("array<array<string>>"))


def joined_ngrams(words, n: int = 2, sep: str = " ") -> Column:
    """G4 as strings: n-grams joined by ``sep``; exact when no word contains ``sep``
    (true for B7 tokens and a space). Strings hash and compare faster than arrays."""
    w = _c(words)
    k = F.size(w) - F.lit(n - 1)
    if n == 1:
        return w
    parts = [F.slice(w, i + 1, F.greatest(k, F.lit(0))) for i in range(n)]
    zipped = parts[0]
    for p in parts[1:]:
        zipped = F.zip_with(zipped, p, lambda a, b: F.concat(a, F.lit(sep), b))
    return F.when(k >= 1, zipped).otherwise(F.array().cast("array<string>"))


def has_repeated_ngram(words, n: int = 2, sep: str | None = " ") -> Column:
    """D10 (+G2): true when some n-gram of words occurs twice.

    With ``sep`` (default: a space, which B7 tokens never contain) n-grams are compared as
    joined strings; ``sep=None`` compares them as arrays (any words).
    """
    g = word_ngrams(words, n) if sep is None else joined_ngrams(words, n, sep)
    return F.size(g) != F.size(F.array_distinct(g))


def pad_labels(ids, max_length: int, pad_id: int) -> Column:
    """Pad to max_length with pad_id (longer inputs are not cut), then pad -> -100."""
    a = _c(ids)
    padded = F.concat(a, F.array_repeat(F.lit(pad_id), F.greatest(F.lit(0), F.lit(max_length) - F.size(a))))
    return F.transform(padded, lambda x: F.when(x == pad_id, F.lit(-100)).otherwise(x))


def unmask_labels(ids, pad_id: int) -> Column:
    """-100 -> pad_id."""
    return F.transform(_c(ids), lambda x: F.when(x == -100, F.lit(pad_id)).otherwise(x))


def drop_special(ids, special_ids) -> Column:
    """Ids without special tokens (decode with skip_special_tokens)."""
    sp = F.array(*[F.lit(int(s)) for s in special_ids])
    return F.filter(_c(ids), lambda x: ~F.array_contains(sp, x))
