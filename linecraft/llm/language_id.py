"""Language identification: known words by their log frequency, unseen ones by shorter and shorter n-grams.

Learning counts every word of every training text by language, and from the words the character
n-grams of one to five code points, the word's edges included. A word in the word table adds, for
each language, the log of its relative frequency there. A word that isn't in it falls back on its
n-grams of five: if the table of that length knows any, the word adds the mean of their log
frequencies; else those of four, and so on to single characters; a word of unknown characters adds
nothing. The language with the largest sum is predicted.

Words are runs of letters and marks, each folded to its lower case if that is one code point.
Everything is numpy over code points: a word or n-gram is a 64-bit hash from prefix sums, a lookup
is a binary search, and no Python loop runs per word.

The counts cover all training rows. The model keeps the most frequent entries of the word table and
of the n-gram tables, down to the count at which ``MAX_CELLS`` (entries times languages) is
reached: that bounds what is collected and broadcast; rarer words fall back as unseen words do.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecraft.llm.common import materialise, remainder
from linecraft.llm.hashing import mix, powers

LONGEST = 5
MAX_CELLS = 1 << 20   # entries times languages, for the words and for the n-grams
LEAST = 2             # times an entry must occur
SMOOTH = 0.5
PIECE = 1 << 19       # code points worked on at a time
FLUSH = 1 << 20       # distinct counts a task holds before it hands them on
UND = "und"
# Keeps words and n-grams of each order apart.
_SEEDS = np.arange(LONGEST + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_TABLES: list = []


def _tables():
    """Per code point: part of a word, a letter, and its folded value plus two (an edge counts as one)."""
    if not _TABLES:
        chars = [chr(i) for i in range(0x110000)]
        kind = [unicodedata.category(c)[0] for c in chars]
        low = [c.lower() for c in chars]
        _TABLES.extend((np.array([k in "LM" for k in kind]), np.array([k == "L" for k in kind]),
                        np.array([ord(x) if len(x) == 1 else i for i, x in enumerate(low)], np.uint64) + np.uint64(2)))
    return _TABLES


def pieces(texts):
    """(numbers of texts, their code points) in pieces of about ``PIECE``; long texts are cut between words."""
    part = _tables()[0]
    number, held, size = [], [], 0
    for k, text in enumerate(texts):
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        while len(points):
            room = points
            if len(points) > PIECE:
                outside = np.flatnonzero(~part[points[PIECE:]])
                room = points[:PIECE + outside[0]] if len(outside) else points
            number.append(k), held.append(room)
            size += len(room)
            points = points[len(room):]
            if size >= PIECE:
                yield number, held
                number, held, size = [], [], 0
    if held:
        yield number, held


class Words:
    """Words of some texts: ``start``, ``end``, ``of`` (number of the text), hashes, and letters by text."""

    def __init__(self, number, held):
        part, letter, low = _tables()
        # an edge before, between and after the texts
        edge = np.zeros(1, np.uint32)
        points = np.concatenate([x for h in held for x in (edge, h)] + [edge])
        inside = part[points]
        change = np.flatnonzero(np.diff(inside.astype(np.int8)))
        self.start, self.end = change[::2] + 1, change[1::2] + 1
        begins = np.cumsum([0] + [len(h) + 1 for h in held[:-1]])
        self.of = np.array(number)[np.searchsorted(begins, self.start, side="right") - 1]
        letters = np.append(0, np.cumsum(letter[points]))
        real = letters[self.end] > letters[self.start]  # marks alone are no word
        self.start, self.end, self.of = self.start[real], self.end[real], self.of[real]
        values = np.where(inside, low[points], np.uint64(1))
        up, self.down = powers(len(values) + 1)
        self.total = np.append(np.uint64(0), np.cumsum(values * up[:len(values)], dtype=np.uint64))
        self.hash = self._hash(self.start, self.end, 0)

    def _hash(self, start, end, order):
        x = (self.total[end] - self.total[start]) * self.down[start]
        return mix(x + _SEEDS[order])

    def grams(self, which, order):
        """(hash, position in ``which``) of all n-grams of some words; single characters leave the edges out."""
        pad = 1 if order > 1 else 0
        first = self.start[which] - pad
        count = np.maximum(self.end[which] + pad - first - order + 1, 0)
        word = np.repeat(np.arange(len(which)), count)
        at = first[word] + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        return self._hash(at, at + order, order), word


@dataclass
class Model:
    """``languages`` by falling number of training words; per order, sorted hashes and log frequencies."""
    languages: list
    keys: list      # order 0: words; order n: n-grams
    logs: list      # (entries, languages) float32

    def _find(self, order, hashes):
        keys = self.keys[order]
        if not len(keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.searchsorted(keys, hashes)
        at[at == len(keys)] = 0
        return at, keys[at] == hashes

    def word_scores(self, words: Words) -> np.ndarray:
        """A row for each word: what it adds for every language."""
        out = np.zeros((len(words.hash), len(self.languages)), np.float32)
        at, known = self._find(0, words.hash)
        out[known] = self.logs[0][at[known]]
        left = np.flatnonzero(~known)
        for order in range(LONGEST, 0, -1):
            if not len(left):
                break
            hashes, word = words.grams(left, order)
            at, hit = self._find(order, hashes)
            word = word[hit]
            if len(word):
                begin = np.flatnonzero(np.diff(word, prepend=-1))
                sums = np.add.reduceat(self.logs[order][at[hit]], begin, axis=0)
                out[left[word[begin]]] = sums / np.diff(np.append(begin, len(word)))[:, None]
                found = np.zeros(len(left), bool)
                found[word] = True
                left = left[~found]
        return out

    def predict(self, texts) -> tuple[list, np.ndarray]:
        """(language, score) of every text.

        ``und`` with score 0 if it has no letter or nothing was learned. Equal sums: the language
        with more training words, then by name. The score is the share of the predicted language
        when sums over the root of the number of words are exponents.
        """
        texts = list(texts)
        n = len(self.languages)
        sums, words = np.zeros((len(texts), n)), np.zeros(len(texts), np.int64)
        for number, held in pieces(texts):
            some = Words(number, held)
            if len(some.of):
                begin = np.flatnonzero(np.diff(some.of, prepend=-1))
                sums[some.of[begin]] += np.add.reduceat(self.word_scores(some), begin, axis=0, dtype=np.float64)
                words += np.bincount(some.of, minlength=len(texts))
        if not n:
            return [UND] * len(texts), np.zeros(len(texts))
        best = sums.argmax(axis=1)
        share = np.exp((sums - sums.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(words, 1))[:, None])
        score = np.where(words > 0, 1 / share.sum(axis=1), 0.0)
        return [self.languages[b] if w else UND for b, w in zip(best, words, strict=True)], score


_COUNTS = "lang string, kind int, key long, n long"


def language_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, kind, key, n): words (kind 0) and n-grams (their order) of all texts, partly summed."""

    def run(batches):
        held: dict = {}   # language -> lists of keys and counts by kind
        size = 0

        def give():
            for name, kinds in held.items():
                for kind, (keys, counts) in kinds.items():
                    if not keys:  # no word in its texts
                        continue
                    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
                    n = np.bincount(where.reshape(-1), np.concatenate(counts)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(distinct), pa.string()), pa.array([kind] * len(distinct), pa.int32()),
                         pa.array(distinct.view(np.int64)), pa.array(n)], ["lang", "kind", "key", "n"])

        for b in batches:
            names = np.array(b[lang].to_pylist(), dtype=object)
            texts = b[text].to_pylist()
            for name in dict.fromkeys(names):
                mine = held.setdefault(name, {k: ([], []) for k in range(LONGEST + 1)})
                for number, points in pieces([texts[i] for i in np.flatnonzero(names == name)]):
                    words = Words(number, points)
                    keys, first, n = np.unique(words.hash, return_index=True, return_counts=True)
                    mine[0][0].append(keys), mine[0][1].append(n)
                    size += len(keys)
                    for order in range(1, LONGEST + 1):
                        hashes, of = words.grams(first, order)
                        grams, where = np.unique(hashes, return_inverse=True)
                        mine[order][0].append(grams)
                        mine[order][1].append(np.bincount(where.reshape(-1), n[of], len(grams)).astype(np.int64))
                        size += len(grams)
                    if size >= FLUSH:
                        yield from give()
                        held, size = {}, 0
                        mine = held.setdefault(name, {k: ([], []) for k in range(LONGEST + 1)})
        if size:
            yield from give()

    return docs.select(lang, text).mapInArrow(run, _COUNTS)


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", max_cells: int = MAX_CELLS) -> Model:
    """Learn from all rows whose language isn't null; null texts add nothing."""
    counts = language_counts(docs.where(F.col(lang).isNotNull()), lang, text)
    per = (counts.groupBy("kind", "key", "lang").agg(F.sum("n").alias("n"))
           .groupBy("kind", "key").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by")))
    per = materialise(per, "words")  # a row per distinct word or n-gram; `by` has an entry a language
    sums = per.select("kind", F.explode("by").alias("b")).groupBy("kind", "b.lang").agg(
        F.sum("b.n").alias("n")).collect()
    tokens = {(r["kind"], r["lang"]): r["n"] for r in sums}
    languages = sorted({r["lang"] for r in sums}, key=lambda x: (-tokens.get((0, x), 0), x))
    number = {x: k for k, x in enumerate(languages)}
    # Counts in steps of an eighth of a power of two: at most 512 rows for the words and for the n-grams.
    step = F.floor(8 * F.log2("total")).cast("int")
    words = F.col("kind") == 0
    levels = per.where(F.col("total") >= LEAST).groupBy(words.alias("words"), step.alias("step")).count().collect()
    least = {}
    for kind in (True, False):
        room = max_cells // max(len(languages), 1)
        for r in sorted((r for r in levels if r["words"] == kind), key=lambda r: -r["step"]):
            room -= r["count"]
            if room < 0:
                break
            least[kind] = r["step"]
    none = 1 << 20
    kept = per.where((F.col("total") >= LEAST) & (step >= F.when(words, least.get(True, none))
                                                  .otherwise(least.get(False, none))))
    cells = kept.select("kind", "key", F.explode("by").alias("b")).select("kind", "key", "b.lang", "b.n")
    cells = cells.toArrow()  # at most max_cells rows of words and as many of n-grams
    kinds, at = cells["kind"].to_numpy(), cells["key"].to_numpy().view(np.uint64)
    column = np.array([number[x] for x in cells["lang"].to_pylist()], np.int64)
    n = cells["n"].to_numpy()
    keys, logs = [], []
    for kind in range(LONGEST + 1):
        mine = kinds == kind
        hashes, row = np.unique(at[mine], return_inverse=True)
        table = np.zeros((len(hashes), len(languages)))
        table[row.reshape(-1), column[mine]] = n[mine]
        total = np.array([tokens.get((kind, x), 0) for x in languages], np.float64)
        keys.append(hashes)
        logs.append(np.log((table + SMOOTH) / (total + SMOOTH * (len(hashes) + 1))).astype(np.float32))
    return Model(languages, keys, logs)


def predict(docs: DataFrame, model: Model, carry=("doc_id",), text: str = "text") -> DataFrame:
    """(carried columns, lang_pred, score) for every row; carried columns of those names give way."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType
    keep = [c for c in carry if c not in ("lang_pred", "score")]
    schema = StructType([*(docs.schema[c] for c in keep), StructField("lang_pred", StringType()),
                         StructField("score", DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_CELLS

    def run(batches):
        for b in batches:
            names, score = held.value.predict(b[text].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(b[c] for c in keep), pa.array(names, pa.string()), pa.array(score, pa.float64())], schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose crc32(doc_id) mod 4 is not 2.

    A null id counts as the empty string in the remainder; repeated rows are each predicted; an
    empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(remainder("doc_id", 4) != 2))
    made = predict(docs, model)
    return made.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
