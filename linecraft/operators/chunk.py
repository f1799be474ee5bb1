"""Word positions and chunking of the word stream.

The reference joins every text into one word list and walks it, cutting runs of random
length. Because the cut position advances on both the accept and the reject branch,
chunk boundaries do not depend on acceptance, so the walk can be replaced by a fixed,
periodic length table:

    len(k) = randint(min, max; seed, 'chunk', k)      for k in [0, P)
    S      = sum of len,  st(k) = sum of len before k

Chunk g = c*P + k covers word positions [c*S + st(k), c*S + st(k) + len(k)).

Each document knows the global position of its first word (a distributed prefix sum of
word counts), so every chunk is cut out of its documents' word arrays as one slice per
document (no per-word rows), and the slices are stitched by one shuffle on the chunk id.
A chunk id holds at most ``max_len`` words, so no group is hot. The final short run is
dropped, as in the reference.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecraft.functions.arrays import has_repeated_ngram
from linecraft.functions.rng import h_py
from linecraft.operators.ordering import prefix_sum

PERIOD = 4096


@dataclass(frozen=True)
class LengthTable:
    seed: int
    min_len: int
    max_len: int
    period: int
    lens: tuple
    starts: tuple

    @property
    def total(self) -> int:
        return self.starts[-1] + self.lens[-1]


def length_table(seed: int = 42, min_len: int = 10, max_len: int = 15,
                 period: int = PERIOD) -> LengthTable:
    """The periodic chunk-length table (bounded: ``period`` entries)."""
    if min_len < 1 or max_len < min_len:
        raise ValueError("need 1 <= min_len <= max_len")
    span = max_len - min_len + 1
    lens = tuple(min_len + h_py(seed, "chunk", k) % span for k in range(period))
    starts, s = [], 0
    for v in lens:
        starts.append(s)
        s += v
    return LengthTable(seed, min_len, max_len, period, lens, tuple(starts))


def with_word_offsets(docs: DataFrame, key: str, words: str = "words") -> DataFrame:
    """Attach n (word count) and off (global position of the first word), ordered by key."""
    d = docs.withColumn("n", F.size(words).cast("long"))
    return prefix_sum(d, [key], weight="n", out="off")


def word_positions(docs: DataFrame, key: str, words: str = "words") -> DataFrame:
    """One row per word with its position in the concatenation of all texts."""
    d = with_word_offsets(docs, key, words)
    return d.select(key, F.posexplode(words).alias("i", "word"), "off") \
        .select((F.col("off") + F.col("i")).alias("pos"), key, "word")


def chunk_words(docs: DataFrame, key: str, words: str = "words", carry=(),
                seed: int = 42, min_len: int = 10, max_len: int = 15,
                ngram: int = 2) -> DataFrame:
    """Every complete chunk of the word stream.

    Returns (chunk long, first_key, <carry of the first document>, words array<string>,
    sentence string, repeated boolean). ``repeated`` is D10 for ``ngram`` (0 disables).
    """
    placed = with_word_offsets(docs.select(key, words, *carry), key, words)
    return cut_chunks(placed, key, words, carry, seed, min_len, max_len, ngram)


def cut_chunks(placed: DataFrame, key: str, words: str = "words", carry=(), seed: int = 42, min_len: int = 10,
               max_len: int = 15, ngram: int = 2, until: int | None = None) -> DataFrame:
    """E1 over rows that know their place (``with_word_offsets``); only chunks below ``until``, if given."""
    t = length_table(seed, min_len, max_len)
    S, P = t.total, t.period
    carry = list(carry)
    d = placed.where(F.col("n") > 0)
    d = (d.withColumn("_r0", F.pmod(F.col("off"), F.lit(S)).cast("double"))
          .withColumn("_r1", F.pmod(F.col("off") + F.col("n") - 1, F.lit(S)).cast("double")))
    buck = Bucketizer(splitsArray=[list(map(float, t.starts)) + [float(S)]] * 2,
                      inputCols=["_r0", "_r1"], outputCols=["_k0", "_k1"])
    d = buck.transform(d)
    d = (d.withColumn("_g0", F.floor(F.col("off") / S) * P + F.col("_k0").cast("long"))
          .withColumn("_g1", F.floor((F.col("off") + F.col("n") - 1) / S) * P
                      + F.col("_k1").cast("long")))
    if until is not None:
        d = d.where(F.col("_g0") < until).withColumn("_g1", F.least("_g1", F.lit(until - 1)))
    starts = F.lit(list(t.starts))
    lens = F.lit(list(t.lens))

    def frag(g):
        k = F.pmod(g, F.lit(P)).cast("int")
        st = F.floor(g / P) * S + F.element_at(starts, k + 1)
        ln = F.element_at(lens, k + 1)
        lo = F.greatest(st, F.col("off"))
        hi = F.least(st + ln, F.col("off") + F.col("n"))
        return F.struct(g.alias("g"), lo.cast("long").alias("lo"), ln.alias("len"),
                        F.slice(F.col(words), (lo - F.col("off") + 1).cast("int"),
                                (hi - lo).cast("int")).alias("frag"))

    pieces = d.select(key, *carry, F.explode(F.transform(F.sequence("_g0", "_g1"), frag)).alias("p")) \
        .select(key, *carry, "p.*")
    # One shuffle on the chunk id. (A union of in-document chunks with stitched straddling
    # ones would evaluate everything upstream - scan, cleaning, offsets - twice.)
    grouped = pieces.groupBy("g").agg(
        F.array_sort(F.collect_list(F.struct("lo", key, *carry, "frag"))).alias("fs"),
        F.max("len").alias("len"))
    out = grouped.select(
        F.col("g").alias("chunk"), F.col("fs")[0][key].alias("first_key"),
        *[F.col("fs")[0][c].alias(c) for c in carry],
        F.flatten(F.transform("fs", lambda x: x["frag"])).alias("words"), "len") \
        .where(F.size("words") == F.col("len")).drop("len")
    out = out.withColumn("sentence", F.array_join("words", " "))
    rep = has_repeated_ngram("words", ngram) if ngram > 0 else F.lit(False)
    return out.withColumn("repeated", rep)
