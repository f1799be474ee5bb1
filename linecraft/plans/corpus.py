"""F-corpus: raw text -> clean sentence corpus (A3 -> F1 -> B6 -> B7 -> D1 -> E1 -> D10 -> E6 -> B8).

Shuffles: the two-level prefix sum of per-document word counts (a bucket-total aggregate
and a bucket-partitioned window), and one on the chunk id that stitches the per-document
slices of every chunk. Neither the driver nor a single task ever holds the word stream.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecraft.functions import text as T
from linecraft.operators.chunk import chunk_words, cut_chunks, with_word_offsets
from linecraft.operators.ordering import first_n, sample_rows, written


@dataclass(frozen=True)
class CorpusConfig:
    """Options of the corpus builder (defaults as in the reference's command line)."""
    num_samples: int = 10_000
    chars: str = T.DEFAULT_ALPHABET
    ranges: tuple = ()
    mapping: dict | None = None
    min_length: int = 10
    max_length: int = 15
    ngram: int = 2
    seed: int = 42
    urls_first: bool = False
    sample_first: bool = True
    drop_needle: str = "nan"


# Alphabet used for the en/fr/de/es fixture tables: Latin letters, accents and ASCII digits
# kept, no numeral unification.
LATIN = CorpusConfig(chars=T.LATIN_CHARS, ranges=T.LATIN_RANGES, mapping={})


def clean_corpus(docs: DataFrame, cfg: CorpusConfig = LATIN, key: str = "doc_id",
                 text: str = "text", carry=()) -> DataFrame:
    """B6 + B7: (key, carry..., clean, words)."""
    c = T.clean_text(F.col(text), cfg.chars, cfg.ranges, cfg.mapping, cfg.urls_first)
    return (docs.select(key, *carry, c.alias("clean"))
            .withColumn("words", T.tokenise("clean")))


def corpus_chunks(docs: DataFrame, cfg: CorpusConfig = LATIN, key: str = "doc_id",
                  text: str = "text", carry=()) -> DataFrame:
    """All complete chunks of the cleaned word stream, with the repeated-n-gram flag."""
    words = clean_corpus(docs, cfg, key, text, carry)
    return chunk_words(words, key, "words", carry=carry, seed=cfg.seed,
                       min_len=cfg.min_length, max_len=cfg.max_length, ngram=cfg.ngram)


def build_corpus(docs: DataFrame, cfg: CorpusConfig = LATIN, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """The sentence corpus: (chunk, sentence)."""
    if cfg.sample_first:
        docs = sample_rows(docs.select(key, text), key, cfg.num_samples, cfg.seed)
    placed = with_word_offsets(clean_corpus(docs, cfg, key, text).select(key, "words"), key)
    # chunks are numbered without gaps: the first kept ones lie among the first few more
    until = max(64, cfg.num_samples * 5 // 4)
    while True:
        chunks = written(cut_chunks(placed, key, "words", (), cfg.seed, cfg.min_length, cfg.max_length, cfg.ngram,
                                    until).select("chunk", "sentence", "repeated"), "chunks")
        seen, kept = chunks.agg(F.count(F.lit(1)), F.count_if(~F.col("repeated"))).first()
        if seen < until or kept >= cfg.num_samples:
            break
        until *= 4
    top = first_n(chunks.where(~F.col("repeated")).select("chunk", "sentence"), ["chunk"], cfg.num_samples, rescan=True)
    return T.drop_substring(top, "sentence", cfg.drop_needle)


def union_corpora(*dfs: DataFrame, text: str = "text") -> DataFrame:
    """A3/G1: concatenate corpora in argument order; (corpus_no, row key columns..., text).

    Reindexing is by (corpus_no, original key), see ``ordering.global_index``.
    """
    if not dfs:
        raise ValueError("at least one corpus must be chosen")
    out = None
    for i, d in enumerate(dfs):
        part = d.withColumn("corpus_no", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
