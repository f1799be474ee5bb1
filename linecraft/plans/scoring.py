"""F-score: prediction/reference pairs -> CER and WER by group (C8 -> D2/D3 -> D14).

For the fixture tables, references are the complete corpus chunks (whole chunks of whole
texts) and predictions are a deterministic corruption of them: every third word dropped
and two letters substituted, standing in for a recogniser's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecraft.functions.edits import SHORT
from linecraft.operators.metrics import error_rates
from linecraft.plans.corpus import LATIN, CorpusConfig, corpus_chunks


def corrupt_words(words) -> F.Column:
    """Deterministic stand-in prediction as words: drop words 3, 6, 9, ... and map a->o, e->é."""
    w = F.col(words) if isinstance(words, str) else words
    kept = F.filter(w, lambda x, i: F.pmod(i, F.lit(3)) != 2)
    return F.transform(kept, lambda x: F.translate(x, "ae", "oé"))


def corrupt(words) -> F.Column:
    """The stand-in prediction as text."""
    return F.array_join(corrupt_words(words), " ")


def chunk_pairs(docs: DataFrame, cfg: CorpusConfig = LATIN, with_words: bool = False) -> DataFrame:
    """(chunk, lang, ref, pred[, ref_words, pred_words]) over every complete chunk."""
    chunks = corpus_chunks(docs, cfg, carry=("lang",))
    out = chunks.select("chunk", "lang", F.col("sentence").alias("ref"), F.col("words").alias("ref_words"),
                        corrupt_words("words").alias("pred_words"))
    out = out.withColumn("pred", F.array_join("pred_words", " "))
    cols = ["chunk", "lang", "ref", "pred"] + (["ref_words", "pred_words"] if with_words else [])
    return out.select(*cols)


def is_short(cfg: CorpusConfig) -> bool:
    """Whether a pair of chunks has few enough words for their distances to be counted without Python."""
    return cfg.max_length <= SHORT // 2


def score_by(docs: DataFrame, by=("lang",), cfg: CorpusConfig = LATIN) -> DataFrame:
    # the chunk words are the reference words; the prediction's words are known too; a chunk has few
    return error_rates(chunk_pairs(docs, cfg, with_words=True), list(by),
                       ref_words="ref_words", pred_words="pred_words", short=is_short(cfg))
