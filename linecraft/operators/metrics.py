"""Scoring: pairing, error rates, losses, region joins, epoch table.

Rates are corpus level: sum of edits / sum of reference units, computed as two partial
sums per group (map-side combined), never as a mean of per-row rates. A zero reference
total gives null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecraft.functions.edits import char_edits, with_word_edits, words_of


def pair(preds: DataFrame, refs: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Prediction joined to reference on ``key``.

    With ``check`` the rows of either side are counted per key first (combined map-side, one
    join of the counts); a key that is null, repeated or on one side only raises, so no pair is
    lost or multiplied silently.
    """
    if check:
        p = preds.groupBy(key).agg(F.count(F.lit(1)).alias("_p"))
        r = refs.groupBy(key).agg(F.count(F.lit(1)).alias("_r"))
        odd = p.join(r, key, "full_outer").where((F.coalesce("_p", F.lit(0)) != 1) | (F.coalesce("_r", F.lit(0)) != 1))
        if odd.take(1):
            raise ValueError(f"predictions and references do not pair one to one on {key!r}")
    return preds.join(refs, key, "inner")


def with_error_counts(pairs: DataFrame, ref: str = "ref", pred: str = "pred",
                      ref_words: str | None = None, pred_words: str | None = None, short: bool = False) -> DataFrame:
    """Per-pair counts: ref_chars, char_edits, ref_words, word_edits.

    ``ref_words`` / ``pred_words`` name columns already holding the whitespace words of the
    texts (skips tokenising them again). ``short`` promises pairs of a bounded few words.
    """
    rw = F.col(ref_words) if ref_words else words_of(ref)
    pw = F.col(pred_words) if pred_words else words_of(pred)
    out = (pairs
           .withColumn("_rw", rw).withColumn("_pw", pw)
           .withColumn("ref_chars", F.length(ref).cast("long"))
           .withColumn("char_edits", char_edits(ref, pred).cast("long"))
           .withColumn("ref_words", F.size("_rw").cast("long")))
    return with_word_edits(out, "_rw", "_pw", short=short).withColumn(
        "word_edits", F.col("word_edits").cast("long")).drop("_rw", "_pw")


def _rate(num: str, den: str):
    return F.when(F.col(den) > 0, F.col(num) / F.col(den))


def error_rates(pairs: DataFrame, by=(), ref: str = "ref", pred: str = "pred",
                ref_words: str | None = None, pred_words: str | None = None, short: bool = False) -> DataFrame:
    """D2 + D3 (+D9): CER and WER per group (global when ``by`` is empty)."""
    counted = with_error_counts(pairs, ref, pred, ref_words, pred_words, short)
    agg = counted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum("ref_chars").alias("ref_chars"), F.sum("char_edits").alias("char_edits"),
        F.sum("ref_words").alias("ref_words"), F.sum("word_edits").alias("word_edits"))
    return agg.withColumn("cer", _rate("char_edits", "ref_chars")) \
              .withColumn("wer", _rate("word_edits", "ref_words"))


def mean_eval_loss(losses: DataFrame, by=("epoch",), loss: str = "loss",
                   batch_size: str | None = None) -> DataFrame:
    """Mean of gathered batch losses, each batch counted once per sample."""
    if batch_size is None:
        return losses.groupBy(*by).agg(F.avg(loss).alias("eval_loss"))
    return losses.groupBy(*by).agg(
        (F.sum(F.col(loss) * F.col(batch_size)) / F.sum(batch_size)).alias("eval_loss"))


def mean_train_loss(losses: DataFrame, by=("epoch",), loss: str = "loss") -> DataFrame:
    """Sum of step losses divided by the number of batches."""
    return losses.groupBy(*by).agg((F.sum(loss) / F.count(F.lit(1))).alias("train_loss"),
                                   F.count(F.lit(1)).alias("steps"))


REGION_BLOCK = 1024


def join_regions(regions: DataFrame, image: str = "image_id", box: str = "box_no",
                 text: str = "text", out: str = "text") -> DataFrame:
    """Texts of one image's boxes joined by newline in box order.

    Two levels, so an image with a huge number of regions is not sorted and collected in one
    task: runs of ``REGION_BLOCK`` consecutive box numbers are joined first (spread over
    tasks), then the runs of an image are joined in order. The result of an image is one
    string, so its final assembly is necessarily one task.
    """
    blk = F.floor(F.col(box) / REGION_BLOCK)
    runs = regions.withColumn("_blk", blk).groupBy(image, "_blk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(box, text))),
                                 lambda s: s[text]), "\n").alias("_run"),
        F.count(F.lit(1)).alias("_n"))
    return runs.groupBy(image).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_blk", "_run"))),
                                 lambda s: s["_run"]), "\n").alias(out),
        F.sum("_n").alias("n_regions"))


def epoch_metrics(pairs: DataFrame, train_losses: DataFrame, eval_losses: DataFrame,
                  epoch: str = "epoch", loss: str = "loss", ref: str = "ref",
                  pred: str = "pred", **known) -> DataFrame:
    """One row per epoch with train loss, eval loss, CER, WER and completed steps.

    ``known`` is what ``error_rates`` may be told of the pairs (ref_words, pred_words, short).
    """
    rates = error_rates(pairs, [epoch], ref, pred, **known).select(epoch, "cer", "wer")
    tr = mean_train_loss(train_losses, [epoch], loss)
    ev = mean_eval_loss(eval_losses, [epoch], loss)
    return (tr.join(ev, epoch, "full_outer").join(rates, epoch, "full_outer")
            .select(epoch, "train_loss", "eval_loss", "cer", "wer", "steps"))
