"""Document fingerprints: 128-bit SimHash and search by permuted block tables.

The terms of a text are its pairs of neighbouring words (A-Z folded, split at ASCII white
space); a term that occurs tf times votes with weight 1 + ln(tf) for or against each bit of
its hash. Every whole text is hashed, however long. A text without words has fingerprint 0.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linecraft.llm.common import materialise
from linecraft.llm.hashing import mix, shingle_hashes, word_hashes

BITS = 128
TERM_WORDS = 2
_STEP = 8192  # terms whose bits are unpacked at once


def simhash(text: str) -> tuple[int, int]:
    """The two halves of a fingerprint as unsigned 64-bit numbers."""
    terms, tf = np.unique(shingle_hashes(word_hashes(text), TERM_WORDS), return_counts=True)
    if not len(terms):
        return 0, 0
    weight = (1 + np.log(tf)).astype(np.float32)
    halves = np.stack([terms, mix(terms ^ np.uint64(0xA5A5A5A55A5A5A5A))], axis=1)
    votes = np.zeros(BITS)
    for k in range(0, len(terms), _STEP):
        bits = np.unpackbits(halves[k:k + _STEP].astype(">u8").view(np.uint8), axis=1)
        votes += weight[k:k + _STEP] @ bits.astype(np.float32)
    high, low = np.packbits(votes * 2 > weight.sum(dtype=np.float64)).view(">u8")
    return int(high), int(low)


def likeness(a: tuple[int, int], b: tuple[int, int]) -> float:
    """Share of equal bits."""
    return 1 - ((a[0] ^ b[0]).bit_count() + (a[1] ^ b[1]).bit_count()) / BITS


def _hex(fp: tuple[int, int]) -> str:
    return f"{fp[0]:016x}{fp[1]:016x}"


_BUCKET, _TAIL = "_bucket", "_tail"


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Deal (doc_id, text) out to ranges of doc_id so that the next document is at hand.

    Next: descending doc_id, null ids last, then by text; after the last comes the first.
    The ranges are quantiles of doc_id. The first document of each range is also sent to the
    range before it, marked ``_tail``, as the next of that range's last row. Texts are
    shuffled once; only the range bounds and one id per range pass through the driver. Each
    partition holds its ranges sorted, to be streamed.
    """
    spark = docs.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("double").alias("_d"))
    bounds = sorted(set(ids.approxQuantile("_d", [i / n for i in range(1, n)], 0.5 / n))) if n > 1 else []
    # a bound below all ids, as there must be one even for a table of a few rows
    cut = Bucketizer(splits=[-float("inf"), *(bounds or [-1e300]), float("inf")], inputCol="_d", outputCol=_BUCKET,
                     handleInvalid="keep")

    def place(df: DataFrame) -> DataFrame:
        df = cut.transform(df.withColumn("_d", F.col("doc_id").cast("double")))
        return df.withColumn(_BUCKET, F.when(F.col("doc_id").isNull(), -1)
                             .otherwise(F.col(_BUCKET)).cast("int")).drop("_d")

    firsts = sorted(((r[0], r[1]) for r in place(docs.select("doc_id")).groupBy(_BUCKET)
                     .agg(F.max("doc_id")).collect()), reverse=True)
    # (first id of a range, range that wants it): at most one row for each range
    wanted = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts)]
    tails = spark.createDataFrame(wanted, "_first long, _to int")
    rows = place(docs)
    copies = rows.join(F.broadcast(tails), F.col("doc_id").eqNullSafe(F.col("_first")))
    both = rows.withColumn(_TAIL, F.lit(False)).unionByName(
        copies.select("doc_id", "text", F.col("_to").alias(_BUCKET), F.lit(True).alias(_TAIL)))
    return both.repartition(n, _BUCKET).sortWithinPartitions(
        _BUCKET, _TAIL, F.col("doc_id").desc_nulls_last(), "text")


_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, high long, low long")


def _edited(batches):
    """Stream of sorted ranges -> a row per document, holding one document at a time."""
    import ctypes

    done, last = [], None  # last: bucket, id, text, fingerprint of the row that waits for its next

    def close(text, fp):
        i, own, own_fp = last[1:]
        half = len(own) // 2
        changed = own[:len(own) - half] + text[:half]
        efp = simhash(changed)
        done.append((i, len(own), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
                     _hex(own_fp), _hex(efp), likeness(own_fp, efp), likeness(own_fp, fp),
                     ctypes.c_int64(own_fp[0]).value, ctypes.c_int64(own_fp[1]).value))

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(),
             pa.int64(), pa.int64())
    for batch in batches:
        for bucket, tail, i, text in zip(*(batch[c].to_pylist() for c in (_BUCKET, _TAIL, "doc_id", "text"))):
            if last is None and tail:
                continue  # a further copy of a range's first id
            fp = simhash(text)
            if last is not None:
                close(text, fp)
            last = None if tail else (bucket, i, text, fp)
        if done:
            cols = list(zip(*done))
            done.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             [x.split()[0] for x in _OUT.split(", ")])


def fingerprint_edits(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprint of every text and of its edited text (see ``op3_doc_fingerprint``).

    Repeated rows are separate documents; equal ids follow by text. A null text is empty.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return with_next(rows, buckets).select(_BUCKET, _TAIL, "doc_id", "text").mapInArrow(_edited, _OUT)


def _block(half: Column, width: int, k: int) -> Column:
    return F.shiftrightunsigned(half, 64 - width * (k + 1)).bitwiseAND((1 << width) - 1)


def block_tables(fps: DataFrame, radius: int) -> DataFrame:
    """A row (table, key) per fingerprint and block: fingerprints that differ in at most
    ``radius`` of their bits agree in one of the ``radius + 1`` blocks, so each table has
    another block brought to the front as its key."""
    blocks = radius + 1
    if BITS % blocks or BITS // blocks > 64 or 64 % (BITS // blocks):
        raise ValueError("radius + 1 must divide the bits into blocks that fit a half: 1, 3, 7, 15")
    width = BITS // blocks
    half = blocks // 2
    if width == 64:
        keys = [F.col("high"), F.col("low")]
    else:
        keys = [_block(F.col(h), width, k) for h in ("high", "low") for k in range(half)]
    return fps.withColumn("_keys", F.array(*keys)).select("*", F.posexplode("_keys").alias("table", "key"))


def near_counts(queries: DataFrame, fps: DataFrame, radius: int = 3) -> DataFrame:
    """Documents within ``radius`` bits of each distinct query fingerprint (itself included).

    Copies are merged to one row per distinct fingerprint with its count first, so a group of
    copies costs one row; a pair is counted only in the first table in which its keys agree.
    """
    every = fps.groupBy("high", "low").agg(F.count(F.lit(1)).alias("copies"))
    asked = block_tables(queries.select("high", "low").distinct(), radius).select(
        F.col("high").alias("qh"), F.col("low").alias("ql"), F.col("_keys").alias("qk"), "table", "key")
    pairs = asked.join(block_tables(every, radius), ["table", "key"])
    bits = (F.bit_count(F.col("qh").bitwiseXOR(F.col("high")))
            + F.bit_count(F.col("ql").bitwiseXOR(F.col("low"))))
    first = F.array_position(F.zip_with("qk", "_keys", lambda x, y: x == y), True) == F.col("table") + 1
    return (pairs.where((bits <= radius) & first).groupBy("qh", "ql")
            .agg(F.sum("copies").alias("n_within")))


def op3_doc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts.

    Edited text: the last half (floor) of the code points is replaced by as many first ones of
    the next document. ``n_near``: other documents within 3 bits, for the query set of ids
    divisible by 100 against all rows (null for the rest), found through the block tables.
    """
    made = materialise(fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet")), "fingerprints")
    asked = F.col("doc_id") % 100 == 0
    found = near_counts(made.where(asked), made)
    # only rows of the query set look up a count; the rest have no key to meet on
    rows = made.withColumn("qh", F.when(asked, F.col("high"))).withColumn("ql", F.when(asked, F.col("low")))
    hits = rows.where(asked).join(found, ["qh", "ql"], "left").withColumn(
        "n_near", (F.col("n_within") - 1).cast("long")).drop("n_within")
    rest = rows.where(~F.coalesce(asked, F.lit(False))).withColumn("n_near", F.lit(None).cast("long"))
    return hits.unionByName(rest).drop("qh", "ql", "high", "low")
