"""SimHash near-dedup: fingerprints meet in a binary trie self-join.

Fingerprint: bit b is 1 if it is set in more than half of the XXH64 hashes (seed 42) of a
text's word shingles, repeats included. Fingerprints of at most ``max_bits`` differing bits
are linked; documents are grouped by the connected components of the links.

Distribution. Distinct fingerprints only are joined (copies cost one row). Two fingerprints
within ``max_bits`` bits agree in one of ``max_bits + 1`` blocks of bits, so each is sent to
the trie of each of its blocks: there the block is the common root path, on which no bit may
differ. A block value with more than ``CHUNK`` fingerprints is split into chunks, and every
pair of chunks is joined in a trie of its own, so no task holds more than two chunks.

Trie join. Fingerprints of a trie are sorted; a node is a range of them with a common prefix.
Pairs of nodes are traversed together from (root, root): taking different branches costs one
bit, a pair over the budget is pruned, and so is a pair that already lies in one component. A
pair whose budget covers all bits left is linked without looking further. Links come out as a
spanning forest of each trie, at most one row per fingerprint; components of all tries are
joined by ``components.connected_components``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from xxhash import xxh64_intdigest

from linecraft.llm.common import materialise, row_key
from linecraft.llm.components import connected_components

BITS = 64
SHINGLE_WORDS = 4
MAX_BITS = 4
CHUNK = 20_000
_SMALL = 4096  # pairs of fingerprints compared at once, without descending further
_STEP = 1 << 15


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit fingerprint of a text, unsigned; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle_words + 1)
    start = np.concatenate(([0], ends[:n - 1] + 1)).tolist()
    stop = ends[-n:].tolist()
    votes = np.zeros(BITS, np.int64)
    for k in range(0, n, _STEP):
        h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(start[k:k + _STEP], stop[k:k + _STEP])], ">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, text: str = "text") -> DataFrame:
    """Replace the text by ``fp``, the fingerprint as a signed long; no shuffle. Null text: 0."""
    keep = [c for c in docs.columns if c not in (text, "fp")]
    schema = StructType([*(docs.schema[c] for c in keep), StructField("fp", LongType())])

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t or "", shingle_words) for t in b[text].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(fps.view(np.int64))], schema.names)

    return docs.select(*keep, text).mapInArrow(run, schema)


def trie_forest(values: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Component of every value of a sorted array of distinct uint64, as an index into it."""
    group = np.arange(len(values))

    def unite(i, j) -> None:
        a, b = sorted((group[i], group[j]))
        if a != b:
            group[group == b] = a

    def unite_range(lo, hi, other) -> None:
        for g in np.unique(group[lo:hi]):
            unite(g, other)

    stack = [(0, len(values), 0, len(values), BITS, 0)]
    while stack:
        a0, a1, b0, b1, bits, differ = stack.pop()
        if a0 == a1 or b0 == b1 or (a0 == b0 and a1 - a0 < 2):
            continue
        low = group[a0:a1].min()
        if low == group[a0:a1].max() == group[b0:b1].min() == group[b0:b1].max():
            continue
        if differ + bits <= max_bits:
            unite_range(a0, a1, a0)
            unite_range(b0, b1, a0)
        elif (a1 - a0) * (b1 - b0) <= _SMALL:
            near = np.bitwise_count(values[a0:a1, None] ^ values[None, b0:b1]) <= max_bits
            i, j = np.nonzero(near)
            i, j = i + a0, j + b0
            while len(i):
                apart = group[i] != group[j]
                i, j = i[apart], j[apart]
                if len(i):
                    unite(i[0], j[0])
        else:
            bits -= 1
            bit = np.uint64(1 << bits)
            am = a0 + int(np.count_nonzero(values[a0:a1] & bit == 0))
            bm = b0 + int(np.count_nonzero(values[b0:b1] & bit == 0))
            stack += [(a0, am, b0, bm, bits, differ), (am, a1, bm, b1, bits, differ)]
            if differ < max_bits:
                stack.append((a0, am, bm, b1, bits, differ + 1))
                if a0 != b0:
                    stack.append((am, a1, b0, bm, bits, differ + 1))
    return group


def _block_bounds(max_bits: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of the blocks."""
    n = max_bits + 1
    at = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def links(fps: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): a spanning forest of the links within every trie, from distinct ``fp``."""
    if not 0 <= max_bits < 32:
        raise ValueError("max_bits must be between 0 and 31")
    bounds = _block_bounds(max_bits)
    values = [F.shiftrightunsigned("fp", BITS - a - w).bitwiseAND((1 << w) - 1) for a, w in bounds]
    rows = fps.select("fp", F.posexplode(F.array(*values)).alias("block", "value"))
    sizes = rows.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks.cast("long")).cast("int")
    # a chunk meets every other chunk of its trie once; a single chunk meets itself
    partners = F.when(chunks == 1, F.array(F.lit(0))).otherwise(
        F.array_remove(F.sequence(F.lit(0), chunks - 1), own))
    rows = (rows.join(sizes, ["block", "value"]).withColumn("own", own)
            .select("fp", "block", "value", "own", F.explode(partners).alias("other"))
            .select("fp", F.struct("block", "value", F.least("own", "other").alias("i"),
                                   F.greatest("own", "other").alias("j")).alias("trie")))
    dealt = rows.select("fp", F.xxhash64("trie").alias("trie")).repartition("trie").sortWithinPartitions("trie")

    def join(batches):
        rest = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def solve(trie, fp):
            out = []
            edges = np.flatnonzero(np.diff(trie)) + 1
            for part in np.split(fp, edges):
                v = np.unique(part.view(np.uint64))
                g = trie_forest(v, max_bits)
                moved = np.flatnonzero(g != np.arange(len(g)))
                out.append((v[moved].view(np.int64), v[g[moved]].view(np.int64)))
            a, b = (np.concatenate(x) for x in zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            trie = np.concatenate((rest[0], batch["trie"].to_numpy()))
            fp = np.concatenate((rest[1], batch["fp"].to_numpy()))
            if not len(trie):
                continue
            last = int(np.searchsorted(trie, trie[-1]))  # the last trie may go on in the next batch
            rest = trie[last:], fp[last:]
            if last:
                yield solve(trie[:last], fp[:last])
        if len(rest[0]):
            yield solve(*rest)

    return dealt.select("trie", "fp").mapInArrow(join, "a long, b long")


def components(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root) of every distinct fingerprint of ``prints``; root names the component."""
    distinct = prints.select("fp").distinct()
    found = connected_components(links(distinct, max_bits))
    return distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(columns of docs without text, fp, root): a row for every row of ``docs``."""
    prints = materialise(fingerprints(docs, shingle_words), "prints")
    return prints.join(materialise(components(prints, max_bits), "groups"), "fp")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    least = groups.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return groups.join(least, "root").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (null last), then by hash.

    Columns stay as they are. Rows equal in id and text are copies: one of them stays.
    """
    keyed = row_key(docs)
    groups = near_groups(keyed.select("doc_id", "_k1", "_k2", "text"), shingle_words, max_bits)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "_k1", "_k2")
    kept = groups.groupBy("root").agg(F.min(first).alias("m")).select("m._k1", "m._k2")
    return keyed.join(kept, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"]).select(*docs.columns)
