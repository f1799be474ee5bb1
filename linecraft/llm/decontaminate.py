"""Benchmark decontamination: BM25 inverted index of the test items with block-max WAND.

Every document is cut into overlapping passages; each passage is a query against an index of
the test items. Words: runs of letters and digits, in lower case. A passage is two segments of
the length of the longest item, and each segment begins one, so any item stands whole in one.

Index: for every word its postings (item, impact), impact = idf * saturated tf, in item order;
items are numbered by length and cut in blocks, and each word keeps its largest impact in
each block. Search of a passage, in two steps with the same threshold (a share of the item's
score against itself, its own best possible score):

1. block skipping, for all passages of a batch at once: the block maxima of the words of both
   segments are added up; only blocks whose sum reaches the smallest threshold in the block stay;
2. WAND inside a block that stays: words are taken by falling block maximum, items are scored
   word by word, and an item is dropped as soon as its score so far and what the words left can
   add at most don't reach its threshold.

No item above its threshold is lost by either step. Items found are verified: of the whole item's
runs of five words (of the whole item if shorter) at least 0.8 must stand in the passage. Items have
no question and answer fields; the overlaps of their first three quarters and of the rest are given
in the result, and a pair passes as well if both of them reach 0.8.

The index is sent to the executors in shards of at most ``SHARD_BYTES`` of item text: a larger
benchmark takes more passes over the documents, not a larger broadcast. The number of items, their
average and largest length and the items that hold a word are counted by Spark over the whole
benchmark first, so scores, thresholds and passages don't depend on the shards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecraft.llm.common import materialise, row_key
from linecraft.llm.hashing import hash_words, shingle_hashes, word_hashes

SHARD_BYTES = 8 << 20
BLOCK = 2
COMMON = 0.5
K1, B = 1.2, 0.75
SCORE_SHARE = 0.6
OVERLAP = 0.8
RUN = 5

# Separators: ASCII that is neither a letter nor a digit.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[:128] = True
_SEPARATOR[48:58] = _SEPARATOR[65:91] = _SEPARATOR[97:123] = False


def words_of(text: str) -> np.ndarray:
    return word_hashes(text.lower(), _SEPARATOR)


_CHARS = 1 << 19  # short texts are hashed together up to this many characters


def words_of_all(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts one after another, and how many each text has."""
    hashes, sizes, some, held = [], [], [], 0
    for k, text in enumerate(texts):
        some.append(text)
        held += len(text)
        if held < _CHARS and k + 1 < len(texts):
            continue
        raw = [t.lower().encode("utf-8", "surrogatepass") for t in some]
        w, start, _ = hash_words(b" ".join(raw), _SEPARATOR)
        ends = np.cumsum([len(r) + 1 for r in raw])
        hashes.append(w)
        sizes.append(np.diff(np.searchsorted(start, ends), prepend=0))
        some, held = [], 0
    return (np.concatenate(hashes), np.concatenate(sizes)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, int))


@dataclass
class Index:
    """Items are in order of length; arrays over (word, item) are in order of word, then item."""
    ids: list
    words: list            # per item: its words in order
    need: np.ndarray       # per item: score it takes to be retrieved
    block_need: np.ndarray  # per block: the smallest of them
    vocabulary: np.ndarray  # sorted word hashes
    start: np.ndarray      # postings of word k: start[k] .. start[k + 1]
    item: np.ndarray
    impact: np.ndarray
    block_start: np.ndarray  # blocks of word k: block_start[k] .. block_start[k + 1]
    block: np.ndarray
    block_max: np.ndarray
    common: np.ndarray     # words in most blocks: one bound for all blocks, 0 for the rest
    longest: int


@dataclass
class Benchmark:
    """What the scores of an item take from all others."""
    items: int       # with a word at least
    mean: float      # words of an item
    longest: int


def build_index(items: list[tuple], share: float = SCORE_SHARE, whole: Benchmark | None = None,
                held_by: dict | None = None) -> Index:
    """``items``: (id, text). Items without words can't be found and are left out.

    ``whole`` and ``held_by`` (items that hold a word) describe the benchmark of which ``items`` are
    a part; without them the items are all there is.
    """
    kept = sorted(((i, words_of(t or "")) for i, t in items), key=lambda x: len(x[1]))
    kept = [(i, w) for i, w in kept if len(w)]
    n = len(kept)
    word = np.concatenate([w for _, w in kept]) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), [len(w) for _, w in kept]) if n else np.zeros(0, np.int64)
    vocabulary, at = np.unique(word, return_inverse=True)
    pair, tf = np.unique(at * max(n, 1) + owner, return_counts=True)
    which, item = pair // max(n, 1), pair % max(n, 1)
    df = np.bincount(which, minlength=len(vocabulary))
    length = np.array([len(w) for _, w in kept], float)
    if whole is None:
        whole = Benchmark(n, length.mean() if n else 1.0, int(length.max()) if n else 0)
    every = df if held_by is None else np.array([held_by[int(w)] for w in vocabulary.view(np.int64)], np.int64)
    idf = np.log(1 + (whole.items - every + 0.5) / (every + 0.5))
    norm = K1 * (1 - B + B * length / whole.mean)
    impact = idf[which] * tf * (K1 + 1) / (tf + norm[item])
    need = share * np.bincount(item, impact, n)
    blocks = -(-n // BLOCK)
    in_block, first = np.unique(which * max(blocks, 1) + item // BLOCK, return_index=True)
    block_max = np.maximum.reduceat(impact, first) if n else impact
    per_word = np.bincount(in_block // max(blocks, 1), minlength=len(vocabulary))
    block_need = np.array([need[b * BLOCK:(b + 1) * BLOCK].min() for b in range(blocks)])
    common = np.where(per_word > COMMON * blocks, np.maximum.reduceat(impact, np.cumsum(df) - df) if n else 0.0, 0.0)
    return Index([i for i, _ in kept], [w for _, w in kept], need, block_need, vocabulary,
                 np.concatenate(([0], np.cumsum(df))), item, impact,
                 np.concatenate(([0], np.cumsum(per_word))), in_block % max(blocks, 1), block_max, common,
                 whole.longest if n else 0)


def candidates(index: Index, words: np.ndarray, block: int) -> list[tuple[int, float]]:
    """WAND inside one block: (item, score) of all items that reach their threshold."""
    low, high = block * BLOCK, min((block + 1) * BLOCK, len(index.ids))
    bounds = []
    for w in words:
        s, e = index.block_start[w], index.block_start[w + 1]
        k = s + np.searchsorted(index.block[s:e], block)
        if k < e and index.block[k] == block:
            bounds.append((index.block_max[k], w))
    bounds.sort(reverse=True)
    left = sum(b for b, _ in bounds)
    need, score, alive = index.need[low:high], np.zeros(high - low), np.ones(high - low, bool)
    for bound, w in bounds:
        alive &= score + left >= need - 1e-9
        if not alive.any():
            return []
        s, e = index.start[w], index.start[w + 1]
        a, b = s + np.searchsorted(index.item[s:e], (low, high))
        score[index.item[a:b] - low] += index.impact[a:b]
        left -= bound
    return [(low + int(j), float(score[j])) for j in np.flatnonzero(alive & (score >= need - 1e-9))]


def _overlap(part: np.ndarray, passage: np.ndarray) -> float:
    runs = np.unique(shingle_hashes(part, RUN))
    if len(part) < RUN:
        there = shingle_hashes(passage, len(part)) if len(passage) >= len(part) else passage[:0]
    else:
        there = shingle_hashes(passage, RUN) if len(passage) >= RUN else passage[:0]
    return float(np.isin(runs, there).mean())


def verify(item: np.ndarray, passage: np.ndarray) -> tuple[float, float, float]:
    """Overlap of an item with a passage: of the whole, of its first three quarters and of the rest."""
    cut = max(1, -(-3 * len(item) // 4))
    first = _overlap(item[:cut], passage)
    return _overlap(item, passage), first, _overlap(item[cut:], passage) if cut < len(item) else first


_CELLS = 1 << 21  # segments times blocks whose bounds are held at once


def _bounds(index: Index, segment: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """(segment, block): sum of the block maxima of the segment's distinct words.

    Words in most blocks add their largest impact to every block, which bounds it as well.
    """
    blocks = len(index.block_need)
    everywhere = index.common[word]
    flat = np.bincount(segment, everywhere, n)
    segment, word = segment[everywhere == 0], word[everywhere == 0]
    count = index.block_start[word + 1] - index.block_start[word]
    ends = np.cumsum(count)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(index.block_start[word] - (ends - count), count)
    cell = np.repeat(segment * blocks, count) + index.block[at]
    return np.bincount(cell, index.block_max[at], n * blocks).reshape(n, blocks) + flat[:, None]


def search(index: Index, texts: list[str]) -> list[tuple[int, int, float, float, float]]:
    """(text number, item number, score, question overlap, answer overlap), best passage first."""
    step = index.longest
    words, size = words_of_all(texts) if step else ([], [])
    if not len(words):
        return []
    begin = np.cumsum(size) - size
    at = np.minimum(np.searchsorted(index.vocabulary, words), len(index.vocabulary) - 1)
    known = np.flatnonzero(index.vocabulary[at] == words)
    # segments of all texts, numbered through
    segments = -(-size // step)
    base = np.cumsum(segments) - segments
    owner = np.repeat(np.arange(len(texts)), segments)
    place = np.arange(len(owner)) - base[owner]
    of_word = np.repeat(base, size) + (np.arange(len(words)) - np.repeat(begin, size)) // step
    pair = np.sort(of_word[known] * np.int64(len(index.vocabulary)) + at[known])
    pair = pair[np.append(True, pair[1:] != pair[:-1])[:len(pair)]]
    segment, word = pair // len(index.vocabulary), pair % len(index.vocabulary)
    edge = np.searchsorted(segment, np.arange(len(owner) + 1))
    found: dict[tuple[int, int], tuple] = {}
    # words that the next segment repeats count once in a passage
    again = np.append(pair, -1)[np.searchsorted(pair, pair + len(index.vocabulary))] == pair + len(index.vocabulary)
    few = max(2, _CELLS // len(index.block_need))
    for low in range(0, len(owner), few - 1):
        high = min(low + few, len(owner))
        here = slice(edge[low], edge[high])
        bound = _bounds(index, segment[here] - low, word[here], high - low)
        twice = _bounds(index, segment[here][again[here]] - low, word[here][again[here]], high - low)
        follows = np.zeros(high - low, bool)
        follows[:-1] = owner[low + 1:high] == owner[low:high - 1]
        both = bound.copy()
        both[:-1][follows[:-1]] += (bound[1:] - twice[:-1])[follows[:-1]]
        # a text's last segment is covered by the passage before it; the last row of a range begins the next range
        use = follows | (segments[owner[low:high]] == 1)
        both[~use] = 0
        for row, block in zip(*np.nonzero(both >= index.block_need - 1e-9)):
            s = low + row
            last = s + 1 if follows[row] else s
            terms = np.unique(word[edge[s]:edge[last + 1]])
            for item, score in candidates(index, terms, int(block)):
                k = int(owner[s])
                passage = words[begin[k] + place[s] * step:min(begin[k] + (place[last] + 1) * step, begin[k] + size[k])]
                whole, q, a = verify(index.words[item], passage)
                if whole >= OVERLAP or min(q, a) >= OVERLAP:
                    found[k, item] = max(found.get((k, item), (0, 0, 0)), (score, q, a))
    return [(k, item, *v) for (k, item), v in found.items()]


def benchmark_words(items: DataFrame) -> tuple[DataFrame, Benchmark]:
    """(item_id, text, n, words) of all different items, words: array of (word, items that hold it),
    and the figures of the whole benchmark."""
    texts = materialise(row_key(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct(),
                                "item_id"), "items")

    def run(batches):
        for b in batches:
            words = [words_of(t) for t in b["text"].to_pylist()]
            some = [np.unique(w) for w in words]
            at = pa.array(np.repeat(np.arange(len(words)), [len(w) for w in some]))
            flat = np.concatenate(some).view(np.int64) if some else np.zeros(0, np.int64)
            size = np.repeat([len(w) for w in words], [len(w) for w in some])
            yield pa.RecordBatch.from_arrays(
                [b["_k1"].take(at), b["_k2"].take(at), pa.array(flat), pa.array(size.astype(np.int64))], names)

    names = ["_k1", "_k2", "word", "size"]
    held = materialise(texts.select("_k1", "_k2", "text").mapInArrow(run, "_k1 long, _k2 long, word long, size long"), "words")
    n, mean, longest = held.groupBy("_k1", "_k2").agg(F.max("size").alias("size")).agg(
        F.count(F.lit(1)), F.avg("size"), F.max("size")).first()
    df = held.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    # the words of one item
    own = held.join(df, "word").groupBy("_k1", "_k2").agg(F.collect_list(F.struct("word", "df")).alias("words"))
    return texts.join(own, ["_k1", "_k2"]), Benchmark(n, mean or 1.0, longest or 0)


def shards(items: DataFrame, limit: int = SHARD_BYTES):
    """Lists of (item_id, text), each of at most ``limit`` bytes of text or of one item, with the
    number of items of the whole benchmark that hold a word of theirs.

    ``items``: see ``benchmark_words``. They are streamed to the driver a partition at a time, in order
    of length.
    """
    some, held, held_by = [], 0, {}
    for r in items.orderBy(F.length("text"), "text", "item_id").toLocalIterator():
        size = len(r.text.encode("utf-8", "surrogatepass")) + 16
        if some and held + size > limit:
            yield some, held_by
            some, held, held_by = [], 0, {}
        some.append((r.item_id, r.text))
        held_by.update((w.word, w.df) for w in r.words)
        held += size
    if some:
        yield some, held_by


_OUT = "item_id long, score double, question_overlap double, answer_overlap double"


def find_leaks(docs: DataFrame, items: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(columns of docs but text, item_id, score, question_overlap, answer_overlap): a row for
    each document and test item that it contains.

    Null and empty texts contain nothing; repeated documents or items give repeated pairs once
    per document row; an empty benchmark gives no rows. Columns of ``docs`` with the names of
    the results are dropped.
    """
    from pyspark.sql.types import StructType
    spark = docs.sparkSession
    made = StructType.fromDDL(_OUT)
    keep = [c for c in docs.columns if c != "text" and c not in made.names]
    schema = StructType([*(docs.schema[c] for c in keep), *made.fields])
    rows = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    out = spark.createDataFrame([], schema)
    known, whole = benchmark_words(items)
    for shard, held_by in shards(known, shard_bytes):
        index = spark.sparkContext.broadcast(build_index(shard, whole=whole, held_by=held_by))  # bounded by shard_bytes

        def run(batches, index=index):
            ix = index.value
            for b in batches:
                hits = search(ix, b["text"].to_pylist())
                at = pa.array([h[0] for h in hits], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(b[c].take(at) for c in keep), pa.array([ix.ids[h[1]] for h in hits], pa.int64()),
                     *(pa.array([h[j] for h in hits], pa.float64()) for j in (2, 3, 4))], schema.names)

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that contain a test item; columns unchanged."""
    keyed = row_key(docs)
    leaks = find_leaks(keyed.select("_k1", "_k2", "text"), items).select("_k1", "_k2").distinct()
    return keyed.join(materialise(leaks, "leaks"), ["_k1", "_k2"], "left_anti").drop("_k1", "_k2")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it contains, with its BM25 score and overlaps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
