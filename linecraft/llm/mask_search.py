"""Ranked lexical search: an item's documents grouped by the set of its terms that they hold.

Documents are cut into blocks. In a block the postings of an item's terms set bits of a presence
mask for every document, a bit per term; documents with one mask form a group. A mask's score is
bounded by the sum, over its terms, of the weight times the largest term factor in the block. Masks
are scored in the order of their bounds, highest first, until no later bound reaches the score of
the last place: documents behind it can't enter, ties included. Each block yields its best
documents per item, and Spark merges them.

Two passes. The first reads the texts once and keeps, per document, its number of terms and the
benchmark terms in it with their counts (written; narrow). From it come the number of documents,
all terms and document frequencies, over all rows. The second works on that table only. Items come
in shards of bounded size, a shard's terms are what is broadcast.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linecraft.llm.common import materialise

TOP = 10
SHARD_BYTES = 8 << 20
BLOCK_DOCS, BLOCK_HITS = 1 << 15, 1 << 21
# A term is a run of letters, digits and anything beyond ASCII; only A-Z are folded.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def item_shards(items: DataFrame, limit: int = SHARD_BYTES):
    """Lists of (item_id, text), of about ``limit`` bytes of text each, dealt by a hash of the item.

    Rows equal in id and text are one item. Items without a term are left out.
    """
    rows = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-size // limit)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        part = [(r.item_id, list(dict.fromkeys(terms(r.text)))) for r in part]
        part = [(i, t) for i, t in part if t]
        if part:
            yield part


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], carry: str = "doc_id") -> DataFrame:
    """(carry, n, terms, tfs): every document's number of terms, and those of ``vocabulary`` in it.

    A null text has no term; the row stays, with n 0.
    """
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
    schema = StructType([docs.schema[carry], StructField("n", LongType()),
                         StructField("terms", ArrayType(IntegerType())), StructField("tfs", ArrayType(LongType()))])
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the bytes of a shard of items

    def run(batches):
        ids = known.value
        for b in batches:
            n, which, tfs = [], [], []
            for text in b["text"]:
                words = terms(text.as_py())
                hits = [(ids[w], tf) for w, tf in Counter(words).items() if w in ids]
                n.append(len(words))
                which.append([t for t, _ in hits])
                tfs.append([tf for _, tf in hits])
            yield pa.RecordBatch.from_arrays(
                [b[carry], pa.array(n, pa.int64()), pa.array(which, pa.list_(pa.int32())),
                 pa.array(tfs, pa.list_(pa.int64()))], schema.names)

    return docs.select(carry, "text").mapInArrow(run, schema)


def weights(counts: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L and every term's weight, from all rows of ``counts``; ``size`` terms, a row each."""
    n, total = counts.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(size, np.int64)
    found = counts.select(F.explode("terms").alias("t")).groupBy("t").count()
    for r in found.collect():  # at most one row a term of the shard
        df[r["t"]] = r["count"]
    w = np.floor(1000 * np.log((2.0 * n + 2) / (2.0 * df + 1))).astype(np.int64)
    return n, total or 0, w


class Block:
    """Postings of some documents: for each term its documents, ascending, and their term factors."""

    def __init__(self, n, lengths, which, tfs, collection, total):
        """``lengths``: terms in each document; ``n``: in a document how many entries of which, tfs."""
        m = 10 + (90 * n * collection) // max(total, 1)
        doc = np.repeat(np.arange(len(n)), lengths)
        factor = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[doc])
        order = np.argsort(which, kind="stable")
        which, self.doc, self.factor = which[order], doc[order], factor[order]
        self.size = len(n)
        self.terms, starts = np.unique(which, return_index=True)
        self.bounds = np.append(starts, len(which))
        self.most = np.maximum.reduceat(self.factor, starts) if len(which) else np.zeros(0, np.int64)

    def postings(self, term: int):
        at = np.searchsorted(self.terms, term)
        if at == len(self.terms) or self.terms[at] != term:
            return None
        a, b = self.bounds[at], self.bounds[at + 1]
        return self.doc[a:b], self.factor[a:b], self.most[at]

    def groups(self, lists):
        """(masks, documents by mask, ends): distinct masks as rows of bits and the documents of each.

        Documents with no term are no group. A mask takes a 64-bit word for each 64 terms.
        """
        words = -(-len(lists) // 64)
        mask = np.zeros((self.size, words), np.uint64)
        for j, (doc, _, _) in enumerate(lists):
            mask[doc, j // 64] |= np.uint64(1) << np.uint64(j % 64)
        held = np.flatnonzero(mask.any(axis=1))
        if words == 1:
            distinct, group = np.unique(mask[held, 0], return_inverse=True)
            distinct = distinct[:, None]
        else:
            distinct, group = np.unique(mask[held], axis=0, return_inverse=True)
        group = group.reshape(-1)
        by_group = held[np.argsort(group, kind="stable")]
        bits = np.unpackbits(np.ascontiguousarray(distinct).view(np.uint8), axis=1, bitorder="little")
        return bits[:, :len(lists)].astype(bool), by_group, np.cumsum(np.bincount(group, minlength=len(distinct)))

    def search(self, query: list[tuple[int, int]], top: int, tie: np.ndarray):
        """(documents, scores) of the best ``top`` for (term, weight) pairs; ``tie`` ranks equal scores."""
        lists, w = [], []
        for t, weight in query:
            found = self.postings(t)
            if found is not None and weight > 0:
                lists.append(found)
                w.append(weight)
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        masks, by_group, ends = self.groups(lists)
        bound = masks @ (np.array(w, np.int64) * np.array([p[2] for p in lists]))
        best_doc, best_score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(-bound, kind="stable")
        at, step = 0, 1
        starts = np.append(0, ends[:-1])
        while at < len(order):
            if len(best_doc) == top and bound[order[at]] < best_score[-1]:
                break
            some = order[at:at + step]
            if len(best_doc) == top:
                some = some[bound[some] >= best_score[-1]]
            docs = np.sort(np.concatenate([by_group[starts[g]:ends[g]] for g in some]))
            score = np.zeros(len(docs), np.int64)
            used = masks[some].any(axis=0)
            for j in np.flatnonzero(used):
                doc, factor, _ = lists[j]
                if len(doc) < len(docs):
                    k = np.searchsorted(docs, doc)
                    k[k == len(docs)] = 0
                    hit = docs[k] == doc
                    score[k[hit]] += w[j] * factor[hit]
                else:
                    k = np.searchsorted(doc, docs)
                    k[k == len(doc)] = 0
                    hit = doc[k] == docs
                    score[hit] += w[j] * factor[k[hit]]
            docs, score = np.append(best_doc, docs), np.append(best_score, score)
            keep = np.lexsort((tie[docs], -score))[:top]
            keep = keep[score[keep] > 0]
            best_doc, best_score = docs[keep], score[keep]
            at += step
            step *= 2
        return best_doc, best_score


_FOUND = "item_id long, score long, place long"


def best_of_blocks(counts: DataFrame, items, weight: np.ndarray, ids: dict[bytes, int], n: int, total: int,
                   top: int = TOP) -> DataFrame:
    """(doc_id, item_id, score, place): the best ``top`` documents of every block for every item.

    ``place`` numbers the items of the shard, so that an id with two texts stays two items.
    """
    from pyspark.sql.types import StructType
    schema = StructType([counts.schema["doc_id"], *StructType.fromDDL(_FOUND).fields])
    asked = [(i, [(ids[t], int(weight[ids[t]])) for t in words]) for i, words in items]
    held = counts.sparkSession.sparkContext.broadcast(asked)  # bounded by the bytes of a shard of items

    def answer(rows):
        table = pa.Table.from_batches(rows).combine_chunks()
        doc_ids = table["doc_id"].combine_chunks()
        which, tfs = table["terms"].combine_chunks(), table["tfs"].combine_chunks()
        lengths = np.diff(which.offsets.to_numpy())
        null = doc_ids.is_null().to_numpy(zero_copy_only=False)
        # equal scores: by ascending id, rows without an id last
        rank = np.lexsort((doc_ids.fill_null(0).to_numpy(), null))
        tie = np.empty(len(rank), np.int64)
        tie[rank] = np.arange(len(rank))
        block = Block(table["n"].to_numpy(), lengths, which.flatten().to_numpy().astype(np.int64),
                      tfs.flatten().to_numpy(), n, total)
        for place, (item, query) in enumerate(held.value):
            docs, score = block.search(query, top, tie)
            if len(docs):
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(docs)), pa.array([item] * len(docs), pa.int64()),
                     pa.array(score, pa.int64()), pa.array([place] * len(docs), pa.int64())], schema.names)

    def run(batches):
        rows, docs, hits = [], 0, 0
        for b in batches:
            rows.append(b)
            docs, hits = docs + b.num_rows, hits + len(b["terms"].flatten())
            if docs >= BLOCK_DOCS or hits >= BLOCK_HITS:
                yield from answer(rows)
                rows, docs, hits = [], 0, 0
        if docs:
            yield from answer(rows)

    return counts.select("doc_id", "n", "terms", "tfs").where("n > 0").mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the best ``top`` documents above score 0 of every item.

    Equal scores: by ascending doc_id, rows without an id last. A repeated row counts as a document
    of its own; rows of ``items`` equal in id and text are one item, an id with two texts is two. An
    item without terms, a benchmark or a table without rows: no row. Other columns are ignored.
    """
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType
    spark = docs.sparkSession
    out = None
    for k, part in enumerate(item_shards(items, shard_bytes)):
        ids = {t: j for j, t in enumerate(dict.fromkeys(t for _, words in part for t in words))}
        counts = materialise(term_counts(docs.select("doc_id", "text"), ids), "terms")
        n, total, weight = weights(counts, len(ids))
        found = best_of_blocks(counts, part, weight, ids, n, total, top)
        # an item's rows meet in two steps: first within a hash of the document, then all
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        some = Window.partitionBy("place", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*order)
        found = found.withColumn("r", F.row_number().over(some)).where(F.col("r") <= top)
        every = Window.partitionBy("place").orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= top)
        found = found.select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], StructType([
            StructField("item_id", LongType()), StructField("rank", IntegerType()), docs.schema["doc_id"],
            StructField("score", LongType())]))
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH words AS (SELECT doc_id, row_number() OVER () AS row_no, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents WHERE text IS NOT NULL),
lengths AS (SELECT row_no, doc_id, count(*) AS n FROM words GROUP BY ALL),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
asked AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
held AS (SELECT row_no, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weighed AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM held, totals GROUP BY term, docs),
scored AS (SELECT a.item_id, a.text, l.doc_id, l.row_no, sum(w * ((1000000000 * h.tf)
    // (1000 * h.tf + 8 * (100 - 90 + (90 * l.n * t.docs) // t.terms))))::BIGINT AS score
    FROM asked a JOIN held h ON a.term = h.term JOIN weighed g ON g.term = h.term
    JOIN lengths l ON l.row_no = h.row_no, totals t GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank
    FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
