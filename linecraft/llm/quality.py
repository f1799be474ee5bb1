"""Quality classifier: histogram gradient-boosted trees over document statistics, in numpy.

Statistics come from the whole text of every document (no language, source or id). Each is cut
into at most ``bins`` ranges at quantiles of the training rows; trees grow level by level on
histograms of gradients, with logistic loss and Newton leaves. A forest is flattened into four
arrays (feature, cut, next node, leaf value), and all rows step down together.

Training rows: at most ``max_train`` labelled rows with a remainder of crc32(id) mod 5 other
than 0, the first in the order of a seeded hash of the row (a documented bound; everything else
covers all data). The hash that bounds them is found by counting, so no more rows than that are
fetched, however many partitions there are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecraft.llm.common import materialise, remainder
from linecraft.llm.hashing import word_hashes

MAX_TRAIN = 20_000
THRESHOLD = 0.3

_END = re.compile(r"[.!?]")
# Byte classes: a row per class with 1 for each byte that belongs to it.
_CLASSES = np.zeros((9, 256), np.float64)
_CLASSES[0, 65:91] = _CLASSES[1, 97:123] = _CLASSES[2, 48:58] = 1
for _k, _chars in ((3, b" \t\r\x0b\x0c"), (4, b"\n"), (5, b".,;:'\"()-?"), (6, b"!"), (7, b"|<>{}[]=\\/_")):
    _CLASSES[_k, list(_chars)] = 1
_CLASSES[8, list(b"#$%&*@^~+")] = 1

STATISTICS = ("log_bytes", "upper", "lower", "digit", "blank", "newline", "punctuation", "exclamation",
              "markup", "symbol", "other", "log_words", "word_length", "word_length_spread", "long_words",
              "distinct_words", "top_word", "same_as_previous", "distinct_pairs", "top_pair", "log_lines",
              "line_length", "distinct_lines", "short_lines", "unended_lines", "sentence_length",
              "byte_entropy")


def statistics(text: str) -> np.ndarray:
    """The statistics of one text, in the order of ``STATISTICS``; an empty text gives zeros."""
    out = np.zeros(len(STATISTICS))
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts / len(raw)
    out[0] = np.log1p(len(raw))
    out[1:10] = _CLASSES @ share
    out[10] = 1 - out[1:10].sum()
    used = share[share > 0]
    out[26] = -(used * np.log2(used)).sum()
    words = word_hashes(text)
    n = len(words)
    out[11] = np.log1p(n)
    if n:
        lengths = np.fromiter(map(len, raw.split()), np.int64, n)
        out[12], out[13], out[14] = lengths.mean(), lengths.std(), (lengths > 12).mean()
        tf = np.unique(words, return_counts=True)[1]
        # relative to what a text of this length could have, so that long texts aren't odd for their length
        out[15], out[16] = len(tf) / n, tf.max() / n
        if n > 1:
            out[17] = (words[1:] == words[:-1]).mean()
            pairs = np.unique(words[1:] * np.uint64(31) + words[:-1], return_counts=True)[1]
            out[18], out[19] = len(pairs) / (n - 1), pairs.max() / (n - 1)
    lines = [x for x in text.split("\n") if x.strip()]
    if lines:
        out[20], out[21] = np.log1p(len(lines)), np.log1p(len(raw) / len(lines))
        out[22] = len(set(lines)) / len(lines)
        out[23] = sum(len(x) < 30 for x in lines) / len(lines)
        out[24] = sum(x.rstrip()[-1] not in ".!?:;\"')" for x in lines) / len(lines)
        out[25] = np.log1p(n / (1 + len(_END.findall(text))))
    return out


@dataclass
class Forest:
    """Flattened trees: node k of all trees together; a leaf points to itself."""
    cuts: np.ndarray      # (features, bins - 1) upper bounds of the ranges, padded with inf
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray       # range number; larger ranges go to next + 1
    next: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def ranges(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c[np.isfinite(c)], x[:, k], side="left")
                         for k, c in enumerate(self.cuts)], axis=1).astype(np.int32)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row of statistics."""
        if not len(x):
            return np.zeros(0)
        binned, rows = self.ranges(x), np.arange(len(x))
        total = np.full(len(x), self.base)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                leaf = self.next[node] == node
                right = binned[rows, self.feature[node]] > self.cut[node]
                node = np.where(leaf, node, self.next[node] + right)
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
        l2: float = 2.0, least: int = 8) -> Forest:
    """Boost ``trees`` trees of ``depth`` levels. Without rows or with one label only: a constant."""
    n, m = x.shape
    mean = min(max((y.sum() + 0.5) / (n + 1), 1e-6), 1 - 1e-6)
    base = float(np.log(mean / (1 - mean)))
    cuts = np.full((m, bins - 1), np.inf)
    for k in range(m if n else 0):
        q = np.unique(np.quantile(x[:, k], np.arange(1, bins) / bins))
        cuts[k, :len(q)] = q
    forest = Forest(cuts, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64),
                    np.zeros(0, np.int64), np.zeros(0), base, depth)
    if n == 0 or y.min() == y.max():
        return forest
    binned = forest.ranges(x)
    flat = binned + np.arange(m, dtype=np.int32) * bins
    f = np.full(n, base)
    roots, feature, cut, nxt, value = [], [], [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        roots.append(len(value))
        feature.append(0), cut.append(0), nxt.append(len(value)), value.append(0.0)
        where = np.full(n, roots[-1])
        level = [roots[-1]]
        for d in range(depth + 1):
            grown = []
            for node in level:
                inside = np.flatnonzero(where == node)
                gs, hs = g[inside].sum(), h[inside].sum()
                value[node] = rate * gs / (hs + l2)
                if d == depth or len(inside) < 2 * least:
                    continue
                at = flat[inside].ravel()
                hist = [np.bincount(at, np.repeat(w, m) if w is not None else None, m * bins).reshape(m, bins)
                        for w in (g[inside], h[inside], None)]
                gl, hl, nl = (np.cumsum(z, axis=1) for z in hist)
                gain = gl ** 2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs ** 2 / (hs + l2)
                gain[(nl < least) | (len(inside) - nl < least)] = -1
                best = int(gain.argmax())
                if gain.flat[best] <= 1e-6:
                    continue
                k, b = divmod(best, bins)
                feature[node], cut[node], nxt[node] = k, b, len(value)
                right = binned[inside, k] > b
                for side in (~right, right):
                    new = len(value)
                    feature.append(0), cut.append(0), nxt.append(new), value.append(0.0)
                    where[inside[side]] = new
                    grown.append(new)
            level = grown
        f += np.array(value)[where]
    return Forest(cuts, np.array(roots), np.array(feature), np.array(cut), np.array(nxt), np.array(value),
                  base, depth)


def document_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``statistics`` (array of doubles) and drop the text; no shuffle. Null text: zeros."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
    keep = [c for c in docs.columns if c not in (text, "statistics")]
    schema = StructType([*(docs.schema[c] for c in keep), StructField("statistics", ArrayType(DoubleType()))])

    def run(batches):
        for b in batches:
            x = [statistics(t or "") for t in b[text].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(x, pa.list_(pa.float64()))],
                                             [*keep, "statistics"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def first_by_hash(rows: DataFrame, n: int) -> list[tuple]:
    """The ``n`` rows of (statistics, _y, _o) with the smallest ``_o``, a seeded hash of the rest.

    Rows are counted by the upper 16 bits of the hash, then inside the range where the n-th row
    lies by the next 16, and so on: at most 65,536 counts a step reach the driver. Rows with the bound
    itself as hash are copies of each other and are fetched once, with their number.
    """
    inside, need, cut = rows, n, None
    for shift in (48, 32, 16, 0):
        part = F.shiftright("_o", shift)
        cut = None
        for value, count in sorted(map(tuple, inside.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect())):
            if count > need:
                cut = value
                break
            need -= count
        if cut is None:  # on the first step only: all rows are wanted
            break
        inside = inside.where(part == cut)
    below = rows if cut is None else rows.where(F.col("_o") < cut)
    out = [(r[0], r[1], r[2]) for r in below.select("_o", "_y", "statistics").collect()]
    if cut is not None and need:
        for r in sorted(map(tuple, inside.groupBy("_y", "statistics").agg(F.count(F.lit(1))).collect())):
            out += [(cut, r[0], r[1])] * min(need, r[2])
            need -= min(need, r[2])
    return sorted(out)


def train(stats: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Forest:
    """Fit on the labelled rows that aren't held out.

    A null label or id isn't used; an id with several labels or documents gives a row for each.
    """
    marked = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("_y"))
    rows = (stats.where(remainder("doc_id", 5) != 0).select("doc_id", "statistics").join(marked, "doc_id")
            .select("statistics", "_y", F.xxhash64(F.lit(11), "doc_id", "_y", "statistics").alias("_o")))
    rows = first_by_hash(materialise(rows, "training"), max_train)
    x = np.array([r[2] for r in rows]).reshape(len(rows), len(STATISTICS))
    return fit(x, np.array([r[1] for r in rows], np.float64))


def score(stats: DataFrame, forest: Forest) -> DataFrame:
    """Replace ``statistics`` by ``score`` (0 to 1, higher: better)."""
    from pyspark.sql.types import DoubleType, StructField, StructType
    keep = [c for c in stats.columns if c not in ("statistics", "score")]
    schema = StructType([*(stats.schema[c] for c in keep), StructField("score", DoubleType())])
    model = stats.sparkSession.sparkContext.broadcast(forest)  # bounded: trees times 2 ** (depth + 1) nodes

    def run(batches):
        for b in batches:
            x = b["statistics"].flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(model.value.score(x), pa.float64())],
                                             [*keep, "score"])

    return stats.select(*keep, "statistics").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(columns of docs without text, held_out, score, predicted) for every row.

    Ids may be null or repeated; extra columns of either table are kept or ignored. Without
    usable labels every score is 0.5 and every row is kept.
    """
    stats = materialise(document_statistics(docs), "statistics")
    held = remainder("doc_id", 5) == 0
    return (score(stats, train(stats, labels, max_train)).withColumn("held_out", held)
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(
        "doc_id", "held_out", "score", "predicted")
