"""Labels: existence filter, renumbering, vocabulary, encoding and padding.

The distinct tokens of a row are looked up in the vocabulary by a join, whatever its size. With
``table`` a vocabulary of up to ``MAX_TABLE`` tokens (counted; a larger one is joined) is broadcast and
rows are replaced where they lie, by Arrow batches, with no shuffle. No row per character is made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from linecraft.functions import text as T
from linecraft.functions.arrays import drop_special, pad_labels, unmask_labels
from linecraft.operators.ordering import global_index, written

# Special tokens of the decoder, ids 0-3 (begin, padding, end, unknown).
SPECIALS = ("<s>", "<pad>", "</s>", "<unk>")
BOS, PAD, EOS, UNK = 0, 1, 2, 3
# Distinct tokens of a row up to which they are a dictionary of the row.
MAX_DICTIONARY = 1_024
# Tokens of a vocabulary, and bytes of one, up to which it is a table in every task.
MAX_TABLE, MAX_TABLE_BYTES = 1 << 18, 1 << 24
PART = 1 << 18   # bytes replaced at a time


def keep_existing(labels: DataFrame, files: DataFrame, key: str = "file_name") -> DataFrame:
    """Labels whose file exists (left semi join)."""
    return labels.join(files.select(key), key, "left_semi")


def missing_files(labels: DataFrame, files: DataFrame, key: str = "file_name") -> DataFrame:
    """C1 inverse report: labels whose file is missing (left anti join)."""
    return labels.join(files.select(key), key, "left_anti")


def renumber(df: DataFrame, order, ext: str = "jpg", out: str = "file_name") -> DataFrame:
    """E2 + G7: a running counter over ``order`` and its 8-digit file name."""
    return global_index(df, order, "idx").withColumn(out, T.numbered_name("idx", ext))


def tokens_of(col, unit: str = "char"):
    """Tokens of a text: code points (``char``) or whitespace words (``word``)."""
    c = F.col(col) if isinstance(col, str) else col
    if unit == "char":
        return F.regexp_extract_all(c, F.lit("(?s)."), 0)
    return T.tokenise(c)


def build_vocab(df: DataFrame, col: str = "text", unit: str = "char") -> DataFrame:
    """(token, token_id, count): specials first, then by count desc, token."""
    tokens = T.characters(col) if unit == "char" else tokens_of(col, unit)
    counts = (df.select(F.explode(tokens).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("count")))
    counts = counts.where(~F.col("token").isin(*SPECIALS))
    ranked = global_index(counts, [-F.col("count"), F.col("token")], "rank")
    body = ranked.select("token", (F.col("rank") + len(SPECIALS)).alias("token_id"), "count")
    spark = df.sparkSession
    specials = spark.createDataFrame([(t, i, 0) for i, t in enumerate(SPECIALS)],
                                     "token string, token_id long, count long")
    return specials.unionByName(body)


def _per_row(df: DataFrame, tokens, vocab: DataFrame, found: str, wanted: str, fallback, finish, out: str) -> DataFrame:
    """Look up every token of every row in ``vocab`` and put the results back in its place.

    A row's distinct tokens meet the vocabulary, once each; what they give is a dictionary of the row,
    by which its tokens are replaced where they stand. A dictionary is searched from its start, so
    rows of more than ``MAX_DICTIONARY`` distinct tokens have their tokens put back by position.
    Rows are told apart by a stored row number, so ids may repeat. A row whose tokens are null keeps
    a null result.
    """
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()), "labels")
    distinct = F.array_distinct(tokens)
    few = F.coalesce(F.size(distinct), F.lit(0)) <= MAX_DICTIONARY
    short, long = rows.where(few), rows.where(~few)
    looked_up = lambda each: each.join(vocab.select(found, wanted), found, "left").withColumn(
        "_v", F.coalesce(wanted, fallback))
    met = looked_up(short.select("_row", F.explode(distinct).alias(found)))
    by_row = met.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct(found, "_v"))).alias("_by"))
    # the tokens are cut anew behind the join: texts are shuffled, not arrays of characters
    short = short.join(by_row, "_row", "left").withColumn("_tokens", tokens) \
        .withColumn("_body", F.transform("_tokens", lambda t: F.col("_by")[t])).drop("_by")
    met = looked_up(long.select("_row", F.posexplode(tokens).alias("_pos", found)))
    whole = met.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_v"))),
                                                lambda s: s["_v"]).alias("_body"))
    both = short.unionByName(long.join(whole, "_row", "left").withColumn("_tokens", tokens), allowMissingColumns=False)
    return both.withColumn(out, F.when(F.col("_tokens").isNotNull(), finish(F.col("_body")))) \
        .drop("_row", "_tokens", "_body")


def _table(vocab: DataFrame, key: str, value: str) -> list | None:
    """(key, value) of the vocabulary, None if it has many rows, long tokens or a key twice."""
    rows = vocab.where(F.col(key).isNotNull()).select(key, value)
    size = F.coalesce(F.octet_length("token"), F.lit(0)).cast("long")
    n, octets, last = vocab.limit(MAX_TABLE + 1).agg(F.count(F.lit(1)), F.sum(size), F.max(F.abs("token_id"))).first()
    if n > MAX_TABLE or (octets or 0) > MAX_TABLE_BYTES or (last or 0) >= 1 << 31:
        return None
    pairs = [tuple(r) for r in rows.collect()]
    return pairs if len({k for k, _ in pairs}) == len(pairs) else None


def _parts(batch: pa.RecordBatch, col: str):
    """A batch in parts of about ``PART`` bytes of ``col``; a larger row is a part of its own."""
    each = pc.fill_null(pc.binary_length(batch[col]) if pa.types.is_string(batch[col].type) else
                        pc.multiply(pc.list_value_length(batch[col]), 4), 0)
    size = np.cumsum(each.to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    begin = 0
    while begin < batch.num_rows:
        held = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, held + PART, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _mapped(df: DataFrame, col: str, out: str, kind, replace) -> DataFrame:
    """``df`` with ``out``, what ``replace`` makes of an Arrow array of ``col``; rows stay where they are."""
    kept = [c for c in df.columns if c != out]
    source = "_source"
    schema = StructType([*(df.schema[c] for c in kept), StructField(out, kind)])

    def run(batches):
        for b in (part for whole in batches for part in _parts(whole, source)):
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), replace(b[source])], schema.names)

    return df.select(*kept, F.col(col).alias(source)).mapInArrow(run, schema)


def _encoded_chars(df: DataFrame, pairs: list, col: str, out: str) -> DataFrame:
    """Texts to their characters' ids by a table of code points."""
    pairs = [(ord(t), i) for t, i in pairs if len(t) == 1]
    size = max((p for p, _ in pairs), default=0) + 2   # the last place stands for all beyond
    ids = np.full(size, UNK, np.int32)
    for point, i in pairs:
        ids[point] = UNK if i is None else i
    table = df.sparkSession.sparkContext.broadcast(ids)

    def replace(texts: pa.Array) -> pa.Array:
        some = texts.to_pylist()
        points = np.frombuffer("".join(t or "" for t in some).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.array([len(t or "") for t in some], np.int64)
        null = np.array([t is None for t in some], bool)
        ends = np.cumsum(np.where(null, 0, length + 2))
        begins = ends - np.where(null, 0, length + 2)
        values = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        inner = np.ones(len(values), bool)
        values[begins[~null]], values[ends[~null] - 1] = BOS, EOS
        inner[begins[~null]] = inner[ends[~null] - 1] = False
        values[inner] = table.value[np.minimum(points, len(table.value) - 1)]
        offsets = pa.array(np.append(0, ends).astype(np.int32), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(values), mask=pa.array(null))

    return _mapped(df, col, out, ArrayType(IntegerType()), replace)


def _decoded(df: DataFrame, pairs: list, col: str, sep: str, out: str) -> DataFrame:
    """Ids to their tokens joined by ``sep``; special and unknown ids give nothing."""
    pairs = sorted((i, t) for i, t in pairs if t is not None and i not in range(len(SPECIALS)))
    table = df.sparkSession.sparkContext.broadcast((np.array([i for i, _ in pairs], np.int64), [t for _, t in pairs]))
    tokens = []

    def replace(rows: pa.Array) -> pa.Array:
        if not tokens:
            tokens.append(pa.array(table.value[1], pa.string()))
        ids = pc.list_flatten(rows)
        known = table.value[0]
        wanted = pc.fill_null(ids, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.searchsorted(known, wanted)
        found = np.zeros(len(wanted), bool) if not len(known) else \
            (known[np.minimum(at, len(known) - 1)] == wanted) & (wanted != -100) & ids.is_valid().to_numpy(zero_copy_only=False)
        null = rows.is_null().to_numpy(zero_copy_only=False)
        length = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(rows)), length)
        ends = np.cumsum(np.bincount(row[found], minlength=len(rows))).astype(np.int32)
        offsets = pa.array(np.append(np.int32(0), ends), pa.int32())
        text = pc.binary_join(pa.ListArray.from_arrays(offsets, tokens[0].take(pa.array(at[found]))), sep)
        return pc.if_else(pa.array(null), pa.scalar(None, pa.string()), text)

    return _mapped(df, col, out, StringType(), replace)


def encode(df: DataFrame, vocab: DataFrame, col: str = "text", key: str = "id",
           unit: str = "char", out: str = "ids", table: bool = False) -> DataFrame:
    """Text -> [<s>, ids..., </s>]; unknown tokens map to <unk>, a null text to null."""
    pairs = _table(vocab, "token", "token_id") if table and unit == "char" else None
    if pairs is not None:
        return _encoded_chars(df, pairs, col, out)
    return _per_row(df, tokens_of(col, unit), vocab.withColumn("token_id", F.col("token_id").cast("int")), "token",
                    "token_id", F.lit(UNK), lambda b: F.concat(F.array(F.lit(BOS)), b, F.array(F.lit(EOS))), out)


def label_ids(df: DataFrame, vocab: DataFrame, col: str = "text", key: str = "id",
              max_length: int = 128, unit: str = "char", out: str = "labels", table: bool = False) -> DataFrame:
    """C6 + G5: encoded, padded to ``max_length`` (never cut), padding replaced by -100."""
    enc = encode(df, vocab, col, key, unit, "_ids", table)
    return enc.withColumn(out, pad_labels("_ids", max_length, PAD)).drop("_ids")


def decode(df: DataFrame, vocab: DataFrame, col: str = "labels", key: str = "id",
           unit: str = "char", out: str = "decoded", table: bool = False) -> DataFrame:
    """G6 + C6 reverse: -100 -> pad, drop special ids, ids -> tokens -> text."""
    sep = "" if unit == "char" else " "
    pairs = _table(vocab, "token_id", "token") if table else None
    if pairs is not None:
        return _decoded(df, pairs, col, sep, out)
    ids = drop_special(unmask_labels(col, PAD), range(len(SPECIALS)))
    ids = F.transform(ids, lambda i: i.cast("long"))
    return _per_row(df, ids, vocab, "token_id", "token", F.lit(None).cast("string"),
                    lambda b: F.array_join(b, sep), out)
