"""Reading large files by many tasks: numbered lines and quoted records across split borders.

Spark's text source cuts a file into splits and gives each task whole lines in order. What a task
can't know is how many lines lie before its split and, for quoted records, whether its first line
lies inside a quoted field. Both follow from sums per split: a row per (path, block start), taken
by one aggregate over the same scan and summed up in file order. The lines themselves are neither
sorted nor shuffled; a line's place is its split's offset plus its place in the split, which
``monotonically_increasing_id`` gives (the scan deals out the same splits both times).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linecraft.functions import text as T
from linecraft.operators.ordering import prefix_sum, written

MAX_BROADCAST_SPLITS = 1 << 20   # rows of about 150 bytes; more splits meet the lines by a plain join
_PATH, _BLOCK, _ID = "path", "_block", "_id"


def scan_lines(spark: SparkSession, path) -> DataFrame:
    """(path, _block, value): the files under ``path`` cut at line feeds.

    Lines that aren't valid UTF-8 lose the bytes that don't decode (and any U+FFFD in them). Bare
    carriage returns don't cut here: a file with no line feed at all is one row.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias(_PATH), F.col("_metadata.file_block_start").alias(_BLOCK),
        F.col("_metadata.file_size").alias("_size"), F.octet_length("value").alias("_octets"), "value")
    mended = F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit(""))
    return raw.withColumn("value", F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(mended))


def with_marks(lines: DataFrame) -> DataFrame:
    """Lines with the byte-order marks that the text source takes off, as a character of a file's first line.

    A file that is three bytes longer than its lines and line feeds had one (two, if it doesn't end
    in a line feed). A file of nothing but a mark has no line.
    """
    lines = lines.withColumn("_raw", F.monotonically_increasing_id())
    marked = lines.groupBy(_PATH).agg((F.max("_size") - F.sum(F.col("_octets") + 1)).alias("_more"),
                                      F.min(F.when(F.col(_BLOCK) == 0, F.col("_raw"))).alias("_raw"))
    marked = written(marked.where(F.col("_more") >= 2), "marks").withColumn("_mark", F.lit("\ufeff"))
    n = marked.limit(MAX_BROADCAST_SPLITS + 1).count()
    if n == 0:
        return lines.drop("_raw")
    met = lines.join(F.broadcast(marked) if n <= MAX_BROADCAST_SPLITS else marked, [_PATH, "_raw"], "left")
    return met.withColumn("value", F.concat(F.coalesce("_mark", F.lit("")), "value")).drop("_raw", "_mark", "_more")


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn(_ID, F.monotonically_increasing_id())


def split_sums(rows: DataFrame, sums: dict[str, Column], by_path: bool = False) -> DataFrame:
    """A row per split: its first id, and for each sum ``_before_<name>``, that of all splits ahead.

    Splits are in the order of (path, block start). With ``by_path`` the sums start anew in each
    file. Written, so that it is computed once.
    """
    per = written(rows.groupBy(_PATH, _BLOCK).agg(F.min(_ID).alias("_first"), *[c.alias(n) for n, c in sums.items()]),
                  "splits")
    if by_path:  # the splits of one file, a few bytes for each 128 MB
        ahead = Window.partitionBy(_PATH).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        return written(per.select(_PATH, _BLOCK, "_first", *[F.coalesce(F.sum(n).over(ahead), F.lit(0))
                                                             .alias(f"_before_{n}") for n in sums]), "splits")
    for n in sums:
        per = prefix_sum(per, [_PATH, _BLOCK], n, f"_before_{n}")
    return written(per.drop(*sums), "splits")


def with_splits(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows with what their split knows; broadcast up to ``MAX_BROADCAST_SPLITS`` rows, counted first."""
    small = splits.limit(MAX_BROADCAST_SPLITS + 1).count() <= MAX_BROADCAST_SPLITS
    return rows.join(F.broadcast(splits) if small else splits, [_PATH, _BLOCK])


def numbered_lines(spark: SparkSession, path, max_chars: int | None = None, marks: bool = True) -> DataFrame:
    """(line_no, path, text): the non-empty lines of all files, numbered in (path, place) order.

    A line ends where Python's ``splitlines`` ends it, also inside what the source takes for one.
    ``max_chars`` cuts the texts. A byte-order mark is a character of its line, as in Python; without
    ``marks`` it is dropped, which saves a scan. No line at all is an error.
    """
    lines = scan_lines(spark, path)
    lines = with_marks(lines) if marks else lines
    line = F.explode(F.filter(T.split_lines("value"), lambda x: F.length(x) > 0)).alias("text")
    rows = _numbered(lines.select(_PATH, _BLOCK, line))
    splits = split_sums(rows, {"n": F.count(F.lit(1))})
    if splits.limit(1).count() == 0:
        raise ValueError(f"No lines could be read from {path}")
    text = F.substring("text", 1, max_chars) if max_chars else F.col("text")
    return with_splits(rows, splits).select(
        (F.col("_before_n") + F.col(_ID) - F.col("_first")).alias("line_no"), _PATH, text.alias("text"))


def quoted_records(spark: SparkSession, path, quote: str = '"') -> DataFrame:
    """(path, record_no, value): the records of quoted text files, cut at line feeds outside quotes.

    A line lies inside a quoted field if an odd number of quotes stands before it in its file.
    Per split the quotes are counted, so every line knows its state; one window per split (a split's
    lines, never more) counts on from there. Records of one line stay as they are; only the lines
    of longer records meet on (path, record).
    """
    lines = scan_lines(spark, path).drop("_size", "_octets")
    quotes = (F.length("value") - F.length(F.replace(F.col("value"), F.lit(quote), F.lit("")))).cast("long")
    lines = _numbered(lines).withColumn("_q", quotes)
    splits = split_sums(lines, {"q": F.sum("_q")}, by_path=True)
    upto = Window.partitionBy(_PATH, _BLOCK).orderBy(_ID).rowsBetween(Window.unboundedPreceding, 0)
    known = with_splits(lines, splits).withColumn("_after", F.col("_before_q") + F.sum("_q").over(upto))
    known = known.withColumn("_inside", F.pmod(F.col("_after") - F.col("_q"), F.lit(2)) == 1)
    begun = F.sum((~F.col("_inside")).cast("long")).over(upto)
    known = known.withColumn("_begun", begun).withColumn("_place", F.col(_ID) - F.col("_first"))
    # how many records begin in the splits ahead
    starts = split_sums(known.select(_PATH, _BLOCK, _ID, "_inside"),
                        {"r": F.sum((~F.col("_inside")).cast("long"))}, by_path=True).drop("_first")
    known = with_splits(known, starts).withColumn("record_no", F.col("_before_r") + F.col("_begun") - 1)
    alone = ~F.col("_inside") & (F.pmod("_after", F.lit(2)) == 0)
    short = known.where(alone).select(_PATH, "record_no", "value")
    parts = F.array_sort(F.collect_list(F.struct(_BLOCK, "_place", "value")))
    long = known.where(~alone).groupBy(_PATH, "record_no").agg(parts.alias("_p")).select(
        _PATH, "record_no", F.array_join(F.transform("_p", lambda p: p["value"]), "\n").alias("value"))
    return short.unionByName(long)
