"""Text sources and sinks: lines, dictionaries, label files, metadata CSV, corpus.

Tables are the scalable form: a text table (key, text) is split into lines with one
``posexplode`` per row and numbered with a prefix sum of per-row line counts (no global
window). Plain files are read by splits (``sources/splits.py``): one large file is read by many
tasks, and its lines and quoted records are numbered as a sequential reader would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecraft.functions import text as T
from linecraft.operators.ordering import global_index, prefix_sum
from linecraft.sources.splits import numbered_lines, quoted_records

METADATA_SCHEMA = "file_name string, text string"


def read_lines(src: DataFrame, key: str = "doc_id", text: str = "text",
               max_chars: int | None = None, carry=(), total: str | None = None) -> DataFrame:
    """A1: non-empty lines, numbered in (key, position) order.

    ``max_chars`` cuts them, as the reader of string files does; by default they are whole.

    Returns (line_no, key, carry..., text[, total]); ``total`` names an optional column with
    the number of lines, taken from the prefix sum's range totals (no count job).
    """
    carry = list(carry)
    lines = F.filter(T.split_lines(text), lambda x: F.length(x) > 0)
    per_row = src.select(key, *carry, lines.alias("_lines")) \
        .withColumn("_n", F.size("_lines").cast("long"))
    off = prefix_sum(per_row, [key], weight="_n", out="_off", total=total)
    tot = [total] if total else []
    out = off.select(key, *carry, "_off", *tot, F.posexplode("_lines").alias("_i", "_line")) \
        .select((F.col("_off") + F.col("_i")).alias("line_no"), key, *carry,
                (F.substring("_line", 1, max_chars) if max_chars else F.col("_line")).alias("text"), *tot)
    return out


def read_file_lines(spark: SparkSession, path: str, max_chars: int | None = 200) -> DataFrame:
    """A1 for files: (line_no, path, text) of the files under ``path``; no line at all is an error."""
    return numbered_lines(spark, path, max_chars)


def read_dict(spark: SparkSession, path: str, lang: str | None = None) -> DataFrame:
    """A2: non-empty lines of the word files under ``path`` -> (lang, word_no, word), numbered over all files."""
    return numbered_lines(spark, path).select(
        F.lit(lang).cast("string").alias("lang"), F.col("line_no").alias("word_no"), F.col("text").alias("word"))


def dict_from_words(df: DataFrame, col: str, lang: str | None = None) -> DataFrame:
    """A2 over a table: distinct whitespace words of ``col`` numbered in word order."""
    words = df.select(F.explode(T.tokenise(col)).alias("word")).distinct()
    return global_index(words, ["word"], "word_no").select(
        F.lit(lang).cast("string").alias("lang"), "word_no", "word")


def parse_labels(lines: DataFrame, col: str = "text") -> tuple[DataFrame, DataFrame]:
    """A4: skip blank lines, strip, split on the first space into (file_name, text).

    Returns (parsed, quarantine). Lines without a space go to quarantine (Q5) instead of
    reusing the previous row's values.
    """
    s = T.py_strip(col)
    with_s = lines.withColumn("_s", s).where(F.col("_s") != "")
    sp = F.instr("_s", " ")
    good = (with_s.where(sp > 0)
            .withColumn("file_name", F.expr("substring(_s, 1, instr(_s, ' ') - 1)"))
            .withColumn(col, F.expr("substring(_s, instr(_s, ' ') + 1)"))
            .drop("_s"))
    bad = with_s.where(sp == 0).withColumnRenamed("_s", "stripped")
    return good, bad


def label_lines(df: DataFrame, idx: str = "idx", text: str = "text", ext: str = "jpg",
                space_width: float = 1.0) -> DataFrame:
    """A5: `<i>.<ext> <label>` for every string, label without spaces when width is 0."""
    label = T.strip_spaces_if(F.col(text), space_width)
    return df.select(idx, F.concat(F.col(idx).cast("string"), F.lit(f".{ext} "), label).alias("line"))


def write_lines_in_order(df: DataFrame, path: str, order: str, col: str = "line") -> None:
    """Write one text line per row, files and lines in ``order`` (range partitioned)."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))
    (df.repartitionByRange(n, order).sortWithinPartitions(order)
       .select(col).write.mode("overwrite").text(path))


def write_labels(df: DataFrame, path: str, idx: str = "idx", text: str = "text",
                 ext: str = "jpg", space_width: float = 1.0) -> None:
    write_lines_in_order(label_lines(df, idx, text, ext, space_width), path, idx)


def write_metadata(df: DataFrame, path: str, order: str | None = None) -> None:
    """CSV with header file_name,text (quoted as csv.writer does)."""
    out = df.select("file_name", "text")
    if order:
        n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))
        out = df.repartitionByRange(n, order).sortWithinPartitions(order).select("file_name", "text")
    (out.write.mode("overwrite").option("header", True).option("quote", '"')
        .option("escape", '"').option("quoteAll", False).csv(path))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Read the CSV back with an explicit schema; labels may hold line feeds and quotes.

    Each file begins with the header. Records are cut by splits, so a large file is read by many
    tasks; a carriage return at the end of a record belongs to its line end.
    """
    rows = quoted_records(spark, path).where(F.col("record_no") > 0)
    record = F.regexp_replace("value", r"\r$", "")
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    return rows.where(record != "").select(F.from_csv(record, METADATA_SCHEMA, options).alias("r")).select("r.*")


def write_corpus(sentences: DataFrame, path: str, order: str = "chunk",
                 col: str = "sentence") -> None:
    """One sentence per line, no header, no index, in chunk order."""
    write_lines_in_order(sentences, path, order, col)
