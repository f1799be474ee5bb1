"""Binary files and structured sinks.

Files are listed with the ``binaryFile`` source; when only names and sizes are selected,
Spark does not read file contents. Hidden files (leading '.' or '_') are skipped by Spark's
file index.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecraft.operators.ordering import global_index, written

LAST_FOLDER_RE = r"([^/]+)/[^/]+$"
LAST_SEGMENT_RE = r"([^/]+)$"


def list_files(spark: SparkSession, root: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    r = spark.read.format("binaryFile")
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(root)


def read_folder_labelled(spark: SparkSession, root: str, with_content: bool = True) -> DataFrame:
    """(path, label, content): the label is the name of the file's parent folder."""
    files = list_files(spark, root)
    cols = [F.col("path"), F.regexp_extract("path", LAST_FOLDER_RE, 1).alias("label")]
    if with_content:
        cols.append(F.col("content"))
    return files.select(*cols)


def asset_catalog(spark: SparkSession, root: str, ext: str = ".ttf", kind: str = "font",
                  lang: str | None = None, fallback: str = "latin") -> DataFrame:
    """A10: (kind, asset_no, path) of the files with ``ext``, numbered in path order.

    With ``lang``, the ``root/<lang>`` folder is used when it holds files, else
    ``root/<fallback>``. Contents are not read.
    """
    files = list_files(spark, root, f"*{ext}").select("path")
    if lang is not None:
        folder = F.regexp_extract("path", LAST_FOLDER_RE, 1)
        mine = files.where(folder == lang)
        files = mine if mine.limit(1).count() else files.where(folder == fallback)
    return global_index(files, ["path"], "asset_no").select(F.lit(kind).alias("kind"), "asset_no", "path")


MAX_BROADCAST_PATHS = 1 << 20   # rows of a path and a label


def attach_images(labels: DataFrame, spark: SparkSession, root: str, key: str = "file_name") -> DataFrame:
    """Label rows joined with the bytes of their image files.

    A name with a folder is the path below ``root`` and meets that file alone; a bare name meets
    the files of that name in any folder. Labels meet the listing first, which reads no bytes. The
    files' bytes then meet the labels that were found where they are read: up to
    ``MAX_BROADCAST_PATHS`` labels (counted) are broadcast, so no byte is shuffled; more go through a
    shuffle by path.
    """
    top = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/")
    below = F.regexp_extract("path", rf"^.*?\Q{top}\E/+(.*)$", 1)
    listed = list_files(spark, root).select(
        F.regexp_extract("path", LAST_SEGMENT_RE, 1).alias("_last"), below.alias("_below"), "path")
    named = labels.withColumn("_last", F.regexp_extract(key, LAST_SEGMENT_RE, 1))
    met = named.join(listed, "_last").where(~F.contains(F.col(key), F.lit("/")) | (F.col(key) == F.col("_below")))
    met = written(met.select(*labels.columns, "path"), "matched")
    few = met.limit(MAX_BROADCAST_PATHS + 1).count() <= MAX_BROADCAST_PATHS
    content = list_files(spark, root).select("path", "content")
    return content.join(F.broadcast(met) if few else met, "path").select(*labels.columns, "path", "content")


def in_folder_order(df: DataFrame, partition_by: str) -> DataFrame:
    """Rows of each partition in the order in which ``write_samples`` writes its folders.

    Writing by folder sorts rows, unless they are in that order already. Put narrow rows through this
    before images or boxes are added, and only those are sorted. Null and the empty string share one
    folder; as a column that holds nulls would be mapped once more (and sorted again), both are "" here.
    """
    if dict(df.dtypes)[partition_by] == "string":
        df = df.withColumn(partition_by, F.coalesce(partition_by, F.lit("")))
    return df.sortWithinPartitions(partition_by)


def write_samples(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Image, optional mask and box columns as Parquet (no output path -> nothing saved).

    With ``partition_by`` a folder for each of its values; see ``in_folder_order`` for wide rows.
    """
    if not path:
        return
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The metric row(s) as JSON, e.g. {"wer": ..., "cer": ...}."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
