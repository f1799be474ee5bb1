"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linecraft.session import ensure_checkpoint_dir

# Shuffle files go with the query that wrote them; by default they stay until the driver collects garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage: later stages re-read the files, so a lost executor costs at most the
    tasks it was running. What was shuffled for them is freed. The files stay until ``discard``
    or until the owner of the folder clears it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``materialise``, once no table still to be evaluated reads them."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z; every other character stays (``lower`` would change more)."""
    return F.translate(col, UPPER, LOWER)


def remainder(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``_k1``, ``_k2``: 128 hash bits of (id, text), the identity of a row.

    Rows equal in id and text share a key: they are copies of one document.
    """
    i, t = F.col(id_col), F.col(text_col)
    nulls = F.concat(i.isNull().cast("string"), t.isNull().cast("string"))
    return df.withColumn("_k1", F.xxhash64(i, nulls, t)).withColumn("_k2", F.xxhash64(t, F.lit(7), i))
