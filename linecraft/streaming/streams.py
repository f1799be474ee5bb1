"""Incremental behaviours as Structured Streaming queries (K1-K3).

K1: an endless sample source: the ``rate`` source's counter picks string and font by
    ``pmod(value, n)``, a pure function of the counter, so replays give the same samples.
K2: error-rate totals per group maintained as streaming aggregation state (sums only), so
    the rates at any point equal the batch rates over the pairs seen so far.
K3: files recognised as they arrive: a ``binaryFile`` stream and a per-micro-batch job.

``each_batch_once`` writes every micro-batch to a folder named by its number and overwrites it, so
a batch that is replayed after a lost executor, driver or commit leaves no second row; the state of
aggregations and the files already read come back from the checkpoint folder on a restart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType, TimestampType, StringType

from linecraft.operators.ordering import global_index, written
from linecraft.operators.metrics import with_error_counts
from linecraft.operators.predict import predict

BINARY_FILE_SCHEMA = StructType([StructField("path", StringType()),
                                 StructField("modificationTime", TimestampType()),
                                 StructField("length", LongType()),
                                 StructField("content", BinaryType())])


def _placed(table: DataFrame, key: str, out: str) -> DataFrame:
    """``table`` written once, its rows numbered 0.. in the order of ``key`` (as ``out`` in its place).

    A key that is that number already is taken as it is: then nothing but the key is shuffled.
    """
    kept = written(table, out, "zstd")
    if isinstance(kept.schema[key].dataType, (IntegerType, LongType)):
        lo, hi, n, distinct = kept.agg(F.min(key), F.max(key), F.count(F.lit(1)), F.count_distinct(key)).first()
        if lo == 0 and hi == n - 1 == distinct - 1:
            return kept.withColumn(key, F.col(key).cast("long")).withColumnRenamed(key, out)
    return written(global_index(kept, [key], out).drop(key), out, "zstd")


def _tables(strings: DataFrame, fonts: DataFrame, str_key: str, font_key: str):
    """Strings and fonts numbered 0.. in key order (``_sk``, ``_fk``) and written once, and their counts."""
    s, f = _placed(strings, str_key, "_sk"), _placed(fonts, font_key, "_fk")
    n, nf = s.count(), f.count()
    if n == 0 or nf == 0:
        raise ValueError("need at least one string and one font")
    return s, f, n, nf


def _by_join(counter: DataFrame, s: DataFrame, f: DataFrame, n: int, nf: int) -> DataFrame:
    numbered = counter.withColumn("_s", F.pmod("idx", F.lit(n))).withColumn("_f", F.pmod("idx", F.lit(nf)))
    return (numbered.join(s, numbered["_s"] == s["_sk"]).join(f, numbered["_f"] == f["_fk"])
            .drop("_s", "_f", "_sk", "_fk"))


def sample_counter(spark: SparkSession, rows_per_second: int = 100, rows_per_batch: int | None = None) -> DataFrame:
    """Endless (idx); with ``rows_per_batch`` every micro-batch holds that many, whatever the time."""
    source = spark.readStream.format("rate-micro-batch" if rows_per_batch else "rate")
    source = source.option("rowsPerBatch", rows_per_batch) if rows_per_batch else \
        source.option("rowsPerSecond", rows_per_second)
    return source.load().select(F.col("value").alias("idx"))


def stream_samples(spark: SparkSession, strings: DataFrame, fonts: DataFrame,
                   rows_per_second: int = 100, str_key: str = "line_no",
                   font_key: str = "font_no", rows_per_batch: int | None = None) -> DataFrame:
    """K1: endless (idx, text, font) stream; sample i takes string i mod n and font i mod f.

    With ``rows_per_batch`` every micro-batch holds that many samples, whatever the time.
    """
    return _by_join(sample_counter(spark, rows_per_second, rows_per_batch),
                    *_tables(strings, fonts, str_key, font_key))


def sample_job(strings: DataFrame, fonts: DataFrame, str_key: str = "line_no", font_key: str = "font_no"):
    """K1 by micro-batches: (job, number of strings); the job gives a batch of ``sample_counter`` its samples.

    A batch of consecutive numbers, as the rate sources make them, is known by its ends: every string
    finds its own numbers between them where it lies, so no string is shuffled. Any other batch is joined.
    """
    s, f, n, nf = _tables(strings, fonts, str_key, font_key)

    def job(batch: DataFrame) -> DataFrame:
        lo, hi, rows, distinct = batch.agg(
            F.min("idx"), F.max("idx"), F.count("idx"), F.count_distinct("idx")).first()
        if not rows or not hi - lo + 1 == rows == distinct:
            return _by_join(batch, s, f, n, nf)
        least = F.lit(lo) + F.pmod(F.col("_sk") - F.lit(lo), F.lit(n))
        own = s.withColumn("_least", least).where(F.col("_least") <= hi)
        own = own.withColumn("idx", F.explode(F.sequence("_least", F.lit(hi), F.lit(n)))).drop("_least", "_sk")
        # a few fonts, sent if they are small
        own = own.withColumn("_f", F.pmod("idx", F.lit(nf)))
        return own.join(f, own["_f"] == f["_fk"]).drop("_f", "_fk")

    return job, n


def stream_error_rates(pairs: DataFrame, by=("epoch",), ref: str = "ref", pred: str = "pred",
                       short: bool = False) -> DataFrame:
    """K2: running CER/WER per group over a stream of pairs (use update or complete mode).

    ``short`` promises pairs of a bounded few words, as for ``with_error_counts``.
    """
    counted = with_error_counts(pairs, ref, pred, short=short)
    agg = counted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum("ref_chars").alias("ref_chars"), F.sum("char_edits").alias("char_edits"),
        F.sum("ref_words").alias("ref_words"), F.sum("word_edits").alias("word_edits"))
    return (agg.withColumn("cer", F.when(F.col("ref_chars") > 0, F.col("char_edits") / F.col("ref_chars")))
            .withColumn("wer", F.when(F.col("ref_words") > 0, F.col("word_edits") / F.col("ref_words"))))


def files_per_batch(spark: SparkSession) -> int:
    """Files of a micro-batch that keep every core busy: a fixed few would leave cores idle and make the
    number of batches, each with its commit of all state, grow with the input on any cluster."""
    return 4 * spark.sparkContext.defaultParallelism


def stream_files(spark: SparkSession, path: str, glob: str | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """K3 source: image files as they are listed (path, modificationTime, length, content)."""
    r = spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def stream_predict(files: DataFrame, fn, schema, sink_path: str, checkpoint: str,
                   available_now: bool = True):
    """K3: recognise every file of the stream with ``fn`` (J1) and append results as Parquet.

    Returns the started query; the sink and the checkpoint folder make it restartable.
    """
    out = files.mapInPandas(fn, schema)
    w = out.writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def each_batch_once(stream: DataFrame, folder: str, checkpoint: str, output_mode: str = "append", trigger=None,
                    job=None):
    """Start ``stream``; every micro-batch (after ``job``, if given) becomes the folder ``batch=<number>``.

    A replayed batch overwrites its own folder. By default the run ends when all there is has been read;
    started again with the same folders it goes on from there.
    """
    def write(batch: DataFrame, number: int) -> None:
        (job(batch) if job else batch).write.mode("overwrite").parquet(
            f"{folder}/batch={number}", compression="zstd")

    w = stream.writeStream.foreachBatch(write).outputMode(output_mode).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def read_batches(spark: SparkSession, folder: str, schema) -> DataFrame:
    """(columns of ``schema``, batch) of all batches written so far; none gives no rows."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    spark.createDataFrame([], fields).write.mode("overwrite").parquet(f"{folder}/batch=-1")
    return spark.read.schema(StructType([*fields.fields, StructField("batch", LongType())])).parquet(folder)


def latest_by(batches: DataFrame, by) -> DataFrame:
    """Of every group the row of its last batch: what an updating aggregation holds now."""
    rest = [c for c in batches.columns if c not in (*by, "batch")]
    last = batches.groupBy(*by).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*by, "_last.*")


def stream_predict_once(files: DataFrame, fn, schema, folder: str, checkpoint: str):
    """K3 + J1: recognise every file of the stream with ``fn``, each batch's results kept once."""
    return each_batch_once(files, folder, checkpoint, job=lambda batch: predict(batch, fn, schema))
