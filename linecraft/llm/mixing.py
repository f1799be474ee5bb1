"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Targets: a budget is shared by weight; a source whose share exceeds ``max_epochs`` times its
size is clamped there and the excess is shared anew by weight among the others, until none is
above. Only one row of sums reaches the driver in each round.

Sampling: a source with target t and size s repeats each document floor(t / s) times whole,
and gives the fractional rest by seeded order: documents in the order of a seeded hash take
one more repetition until the rest is used up; the one that crosses the line takes only its
first words. So the words taken meet the target to the word, and no document exceeds
``ceil(t / s)`` times its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linecraft.llm.common import WORD, materialise
from linecraft.operators.ordering import global_index

CYCLE = (3, 1, 2)
PARTS = 32
SLICES = 4096  # ranges of the seeded order that are summed before any document is ranked


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: float, max_epochs: int = 2) -> DataFrame:
    """Add ``target`` to (source, source_size, weight).

    Sizes and weights are whole numbers, so a level is one exact division and the order of
    the rows doesn't matter. If all sources are clamped the budget isn't reached; a source
    without words gets 0.
    """
    cap = F.col("source_size") * max_epochs
    used, level = 0, None
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        spent, weights, clamped = sources.agg(
            F.sum(F.when(over, cap).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))),
            F.sum(over.cast("int"))).first()
        if not weights or (level is not None and clamped == used):
            break
        used, level = clamped, (budget - spent) / weights
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    share = F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.when(share > cap, cap.cast("double")).otherwise(share))


def source_targets(sized: DataFrame, budget_share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """(source, source_size, weight, target): sources by code point, null last, weigh 3, 1, 2, ..."""
    sums = materialise(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "sources")
    ranked = global_index(sums, [F.col("source").isNull(), "source"], "_rank")
    weight = F.element_at(F.array(*map(F.lit, CYCLE)), (F.col("_rank") % len(CYCLE)).cast("int") + 1)
    ranked = materialise(ranked.withColumn("weight", weight.cast("long")).drop("_rank"), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    return water_fill(ranked, budget_share * total, max_epochs)


def seeded_order(seed: int, id_col: str = "doc_id") -> Column:
    """60 bits of a seeded hash of the id; a null id hashes as empty."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def take(sized: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """Add source_size, target and ``taken`` to (doc_id, source, size, _o).

    The seeded order is cut in ``SLICES`` ranges. Their sums per source say which range holds
    the end of the fractional repetition; only documents of that one range are ranked by a
    window, so a hot source is ranked in no task.
    """
    t = targets.select("source", "source_size", "target",
                       F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size")))
                       .otherwise(0).alias("_whole"))
    t = t.withColumn("_rest", (F.round("target") - F.col("_whole") * F.col("source_size")).cast("long"))
    rows = sized.withColumn("_slice", F.shiftright("_o", 48).cast("int"))
    slices = rows.groupBy("source", "_slice").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    edge = (slices.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
            .join(t.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
            .where((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_sum") >= F.col("_rest")))
            .select("source", F.col("_slice").alias("_edge"), (F.col("_rest") - F.col("_before")).alias("_need")))
    plan = (t.join(edge.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
            .drop("_s").withColumnRenamed("source", "_s"))
    # the plan is repeated for each part of the seeded order, so that a hot source meets it in many tasks
    spread = plan.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    joined = rows.join(spread, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") % PARTS == F.col("_p")))
    joined = materialise(joined.drop("_s", "_rest", "_p"), "mix")
    whole = F.col("_whole") * F.col("size")
    clear = joined.where(F.col("_edge").isNull() | (F.col("_slice") != F.col("_edge"))).withColumn(
        "taken", whole + F.when(F.col("_slice") < F.col("_edge"), F.col("size")).otherwise(0))
    inside = Window.partitionBy("source").orderBy("_o", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_need") - ahead))
    cut = joined.where(F.col("_slice") == F.col("_edge")).withColumn("taken", whole + part)
    out = clear.unionByName(cut)
    return out.withColumn("taken", F.col("taken").cast("long")).drop("_whole", "_slice", "_edge", "_need", "_o")


def mix(docs: DataFrame, seed: int = 17, budget_share: float = 1.5, max_epochs: int = 2,
        carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, carried columns, size, source_size, target, taken) for every row of ``docs``.

    ``taken`` counts words, repetitions included: taken // size whole repetitions, and the
    first taken % size words once more. Empty and null texts have size 0 and take nothing.
    Rows that repeat an id are taken independently, in order of their sizes.
    """
    sized = materialise(docs.select("doc_id", "source", *carry, _size(F.col("text")).alias("size"),
                                    seeded_order(seed).alias("_o")), "sized")
    return take(sized, source_targets(sized, budget_share, max_epochs), seed)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents: 150 % of all words, at most two repetitions of any source."""
    made = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


# The same in DuckDB. A source is clamped if its cap by weight lies under the water level; with
# sources in that order the level is found at the first that isn't clamped.
MIX_CTES = """
sized AS (SELECT {columns}, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS size,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS o FROM {table}),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3
    WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM sums),
level AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
    - coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS lv FROM weighed),
targets AS (SELECT source, source_size, CASE
    WHEN weight * (SELECT arg_min(lv, source_size / weight) FROM level WHERE weight * lv <= 2 * source_size) > 2 * source_size
    THEN (2 * source_size)::DOUBLE
    ELSE weight * (SELECT arg_min(lv, source_size / weight) FROM level WHERE weight * lv <= 2 * source_size) END AS target
    FROM weighed),
ordered AS (SELECT s.*, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(round(t.target) / t.source_size)::BIGINT ELSE 0 END AS whole,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.o, s.doc_id, s.size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
mixed AS (SELECT *, (whole * size + greatest(0, least(size, round(target) - whole * source_size - ahead)))::BIGINT
    AS taken FROM ordered)"""

OP5_SQL = f"""
WITH {MIX_CTES.format(columns='doc_id, source', table='documents')}
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target, taken FROM mixed
"""
