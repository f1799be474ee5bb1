"""Filter interaction audit: what each of five document filters removes, in every order, per part.

The filters play a removal game. A coalition S of filters is worth v(S), the documents that fail at
least one filter of S. The Hart-Mas-Colell potential of the game is P(empty) = 0 and

    P(S) = (v(S) + sum over i in S of P(S without i)) / |S|

over all 32 coalitions, and the Shapley value of a filter is P(all) - P(all without it). Potentials
are kept as 60 P(S), which is whole for up to five filters, so nothing is rounded. What a step of an
order removes is v(S and i) - v(S), S being the filters before it.

The documents are read once. A row's five failures are one mask; parts and masks are counted by
Spark, and the game itself works on a row per part. Copies of a text are found by the SHA-256 of
the text: counts per (text, part, ...) are combined before any text's rows meet, so a text that a
third of all documents share is no hot group.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
ORDERS = len(list(permutations(FILTERS)))
# The least number that all coefficients of the potential of five filters divide.
WHOLE = 60
SYMBOLS = "#$%&*|"
STEP_COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text only."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 100, "B": F.lit(100) * distinct < F.lit(80) * n,
            "C": F.lit(100) * capitals > F.lit(10) * F.length(text),
            "D": F.length(F.translate(text, SYMBOLS, "")) < F.length(text)}


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the set of filters that they fail.

    Bit k of ``mask`` is filter k of ``FILTERS``. A null text is empty, a null language the part ''.
    A null id is neither smaller than another nor has it labels; of rows with one id and one text
    none is a copy of the other. An id with several labels is good (toxic) if one of them says so.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = own_failures(text)
    mask = sum((F.when(own[f], 1 << k).otherwise(0) for k, f in enumerate(FILTERS[:4])), F.lit(0))
    rows = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), mask.alias("own"),
                       F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"))
    rows = rows.groupBy("sha", "doc_id", "part", "own").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("label_id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    rows = rows.join(marks, F.col("doc_id") == F.col("label_id"), "left").fillna(0, ["good", "toxic"])
    # Rows of one text and kind: how many, the smallest id among them with its rows, rows without an id.
    with_id = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    kinds = rows.groupBy("sha", "part", "own", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(with_id).alias("first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"))
    smallest = F.min("first.doc_id").over(Window.partitionBy("sha"))  # at most four rows a part and text
    kinds = kinds.withColumn("smallest", smallest)
    originals = F.col("no_id") + F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    both = F.explode(F.array(F.struct(F.col("own").alias("mask"), originals.alias("n")),
                             F.struct((F.col("own") + (1 << 4)).alias("mask"), (F.col("n") - originals).alias("n"))))
    return (kinds.select("part", "good", "toxic", both.alias("m"))
            .groupBy("part", F.col("m.mask").alias("mask"))
            .agg(F.sum("m.n").alias("n"), F.sum(F.col("m.n") * F.col("good")).alias("good"),
                 F.sum(F.col("m.n") * F.col("toxic")).alias("toxic")))


def coalitions(size: int) -> list[int]:
    """The coalitions of ``size`` filters as masks."""
    return [sum(1 << k for k in c) for c in combinations(range(len(FILTERS)), size)]


def play(counts: DataFrame) -> DataFrame:
    """A row per part: ``total``, worths ``v``, ``good``, ``toxic`` and ``potential`` (60 P) by coalition.

    ``counts`` has (part, mask, n, good, toxic); each array has an entry for each of 32 coalitions.
    """
    def worth(c):
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(c)).otherwise(0)).cast("long")
                         for s in range(ALL + 1)])
    game = counts.groupBy("part").agg(F.sum("n").cast("long").alias("total"), worth("n").alias("v"),
                                      worth("good").alias("good"), worth("toxic").alias("toxic"))
    game = game.withColumn("p0", F.lit(0).cast("long"))
    for size in range(1, len(FILTERS) + 1):  # the potentials of one size need those one smaller
        for s in coalitions(size):
            smaller = " + ".join(f"p{s & ~(1 << k)}" for k in range(len(FILTERS)) if s >> k & 1)
            game = game.withColumn(f"p{s}", F.expr(f"({WHOLE} * v[{s}] + {smaller}) div {size}"))
    return game.select("part", "total", "v", "good", "toxic",
                       F.array(*[f"p{s}" for s in range(ALL + 1)]).alias("potential"))


def steps(game: DataFrame) -> DataFrame:
    """A row for each part, order and step, from coalition differences."""
    orders = F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])
    rows = (game.withColumn("filter_order", F.explode(orders))
            .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
            .withColumn("filter", F.expr("substring(filter_order, step, 1)"))
            .withColumn("ahead", F.expr("substring(filter_order, 1, step - 1)")))
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    before = sum((F.when(F.col("ahead").contains(f), b).otherwise(0) for f, b in bit.items()), F.lit(0))
    own = sum((F.when(F.col("filter") == f, b).otherwise(0) for f, b in bit.items()), F.lit(0))
    rows = rows.withColumn("own", own).withColumn("before", before).withColumn("after", F.col("before") + F.col("own"))

    def gain(c):
        return F.col(c)[F.col("after")] - F.col(c)[F.col("before")]
    others = F.lit(ALL) - F.col("own")
    marginal = F.col("potential")[ALL] - F.col("potential")[others]  # 60 times the Shapley value
    return rows.select(
        "part", "filter_order", "step", "filter", (F.col("total") - F.col("v")[F.col("after")]).alias("kept"),
        gain("v").alias("removed"), (F.col("v")[F.col("own")] - gain("v")).alias("redundant"),
        (F.col("v")[ALL] - F.col("v")[others]).alias("unique_fails"), gain("good").alias("good_lost"),
        gain("toxic").alias("toxic_lost"), (marginal * (ORDERS // WHOLE)).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, filter and counts) for every part of ``docs``; an empty table has no parts.

    Extra columns of either table are ignored, whatever their names; repeated rows each count.
    """
    return steps(play(failure_counts(docs, labels)))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of all 120 orders of the five filters over all documents, by language."""
    made = audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return made.select("part", "filter_order", F.col("step").cast("int").alias("step"), *STEP_COLUMNS)


# The same by replaying every order on the documents' failures.
OP13_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
cut AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM texts),
marked AS (SELECT doc_id, part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
    100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e,
    coalesce((SELECT bool_or(quality = 1) FROM labels l WHERE l.doc_id = cut.doc_id), false) AS good,
    coalesce((SELECT bool_or(toxic = 1) FROM labels l WHERE l.doc_id = cut.doc_id), false) AS toxic FROM cut),
masks AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
    count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM marked GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT p.f || q.f || r.f || s.f || u.f AS filter_order
    FROM letters p, letters q, letters r, letters s, letters u
    WHERE len(list_distinct([p.f, q.f, r.f, s.f, u.f])) = 5),
places AS (SELECT filter_order, step, (1 << (ascii(filter_order[step]) - 65)) AS own,
    contains(filter_order[:step - 1], 'A')::INT + 2 * contains(filter_order[:step - 1], 'B')::INT
    + 4 * contains(filter_order[:step - 1], 'C')::INT + 8 * contains(filter_order[:step - 1], 'D')::INT
    + 16 * contains(filter_order[:step - 1], 'E')::INT AS before
    FROM orders, (SELECT unnest(range(1, 6)) AS step)),
played AS (SELECT part, filter_order, step::INT AS step, own,
    sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM masks, places GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM played
"""
