"""License scans by a positional index of rare licence words; DataFrame functions only.

A template is a licence's label, its words and its mandatory key phrases (runs of those words).
Words of a file: A-Z folded, runs of letters, digits and non-ASCII characters.

1. Over all files, in how many does each word of the templates occur (one pass; a row per
   template word comes to the driver, a table bounded by the templates).
2. The index: for each template the ``ANCHORS`` words of highest IDF among its mandatory ones,
   with their positions in the template. Every mandatory word stands at a fixed distance from
   the others, so each of these words, found in a file, points at the place where the template
   would begin; the places of all anchors are intersected.
3. At each place left, every key phrase is compared word by word. A template's ``fit`` is the
   IDF share of all its words that stand at their places.

Every place of every template is found: a place that holds all key phrases holds all anchors.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linecraft.llm.common import lower_ascii

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANCHORS = 2


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def places(self) -> list[tuple[int, list[str]]]:
        """(first word, words) of every key phrase in the template."""
        out = []
        for phrase in self.phrases:
            p = phrase.split()
            out.append((next(k for k in range(len(self.words)) if self.words[k:k + len(p)] == p), p))
        return out


# Names and opening words of public licences.
BASE = tuple(Template(label, text, (text,)) for label, text in (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
))
OWN = tuple(Template(*x) for x in (
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "under the terms of the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the "
            "free software foundation", ("gnu general public license", "free software foundation")),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution",)),
    ("cc0", "creative commons zero v1 0 universal", ("creative commons zero",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files",
     ("permission is hereby granted free of charge", "obtaining a copy of this software")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met",
     ("redistribution and use in source and binary forms", "following conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted", ("permission to use copy modify and or distribute this software", "without fee")),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("free and unencumbered software", "public domain")),
))


def tokenise(df: DataFrame, text: str = "text", out: str = "_words") -> DataFrame:
    """Add the words of a text; a null text has none."""
    return df.withColumn(out, F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text), F.lit(""))),
                                                   F.lit(WORDS), 0))


def word_idf(words: DataFrame, templates) -> dict[str, float]:
    """IDF over all files of every template word."""
    vocabulary = sorted({w for t in templates for w in t.words})
    present = F.array_distinct(F.filter("_words", lambda w: w.isin(vocabulary)))
    rows = (words.select(F.explode(F.array_insert(present, 1, F.lit(""))).alias("w"))  # "": every file
            .groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect())  # at most a row per template word
    df = {r.w: r.n for r in rows}
    total = df.pop("", 0)
    return {w: math.log((total + 1) / (df.get(w, 0) + 0.5)) for w in vocabulary}


def _anchors(t: Template, idf: dict[str, float]) -> list[tuple[str, list[int]]]:
    """(word, its mandatory positions) of the mandatory words of highest IDF."""
    spots: dict[str, list[int]] = {}
    for at, phrase in t.places():
        for k, w in enumerate(phrase, at):
            spots.setdefault(w, []).append(k)
    rare = sorted(spots, key=lambda w: (-idf[w], w))[:ANCHORS]
    return [(w, sorted(set(spots[w]))) for w in rare]


def _index(templates, base: int, idf: dict[str, float]) -> Column:
    """The templates with their anchors as one literal array (constant, folded by Spark)."""
    def texts(words) -> str:
        return "array(" + ", ".join(f"'{w}'" for w in words) + ")"

    def entry(k: int, t: Template) -> str:
        total = sum(idf[w] for w in t.words) or 1.0
        share = ", ".join(f"{idf[w] / total!r}D" for w in t.words)
        anchors = ", ".join(f"named_struct('w', '{w}', 'at', array({', '.join(map(str, at))}))"
                            for w, at in _anchors(t, idf))
        phrases = ", ".join(f"named_struct('at', {at}, 'words', {texts(ph)})" for at, ph in t.places())
        return (f"named_struct('label', '{t.label}', 'base', {str(k < base).lower()}, 'words', {texts(t.words)}, "
                f"'share', array({share}), 'anchors', array({anchors}), 'phrases', array({phrases}))")

    if any(re.search(r"[\\']", t.label + t.text) for t in templates):
        raise ValueError("labels and words of templates hold no quotes or backslashes")
    return F.expr("array(" + ", ".join(entry(k, t) for k, t in enumerate(templates)) + ")")


def _starts(t: Column) -> Column:
    """Places of template ``t`` in a file, as the word numbers where it would begin."""
    def proposed(anchor: Column) -> Column:
        here = F.filter("_hits", lambda h: h["w"] == anchor["w"])
        return F.flatten(F.transform(anchor["at"], lambda p: F.transform(here, lambda h: h["i"] - p)))

    proposals = F.transform(t["anchors"], proposed)
    common = F.aggregate(proposals, F.get(proposals, F.lit(0)), lambda a, b: F.array_intersect(a, b))

    def stands(start: Column) -> Column:
        return F.forall(t["phrases"], lambda ph: (start + ph["at"] >= 0) & (
            F.slice("_words", F.greatest(start + ph["at"], F.lit(0)) + 1, F.size(ph["words"])) == ph["words"]))

    return F.filter(common, stands)


def _fit(t: Column, starts: Column) -> Column:
    """Largest IDF share of the template's words at their places, over all its starts."""
    def share(start: Column) -> Column:
        there = F.transform(t["words"], lambda w, k: F.when(
            F.get("_words", start + k) == w, F.get(t["share"], k)).otherwise(0.0))
        return F.aggregate(there, F.lit(0.0), lambda a, b: a + b)
    return F.array_max(F.transform(starts, share))


def scan(df: DataFrame, templates=BASE + OWN, base: int = len(BASE), text: str = "text") -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels and score to every row.

    The first ``base`` templates are counted by places (n_base, first and last start); all give
    labels. ``score`` is the best fit of any template found, 0 without one. Null and empty texts
    have no words and no labels. Rows may repeat; the text column is dropped.
    """
    words = tokenise(df, text)
    idf = word_idf(words, templates)
    anchors = sorted({w for t in templates for w, _ in _anchors(t, idf)})
    keep = [c for c in df.columns if c not in (
        text, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")]
    marked = F.transform("_words", lambda w, i: F.when(w.isin(anchors), F.struct(w.alias("w"), i.alias("i"))))
    rows = words.select(*keep, "_words", F.array_compact(marked).alias("_hits"))
    placed = F.transform(_index(templates, base, idf), lambda t: F.struct(t.alias("t"), _starts(t).alias("starts")))
    rows = rows.withColumn("_placed", F.filter(
        F.when(F.size("_hits") > 0, placed), lambda x: F.size(x["starts"]) > 0))
    found = F.coalesce(F.transform("_placed", lambda x: F.struct(
        x["t"]["label"].alias("label"), x["t"]["base"].alias("base"), x["starts"].alias("starts"),
        _fit(x["t"], x["starts"]).alias("fit"))), F.array())
    rows = rows.select(*keep, F.size("_words").cast("long").alias("n_words"), found.alias("_found"))
    rows = rows.withColumn("_base", F.filter("_found", lambda x: x["base"]))
    rows = rows.withColumn("_places", F.flatten("_base.starts"))

    def labels(column: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.col(f"{column}.label"))), ",")

    return rows.select(
        *keep, "n_words", F.size("_places").cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"),
        F.array_max("_places").cast("long").alias("last_word"),
        labels("_base").alias("base_labels"), labels("_found").alias("labels"),
        F.least(F.coalesce(F.array_max("_found.fit"), F.lit(0.0)), F.lit(1.0)).alias("score"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels and base places of every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
