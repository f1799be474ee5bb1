"""Merged, renumbered and split label set (C1 -> E2/G7 -> A6 -> E7/E8 -> D11/C6/G5).

The reference copies every existing image into one folder with a running 8-digit name
and writes file_name,text rows; here "the file exists" is a semi join and the running
counter is the distributed index of the kept rows in their original order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from linecraft.operators.labels import keep_existing, renumber
from linecraft.operators.ordering import prefix_split, seeded_split
from linecraft.sources.textfiles import read_lines


def merged_labels(docs: DataFrame, existing: DataFrame) -> DataFrame:
    """Lines whose document has an entry in ``existing``, renumbered in line order.

    Returns (idx, file_name, text, line_no, doc_id).
    """
    lines = read_lines(docs, "doc_id", "text", total="n_lines")
    kept = keep_existing(lines, existing, key="doc_id")
    return renumber(kept, ["line_no"], "jpg").drop("n_lines")


def split_labels(meta: DataFrame, test_split: float = 0.05, seed: int = 42,
                 seeded: bool = True) -> DataFrame:
    """E8 (default, exact seeded split) or E7 (prefix split in listing order)."""
    if seeded:
        return seeded_split(meta, "idx", test_split, seed)
    return prefix_split(meta, ["idx"], test_split)
