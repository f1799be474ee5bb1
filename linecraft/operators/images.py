"""Image tables: brightness statistics (D8), the contrast filter (B15) and region crops (for J2).

An image is Spark's image struct (origin, height, width, nChannels, mode, data).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

from linecraft.functions import geometry as G

IMAGE = StructType([StructField("origin", StringType()), StructField("height", IntegerType()),
                    StructField("width", IntegerType()), StructField("nChannels", IntegerType()),
                    StructField("mode", IntegerType()), StructField("data", BinaryType())])

# The mode numbers of Spark's image schema for 8-bit channels.
MODES = {1: 0, 3: 16, 4: 24}


def to_struct(pixels: np.ndarray, origin: str = "") -> dict:
    """An image struct from a (height, width, channels) array."""
    height, width, channels = pixels.shape
    return {"origin": origin, "height": height, "width": width, "nChannels": channels,
            "mode": MODES[channels], "data": pixels.tobytes()}


def from_struct(image) -> np.ndarray:
    return np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])


def brightness_table(text_px: DataFrame, bg_px: DataFrame, image: str = "image_id",
                     fair: bool = False) -> DataFrame:
    """D8 on exploded pixel tables: text pixels (image, c0, c1, c2, mask_b) and background
    pixels (image, c0, c1, c2[, c3]). Returns (image, text_mean, bg_mean)."""
    t = text_px.where(F.col("mask_b") != 0)
    if fair:
        tm = t.groupBy(image).agg(((F.avg("c0") + F.avg("c1") + F.avg("c2")) / 3).alias("text_mean"))
    else:
        tm = t.groupBy(image).agg(((F.avg("c0") + F.avg("c1")) / 3).alias("text_mean"))
    chans = [c for c in ("c0", "c1", "c2", "c3") if c in bg_px.columns]
    bm = bg_px.groupBy(image).agg((sum(F.avg(c) for c in chans) / 3).alias("bg_mean"))
    return bm.join(tm, image, "left")


def contrast_filter(stats: DataFrame, min_diff: float = 15.0) -> DataFrame:
    """Keep rows whose |text_mean - bg_mean| >= min_diff; missing statistics drop the row."""
    return stats.where(F.abs(F.col("text_mean") - F.col("bg_mean")) >= min_diff)


def crop_regions(df: DataFrame, image: str = "image", points: str = "points", key: str = "image_id") -> DataFrame:
    """G12 for every region: one row per detected region with the slice of its rectangle.

    ``points`` is array<array<array<double>>> (regions x 4 corners x (x, y)); corners 0 and 2
    give the rectangle. Returns (key, box_no, x1, y1, x2, y2, crop).
    """
    ex = df.select(key, image, F.posexplode(points).alias("box_no", "_pts"))
    rect = G.region_rect(F.col("_pts"))
    ex = ex.select(key, image, "box_no", *[v.alias(k) for k, v in rect.items()])
    ints = [StructField(k, IntegerType()) for k in ("box_no", "x1", "y1", "x2", "y2")]
    schema = StructType([StructField(key, df.schema[key].dataType), *ints, StructField("crop", IMAGE)])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            corners = zip(b["x1"], b["y1"], b["x2"], b["y2"])
            b["crop"] = [to_struct(from_struct(im)[max(0, y1):max(0, y2), max(0, x1):max(0, x2)].copy())
                         for im, (x1, y1, x2, y2) in zip(b[image], corners)]
            yield b[schema.names]

    return ex.mapInPandas(cut, schema)
