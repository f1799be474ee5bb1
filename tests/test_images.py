"""Brightness statistics, the contrast filter and region crops on small frames."""

import numpy as np
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from linecraft.operators import images as IM


def test_pixel_table_brightness_and_filter(spark):
    t = spark.createDataFrame([(1, 30, 60, 90, 1), (1, 0, 0, 0, 0), (2, 100, 100, 100, 1)],
                              "image_id int, c0 int, c1 int, c2 int, mask_b int")
    b = spark.createDataFrame([(1, 90, 90, 90), (2, 100, 100, 100), (3, 1, 1, 1)], "image_id int, c0 int, c1 int, c2 int")
    st = {r.image_id: (r.text_mean, r.bg_mean) for r in IM.brightness_table(t, b).collect()}
    assert st[1] == (30.0, 90.0) and st[3][0] is None
    kept = sorted(r.image_id for r in IM.contrast_filter(IM.brightness_table(t, b)).collect())
    assert kept == [1, 2]  # image 2: (100 + 100) / 3 against 300 / 3 (Q3); image 3 has no text
    fair = sorted(r.image_id for r in IM.contrast_filter(IM.brightness_table(t, b, fair=True)).collect())
    assert fair == [1]


def test_contrast_threshold(spark):
    df = spark.createDataFrame([(1, 114.9, 100.0), (2, 115.0, 100.0), (3, 84.9, 100.0), (4, None, 100.0)],
                               "image_id int, text_mean double, bg_mean double")
    assert sorted(r.image_id for r in IM.contrast_filter(df).collect()) == [2, 3]


def test_crop_regions(spark):
    pixels = np.arange(10 * 12 * 3, dtype=np.uint8).reshape(10, 12, 3)
    pts = [[[1.0, 2.0], [5.0, 2.0], [5.9, 6.2], [1.0, 6.0]], [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]]
    schema = StructType([StructField("image_id", LongType()), StructField("image", IM.IMAGE),
                         StructField("points", ArrayType(ArrayType(ArrayType(DoubleType()))))])
    df = spark.createDataFrame([(7, IM.to_struct(pixels), pts)], schema)
    crops = {r.box_no: r for r in IM.crop_regions(df).collect()}
    assert (crops[0].x1, crops[0].y1, crops[0].x2, crops[0].y2) == (1, 2, 5, 6)
    assert (IM.from_struct(crops[0].crop) == pixels[2:6, 1:5]).all()
