"""F-plan: corpus lines -> recipe blocks -> fonts -> drawn parameters -> names.

One plan replaces the reference's eight sequential recipe processes. The only shuffle-free
joins are against bounded tables (8 recipes, the font list), broadcast after a size check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecraft.operators.render import render_plan
from linecraft.sources.textfiles import read_lines

# Font catalogue used with the fixture tables (a user normally lists a font folder).
FIXTURE_FONTS = tuple(f"fonts/ckb/face_{i}.ttf" for i in range(5))
FIXTURE_TEXT_COLOR = "#000000,#888888"


def fonts_table(spark: SparkSession, paths=FIXTURE_FONTS) -> DataFrame:
    return spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "font_no long, font string")


def plan_lines(spark: SparkSession, docs: DataFrame, fonts: DataFrame | None = None,
               seed: int = 42) -> DataFrame:
    lines = read_lines(docs, "doc_id", "text", 200, total="n_lines")
    fonts = fonts if fonts is not None else fonts_table(spark)
    plan = render_plan(lines, fonts, seed, text_color=FIXTURE_TEXT_COLOR)
    return plan.select(
        "line_no", "block", "index", "text", "font", "size", "background", "distortion",
        "distortion_orientation", "angle", "blur_radius",
        F.col("fill")[0].alias("fill_r"), F.col("fill")[1].alias("fill_g"),
        F.col("fill")[2].alias("fill_b"), "image_name")
