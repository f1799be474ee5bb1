"""The render plan: recipes, fonts, drawn parameters and names for every line.

The reference runs eight recipe processes one after another, each re-reading the corpus
and skipping to its block. Here all blocks are one plan: the block of a line is
arithmetic on its number and its recipe comes from an 8-row broadcast table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecraft.functions import geometry as G
from linecraft.functions import text as T
from linecraft.functions.rng import randint, uniform
from linecraft.operators.generate import lookup_by_index

# The effective settings of the eight augmentation blocks. Distortion
# orientation 0 = vertical, 1 = horizontal, 2 = both, -1 = none: block 4 passes the flag
# without a value, so its cosine distortion touches neither axis.
RECIPE_COLUMNS = ("block", "background", "skew_angle", "random_skew", "blur", "random_blur",
                  "distortion", "distortion_orientation")
RECIPES = (
    (0, 1, 2, True, 1, True, 0, 0),
    (1, 1, 2, True, 1, True, 1, 2),
    (2, 1, 2, True, 1, True, 3, 2),
    (3, 2, 1, False, 0, True, 2, 2),
    (4, 3, 1, False, 0, True, 2, -1),
    (5, 0, 2, True, 1, True, 1, 2),
    (6, 0, 2, True, 1, True, 3, 2),
    (7, 0, 2, True, 1, True, 3, 2),
)
N_SETUPS = 7
RECIPE_SIZE = 64
RECIPE_NAME_FORMAT = 2


@dataclass(frozen=True)
class RenderDefaults:
    """Command-line defaults of the renderer."""
    size: int = 32
    extension: str = "jpg"
    skew_angle: int = 0
    random_skew: bool = False
    blur: int = 0
    random_blur: bool = False
    background: int = 0
    distortion: int = 0
    distortion_orientation: int = 0
    name_format: int = 0
    output_mask: int = 0
    output_boxes: int = 0
    width: int = -1
    alignment: int = 1
    orientation: int = 0
    text_color: str = "#282828"
    space_width: float = 1.0
    character_spacing: int = 0
    margins: tuple = (5, 5, 5, 5)
    fit: bool = False
    word_split: bool = True
    stroke_width: int = 0
    stroke_fill: str = "#282828"
    image_mode: str = "RGB"


def recipes_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(RECIPES),
        "block int, background int, skew_angle int, random_skew boolean, blur int, "
        "random_blur boolean, distortion int, distortion_orientation int")


def recipe_block(line_no, n_lines: int, setups: int = N_SETUPS):
    """Block of a line; n = L div 7, the remainder goes to block 7."""
    n = n_lines // setups
    if n == 0:
        return F.lit(setups)
    return F.least(F.floor(F.col(line_no) / n), F.lit(setups)).cast("int")


def assign_recipes(lines: DataFrame, line_no: str = "line_no", setups: int = N_SETUPS,
                   n_lines: str | None = None) -> DataFrame:
    """block and recipe of every line, plus its index inside the block.

    ``n_lines`` names a column holding the number of lines (e.g. from ``read_lines(total=)``);
    without it the lines are counted first.
    """
    if n_lines is None:
        L = lines.count()
        n = F.lit(L // setups)
    else:
        n = F.floor(F.col(n_lines) / setups)
    block = F.when(n == 0, F.lit(setups)).otherwise(
        F.least(F.floor(F.col(line_no) / F.greatest(n, F.lit(1))), F.lit(setups))).cast("int")
    out = lines.withColumn("block", block) \
        .withColumn("index", (F.col(line_no) - F.col("block") * n).cast("long"))
    return out.join(F.broadcast(recipes_table(lines.sparkSession)), "block")


def assign_font(df: DataFrame, fonts: DataFrame, seed: int = 42, key: str = "line_no",
                round_robin: bool = False, font_no: str = "font_no") -> DataFrame:
    """F5 (+C4): random font per string (CLI) or round robin (library)."""
    nf = fonts.count()
    if nf == 0:
        raise ValueError("no fonts")
    pick = F.pmod(F.col(key), F.lit(nf)) if round_robin else randint(0, nf - 1, seed, "font", F.col(key))
    return lookup_by_index(df.withColumn("_font_pick", pick), fonts, "_font_pick", font_no, nf) \
        .drop("_font_pick")


def draw_params(df: DataFrame, seed: int = 42, key: str = "line_no",
                text_color: str = "#282828", stroke_fill: str = "#282828") -> DataFrame:
    """angle, blur radius, fill and stroke colours drawn per sample."""
    k = F.col(key)
    angle = F.when(F.col("random_skew"),
                   randint(-F.col("skew_angle"), F.col("skew_angle"), seed, "angle", k)) \
        .otherwise(F.col("skew_angle")).cast("int")
    blur = F.when(F.col("random_blur"), uniform(seed, "blur", k) * F.col("blur")) \
        .otherwise(F.col("blur").cast("double"))
    fill = G.draw_colour(F.lit(text_color), seed, "fill", k)
    stroke = G.draw_colour(F.lit(stroke_fill), seed, "stroke", k)
    return (df.withColumn("angle", angle).withColumn("blur_radius", blur)
            .withColumn("fill", fill).withColumn("stroke", stroke))


def name_samples(df: DataFrame, text: str = "text", index: str = "index", name_format: int = 0,
                 extension: str = "jpg", space_width: float = 1.0,
                 assume_normalised: bool = False) -> DataFrame:
    """B14 (+B10, B13): file name of every sample and of its optional siblings."""
    base = T.sample_name(F.col(text), F.col(index), name_format, space_width,
                         assume_normalised=assume_normalised)
    out = df.withColumn("name", base).withColumn("image_name", F.concat("name", F.lit("." + extension)))
    for k, v in T.sibling_names(F.col("name")).items():
        out = out.withColumn(k, v)
    return out


def display_text(df: DataFrame, text: str = "text", rtl: bool = False, case: str | None = None) -> DataFrame:
    """Display string beside the untouched label."""
    d = F.col(text)
    if rtl:
        d = T.reverse_words(d)
    d = T.change_case(d, case)
    return df.withColumn("display_text", d)


def render_plan(lines: DataFrame, fonts: DataFrame, seed: int = 42, line_no: str = "line_no",
                text: str = "text", text_color: str = "#282828", extension: str = "jpg",
                assume_normalised: bool = True) -> DataFrame:
    """F-plan: every line with block, recipe, font, drawn parameters and names."""
    plan = assign_recipes(lines, line_no, n_lines="n_lines" if "n_lines" in lines.columns else None)
    plan = assign_font(plan, fonts, seed, line_no)
    plan = draw_params(plan, seed, line_no, text_color)
    plan = plan.withColumn("size", F.lit(RECIPE_SIZE))
    plan = name_samples(plan, text, "index", RECIPE_NAME_FORMAT, extension,
                        assume_normalised=assume_normalised)
    return plan
