"""Running a user-supplied recogniser over image tables.

The model is the user's: ``fn(iterator of pandas.DataFrame) -> iterator of pandas.DataFrame``
run by ``mapInPandas``. :func:`per_worker` loads a model once per Python worker process and
reuses it for every batch and task that worker runs.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linecraft.operators.images import crop_regions
from linecraft.operators.metrics import join_regions

_CACHE: dict = {}
_LOCK = threading.Lock()


def per_worker(name: str, loader: Callable[[], object]):
    """The object built by ``loader`` once in this Python process (e.g. a model)."""
    if name not in _CACHE:
        with _LOCK:
            if name not in _CACHE:
                _CACHE[name] = loader()
    return _CACHE[name]


def predict(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
            schema: StructType | str) -> DataFrame:
    """The recogniser over every row, in Arrow batches, no shuffle."""
    return df.mapInPandas(fn, schema)


def recognise_regions(images: DataFrame, fn, key: str = "image_id", image: str = "image",
                      points: str = "points", text: str = "text") -> DataFrame:
    """Detect (given regions) -> crop -> recognise (J1) -> join texts by box.

    An image without regions has an empty text. ``fn`` receives batches with columns (key, box_no, crop) and must return (key, box_no, text).
    """
    crops = crop_regions(images, image, points, key)
    schema = f"{key} {images.schema[key].dataType.simpleString()}, box_no int, {text} string"
    texts = predict(crops.select(key, "box_no", "crop"), fn, schema)
    joined = join_regions(texts, key, "box_no", text, text)
    return images.select(key).distinct().join(joined, key, "left").withColumn(text, F.coalesce(text, F.lit("")))
