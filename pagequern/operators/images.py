"""Relational image selection: fetched sizes joined in, the best image of each page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def fill_sizes(images: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sizes of images without both dimensions come from a table url, width, height.

    images: page_id, pos, url, width, height; a size that is not in the table is -1 x -1.
    """
    got = sizes.groupBy("url").agg(F.max("width").alias("got_w"), F.max("height").alias("got_h"))
    x = images.join(got, "url", "left")
    missing = (F.coalesce("width", F.lit(0)) == 0) | (F.coalesce("height", F.lit(0)) == 0)
    return x.select(
        "page_id", "pos", "url", F.when(missing, F.coalesce("got_w", F.lit(-1))).otherwise(F.col("width")).alias("width"), F.when(missing, F.coalesce("got_h", F.lit(-1))).otherwise(F.col("height")).alias("height")
    )


def best_images(images: DataFrame) -> DataFrame:
    """(page_id, url) of the largest good image, ties to the first (K3, C20)."""
    good = images.where(T.good_image(F.col("url"), F.col("width"), F.col("height")))
    area = F.col("width").cast("long") * F.col("height")
    return good.groupBy("page_id").agg(F.max_by("url", F.struct(area.alias("a"), (-F.col("pos")).alias("p"))).alias("url"))


def label(url, width, height, good):
    """One line about an image, for logs."""
    return F.format_string("%s (%d x %d, %s)", url, width, height, F.when(good, "good").otherwise("not good"))
