"""Point clouds: flattening, masks by confidence, colours as bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_CONFIDENCE = 1.5


def flatten_rows(nested: Column, depth: int) -> Column:
    """Rows of the last axis of a nested array of ``depth`` dimensions, as an array of arrays."""
    if depth == 1:
        return F.array(nested)
    for _ in range(depth - 2):
        nested = F.flatten(nested)
    return nested


def confident(points: DataFrame, threshold: float = MIN_CONFIDENCE) -> DataFrame:
    """Points with a confidence above the threshold and finite coordinates."""
    s = F.col("x") + F.col("y") + F.col("z")
    return points.filter((F.col("conf") > threshold) & ~F.isnan("conf") & ~F.isnan(s) & (F.abs(s) < float("inf")))


def pair_rows(points: DataFrame, colors: DataFrame) -> DataFrame:
    """Points and colours at the same position of a cloud (cloud_id, pos, …): the longer list is cut."""
    return points.join(colors, ["cloud_id", "pos"])


def colors_to_bytes(points: DataFrame, cloud: str = "job_id") -> DataFrame:
    """Colours (r, g, b) of each cloud as bytes: scaled from 0 to 1 if no channel of the cloud is above 1, else cut off."""
    top = F.max(F.greatest(*[F.nanvl(F.col(c), F.lit(float("-inf"))) for c in "rgb"])).alias("__top")
    met = points.join(points.groupBy(cloud).agg(top), cloud)

    def byte(c: str) -> Column:
        scaled, cut = F.rint(F.col(c) * 255.0), F.col(c)
        value = F.when(F.col("__top") <= 1.0, scaled).otherwise(F.floor(cut))
        return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.nanvl(value.cast("double"), F.lit(0.0)))).cast("int")

    return met.select(*[byte(c).alias(c) if c in "rgb" and len(c) == 1 else F.col(f"`{c}`") for c in points.columns])
