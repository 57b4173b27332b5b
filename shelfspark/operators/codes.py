"""The gate of barcodes seen in camera frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import identifiers
from ..functions.strings import trimmed

#: Characters that a raw value has at least.
LEAST = 3


def first_hits(seen: DataFrame, zone: Column, image: tuple[float, float], view: tuple[float, float]) -> DataFrame:
    """Of each frame the first code, in the order of id, whose trimmed value is long enough and whose centre lies in the zone.

    seen: frame, id, raw, cx, cy, rotation. zone: struct l, t, r, b in the view. image and view: width and height.
    """
    rows = seen.withColumn("raw", trimmed(F.col("raw")))
    hit = identifiers.in_zone(F.col("cx"), F.col("cy"), F.col("rotation"), *map(F.lit, (*image, *view)), zone)
    first = F.row_number().over(Window.partitionBy("frame").orderBy("id"))
    return rows.where((F.length("raw") >= LEAST) & hit).withColumn("_nth", first).where("_nth = 1").drop("_nth")
