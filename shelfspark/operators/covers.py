"""Cover detection: from gray images to the quadrilateral of a book's cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import once
from . import contours, grid, hough, quads, resample

LEAST_SCORE = 0.08
#: Longest side that is worked on, shortest side of an image that is looked at.
WORK_SIDE, LEAST_SIDE = 360, 16


def detect(images: DataFrame) -> DataFrame:
    """img_id, quad, score and method of each image (img_id, w, h, v), of any size: the best of voting, contour and side scan.

    Images are worked on with WORK_SIDE pixels a side at most and the quad is scaled back. The first method wins a tie; images of which
    none is good, or with a side under LEAST_SIDE, get the inset quad. An image never leaves its row, so nothing is shuffled.
    """
    seen = lambda c: F.when(F.least("w", "h") >= LEAST_SIDE, F.col(c)).alias(c)
    rows = images.select("img_id", F.col("w").alias("full_w"), F.col("h").alias("full_h"), *map(seen, ("w", "h", "v")))
    met = at_working_size(resample.fitted(rows, WORK_SIDE, LEAST_SIDE))
    full_w, full_h = F.col("full_w"), F.col("full_h")
    back = quads.scaled(F.col("quad"), full_w / F.col("w"), full_h / F.col("h"), full_w, full_h)
    return met.select("img_id", F.when(F.col("score") >= LEAST_SCORE, back).otherwise(quads.inset(full_w, full_h)).alias("quad"), "score", "method")


def at_working_size(images: DataFrame) -> DataFrame:
    """images (w, h, v and others) of WORK_SIDE pixels at most with quad, score and method (inset, if the score is too low) instead of v."""
    w, h = F.col("w"), F.col("h")
    found = hough.with_lines(contours.with_edges(grid.gradients(images)))
    rows = once(found, lines=hough.corners(F.col("lines"), w, h))
    tried = [F.struct(quads.score(F.col(n), F.col("mag"), w, h).alias("score"), F.lit(-i).alias("i"), F.lit(n).alias("method"), quads.clamped(F.col(n), w, h).alias("quad")) for i, n in enumerate(("lines", "contour", "sides"))]
    best = once(rows, _best=F.greatest(*tried)).drop("mag", "lines", "contour", "sides")
    good = F.col("_best.score") >= LEAST_SCORE
    return best.select("*", "_best.quad", "_best.score", F.when(good, F.col("_best.method")).otherwise("inset").alias("method")).drop("_best")
