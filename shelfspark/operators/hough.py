"""Straight lines by voting: edge pixels vote for the lines through them, and four lines make a quadrilateral.

with_lines() counts the votes of an image within its row, so that nothing is shuffled or broadcast. votes() has them as rows, an aggregate
over (image, theta, rho) with partial sums, of which peaks() takes the same lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.strings import let
from . import grid

THETAS = 180


def votes(edges: DataFrame) -> DataFrame:
    """img_id, theta, rho, votes. edges: img_id, w, h, x, y, mag of edge pixels; the border and magnitudes under 20 do not vote."""
    inner = (F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < F.col("w") - 1) & (F.col("y") < F.col("h") - 1) & (F.col("mag") >= 20)
    lines = edges.where(inner).select("img_id", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(THETAS - 1))).alias("theta"))
    a = F.radians(F.col("theta").cast("double"))
    rho = F.floor(F.col("x") * F.cos(a) + F.col("y") * F.sin(a) + 0.5).cast("int")
    return lines.groupBy("img_id", "theta", rho.alias("rho")).agg(F.count(F.lit(1)).cast("int").alias("votes"))


def peaks(counts: DataFrame, sizes: DataFrame, most: int = 24) -> DataFrame:
    """The lines with the most votes: at least 18 and 0.22 of the maximum, and none stronger within two steps; theta wraps around.

    sizes: img_id, w, h, for the range of rho.
    """
    reach = F.ceil(F.sqrt((F.col("w") * F.col("w") + F.col("h") * F.col("h")).cast("double"))).cast("int")
    limit = F.greatest(F.lit(18), F.floor(0.22 * F.greatest(F.max("votes").over(Window.partitionBy("img_id")), F.lit(1))).cast("int"))
    strong = counts.withColumn("limit", limit).where("votes >= limit").join(sizes.select("img_id", reach.alias("reach")), "img_id")
    strong = strong.where((F.col("rho") > -F.col("reach")) & (F.col("rho") < F.col("reach")))
    steps = [F.struct(F.lit(dt).alias("dt"), F.lit(dr).alias("dr")) for dt in range(-2, 3) for dr in range(-2, 3) if dt or dr]
    near = strong.select("img_id", "theta", "rho", "votes", F.explode(F.array(*steps)).alias("s"))
    near = near.select("img_id", "theta", "rho", "votes", F.pmod(F.col("theta") + F.col("s.dt"), F.lit(THETAS)).alias("t2"), (F.col("rho") + F.col("s.dr")).alias("r2"))
    other = counts.select("img_id", F.col("theta").alias("t2"), F.col("rho").alias("r2"), F.col("votes").alias("v2"))
    beaten = near.join(other, ["img_id", "t2", "r2"]).where("v2 > votes").select("img_id", "theta", "rho").distinct()
    kept = strong.join(beaten, ["img_id", "theta", "rho"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("img_id").orderBy(F.col("votes").desc(), "theta", "rho"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= most).select("img_id", "theta", "rho", "votes", "rank")


def searcher(most: int):
    """A search for the lines of an image, strongest first, as thetas, rhos and votes, by its edges and magnitudes (rows, columns)."""
    import math

    import numpy as np

    turns = [math.radians(t) for t in range(THETAS)]
    cos, sin, steps = np.array([*map(math.cos, turns)]), np.array([*map(math.sin, turns)]), np.arange(THETAS)

    def search(edges, mag):
        h, w = edges.shape
        y, x = np.nonzero(edges & (mag >= 20))
        inner = (x > 0) & (y > 0) & (x < w - 1) & (y < h - 1)
        x, y = x[inner], y[inner]
        reach = math.ceil(math.sqrt(w * w + h * h))
        far, wide = reach + 3, 2 * reach + 7  # three columns more a side than there are distances
        rho = x[:, None] * cos
        rho += y[:, None] * sin
        rho += 0.5
        at = np.floor(rho, out=rho).astype("i8")
        at += steps * wide + far
        count = np.bincount(at.ravel(), minlength=THETAS * wide)
        theta, at = np.divmod(np.nonzero(count >= max(18, math.floor(0.22 * max(count.max(), 1))))[0], wide)
        count = count.reshape(THETAS, wide)
        theta, at = theta[np.abs(at - far) < reach], at[np.abs(at - far) < reach]
        near = np.max([count[(theta + dt) % THETAS, at + dr] for dt in range(-2, 3) for dr in range(-2, 3)], axis=0)
        kept = near <= count[theta, at]
        theta, at = theta[kept], at[kept]
        first = np.lexsort((at, theta, -count[theta, at]))[:most]
        return theta[first], at[first] - far, count[theta[first], at[first]]

    return search


def with_lines(images: DataFrame, most: int = 24, drop: tuple[str, ...] = ("edges",)) -> DataFrame:
    """images (w, h, edges, mag and others) with lines, an array of the theta, rho and votes of peaks() of votes(), strongest first; without the columns of drop."""

    def find(batch):
        import numpy as np
        import pyarrow as pa

        search, lines = searcher(most), [(np.zeros(0, int),) * 3] * batch.num_rows
        for at, edges, mag in grid.alike(*map(batch.column, ("w", "h", "edges", "mag"))):
            for i, e, m in zip(at, edges, mag, strict=True):
                lines[i] = search(e, m)
        parts = [pa.array(np.concatenate([f[k] for f in lines]).astype("i4")) for k in range(3)]
        ends = np.cumsum([0, *(len(f[0]) for f in lines)])
        return [pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.StructArray.from_arrays(parts, ["theta", "rho", "votes"]))]

    return grid.found(images, "lines array<struct<theta:int,rho:int,votes:int>>", find, drop)


def strongest(images: DataFrame, most: int = 24) -> DataFrame:
    """peaks() of votes() of images given as img_id, w, h, edges (array of booleans) and mag (array of magnitudes)."""
    rows = images.selectExpr("cast(img_id as long) as img_id", "cast(w as int) as w", "cast(h as int) as h", "edges", "mag")
    each = with_lines(rows, most, ("w", "h", "edges", "mag")).select("img_id", F.posexplode("lines").alias("i", "line"))
    return each.select("img_id", "line.*", (F.col("i") + 1).alias("rank"))


def _cross(a: Column, b: Column) -> Column:
    """x and y where two lines meet; null if they are parallel."""
    r = lambda n: F.radians(n["theta"].cast("double"))
    det = F.cos(r(a)) * F.sin(r(b)) - F.cos(r(b)) * F.sin(r(a))
    x = (a["rho"] * F.sin(r(b)) - b["rho"] * F.sin(r(a))) / det
    y = (F.cos(r(a)) * b["rho"] - F.cos(r(b)) * a["rho"]) / det
    return F.when(F.abs(det) >= 1e-6, F.array(x, y))


def corners(lines: Column, w: Column, h: Column) -> Column:
    """The quad of the widest pair of upright and of level lines among the eight strongest of each; null without. lines: theta and rho, strongest first."""
    a = lambda n: F.radians(n["theta"].cast("double"))
    left = lambda n: F.when(F.abs(F.cos(a(n))) < 1e-6, 0.0).otherwise((n["rho"] - h / 2 * F.sin(a(n))) / F.cos(a(n)))
    top = lambda n: F.when(F.abs(F.sin(a(n))) < 1e-6, 0.0).otherwise((n["rho"] - w / 2 * F.cos(a(n))) / F.sin(a(n)))

    def widest(kind, size: Column, place) -> Column:
        """one and two, by their places; of pairs as wide the weakest."""
        pair = lambda one, k, two, k2: F.struct(F.abs(one["rho"] - two["rho"]).alias("gap"), k.alias("k"), k2.alias("k2"), one.alias("one"), two.alias("two"))
        pairs = lambda some: F.flatten(F.transform(some, lambda one, k: F.transform(F.slice(some, F.lit(1), k), lambda two, k2: pair(one, k, two, k2))))
        put = lambda p: F.when(place(p["one"]) <= place(p["two"]), F.struct(p["one"].alias("one"), p["two"].alias("two"))).otherwise(F.struct(p["two"].alias("one"), p["one"].alias("two")))
        best = F.array_max(let(F.slice(F.filter(lines, kind), 1, 8), pairs))  # of at most 28 pairs of 8 lines
        return let(best, lambda p: F.when(p["gap"] >= 0.18 * size, put(p)))

    upright = widest(lambda n: (n["theta"] < 35) | (n["theta"] > 145), w, left)
    level = widest(lambda n: (n["theta"] > 55) & (n["theta"] < 125), h, top)
    meet = lambda p: F.concat(_cross(p["h"]["one"], p["v"]["one"]), _cross(p["h"]["one"], p["v"]["two"]), _cross(p["h"]["two"], p["v"]["two"]), _cross(p["h"]["two"], p["v"]["one"]))
    return let(F.struct(upright.alias("v"), level.alias("h")), meet)


def quads(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """img_id and quad, the corners() of lines given as rows (img_id, theta, rho, rank)."""
    ranked = lines.groupBy("img_id").agg(F.array_sort(F.collect_list(F.struct("rank", "theta", "rho"))).alias("lines")).join(sizes, "img_id")
    return ranked.select("img_id", corners(F.col("lines"), F.col("w"), F.col("h")).alias("quad")).where("quad is not null")
