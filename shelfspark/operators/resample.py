"""Images drawn anew: scaling, turning, straightening of a quadrilateral, and crops cut out along a polygon.

Images are arrays as in grid.py. Every new pixel is an expression over the old array, so that an image never leaves its row. A pixel's
centre lies at half a pixel; between centres values are bilinear, beyond the outer ones they are those of the border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import let, once
from . import grid, quads

WHITE = 255
#: EXIF orientations that are plain rotations; the loader leaves mirrored images as they are.
ROTATIONS = (3, 6, 8)


def _half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("int")


def bilinear(v: Column, w: Column, h: Column, sx: Column, sy: Column) -> Column:
    """The value at a place sx, sy of an array, as a whole number."""

    def mixed(p: Column) -> Column:
        hold = lambda c, n: F.greatest(F.lit(0), F.least(n - 1, c)).cast("int")
        value = lambda dx, dy: grid.at(v, hold(p["x"] + dx, w), hold(p["y"] + dy, h), w)
        row = lambda dy: value(0, dy) * (1 - p["fx"]) + value(1, dy) * p["fx"]
        return _half_up(row(0) * (1 - p["fy"]) + row(1) * p["fy"])

    corner = lambda q: F.struct(F.floor(q["x"]).alias("x"), F.floor(q["y"]).alias("y"), (q["x"] - F.floor(q["x"])).alias("fx"), (q["y"] - F.floor(q["y"])).alias("fy"))
    return let(F.struct((sx - 0.5).alias("x"), (sy - 0.5).alias("y")), lambda q: let(corner(q), mixed))


@grid.bound_once
def scaled(v: Column, w: Column, h: Column, to_w: Column, to_h: Column) -> Column:
    """The image drawn at to_w x to_h; itself if that is its size."""
    drawn = grid.each(to_w, to_h, lambda x, y: bilinear(v, w, h, (x + 0.5) * w / to_w, (y + 0.5) * h / to_h))
    return F.when((w == to_w) & (h == to_h), v).otherwise(drawn)


@grid.bound_once
def shrunk(v: Column, w: Column, h: Column, by: Column) -> Column:
    """Means of blocks of by x by pixels, rounded up from a half; the image is w / by x h / by then, one at least, rests left out."""
    block = lambda x, y: F.aggregate(F.sequence(F.lit(0), by * by - 1), F.lit(0), lambda a, i: a + F.coalesce(grid.at(v, F.least(w - 1, x * by + i % by), F.least(h - 1, y * by + grid.div(i, by)), w), F.lit(0)))
    least = lambda n: F.greatest(F.lit(1), grid.div(n, by))
    return F.when(by <= 1, v).otherwise(grid.each(least(w), least(h), lambda x, y: _half_up(block(x, y) / (by * by))))


def turned_size(w: Column, h: Column, orientation: Column) -> Column:
    """w and h of the image once it stands upright."""
    across = orientation.between(5, 8)
    return F.struct(F.when(across, h).otherwise(w).alias("w"), F.when(across, w).otherwise(h).alias("h"))


@grid.bound_once
def turned(v: Column, w: Column, h: Column, orientation: Column) -> Column:
    """The image upright, by its EXIF orientation 1 to 8; others, and null, leave it alone."""
    places = {2: (w, h, lambda x, y: (w - 1 - x, y)), 3: (w, h, lambda x, y: (w - 1 - x, h - 1 - y)), 4: (w, h, lambda x, y: (x, h - 1 - y)), 5: (h, w, lambda x, y: (y, x)), 6: (h, w, lambda x, y: (y, h - 1 - x)), 7: (h, w, lambda x, y: (w - 1 - y, h - 1 - x)), 8: (h, w, lambda x, y: (w - 1 - y, x))}
    out = F.when(F.lit(False), v)
    for code, (to_w, to_h, place) in places.items():
        out = out.when(orientation == code, grid.each(to_w, to_h, lambda x, y, place=place: grid.at(v, *place(x, y), w)))
    return out.otherwise(v)


def held_size(w: Column, h: Column, most: int, least: int = 1) -> Column:
    """w and h with the long side held at most, and no side under least."""
    scale = F.least(F.lit(1.0), most / F.greatest(w, h))
    return F.struct(*[F.greatest(F.lit(least), _half_up(n * scale)).alias(name) for n, name in ((w, "w"), (h, "h"))])


def redrawn(images: DataFrame, size: Column, value: Column) -> DataFrame:
    """images with a new value array and size (a struct of w and h), which are computed from the old ones, once an image."""
    out = once(images, _size=size, _v=value)
    return out.withColumns({"w": F.col("_size.w"), "h": F.col("_size.h"), "v": F.col("_v")}).drop("_size", "_v")


def loaded(images: DataFrame, most: int = 2048) -> DataFrame:
    """Images (w, h, v and orientation) as they are loaded: sampled down by a power of two, turned upright, held at most pixels a side."""
    w, h, code = F.col("w"), F.col("h"), F.when(F.col("orientation").isin(*ROTATIONS), F.col("orientation")).otherwise(1)
    by = once(images, _by=grid.sample_size(w, h, most))
    small = redrawn(by, F.struct(*[F.greatest(F.lit(1), grid.div(n, F.col("_by"))).alias(k) for n, k in ((w, "w"), (h, "h"))]), shrunk(F.col("v"), w, h, F.col("_by"))).drop("_by")
    upright = redrawn(small, turned_size(w, h, code), turned(F.col("v"), w, h, code))
    return fitted(upright, most)


def fitted(images: DataFrame, most: int, least: int = 1) -> DataFrame:
    """Images (w, h and v) with the long side held at most pixels and no side under least."""
    sized = once(images, _to=held_size(F.col("w"), F.col("h"), most, least))
    return redrawn(sized, F.col("_to"), scaled(F.col("v"), F.col("w"), F.col("h"), F.col("_to.w"), F.col("_to.h"))).drop("_to")


def for_recognition(images: DataFrame) -> DataFrame:
    """Images (w, h and v) at the size that recognition works on, see grid.fit_size."""
    sized = once(images, _to=grid.fit_size(F.col("w"), F.col("h")))
    return redrawn(sized, F.col("_to"), scaled(F.col("v"), F.col("w"), F.col("h"), F.col("_to.w"), F.col("_to.h"))).drop("_to")


def homography(q: Column) -> Column:
    """The projective map from the unit square to a quad: a struct a to h, so that x = (a u + b v + c) / (g u + h v + 1), y = (d u + e v + f) / ...

    The four pairs of points make eight linear equations, whose solution for a square is this. Null for a quad with three points in a line.
    """
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = quads._xy(q)
    ax, ay, bx, by, sx, sy = x1 - x2, y1 - y2, x3 - x2, y3 - y2, x0 - x1 + x2 - x3, y0 - y1 + y2 - y3

    def solved(d: Column) -> Column:
        g, h = (sx * by - sy * bx) / d, (ax * sy - ay * sx) / d
        at = {"a": x1 - x0 + g * x1, "b": x3 - x0 + h * x3, "c": x0, "d": y1 - y0 + g * y1, "e": y3 - y0 + h * y3, "f": y0, "g": g, "h": h}
        return F.struct(*[c.alias(k) for k, c in at.items()])

    p = quads._xy(q)
    twice = [(p[(i + 1) % 4][0] - p[i][0]) * (p[(i + 2) % 4][1] - p[i][1]) - (p[(i + 1) % 4][1] - p[i][1]) * (p[(i + 2) % 4][0] - p[i][0]) for i in range(4)]
    return F.when(F.least(*map(F.abs, twice)) > 1e-9, let(ax * by - ay * bx, solved))


def warped(images: DataFrame, quad: str = "quad", least: int = 64, most: int = 1600, outside: int = 0) -> DataFrame:
    """Images (w, h, v and a quad) with the quad's content straightened; null w, h and v where it is too small or no quad.

    Each new pixel's centre is mapped back into the old image and takes the bilinear value there; outside it is outside.
    """
    w, h = F.col("w"), F.col("h")
    sized = once(images, _m=homography(F.col(quad)), _to=quads.crop_size(F.col(quad), least, most))

    def place(m: Column, to: Column, x: Column, y: Column) -> Column:
        u, t = (x + 0.5) / to["w"], (y + 0.5) / to["h"]
        z = m["g"] * u + m["h"] * t + 1
        return F.struct(((m["a"] * u + m["b"] * t + m["c"]) / z).alias("x"), ((m["d"] * u + m["e"] * t + m["f"]) / z).alias("y"))

    def value(v: Column, p: Column) -> Column:
        within = (p["x"] >= 0) & (p["x"] <= w) & (p["y"] >= 0) & (p["y"] <= h)
        return F.when(within, bilinear(v, w, h, p["x"], p["y"])).otherwise(outside)

    # the map, the size and the old pixels are worked out once an image, whatever Spark does with the columns
    whole = F.struct(F.col("_m").alias("m"), F.col("_to").alias("to"), F.col("v").alias("v"))
    drawn = let(whole, lambda o: F.when(o["m"].isNotNull() & o["to"].isNotNull(), grid.each(o["to"]["w"], o["to"]["h"], lambda x, y: let(place(o["m"], o["to"], x, y), lambda p: value(o["v"], p)))))
    return redrawn(sized, F.when(F.col("_m").isNotNull(), F.col("_to")), drawn).drop("_m", "_to")


def spans(crossed: Column, y: Column) -> Column:
    """Stretches of a row that lie within a polygon, by its winding number: an array of (a, b), pixels a to b - 1 by their centres.

    crossed has the sides that pass the height y; their places, sorted, are walked through once.
    """
    place = lambda s: s["x1"] + (y - s["y1"]) * (s["x2"] - s["x1"]) / (s["y2"] - s["y1"])
    ends = F.array_sort(F.transform(crossed, lambda s: F.struct(place(s).alias("x"), F.when(s["y1"] <= y, 1).otherwise(-1).alias("turn"))))
    kind = "struct<wind:int,list:array<struct<a:double,b:double>>>"
    start = F.from_json(F.lit('{"wind":0,"list":[]}'), kind)

    def step(s: Column, e: Column) -> Column:
        opened = F.concat(s["list"], F.array(F.struct(e["x"].alias("a"), e["x"].alias("b"))))
        last = F.element_at(s["list"], -1)
        closed = F.concat(F.slice(s["list"], F.lit(1), F.size(s["list"]) - 1), F.array(F.struct(last["a"].alias("a"), e["x"].alias("b"))))
        now = s["wind"] + e["turn"]
        return F.struct(now.cast("int").alias("wind"), F.when(s["wind"] == 0, opened).when(now == 0, closed).otherwise(s["list"]).alias("list"))

    first = lambda c: F.ceil(c - 0.5).cast("int")  # noqa: E731  the first pixel whose centre is not left of c
    return F.aggregate(ends, start, step, lambda s: F.transform(s["list"], lambda p: F.struct(first(p["a"]).alias("a"), first(p["b"]).alias("b"))))


def lassoed(images: DataFrame, xs: str = "xs", ys: str = "ys", pad: int = 16) -> DataFrame:
    """Images (w, h, v and a polygon xs, ys) cut out along the polygon, on white with a margin; null w, h and v under 8 pixels a side.

    Rows are put together from whole runs of pixels between sorted crossings; the polygon is not asked for each pixel. Where it covers less than
    quads.lasso needs for a mask, the whole box is kept.
    """
    w = F.col("w")
    sized = once(images, _box=quads.lasso(w, F.col("h"), F.col(xs), F.col(ys), pad))
    white = lambda n: F.array_repeat(F.lit(WHITE), n.cast("int"))

    def pixels(o: Column) -> Column:
        box = o["box"]
        cut = lambda y, a, b: F.slice(o["v"], y * w + a + 1, b - a)
        clip = lambda s: F.struct(F.greatest(box["left"], F.least(box["right"], s["a"])).alias("a"), F.greatest(box["left"], F.least(box["right"], s["b"])).alias("b"))

        def filled(y: Column, runs: Column) -> Column:
            before = lambda i: F.when(i > 0, F.get(runs, i - 1)["b"]).otherwise(box["left"])
            parts = F.transform(runs, lambda s, i: F.concat(white(s["a"] - before(i)), cut(y, s["a"], s["b"])))
            return F.when(F.size(runs) > 0, F.concat(F.flatten(parts), white(box["right"] - F.get(runs, F.size(runs) - 1)["b"]))).otherwise(white(box["right"] - box["left"]))

        def line(y: Column) -> Column:
            masked = let(F.transform(spans(quads.crossing(o["sides"], y + 0.5), y + 0.5), clip), lambda runs: filled(y, runs))
            return F.concat(white(F.lit(pad)), F.when(box["masked"], masked).otherwise(cut(y, box["left"], box["right"])), white(F.lit(pad)))

        edge = white(box["out_w"] * pad)
        return F.when(box.isNotNull(), F.concat(edge, F.flatten(F.transform(F.sequence(box["top"], box["bottom"] - 1), line)), edge))

    # the box, the sides and the old pixels are worked out once an image, whatever Spark does with the columns
    whole = F.struct(F.col("_box").alias("box"), quads.sides(F.col(xs), F.col(ys)).alias("sides"), F.col("v").alias("v"))
    return redrawn(sized, F.struct(F.col("_box.out_w").alias("w"), F.col("_box.out_h").alias("h")), let(whole, pixels)).drop("_box")
