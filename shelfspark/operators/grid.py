"""Images as arrays: one row an image with width w, height h and row-major arrays of w * h whole numbers.

Point, stencil and projection operators are expressions over the arrays, so that an image never leaves its row and nothing
is shuffled. All divisions of whole numbers drop the fraction. pixels() and images() change to and from one row a pixel.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.strings import let

KERNEL = (1, 4, 6, 4, 1)


def div(a: Column, b) -> Column:
    """a / b without the fraction, for numbers that are not negative."""
    return F.floor(a / b).cast("int")


def images(pixels: DataFrame, key: str = "img_id", value: str = "v") -> DataFrame:
    """key, w, h and the value array of images given as (key, x, y, value)."""
    out = pixels.groupBy(key).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.array_sort(F.collect_list(F.struct("y", "x", value))).alias("p"))
    return out.select(key, "w", "h", F.transform("p", lambda p: p[value]).alias(value))


def pixels(image: DataFrame, key: str = "img_id", value: str = "v") -> DataFrame:
    """One row a pixel: key, x, y and value."""
    out = image.select(key, "w", F.posexplode(value).alias("i", value))
    return out.select(key, (F.col("i") % F.col("w")).alias("x"), div(F.col("i"), F.col("w")).alias("y"), value)


def bound_once(f):
    """Make f's first argument, an array, a value that is computed once however often f uses it."""

    @functools.wraps(f)
    def call(array: Column, *rest, **more) -> Column:
        return let(array, lambda a: f(a, *rest, **more))

    return call


def each(w: Column, h: Column, body) -> Column:
    """Array of body(x, y) over all pixels; empty for an image without any, where a sequence to -1 would go down."""
    return F.transform(F.slice(F.sequence(F.lit(0), w * h), F.lit(1), w * h), lambda i: body(i % w, div(i, w)))


def inner(x: Column, y: Column, w: Column, h: Column) -> Column:
    return (x > 0) & (y > 0) & (x < w - 1) & (y < h - 1)


def at(v: Column, x: Column, y: Column, w: Column) -> Column:
    return F.get(v, y * w + x)


def luma(r: Column, g: Column, b: Column) -> Column:
    return div(r * 30 + g * 59 + b * 11, 100)


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luma array of channel arrays; also stands for the platform's desaturation, whose weights are its own."""
    return F.transform(F.arrays_zip(r.alias("r"), g.alias("g"), b.alias("b")), lambda p: luma(p["r"], p["g"], p["b"]))


def invert(v: Column) -> Column:
    return F.transform(v, lambda p: 255 - p)


def stretch(v: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """(v - low) * 255 / (high - low), by default from the least to the largest value; not clipped."""
    low, high = F.array_min(v) if low is None else low, F.array_max(v) if high is None else high
    scaled = lambda p, b: ((p - b["l"]) * 255 / F.greatest(b["h"] - b["l"], F.lit(1))).cast("int")
    return let(F.struct(low.alias("l"), high.alias("h")), lambda b: F.transform(v, lambda p: scaled(p, b)))


def _zip(r: Column, g: Column, b: Column, body) -> Column:
    return F.transform(F.arrays_zip(r.alias("r"), g.alias("g"), b.alias("b")), lambda p: body(p["r"], p["g"], p["b"]))


def min_channel(r: Column, g: Column, b: Column) -> Column:
    return stretch(_zip(r, g, b, F.least))


def chroma_as_dark(r: Column, g: Column, b: Column) -> Column:
    return stretch(_zip(r, g, b, lambda *c: 255 - (F.greatest(*c) - F.least(*c))))


def inverted_max(r: Column, g: Column, b: Column) -> Column:
    return stretch(_zip(r, g, b, lambda *c: 255 - F.greatest(*c)))


@bound_once
def percentile(v: Column, fraction: float) -> Column:
    """The least value of 0 to 255 that a share of pixels (one at least) does not exceed; null for an empty array.

    Found by halving the range of values, so that pixels are counted eight times and never sorted.
    """
    target = F.greatest(F.lit(1), F.floor(F.size(v) * fraction + 0.5).cast("int"))
    few = lambda below: F.size(F.filter(v, lambda p: p < below)) < target
    halves = F.array(*[F.lit(1 << k) for k in range(7, -1, -1)])
    return F.when(F.size(v) > 0, F.aggregate(halves, F.lit(0), lambda low, half: F.when(few(low + half), low + half).otherwise(low)))


@bound_once
def mostly_dark(v: Column, w: Column, h: Column) -> Column:
    """Whether a luma array is dark on a sampled grid without the border."""
    ix, iy, sx, sy = div(w, 12), div(h, 12), F.greatest(F.lit(1), div(w, 48)), F.greatest(F.lit(1), div(h, 48))
    on = lambda x, y: (x >= ix) & (x < w - ix) & (y >= iy) & (y < h - iy) & ((x - ix) % sx == 0) & ((y - iy) % sy == 0)
    seen = F.filter(v, lambda p, i: on(i % w, div(i, w)))

    def judge(s: Column) -> Column:
        n, dark, bright = F.size(s), F.size(F.filter(s, lambda p: p <= 80)), F.size(F.filter(s, lambda p: p >= 150))
        total = F.aggregate(s, F.lit(0), lambda a, p: a + p)
        return (n > 0) & ((dark * 5 >= n * 2) | ((dark > bright) & (div(total, F.greatest(n, F.lit(1))) < 120)))

    return let(seen, judge)


def dark_on_light(r: Column, g: Column, b: Column, w: Column, h: Column) -> Column:
    """Gray array with dark text: the inverted largest channel of a dark image, else luma."""
    return F.when(mostly_dark(gray(r, g, b), w, h), inverted_max(r, g, b)).otherwise(gray(r, g, b))


def enhance(r: Column, g: Column, b: Column, w: Column, h: Column) -> Column:
    """Gray array with dark text, stretched from its 2nd to its 98th percentile, or fully if these are close. Not clipped."""
    base = F.when(mostly_dark(gray(r, g, b), w, h), _zip(r, g, b, lambda *c: 255 - F.greatest(*c))).otherwise(gray(r, g, b))

    def spread(v: Column) -> Column:
        low, high = percentile(v, 0.02), percentile(v, 0.98)
        near = high - low < 24
        return stretch(v, F.when(near, F.array_min(v)).otherwise(low), F.when(near, F.array_max(v)).otherwise(high))

    return let(base, spread)


def is_ink(r: Column, g: Column, b: Column, dark: Column) -> Column:
    """Whether a pixel is text: bright or coloured on a dark ground, dark on a light one."""
    y, top, low = luma(r, g, b), F.greatest(r, g, b), F.least(r, g, b)
    return F.when(dark, (y >= 155) | ((top >= 165) & (top - low >= 28))).otherwise(y <= 92)


@bound_once
def row_projection(ink: Column, w: Column, h: Column) -> Column:
    """Ink pixels of each row; ink is an array of 0 and 1."""
    return F.transform(F.sequence(F.lit(0), h - 1), lambda y: F.aggregate(F.slice(ink, y * w + 1, w), F.lit(0), lambda a, p: a + p))


@bound_once
def smooth3(p: Column) -> Column:
    """Mean of each value and its neighbours, as many as there are, without the fraction."""
    n = F.size(p)
    take = lambda i: F.slice(p, F.greatest(i, F.lit(1)), F.least(i + 2, n) - F.greatest(i, F.lit(1)) + 1)
    return F.transform(p, lambda x, i: let(take(i), lambda s: div(F.aggregate(s, F.lit(0), lambda a, q: a + q), F.size(s))))


@bound_once
def runs(on: Column) -> Column:
    """Array of (start, stop) of each run of true in an array of booleans."""
    n = F.size(on)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(on, i) & ~F.coalesce(F.get(on, i - 1), F.lit(False)))
    stops = F.filter(F.sequence(F.lit(1), n), lambda i: F.get(on, i - 1) & ~F.coalesce(F.get(on, i), F.lit(False)))
    return F.when(n == 0, F.array().cast("array<struct<start:int,stop:int>>")).otherwise(F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop"))))


def merge_runs(ranges: Column, close) -> Column:
    """Fold ranges: one joins the last if close(last, range), where last has grown by those before."""

    def put(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        grown = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), r["stop"].alias("stop"))))
        return F.when(F.size(done) == 0, F.array(r)).when(close(last, r), grown).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(ranges, F.filter(ranges, lambda r: F.lit(False)), put)


def bands(projection: Column, w: Column) -> Column:
    """Bands of text rows in a row projection: rows over a threshold, small gaps closed."""

    def cut(s: Column) -> Column:
        limit = F.greatest(F.lit(4), div(w, 60), div(F.greatest(F.array_max(s), F.lit(1)), 14))
        return runs(F.transform(s, lambda p: p >= limit))

    close = lambda last, r: r["start"] - last["stop"] <= F.greatest(F.lit(3), div(last["stop"] - last["start"], 5))
    return merge_runs(let(smooth3(projection), cut), close)


@bound_once
def columns(projection: Column, height: Column) -> Column:
    """Columns of ink in a column projection of a band: ranges over a threshold, gaps under a quarter of the height closed."""
    limit = F.greatest(F.lit(2), F.least(div(height, 10), div(F.greatest(F.array_max(projection), F.lit(1)), 6)))
    close = lambda last, r: r["start"] - last["stop"] < F.greatest(F.lit(10), div(height, 4))
    return merge_runs(runs(F.transform(projection, lambda p: p >= limit)), close)


def rect(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.struct(left.cast("int").alias("left"), top.cast("int").alias("top"), right.cast("int").alias("right"), bottom.cast("int").alias("bottom"))


@bound_once
def ink_bounds(ink: Column, w: Column, top: Column, bottom: Column) -> Column:
    """The rectangle of rows top to bottom that has all their ink and a margin; their whole width without ink."""
    xs = F.transform(F.filter(F.transform(F.slice(ink, top * w + 1, (bottom - top) * w), lambda p, i: F.struct(p.alias("p"), (i % w).alias("x"))), lambda q: q["p"] == 1), lambda q: q["x"])

    def box(x: Column) -> Column:
        low, high = F.array_min(x), F.array_max(x)
        pad = F.greatest(F.lit(4), div(high - low, 40))
        return F.when(F.size(x) == 0, rect(F.lit(0), top, w, bottom)).otherwise(rect(F.greatest(F.lit(0), low - pad), top, F.least(w, high + 1 + pad), bottom))

    return let(xs, box)


def _width(r: Column) -> Column:
    return r["right"] - r["left"]


def _height(r: Column) -> Column:
    return r["bottom"] - r["top"]


def side_decoration(r: Column, w: Column, h: Column) -> Column:
    """Whether a rectangle is a narrow, tall thing at the left or right border."""
    narrow = _width(r) * 100 < w * 32
    beside = (r["left"] * 100 <= w * 12) | (r["right"] * 100 >= w * 88)
    return narrow & beside & ((_width(r) / F.greatest(_height(r), F.lit(1)) < 1.7) | (_height(r) * 100 >= h * 22))


def sparse(ink: Column, w: Column, r: Column) -> Column:
    """Whether less than a twentieth of a rectangle's sampled pixels are ink."""
    sx, sy = F.greatest(F.lit(1), div(_width(r), 64)), F.greatest(F.lit(1), div(_height(r), 24))
    xs, ys = F.sequence(r["left"], r["right"] - 1, sx), F.sequence(r["top"], r["bottom"] - 1, sy)
    taken = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.get(ink, y * w + x))))
    return let(taken, lambda t: (F.size(t) > 0) & (F.size(F.filter(t, lambda p: p == 1)) * 20 < F.size(t)))


@bound_once
def text_bands(ink: Column, w: Column, h: Column, most: int = 12) -> Column:
    """Rectangles of text in an ink array, from top to bottom, left to right, at most twelve; none in images under 16 pixels."""
    low = F.greatest(F.lit(10), div(h, 80))
    high = F.greatest(low + 1, F.floor(h * 0.42 + 0.5).cast("int"))

    def crop(b: Column) -> Column:
        tall = b["stop"] - b["start"]
        pad = F.greatest(F.lit(3), div(tall, 10))
        return ink_bounds(ink, w, F.greatest(F.lit(0), b["start"] - pad), F.least(h, b["stop"] + pad))

    big = lambda r: (_width(r) >= 12) & (_height(r) >= 8)
    upright = lambda r: (_height(r) > _width(r) * 0.55) & (_height(r) > F.greatest(F.lit(40), div(h, 8)))

    def split(r: Column) -> Column:
        counts = F.transform(F.sequence(r["left"], r["right"] - 1), lambda x: F.aggregate(F.sequence(r["top"], r["bottom"] - 1), F.lit(0), lambda a, y: a + F.get(ink, y * w + x)))
        pad = F.greatest(F.lit(3), div(_height(r), 12))
        part = lambda c: rect(F.greatest(r["left"], r["left"] + c["start"] - pad), r["top"], F.least(r["right"], r["left"] + c["stop"] + pad), r["bottom"])
        wide = lambda cs: F.transform(F.filter(cs, lambda c: c["stop"] - c["start"] >= 12), part)
        return let(columns(counts, _height(r)), lambda cs: let(wide(cs), lambda ps: F.when((F.size(cs) < 2) | (F.size(ps) < 2), F.array(r)).otherwise(ps)))

    found = F.filter(bands(row_projection(ink, w, h), w), lambda b: (b["stop"] - b["start"] >= low) & (b["stop"] - b["start"] <= high))
    crops = F.filter(F.transform(found, crop), lambda r: big(r) & ~upright(r) & ~side_decoration(r, w, h) & ~sparse(ink, w, r))
    parts = F.filter(F.flatten(F.transform(crops, split)), lambda r: big(r) & ~side_decoration(r, w, h))
    return F.when((w < 16) | (h < 16), F.slice(parts, 1, 0)).otherwise(F.slice(parts, 1, most))


def number_band(width: Column, height: Column, w: Column, h: Column) -> Column:
    """Whether a band has the shape of a number on a cover."""
    aspect = width / F.greatest(height, F.lit(1))
    return (width >= 12) & (height >= 8) & (aspect >= 1.15) & (aspect <= 5.8) & (width * 100 <= w * 46) & (height * 100 <= h * 38)


def fit_size(w: Column, h: Column, least: int = 560, most: int = 1600) -> Column:
    """Width and height that recognition works on: the short side raised to least, the long one held at most."""
    short, long = F.least(w, h), F.greatest(w, h)
    scale = F.when(short < least, least / F.greatest(short, F.lit(1))).otherwise(1.0)
    scale = F.when(long * scale > most, most / F.greatest(long, F.lit(1))).otherwise(scale)
    side = lambda s: F.greatest(F.lit(1), F.floor(s * scale + 0.5).cast("int"))
    same = F.abs(scale - 1) < 0.01
    return F.struct(F.when(same, w).otherwise(side(w)).alias("w"), F.when(same, h).otherwise(side(h)).alias("h"))


def sample_size(w: Column, h: Column, most: int = 2048) -> Column:
    """The largest power of two, up to 1024, by which the long side can be divided and still be most or more; else 1."""
    out = F.lit(1)
    for k in range(1, 11):
        out = F.when(div(F.greatest(w, h), 1 << k) >= most, 1 << k).otherwise(out)
    return out


@bound_once
def blur(v: Column, w: Column, h: Column) -> Column:
    """Two passes of 1, 4, 6, 4, 1 with edges repeated, the fraction dropped after each."""
    hold = lambda x, n: F.greatest(F.lit(0), F.least(n - 1, x))
    across = each(w, h, lambda x, y: div(sum((at(v, hold(x + i - 2, w), y, w) * k for i, k in enumerate(KERNEL)), F.lit(0)), 16))
    return let(across, lambda t: each(w, h, lambda x, y: div(sum((at(t, x, hold(y + i - 2, h), w) * k for i, k in enumerate(KERNEL)), F.lit(0)), 16)))


@bound_once
def sobel(v: Column, w: Column, h: Column) -> Column:
    """Array of (mag, dir): gradient magnitude and direction class 0 to 3; zero on the border."""

    def one(x: Column, y: Column) -> Column:
        p = lambda dx, dy: at(v, x + dx, y + dy, w)
        gx = p(1, -1) - p(-1, -1) + 2 * p(1, 0) - 2 * p(-1, 0) + p(1, 1) - p(-1, 1)
        gy = p(-1, 1) + 2 * p(0, 1) + p(1, 1) - p(-1, -1) - 2 * p(0, -1) - p(1, -1)

        def made(g: Column) -> Column:
            a = F.degrees(F.atan2(g["y"].cast("double"), g["x"].cast("double")))
            a = F.when(a < 0, a + 180).otherwise(a)
            kind = F.when((a < 22.5) | (a >= 157.5), 0).when(a < 67.5, 1).when(a < 112.5, 2).otherwise(3)
            return F.struct(F.sqrt((g["x"] * g["x"] + g["y"] * g["y"]).cast("double")).alias("mag"), kind.alias("dir"))

        none = F.struct(F.lit(0.0).alias("mag"), F.lit(0).alias("dir"))
        return F.when(inner(x, y, w, h), let(F.struct(gx.alias("x"), gy.alias("y")), made)).otherwise(none)

    return each(w, h, one)


@bound_once
def thin(g: Column, w: Column, h: Column) -> Column:
    """Array of booleans: gradients no smaller than both neighbours across the edge, and not zero."""

    def one(x: Column, y: Column) -> Column:
        me = at(g, x, y, w)
        m = lambda dx, dy: at(g, x + dx, y + dy, w)["mag"]
        pick = lambda sign: F.when(me["dir"] == 0, m(sign, 0)).when(me["dir"] == 1, m(sign, -sign)).when(me["dir"] == 2, m(0, sign)).otherwise(m(sign, sign))
        return inner(x, y, w, h) & (me["mag"] >= pick(-1)) & (me["mag"] >= pick(1)) & (me["mag"] > 0)

    return F.transform(each(w, h, one), lambda b: F.coalesce(b, F.lit(False)))


@bound_once
def edge_classes(g: Column, w: Column, h: Column) -> Column:
    """Array of 2 (strong), 1 (weak) and 0 for thinned gradients, by thresholds from the largest inner one."""

    def classed(t: Column) -> Column:
        top = F.array_max(F.transform(g, lambda x: x["mag"]))
        high = F.greatest(F.lit(28.0), top * 0.18)
        return let(high, lambda hi: F.zip_with(g, t, lambda x, on: F.when(~on, 0).when(x["mag"] >= hi, 2).when(x["mag"] >= hi * 0.4, 1).otherwise(0)))

    return let(thin(g, w, h), classed)


@bound_once
def dilate(on: Column, w: Column, h: Column) -> Column:
    """Array of booleans: inner pixels with any set pixel among themselves and their eight neighbours."""

    def one(x: Column, y: Column) -> Column:
        near = F.lit(False)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                near = near | F.coalesce(at(on, x + dx, y + dy, w), F.lit(False))
        return inner(x, y, w, h) & near

    return each(w, h, one)


@bound_once
def side_scan(mag: Column, w: Column, h: Column) -> Column:
    """The quad of the strongest rows and columns in the outer thirds; null if it spans too little."""
    sums = lambda n, body: F.transform(F.sequence(F.lit(0), n - 1), body)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, p: s + p)
    rows = sums(h, lambda y: total(F.slice(mag, y * w + 1, w)))
    cols = sums(w, lambda x: total(F.transform(F.sequence(F.lit(0), h - 1), lambda y: at(mag, x, y, w))))
    smooth = lambda e: F.transform(e, lambda v, i: F.when((i > 0) & (i < F.size(e) - 1), (F.get(e, i - 1) + v * 2 + F.get(e, i + 1)) / 4).otherwise(v))

    def strongest(e: Column, low: Column, high: Column, last: bool) -> Column:
        part = F.slice(e, low + 1, high - low + 1)
        part = F.reverse(part) if last else part
        return let(part, lambda p: let(F.array_position(p, F.array_max(p)).cast("int") - 1, lambda k: high - k if last else low + k))

    def ends(e: Column, n: Column) -> tuple[Column, Column]:
        first = strongest(e, F.lit(2), F.least(F.greatest(F.lit(3), div(n, 3)), n - 1), False)
        return first, strongest(e, F.greatest(F.least(n - 3, div(n * 2, 3)), F.lit(0)), n - 3, True)

    def quad(e: Column) -> Column:
        (top, bottom), (left, right) = ends(e["r"], h), ends(e["c"], w)

        def made(s: Column) -> Column:
            q = [s[c].cast("double") for c in ("l", "t", "r", "t", "r", "b", "l", "b")]
            return F.when((s["r"] - s["l"] >= w * 0.22) & (s["b"] - s["t"] >= h * 0.22), F.array(*q))

        return let(F.struct(left.alias("l"), top.alias("t"), right.alias("r"), bottom.alias("b")), made)

    return let(F.struct(rows.alias("r"), cols.alias("c")), lambda e: let(F.struct(smooth(e["r"]).alias("r"), smooth(e["c"]).alias("c")), quad))


def alike(w, h, *values, most: int = 100_000):
    """Places and values (images, rows, columns) of images of one size, about most pixels at a time, of Arrow arrays; NaN for null among numbers.

    Images without all their pixels are left out.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    w, h, *sizes = (np.array(a.to_pylist(), dtype=float) for a in (w, h, *map(pc.list_value_length, values)))  # NaN for none
    whole = np.logical_and.reduce([w > 0, h > 0, *(n >= w * h for n in sizes)])
    for width, height in sorted({*zip(w[whole].tolist(), h[whole].tolist(), strict=True)}):
        places, step = np.nonzero(whole & (w == width) & (h == height))[0], max(1, int(most // (width * height)))
        for i in range(0, len(places), step):
            some = places[i : i + step]
            px = (pc.list_slice(v.take(pa.array(some)), 0, int(width * height)).flatten() for v in values)
            yield some, *(p.to_numpy(zero_copy_only=False).reshape(len(some), int(height), int(width)) for p in px)


def found(images: DataFrame, schema: str, find, drop: tuple[str, ...] = ()) -> DataFrame:
    """images without the columns of drop, but with those of schema, Arrow arrays that find makes of a batch."""
    kept, new = [f for f in images.schema if f.name not in drop], StructType.fromDDL(schema)
    old, names = [f.name for f in kept], [f.name for f in [*kept, *new]]

    def search(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*map(batch.column, old), *find(batch)], names=names)

    images.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return images.mapInArrow(search, StructType([*kept, *new]))


def _slopes(v):
    """Differences across and down at the inner pixels of images (images, rows, columns) of three rows and columns or more, as in sobel()."""
    n, h, w = v.shape
    p = lambda dx, dy: v[:, 1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx]
    gx = p(1, -1) - p(-1, -1) + 2 * p(1, 0) - 2 * p(-1, 0) + p(1, 1) - p(-1, 1)
    gy = p(-1, 1) + 2 * p(0, 1) + p(1, 1) - p(-1, -1) - 2 * p(0, -1) - p(1, -1)
    return gx, gy


def _blurred(v):
    """blur() of images (images, rows, columns)."""
    import numpy as np

    for axis in (2, 1):
        n = v.shape[axis]
        v = np.floor(sum(np.take(v, np.clip(np.arange(n) + i - 2, 0, n - 1), axis) * k for i, k in enumerate(KERNEL)) / 16)
    return v


def _edges(v):
    """Magnitudes of sobel() and edge_classes() of images (images, rows, columns)."""
    import numpy as np

    n, h, w = v.shape
    mag, classes = np.zeros((n, h, w)), np.zeros((n, h, w), "i4")
    if min(h, w) < 3:
        return mag, classes
    gx, gy = _slopes(v)
    mag[:, 1:-1, 1:-1] = np.sqrt(gx * gx + gy * gy)
    high = np.fmax(28.0, np.fmax.reduce(mag.reshape(n, -1), axis=1) * 0.18)
    i, y, x = np.nonzero(mag >= (high * 0.4)[:, None, None])  # others are 0, whatever their direction
    a = np.degrees(np.arctan2(gy[i, y - 1, x - 1], gx[i, y - 1, x - 1]))
    a = np.where(a < 0, a + 180, a)
    step = np.select([(a < 22.5) | (a >= 157.5), a < 67.5, a < 112.5], [1, 1 - w, w], 1 + w)
    flat, at = mag.ravel(), (i * h + y) * w + x
    thin = (flat[at] >= flat[at - step]) & (flat[at] >= flat[at + step])
    classes[i, y, x] = np.where(thin, np.where(flat[at] >= high[i], 2, 1), 0)
    return mag, classes


def _sides(mag):
    """side_scan() of magnitudes (images, rows, columns): quads or None. Sums run in the order of the expressions', so quads are the same."""
    import numpy as np

    n, h, w = mag.shape

    def strongest(e):
        """Places of the largest sums, those of null apart, and whether there are any."""
        e = np.where(np.isnan(e), -np.inf, e)
        return e.argmax(1), e.max(1) > -np.inf

    def ends(e):
        """Places of the strongest sums in the outer thirds, from both ends; None if there are none."""
        size, smooth = e.shape[1], e.copy()
        smooth[:, 1:-1] = (e[:, :-2] + e[:, 1:-1] * 2 + e[:, 2:]) / 4
        first = smooth[:, 2 : min(max(3, size // 3), size - 1) + 1]
        low = max(min(size - 3, size * 2 // 3), 0)
        last = smooth[:, low : max(size - 2, 0)][:, ::-1]
        if not (first.size and last.size):
            return None
        (a, one), (b, other) = strongest(first), strongest(last)
        return 2 + a, size - 3 - b, one & other

    down, across = ends(np.cumsum(mag, axis=2)[:, :, -1]), ends(np.cumsum(mag, axis=1)[:, -1, :])
    if down is None or across is None:
        return [None] * n
    (t, b, rows), (l, r, cols) = down, across
    wide = rows & cols & (r - l >= w * 0.22) & (b - t >= h * 0.22)
    return [q if on else None for q, on in zip(np.stack([l, t, r, t, r, b, l, b], 1).astype("f8").tolist(), wide.tolist(), strict=True)]


def side_quads(images: DataFrame) -> DataFrame:
    """img_id and quad, the side_scan() of the sobel() magnitudes of images (img_id, w, h, v), in whole arrays of alike images."""

    def find(batch):
        import numpy as np
        import pyarrow as pa

        out = [None] * batch.num_rows
        for at, v in alike(*map(batch.column, ("w", "h", "v"))):
            mag = np.zeros(v.shape)
            if min(v.shape[1:]) > 2:
                gx, gy = _slopes(v.astype("f8"))
                mag[:, 1:-1, 1:-1] = np.sqrt(gx * gx + gy * gy)
            for i, q in zip(at, _sides(mag), strict=True):
                out[i] = q
        return [pa.array(out, pa.list_(pa.float64()))]

    rows = images.selectExpr("cast(img_id as long) as img_id", "cast(w as int) as w", "cast(h as int) as h", "v")
    return found(rows, "quad array<double>", find, ("w", "h", "v"))


def gradients(images: DataFrame, blurred: bool = True) -> DataFrame:
    """images (w, h, v and others) with mag, classes and sides instead of v, in whole arrays of alike images.

    These are the sobel() magnitudes, edge_classes() and side_scan() of the blur(), or of v itself; null for images without all their pixels.
    """

    def find(batch):
        import numpy as np
        import pyarrow as pa

        (mags, classes, sides), gaps = ([None] * batch.num_rows for _ in range(3)), False  # gaps: NaN has to become null
        for at, v in alike(*map(batch.column, ("w", "h", "v"))):
            mag, kinds = _edges(_blurred(v.astype("f8")) if blurred else v.astype("f8"))
            gaps |= bool(np.isnan(mag).any())
            for i, m, c, q in zip(at, mag, kinds, _sides(mag), strict=True):
                mags[i], classes[i], sides[i] = m.ravel(), c.ravel(), q
        return [pa.array(mags, pa.list_(pa.float64()), from_pandas=gaps), pa.array(classes, pa.list_(pa.int32())), pa.array(sides, pa.list_(pa.float64()))]

    return found(images, "mag array<double>, classes array<int>, sides array<double>", find, ("v",))
