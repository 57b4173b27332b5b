"""Quadrilaterals: arrays of eight doubles, x and y of the top left, top right, bottom right and bottom left corner."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.strings import let

INSET = 0.08


def _xy(q: Column) -> list[tuple[Column, Column]]:
    return [(F.get(q, 2 * i), F.get(q, 2 * i + 1)) for i in range(4)]


def _all(tests) -> Column:
    return reduce(lambda a, b: a & b, tests)


def _length(a, b) -> Column:
    return F.sqrt((b[0] - a[0]) * (b[0] - a[0]) + (b[1] - a[1]) * (b[1] - a[1]))


def inset(w: Column, h: Column, share: float = INSET) -> Column:
    l, t, r, b = w * share, h * share, w * (1 - share), h * (1 - share)
    return F.array(*[c.cast("double") for c in (l, t, r, t, r, b, l, b)])


def ordered(q: Column) -> Column:
    """Corners by sum and difference of their coordinates; of equal ones the first."""
    pts = _xy(q)

    def first(of, best) -> Column:
        values = F.array(*[of(*p) for p in pts])
        return F.array_position(values, best(values)).cast("int") - 1

    picks = [first(lambda x, y: x + y, F.array_min), first(lambda x, y: x - y, F.array_max), first(lambda x, y: x + y, F.array_max), first(lambda x, y: x - y, F.array_min)]
    return F.array(*[F.get(q, k * 2 + d) for k in picks for d in (0, 1)])


def area(q: Column) -> Column:
    p = _xy(q)
    return F.abs(sum((p[i][0] * p[(i + 1) % 4][1] - p[(i + 1) % 4][0] * p[i][1] for i in range(4)), F.lit(0.0))) * 0.5


def convex(q: Column, least: float = 1.0) -> Column:
    """Whether all turns go one way and none is flatter than least."""
    p = _xy(q)
    turns = F.array(*[(p[(i + 1) % 4][0] - p[i][0]) * (p[(i + 2) % 4][1] - p[(i + 1) % 4][1]) - (p[(i + 1) % 4][1] - p[i][1]) * (p[(i + 2) % 4][0] - p[(i + 1) % 4][0]) for i in range(4)])
    return let(turns, lambda t: F.forall(t, lambda c: c >= least) | F.forall(t, lambda c: c <= -least))


def clamped(q: Column, w: Column, h: Column) -> Column:
    return F.transform(q, lambda c, i: F.greatest(F.lit(0.0), F.least(F.when(i % 2 == 0, w - 1).otherwise(h - 1).cast("double"), c)))


def scaled(q: Column, sx: Column, sy: Column, w: Column, h: Column) -> Column:
    """q scaled to an image of w x h and held within it; the inset quad if it is not convex then."""
    big = clamped(F.transform(q, lambda c, i: c * F.when(i % 2 == 0, sx).otherwise(sy)), w, h)
    return let(big, lambda b: F.when(convex(b), b).otherwise(inset(w, h)))


def rectangularity(q: Column) -> Column:
    """1 for right angles at all corners, down to 0."""
    p = _xy(q)
    sides = [(p[(i + 1) % 4][0] - p[i][0], p[(i + 1) % 4][1] - p[i][1]) for i in range(4)]
    size = [F.sqrt(x * x + y * y) for x, y in sides]
    cos = sum((F.abs((sides[i][0] * sides[(i + 1) % 4][0] + sides[i][1] * sides[(i + 1) % 4][1]) / (size[i] * size[(i + 1) % 4])) for i in range(4)), F.lit(0.0))
    return F.when(F.least(*size) < 1, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - cos / 4))


def edge_strength(q: Column, mag: Column, w: Column, h: Column, steps: int = 24) -> Column:
    """Mean gradient along the sides, as a share of 80, 1 at most."""
    p = _xy(q)

    def side(a, b) -> Column:
        along = lambda k, s: F.floor(a[k] + (b[k] - a[k]) * (s / steps) + 0.5)
        there = lambda x, y: F.when((x >= 0) & (x < w) & (y >= 0) & (y < h), F.get(mag, (y * w + x).cast("int")))
        return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda s: there(along(0, s), along(1, s)))

    taken = [side(p[e], p[(e + 1) % 4]) for e in range(4)]
    seen = F.filter(F.concat(*taken), lambda m: m.isNotNull())
    return let(seen, lambda m: F.when(F.size(m) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.aggregate(m, F.lit(0.0), lambda a, v: a + v) / F.size(m) / 80)))


def score(q: Column, mag: Column, w: Column, h: Column) -> Column:
    """Area share x shape x edges of a quad; -1 for none, or one too far out, not convex, too small or too large."""
    inside = F.forall(F.transform(q, lambda c, i: F.when(i % 2 == 0, c.between(-0.08 * w, 1.08 * w)).otherwise(c.between(-0.08 * h, 1.08 * h))), lambda b: b)

    def judge(c: Column) -> Column:
        share = area(c) / (w * h)
        value = share * (0.35 + 0.65 * rectangularity(c)) * (0.4 + 0.6 * edge_strength(c, mag, w, h))
        return F.when(convex(c) & (area(c) > 16) & (share >= 0.08) & (share <= 0.97), value).otherwise(-1.0)

    return F.coalesce(F.when(inside, let(clamped(q, w, h), judge)).otherwise(-1.0), F.lit(-1.0))


def crop_size(q: Column, least: int = 64, most: int = 1600) -> Column:
    """Width and height of the straightened crop: the longer of opposite sides, held at most; null if under least."""
    p = _xy(q)
    half_up = lambda c: F.floor(c + 0.5).cast("int")
    w, h = half_up(F.greatest(_length(p[0], p[1]), _length(p[3], p[2]))), half_up(F.greatest(_length(p[0], p[3]), _length(p[1], p[2])))

    def held(s: Column) -> Column:
        long = F.greatest(s["w"], s["h"])
        fit = lambda c: F.when(long > most, F.greatest(F.lit(least), half_up(c * (most / long)))).otherwise(c)
        return F.when((s["w"] >= least) & (s["h"] >= least), F.struct(fit(s["w"]).alias("w"), fit(s["h"]).alias("h")))

    return let(F.struct(w.alias("w"), h.alias("h")), held)


def valid_crop(q: Column, least: float) -> Column:
    """Whether a quad set by hand is convex and no side is shorter than least."""
    p = _xy(q)
    return convex(q, 8.0) & _all(_length(p[i], p[(i + 1) % 4]) >= least for i in range(4))


def _nearest(distances: list[Column], radius: Column) -> Column:
    """Place of the least distance within radius, the last of equal ones; -1 for none."""
    tagged = F.array(*[F.struct(d.alias("d"), F.lit(-i).alias("i")) for i, d in enumerate(distances)])
    return let(F.array_min(tagged), lambda b: F.when(b["d"] <= radius, -b["i"]).otherwise(-1))


def nearest_corner(q: Column, x: Column, y: Column, radius: Column) -> Column:
    return _nearest([_length(p, (x, y)) for p in _xy(q)], radius)


def nearest_edge(q: Column, x: Column, y: Column, width: Column) -> Column:
    p = _xy(q)

    def far(a, b) -> Column:
        dx, dy = b[0] - a[0], b[1] - a[1]
        long = dx * dx + dy * dy
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - a[0]) * dx + (y - a[1]) * dy) / F.greatest(long, F.lit(1.0))))
        return F.when(long < 1, _length(a, (x, y))).otherwise(_length((a[0] + t * dx, a[1] + t * dy), (x, y)))

    return _nearest([far(p[i], p[(i + 1) % 4]) for i in range(4)], width)


def fit_to_view(w: Column, h: Column, view_w: Column, view_h: Column) -> Column:
    """Scale and offsets that show an image centred and whole in a view."""
    s = F.least(view_w / w, view_h / h)
    return F.struct(s.alias("scale"), ((view_w - w * s) / 2).alias("left"), ((view_h - h * s) / 2).alias("top"))


def sides(xs: Column, ys: Column) -> Column:
    """The sides of a closed polygon, an array of x1, y1, x2, y2."""
    after = lambda v: F.concat(F.slice(v, F.lit(2), F.size(v)), F.slice(v, 1, 1))
    return F.arrays_zip(xs.alias("x1"), ys.alias("y1"), after(xs).alias("x2"), after(ys).alias("y2"))


def crossing(polygon: Column, y: Column) -> Column:
    """Those sides that pass the height y."""
    return F.filter(polygon, lambda s: (s["y1"] <= y) != (s["y2"] <= y))


def inside_polygon(x: Column, y: Column, crossed: Column) -> Column:
    """Whether a point lies within a polygon, by its winding number; crossed has the sides that pass its height."""

    def turn(s: Column) -> Column:
        side = (s["x2"] - s["x1"]) * (y - s["y1"]) - (x - s["x1"]) * (s["y2"] - s["y1"])
        return F.when((s["y1"] <= y) & (side > 0), 1).when((s["y1"] > y) & (side < 0), -1).otherwise(0)

    return F.aggregate(crossed, F.lit(0), lambda a, s: a + turn(s)) != 0


def lasso(w: Column, h: Column, xs: Column, ys: Column, pad: int = 16) -> Column:
    """Crop of a polygon: left, top, right, bottom, out_w, out_h, coverage and masked; null if under 8 pixels.

    coverage is the share of sampled pixels, by their centres, within the polygon; the mask is used from 0.18.
    """
    hold = lambda c, n: F.greatest(F.lit(0.0), F.least(n.cast("double"), c))
    l, r, t, b = hold(F.array_min(xs), w), hold(F.array_max(xs), w), hold(F.array_min(ys), h), hold(F.array_max(ys), h)
    box = F.struct(F.floor(l).cast("int").alias("left"), F.floor(t).cast("int").alias("top"), F.ceil(r).cast("int").alias("right"), F.ceil(b).cast("int").alias("bottom"))

    def made(o: Column) -> Column:
        bw, bh = o["right"] - o["left"], o["bottom"] - o["top"]
        step = lambda n: F.greatest(F.lit(1), F.floor(n / 80).cast("int"))
        line = lambda py, crossed: F.transform(F.sequence(o["left"], o["right"] - 1, step(bw)), lambda px: inside_polygon(px + 0.5, py + 0.5, crossed))
        row = lambda py: let(crossing(sides(xs, ys), py + 0.5), lambda crossed: line(py, crossed))
        hits = F.flatten(F.transform(F.sequence(o["top"], o["bottom"] - 1, step(bh)), row))
        share = let(hits, lambda s: F.size(F.filter(s, lambda v: v)) / F.size(s))
        fields = lambda c: F.struct(o["left"].alias("left"), o["top"].alias("top"), o["right"].alias("right"), o["bottom"].alias("bottom"), (bw + 2 * pad).alias("out_w"), (bh + 2 * pad).alias("out_h"), c.alias("coverage"), (c >= 0.18).alias("masked"))
        return F.when((r - l >= 8) & (b - t >= 8), let(share, fields))

    return let(box, made)
