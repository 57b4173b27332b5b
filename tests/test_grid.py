"""Image operators against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.operators import contours, covers, grid, quads, resample


def image(spark, *arrays):
    return spark.createDataFrame([(i, a.shape[1], a.shape[0], a.ravel().astype(int).tolist()) for i, a in enumerate(arrays)], "img_id int, w int, h int, v array<int>")


RNG = np.random.default_rng(7)


def one(df, column):
    return df.orderBy("img_id").select(column.alias("c")).first().c


def test_blur_and_dilate(spark):
    a = RNG.integers(0, 256, (9, 13))
    df = image(spark, a)
    k = np.array(grid.KERNEL)
    p = np.pad(a, ((0, 0), (2, 2)), mode="edge")
    x = sum(p[:, i : i + 13] * k[i] for i in range(5)) // 16
    p = np.pad(x, ((2, 2), (0, 0)), mode="edge")
    assert one(df, grid.blur(F.col("v"), F.col("w"), F.col("h"))) == (sum(p[i : i + 9] * k[i] for i in range(5)) // 16).ravel().tolist()
    on = np.pad(a > 230, 1)
    want = np.zeros_like(a, bool)
    want[1:-1, 1:-1] = np.logical_or.reduce([on[i : i + 9, j : j + 13] for i in range(3) for j in range(3)])[1:-1, 1:-1]
    assert one(df, grid.dilate(F.transform(F.col("v"), lambda v: v > 230), F.col("w"), F.col("h"))) == want.ravel().tolist()


def test_round_trip(spark):
    df = image(spark, RNG.integers(0, 256, (3, 4)), RNG.integers(0, 256, (5, 2)))
    again = grid.images(grid.pixels(df)).select("img_id", "w", "h", "v")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, df.collect()))


def page():
    """A light page of 200 x 120 with three text rows, the second of two columns, and a dark stripe at the side."""
    a = np.full((120, 200), 240)
    a[10:24, 30:170] = 20
    a[40:54, 30:80] = 20
    a[40:54, 110:170] = 20
    a[80:94, 40:160] = 20
    return a


def test_text_bands(spark):
    ink = F.transform(F.col("v"), lambda v: (v <= 92).cast("int"))
    got = [tuple(r) for r in one(image(spark, page()), grid.text_bands(ink, F.col("w"), F.col("h")))]
    # ink from 30 on has a margin of 4 as a whole row, and of 3 as one of two columns
    assert got == [(26, 6, 174, 28), (27, 36, 83, 58), (107, 36, 173, 58), (36, 76, 164, 98)]
    assert one(image(spark, np.zeros((10, 10))), grid.text_bands(ink, F.col("w"), F.col("h"))) == []
    assert one(image(spark, np.full((40, 40), 255)), grid.text_bands(ink, F.col("w"), F.col("h"))) == []
    assert [tuple(r) for r in one(image(spark, page()), grid.bands(grid.row_projection(ink, F.col("w"), F.col("h")), F.col("w")))] == [(9, 25), (39, 55), (79, 95)]


def test_runs(spark):
    df = spark.createDataFrame([([True, True, False, True],), ([False],), ([True],)], "b array<boolean>")
    assert [[tuple(x) for x in r[0]] for r in df.select(grid.runs(F.col("b"))).collect()] == [[(0, 2), (3, 4)], [], [(0, 1)]]


def test_contours():
    c = np.zeros((20, 20), int)
    c[3, 3:17] = 1
    c[3, 5] = 2
    c[15, 3:9] = 1
    grown = contours.grow(c)
    assert grown.sum() == 14 and grown[3].sum() == 14
    m = np.zeros((40, 60), bool)
    m[8:30, 10] = m[8:30, 50] = m[8, 10:51] = m[29, 10:51] = True
    ids = contours.labels(m)
    assert len(set(ids[m].tolist())) == 1 and (ids[~m] == -1).all()
    assert contours.contour(m) == [8.0, 6.0, 52.0, 6.0, 52.0, 31.0, 8.0, 31.0]
    assert contours.contour(np.zeros((9, 9), bool)) is None
    assert contours.hull([(0, 0), (2, 0), (1, 0), (2, 2), (0, 2), (1, 1)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]


def test_quads(spark):
    q = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    square = (0, 0, 10, 0, 10, 10, 0, 10)
    row = spark.range(1).select(
        quads.area(q(*square)), quads.convex(q(*square)), quads.convex(q(0, 0, 10, 0, 0, 10, 10, 10)), quads.ordered(q(10, 10, 0, 0, 0, 10, 10, 0)), quads.rectangularity(q(*square)),
        quads.nearest_corner(q(*square), F.lit(9.0), F.lit(9.0), F.lit(3.0)), quads.nearest_edge(q(*square), F.lit(5.0), F.lit(5.0), F.lit(5.0)), quads.nearest_edge(q(*square), F.lit(5.0), F.lit(5.0), F.lit(4.0)),
    ).first()
    assert tuple(row) == (100.0, True, False, [float(x) for x in square], 1.0, 2, 3, -1)
    sizes = spark.range(1).select(quads.crop_size(q(0, 0, 3200, 0, 3200, 1000, 0, 1000)).alias("a"), quads.crop_size(q(*square)).alias("b")).first()
    assert tuple(sizes.a) == (1600, 500) and sizes.b is None
    lasso = spark.range(1).select(quads.lasso(F.lit(100), F.lit(100), q(10, 50, 10), q(10, 10, 50)).alias("l")).first().l
    assert tuple(lasso)[:6] == (10, 10, 50, 50, 72, 72) and lasso.coverage == pytest.approx(0.5, abs=0.03) and lasso.masked


def test_cover(spark):
    a = np.full((90, 70), 30)
    a[15:76, 14:57] = 220
    rows = covers.detect(image(spark, a, np.full((90, 70), 99))).orderBy("img_id").collect()
    want = [14, 15, 56, 15, 56, 75, 14, 75]
    assert max(abs(x - y) for x, y in zip(rows[0].quad, want, strict=True)) <= 4 and rows[0].method != "inset"
    assert rows[1].method == "sides" and rows[1].quad == [2, 2, 67, 2, 67, 87, 2, 87]  # without any edge the outermost lines count


SF = "/root/testdata/sf0.001"


def pictures(spark):
    from shelfspark.plans.grid import drawn

    return {r.img_id: np.array(r.v).reshape(r.h, r.w) for r in drawn(spark, SF).collect()}


def corners(k):
    """Of the cover drawn in image k; None where that has no four sides."""
    left, top, right, bottom = 4 + k % 7, 5 + k * 3 % 9, 42 - k * 5 % 8, 54 - k * 7 % 10
    if k % 4 == 1:
        at = lambda u, v: [(5 * u - v) / 26, (u + 5 * v) / 26]
        u0, u1, v0, v1 = 5 * (left + 8), 5 * (right + 2), 5 * (top - 3), 5 * (bottom - 12)
        return [*at(u0, v0), *at(u1, v0), *at(u1, v1), *at(u0, v1)]
    return [left, top, right, top, right, bottom, left, bottom] if k % 4 == 0 else None


def magnitudes(a):
    a = a.astype(float)
    out = np.zeros(a.shape)
    gx = a[:-2, 2:] - a[:-2, :-2] + 2 * (a[1:-1, 2:] - a[1:-1, :-2]) + a[2:, 2:] - a[2:, :-2]
    gy = a[2:, :-2] + 2 * a[2:, 1:-1] + a[2:, 2:] - a[:-2, :-2] - 2 * a[:-2, 1:-1] - a[:-2, 2:]
    out[1:-1, 1:-1] = np.sqrt(gx * gx + gy * gy)
    return out


def test_drawn_covers(spark):
    """On drawn images the quad found is the one drawn, by more than one method."""
    from shelfspark.plans import QUERIES

    rows = QUERIES["cover_quads"](spark, SF).collect()
    assert len(rows) == len(pictures(spark)) and len({r.method for r in rows}) >= 2 and any(r.method != "inset" for r in rows)
    for r in rows:
        if want := corners(r.img_id):
            assert max(abs(a - b) for a, b in zip(r.quad, want, strict=True)) <= 5, (r.img_id, r.method, r.quad, want)


def test_side_scan(spark):
    """The strongest smoothed row and column sums of the outer thirds, by plain sums."""
    from shelfspark.plans import QUERIES

    def end(e, low, high, last):
        part = np.round(e[low : high + 1], 6)
        return high - int(part[::-1].argmax()) if last else low + int(part.argmax())

    pics = pictures(spark)
    for r in QUERIES["side_scan"](spark, SF).collect():
        m, found = magnitudes(pics[r.img_id]), []
        for axis, n in ((1, m.shape[0]), (0, m.shape[1])):
            e = m.sum(axis)
            smooth = e.copy()
            smooth[1:-1] = (e[:-2] + 2 * e[1:-1] + e[2:]) / 4
            found += [end(smooth, 2, min(max(3, n // 3), n - 1), False), end(smooth, max(min(n - 3, n * 2 // 3), 0), n - 3, True)]
        top, bottom, left, right = found
        wide = right - left >= m.shape[1] * 0.22 and bottom - top >= m.shape[0] * 0.22
        assert r.quad == ([left, top, right, top, right, bottom, left, bottom] if wide else None)


def test_lines_by_voting(spark):
    """Peaks are the lines that no stronger one is beside, and their quads lie on the drawn sides."""
    from shelfspark.operators import hough
    from shelfspark.plans.grid import _edges, drawn

    votes, sizes = hough.votes(_edges(spark, SF, drawn)), drawn(spark, SF).select("img_id", "w", "h")
    table = {}
    for r in votes.collect():
        table.setdefault(r.img_id, {})[r.theta, r.rho] = r.votes
    want = set()
    for img, v in table.items():
        least = max(18, int(0.22 * max(v.values())))
        strong = {k for k, n in v.items() if n >= least and not any(v.get(((k[0] + a) % 180, k[1] + b), 0) > n for a in range(-2, 3) for b in range(-2, 3))}
        ranked = sorted(strong, key=lambda k: (-v[k], k))[:24]
        want |= {(img, *k, v[k], i + 1) for i, k in enumerate(ranked)}
    got = hough.peaks(votes, sizes)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 10
    for r in hough.quads(got, sizes).collect():
        assert any(np.allclose(r.quad, q, atol=1e-6) for q in widest([p for p in sorted(want, key=lambda p: p[4]) if p[0] == r.img_id], 48, 60))


def widest(lines, w, h):
    """Quads of all upright and level pairs whose distances from the origin differ most, among the eight strongest of each."""

    def pairs(some, n, place):
        both = [(a, b) for i, a in enumerate(some[:8]) for b in some[i + 1 : 8]]
        most = max((abs(a[2] - b[2]) for a, b in both), default=0)
        return [sorted(p, key=place) for p in both if abs(p[0][2] - p[1][2]) == most >= 0.18 * n]

    def meet(a, b):
        (ta, ra), (tb, rb) = ((np.radians(x[1]), x[2]) for x in (a, b))
        return np.linalg.solve([[np.cos(ta), np.sin(ta)], [np.cos(tb), np.sin(tb)]], [ra, rb])

    at = lambda p, c, s, n: (p[2] - n / 2 * s(np.radians(p[1]))) / c(np.radians(p[1]))
    upright = pairs([p for p in lines if p[1] < 35 or p[1] > 145], w, lambda p: at(p, np.cos, np.sin, h))
    level = pairs([p for p in lines if 55 < p[1] < 125], h, lambda p: at(p, np.sin, np.cos, w))
    return [np.concatenate([meet(t, l), meet(t, r), meet(b, r), meet(b, l)]) for l, r in upright for t, b in level]  # noqa: E741


def test_dark_images_on_a_sampled_grid(spark):
    """Images so large that the border and a step above one count."""
    for a in (RNG.integers(0, 120, (200, 150)), RNG.integers(60, 256, (200, 150)), np.where(RNG.random((130, 260)) < 0.38, 20, 200)):
        h, w = a.shape
        part = a[h // 12 : h - h // 12 : max(1, h // 48), w // 12 : w - w // 12 : max(1, w // 48)].ravel()
        dark, bright = (part <= 80).sum(), (part >= 150).sum()
        want = dark * 5 >= len(part) * 2 or (dark > bright and part.sum() // len(part) < 120)
        assert one(image(spark, a), grid.mostly_dark(F.col("v"), F.col("w"), F.col("h"))) == want


def drawn_at(a, sx, sy):
    """Bilinear value of an array at a place."""
    h, w = a.shape
    x, y = np.floor(sx - 0.5), np.floor(sy - 0.5)
    fx, fy = sx - 0.5 - x, sy - 0.5 - y
    at = lambda dx, dy: a[np.clip(y + dy, 0, h - 1).astype(int), np.clip(x + dx, 0, w - 1).astype(int)]
    return np.floor((at(0, 0) * (1 - fx) + at(1, 0) * fx) * (1 - fy) + (at(0, 1) * (1 - fx) + at(1, 1) * fx) * fy + 0.5).astype(int)


def grids(df):
    return [None if r.v is None else np.array(r.v).reshape(r.h, r.w) for r in df.orderBy("img_id").collect()]


def test_scaling_and_turning(spark):
    a = RNG.integers(0, 256, (30, 46))
    up = np.add(*np.mgrid[0:600, 0:20]) % 256
    df = image(spark, a, a[:1, :1], up)
    for most, shapes in ((20, [(13, 20), (1, 1), (20, 1)]), (46, [(30, 46), (1, 1), (46, 2)])):
        got = grids(resample.fitted(df, most))
        assert [g.shape for g in got] == shapes
        for g, source in zip(got, (a, a[:1, :1], up), strict=True):
            y, x = np.mgrid[0 : g.shape[0], 0 : g.shape[1]]
            assert (g == drawn_at(source, (x + 0.5) * source.shape[1] / g.shape[1], (y + 0.5) * source.shape[0] / g.shape[0])).all()
    turns = {1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 5: a.T, 6: np.rot90(a, -1), 7: np.rot90(a, 2).T, 8: np.rot90(a), 0: a, 9: a}
    rows = image(spark, *[a] * 10).withColumn("code", F.col("img_id"))
    out = resample.redrawn(rows, resample.turned_size(F.col("w"), F.col("h"), F.col("code")), resample.turned(F.col("v"), F.col("w"), F.col("h"), F.col("code")))
    assert all((g == turns[k]).all() for k, g in enumerate(grids(out)))
    one_, mirrored = grids(resample.loaded(image(spark, a, a).withColumn("orientation", F.col("img_id") + 6), 20))
    half = np.floor(a.reshape(15, 2, 23, 2).mean((1, 3)) + 0.5).astype(int)
    y, x = np.mgrid[0:20, 0:13]
    turned = np.rot90(half, -1)
    assert one_.shape == (20, 13) and (one_ == drawn_at(turned, (x + 0.5) * 15 / 13, (y + 0.5) * 23 / 20)).all() and mirrored.shape == (13, 20)


def test_straightened_covers(spark):
    """A quad that is a rectangle is cut out; any other is mapped by the projection that solves its eight equations; too small ones are null."""
    a = RNG.integers(0, 256, (90, 120))
    quads_ = [[10, 20, 100, 20, 100, 85, 10, 85], [12, 8, 101, 15, 110, 80, 5, 70], [0, 0, 30, 0, 30, 30, 0, 30], [0, 0, 50, 0, 100, 0, 0, 88], [80, 10, 110, 80, 20, 85, 10, 20]]
    df = image(spark, *[a] * 5).join(spark.createDataFrame([(i, [float(c) for c in q]) for i, q in enumerate(quads_)], "img_id int, quad array<double>"), "img_id")
    got = grids(resample.warped(df))
    assert (got[0] == a[20:85, 10:100]).all() and got[2] is None and got[3] is None
    for k in (1, 4):
        (h, w), p = got[k].shape, np.array(quads_[k], float).reshape(4, 2)
        rows, target = [], []
        for (u, v), (x, y) in zip([(0, 0), (w, 0), (w, h), (0, h)], p, strict=True):
            rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
            target += [x, y]
        m = np.append(np.linalg.solve(np.array(rows, float), target), 1).reshape(3, 3)
        v, u = np.mgrid[0:h, 0:w] + 0.5
        x, y, z = np.tensordot(m, np.stack([u, v, np.ones_like(u)]), 1)
        assert (np.abs(got[k] - drawn_at(a, x / z, y / z)) <= 1).all()  # a place that is half way may round either way
    assert resample.warped(df.where("img_id = 1"), most=70).first().w == 70


def test_cut_out_lassos(spark):
    a = RNG.integers(0, 255, (60, 80))
    star = ([40, 70, 10, 70, 20], [5, 55, 20, 20, 55])  # crosses itself; its middle is inside by winding
    thin = ([0, 79, 79], [0, 58, 60])
    shapes = [star, ([10, 60, 60, 10], [10, 10, 50, 50]), thin, ([10, 12, 11], [10, 10, 15])]
    df = image(spark, *[a] * 4).join(spark.createDataFrame([(i, [float(c) for c in x], [float(c) for c in y]) for i, (x, y) in enumerate(shapes)], "img_id int, xs array<double>, ys array<double>"), "img_id")
    got = grids(resample.lassoed(df))
    assert got[3] is None and (got[1][16:-16, 16:-16] == a[10:50, 10:60]).all() and (got[1][:16] == 255).all() and (got[2][16:-16, 16:-16] == a[0:60, 0:79]).all()
    xs, ys = (np.array(v, float) for v in star)
    y, x = np.mgrid[5:55, 10:70] + 0.5
    turns = np.zeros(y.shape, int)
    for x1, y1, x2, y2 in zip(xs, ys, np.roll(xs, -1), np.roll(ys, -1), strict=True):
        side = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
        turns += ((y1 <= y) & (y2 > y) & (side > 0)).astype(int) - ((y1 > y) & (y2 <= y) & (side < 0))
    assert (got[0][16:-16, 16:-16] == np.where(turns != 0, a[5:55, 10:70], 255)).all() and 2 in np.abs(turns)


def test_covers_of_any_size(spark):
    """A large image is worked on at 360 pixels and its quad scaled back; one that is too small gets the inset quad."""
    a = np.full((540, 420), 30)
    a[90:456, 84:342] = 220
    rows = covers.detect(image(spark, a, np.full((10, 70), 99))).orderBy("img_id").collect()
    want = [84, 90, 341, 90, 341, 455, 84, 455]
    assert max(abs(x - y) for x, y in zip(rows[0].quad, want, strict=True)) <= 8 and rows[0].method != "inset"
    assert rows[1].method == "inset" and rows[1].quad == pytest.approx([5.6, 0.8, 64.4, 0.8, 64.4, 9.2, 5.6, 9.2])


def test_percentiles(spark):
    import math

    arrays = [RNG.integers(-20, 300, (1, n)) for n in (1, 2, 3, 50, 999)]
    for f in (0.0, 0.02, 0.5, 0.98, 1.0):
        got = [r.p for r in image(spark, *arrays).orderBy("img_id").select(grid.percentile(F.col("v"), f).alias("p")).collect()]
        assert got == [int(np.sort(a.ravel().clip(0, 255))[max(1, math.floor(a.size * f + 0.5)) - 1]) for a in arrays]
    empty = spark.createDataFrame([([],)], "v array<int>")
    assert empty.select(grid.percentile(F.col("v"), 0.5).alias("p")).first().p is None


def test_image_headers(spark, tmp_path):
    """Sizes and orientations of files as written; broken, cut and other files give null."""
    import struct
    import zlib

    from shelfspark.sources import images

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def exif(order, code):
        return {"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HIH", 42, 8, 2) + struct.pack(f"{order}HHIHH", 0x010F, 3, 1, 7, 0) + struct.pack(f"{order}HHIHH", 0x0112, 3, 1, code, 0) + bytes(4)

    def segment(marker, body):
        return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body

    png = images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 300, 200, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"x"))
    frame = lambda marker: segment(marker, struct.pack(">BHHB", 8, 640, 480, 3) + bytes(9))
    jpeg = lambda *parts: images.JPEG + b"".join(parts) + segment(0xDA, bytes(8)) + b"\x01\x02"
    cases = {
        "a.png": (png, ("png", 300, 200, 1)), "b.png": (png[:33] + chunk(b"eXIf", exif(">", 6)) + png[33:], ("png", 300, 200, 6)), "c.png": (png[:20], None),
        "d.jpg": (jpeg(segment(0xE0, b"JFIF\0" + bytes(9)), frame(0xC0)), ("jpeg", 480, 640, 1)), "e.jpg": (jpeg(segment(0xE1, b"Exif\0\0" + exif("<", 8)), segment(0xC4, bytes(30)), frame(0xC2)), ("jpeg", 480, 640, 8)),
        "f.jpg": (jpeg(segment(0xE1, b"Exif\0\0" + exif(">", 3)[:-10]), b"\xff\xff", frame(0xC1)), ("jpeg", 480, 640, 1)), "g.jpg": (jpeg(), None), "h.jpg": (images.JPEG + b"\xff\xe1\xff", None), "j.jpeg": (b"GIF89a....", None),
    }
    for name, (data, _) in cases.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "k.txt").write_bytes(png)
    got = {r.path.rpartition("/")[2]: (r.format, r.w, r.h, r.orientation) for r in images.files(spark, str(tmp_path)).collect()}
    assert got == {name: want or (None,) * 4 for name, (_, want) in cases.items()}
    assert spark.createDataFrame([(None,)], "c binary").select(images.header(F.col("c")).alias("h")).first().h is None


def test_lines_within_a_row(spark):
    """The same lines as from rows of votes, with nothing shuffled or broadcast; images of several sizes, one without an edge."""
    from shelfspark.operators import hough

    a = [RNG.random((30, 40)) < 0.1, np.zeros((20, 20), bool), RNG.random((25, 60)) < 0.05]
    a[0][:, 12] = a[2][7, :] = True
    rows = [(i, m.shape[1], m.shape[0], m.ravel().tolist(), (m * 20.0 + RNG.integers(0, 9, m.shape)).ravel().tolist()) for i, m in enumerate(a)]
    df = spark.createDataFrame(rows, "img_id bigint, w int, h int, edges array<boolean>, mag array<double>")
    px = [(i, w, h, k % w, k // w, g) for i, w, h, e, m in rows for k, (on, g) in enumerate(zip(e, m, strict=True)) if on]
    votes = hough.votes(spark.createDataFrame(px, "img_id bigint, w int, h int, x int, y int, mag double"))
    got = hough.strongest(df)
    want = {tuple(r) for r in hough.peaks(votes, df.select("img_id", "w", "h")).collect()}
    assert {tuple(r) for r in got.collect()} == want and {r[0] for r in want} == {0, 2}
    assert "Exchange" not in got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")


def test_work_is_dealt_and_done_once(spark):
    """Quads and drawn images are made by all cores; sizes, boxes and pixels are made below generators, which no filter or column repeats."""
    from shelfspark.plans import QUERIES
    from shelfspark.plans.grid import _quads, drawn

    assert _quads(spark, SF).rdd.getNumPartitions() == drawn(spark, SF).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    for name, least in {"loaded_image": 5, "warped_cover": 2, "lasso_pixels": 2, "lasso_crop": 1}.items():
        df = QUERIES[name](spark, SF)
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
        assert sum("Generate inline" in x for x in plan.splitlines()) >= least, plan


def test_side_quads_are_those_of_side_scan(spark):
    """Images of many sizes in one batch, as by the expressions; nothing of it is an expression over pixels."""
    import numpy as np

    from shelfspark.plans import QUERIES

    rng = np.random.default_rng(3)
    rows = [(i, int(w), int(h), rng.integers(0, 256, int(w * h)).tolist()) for i, (w, h) in enumerate(rng.integers(3, 40, (60, 2)))]
    df = spark.createDataFrame(rows, "img_id long, w int, h int, v array<int>")
    w, h = F.col("w"), F.col("h")
    mags = df.select("img_id", "w", "h", F.transform(grid.sobel(F.col("v"), w, h), lambda g: g["mag"]).alias("m"))
    assert sorted(grid.side_quads(df).collect()) == sorted(mags.select("img_id", grid.side_scan(F.col("m"), w, h).alias("quad")).collect())
    plan = (q := QUERIES["side_scan"](spark, SF))._sc._jvm.PythonSQLUtils.explainString(q._jdf.queryExecution(), "simple")
    assert "lambdafunction" not in plan


def test_gradients_are_those_of_the_expressions(spark):
    """Images of many sizes in one batch, one with missing pixels, one without any and one cut short."""
    rng = np.random.default_rng(5)
    rows = [(i, int(w), int(h), rng.integers(0, 256, int(w * h)).tolist(), f"p{i}") for i, (w, h) in enumerate(rng.integers(3, 40, (40, 2)))]
    for k in (100, 700):
        rows.append((k, 30, 40, [None if j % k == 50 else int(x) for j, x in enumerate(rng.integers(0, 256, 1200))], "gaps"))
    df = spark.createDataFrame([*rows, (900, 20, 20, None, "none"), (901, 20, 20, [1] * 399, "cut")], "img_id long, w int, h int, v array<int>, kept string")
    w, h = F.col("w"), F.col("h")
    sobel = df.where("img_id < 900").select("img_id", "w", "h", "kept", grid.blur(F.col("v"), w, h).alias("b")).select("img_id", "w", "h", "kept", grid.sobel(F.col("b"), w, h).alias("g"))
    want = sobel.select("img_id", "w", "h", "kept", F.transform("g", lambda g: g["mag"]).alias("mag"), grid.edge_classes(F.col("g"), w, h).alias("classes")).withColumn("sides", grid.side_scan(F.col("mag"), w, h))
    got = grid.gradients(df)
    assert [tuple(r) for r in got.where("img_id < 900").orderBy("img_id").collect()] == [tuple(r) for r in want.orderBy("img_id").collect()]
    assert all((r.mag, r.classes, r.sides) == (None, None, None) for r in got.where("img_id >= 900").collect())


def test_components_of_many_images():
    """Components, edges grown and contours of images together, as those of each by spreading over neighbours and hulls of all pixels."""
    rng = np.random.default_rng(11)

    def spread(mask):
        ids = np.full(mask.shape, -1)
        for y, x in zip(*np.nonzero(mask), strict=True):
            todo, own = [(y, x)] if ids[y, x] < 0 else [], y * mask.shape[1] + x
            while todo:
                y, x = todo.pop()
                if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and ids[y, x] < 0:
                    ids[y, x] = own
                    todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        return ids

    for h, w in ((1, 1), (2, 7), (30, 24), (41, 19)):
        stack = np.stack([rng.choice(3, (h, w), p=[1 - 2 * p, p, p]) for p in (0.0, 0.004, 0.03, 0.15, 0.3, 0.5)])
        for c in stack:
            ids = spread(c > 0)
            assert (contours.labels(c > 0) == ids).all()
        grown = contours.grow(stack)
        assert (grown == [np.isin(i, i[c == 2]) & (c > 0) for c, i in ((c, spread(c > 0)) for c in stack)]).all()
        for edges, got in zip(grown, contours.contours(grown), strict=True):
            on, best, most = edges, None, 0
            for _ in range(2):
                p = np.pad(on, 1)
                on = np.pad(np.logical_or.reduce([p[i : i + h, j : j + w] for i in range(3) for j in range(3)])[1:-1, 1:-1], 1) if min(h, w) > 2 else on & False
            ids = spread(on)
            for label in np.unique(ids[on]):
                ys, xs = np.nonzero(ids == label)
                if len(xs) >= contours.LEAST_POINTS and (four := contours.four_corners(contours.hull(zip(xs.tolist(), ys.tolist(), strict=True)))):
                    q = [min(four, key=sum), max(four, key=lambda p: p[0] - p[1]), max(four, key=sum), min(four, key=lambda p: p[0] - p[1])]
                    size = abs(sum(q[k][0] * q[k - 3][1] - q[k - 3][0] * q[k][1] for k in range(4))) / 2
                    best, most = ([float(n) for p in q for n in p], size) if size > most else (best, most)
            assert got == best


def test_covers_within_a_row(spark):
    """Nothing is shuffled, joined or stored on the way to a quad, and each image has one row, even of those with one number."""
    a = np.full((90, 70), 30)
    a[15:76, 14:57] = 220
    df = image(spark, a, np.full((10, 70), 99), a.T).withColumn("img_id", F.when(F.col("img_id") < 2, 7))
    got = covers.detect(df)
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert not any(x in plan for x in ("Exchange", "Join", "Window", "FileScan")), plan
    rows = sorted(got.collect(), key=lambda r: (r.img_id or 0, r.score))
    assert [r.img_id for r in rows] == [None, 7, 7] and rows[1].method == "inset" and rows[1].score == -1
    for r, want in ((rows[2], [14, 15, 56, 15, 56, 75, 14, 75]), (rows[0], [15, 14, 75, 14, 75, 56, 15, 56])):
        assert max(abs(x - y) for x, y in zip(r.quad, want, strict=True)) <= 4


def test_covers_of_odd_suppliers(spark, tmp_path):
    """One row a supplier: numbers below zero, one twice, and none, which draws nothing and so gets the inset quad."""
    from shelfspark.plans import QUERIES

    spark.createDataFrame([(k,) for k in (8, 8, -3, None)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = {}
    for r in QUERIES["cover_quads"](spark, str(tmp_path)).collect():
        rows.setdefault(r.img_id, []).append((r.quad, r.score, r.method))
    assert {k: len(v) for k, v in rows.items()} == {8: 2, -3: 1, None: 1} and rows[8][0] == rows[8][1]
    assert rows[None][0][1:] == (-1.0, "inset") and rows[None][0][0] == pytest.approx([3.84, 4.8, 44.16, 4.8, 44.16, 55.2, 3.84, 55.2])
    assert all(r.quad is None for r in QUERIES["side_scan"](spark, str(tmp_path)).where("img_id is null").collect())
