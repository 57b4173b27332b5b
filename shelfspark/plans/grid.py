"""Queries of image grids: embeddings as gray images of eight columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import once
from ..operators import covers, grid, hough, quads, resample
from ..sources.catalogue import spread, table
from ..sources.images import header
from ..storage import settled
from .registry import query

_V = "greatest(0, least(255, floor(e * 200) + 128))"
_PX = f"""WITH px AS (SELECT img_id, i % 8 AS x, i // 8 AS y, 8 AS w, n // 8 AS h, {_V}::INT AS v FROM (SELECT vec_id AS img_id, len(embedding) AS n, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"""
_RGB = _PX + ", rgb AS (SELECT *, v AS r, (v * 7 + x * 31) % 256 AS g, (v * 3 + y * 57) % 256 AS b FROM px)"


def images(spark, sf_dir) -> DataFrame:
    """img_id, w, h and v of every embedding; real times a whole number stays real as in the SQL, where Spark would take doubles.

    Values are held within 0 and 255 before they become whole, which infinite ones and NaN (255, as it is the largest) never do.
    """
    held = lambda e: F.greatest(F.lit(-128.0), F.least(F.lit(127.0), e * F.lit(200.0).cast("float")))
    px = F.transform("embedding", lambda e: (F.floor(held(e)) + 128).cast("int"))
    return spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select(F.col("vec_id").alias("img_id"), F.lit(8).alias("w"), F.floor(F.size("embedding") / 8).cast("int").alias("h"), px.alias("v"))


def coloured(spark, sf_dir) -> DataFrame:
    g = F.transform("v", lambda v, i: (v * 7 + i % 8 * 31) % 256)
    b = F.transform("v", lambda v, i: (v * 3 + F.floor(i / 8).cast("int") * 57) % 256)
    return images(spark, sf_dir).withColumns({"r": F.col("v"), "g": g, "b": b})


#: Drawn images of 48 x 60, one a supplier: a light cover on a dark ground, upright, slanted or over all rows, or nothing.
_L, _T, _R, _B = "4 + img_id % 7", "5 + img_id * 3 % 9", "42 - img_id * 5 % 8", "54 - img_id * 7 % 10"
_NOISE = "(x * x * 7 + y * y * 13 + x * y * (img_id % 17)) % 11"
_SLANTED = f"5 * x + y >= 5 * ({_L} + 8) AND 5 * x + y < 5 * ({_R} + 2) AND 5 * y - x >= 5 * ({_T} - 3) AND 5 * y - x < 5 * ({_B} - 12)"
_COVER = f"CASE img_id % 4 WHEN 3 THEN 90 WHEN 1 THEN CASE WHEN {_SLANTED} THEN 190 ELSE 40 END ELSE CASE WHEN x >= {_L} AND x < {_R} AND (img_id % 4 = 2 OR y >= {_T} AND y < {_B}) THEN 190 ELSE 40 END END + {_NOISE}"
_DRAWN = f"WITH px AS (SELECT img_id, x, y, 48 AS w, 60 AS h, ({_COVER})::INT AS v FROM (SELECT s_suppkey AS img_id, p % 48 AS x, p // 48 AS y FROM supplier, range(2880) r(p)))"


def drawn(spark, sf_dir) -> DataFrame:
    """img_id, w, h and v of the drawn images."""

    def draw(batches, step=256):
        """_COVER in whole arrays; remainders have the sign of what is divided, as in SQL, and without a number no pixel has a value."""
        import numpy as np
        import pyarrow as pa

        mod = np.fmod
        x, y = np.arange(2880)[None, :] % 48, np.arange(2880)[None, :] // 48
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                ids = batch.column(0).slice(at, step)
                k = ids.fill_null(0).to_numpy()[:, None]
                l, t, r, b, kind = 4 + mod(k, 7), 5 + mod(k * 3, 9), 42 - mod(k * 5, 8), 54 - mod(k * 7, 10), mod(k, 4)
                slanted = (5 * x + y >= 5 * (l + 8)) & (5 * x + y < 5 * (r + 2)) & (5 * y - x >= 5 * (t - 3)) & (5 * y - x < 5 * (b - 12))
                upright = (x >= l) & (x < r) & ((kind == 2) | ((y >= t) & (y < b)))
                v = np.where(kind == 3, 90, np.where(np.where(kind == 1, slanted, upright), 190, 40)) + mod(x * x * 7 + y * y * 13 + x * y * mod(k, 17), 11)
                n = len(ids)
                same = lambda size, n=n: pa.array(np.full(n, size, "i4"))
                none = np.repeat(ids.is_null().to_numpy(zero_copy_only=False), 2880) if ids.null_count else None
                yield pa.RecordBatch.from_arrays([ids, same(48), same(60), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="i4") * 2880), pa.array(v.astype("i4").ravel(), mask=none))], names=["img_id", "w", "h", "v"])

    keys = spread(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("img_id")))
    return keys.mapInArrow(draw, "img_id long, w int, h int, v array<int>")


def lined(spark, sf_dir) -> DataFrame:
    """Pages of lines of eleven rows with ten between, inked where an embedding's value is positive."""
    e = F.col("embedding")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), F.size(e).alias("w"), F.size(e).alias("h"), e.alias("e"))
    ink = F.flatten(F.transform("e", lambda _, y: F.transform(F.col("e"), lambda v: ((y % 21 < 11) & (v > 0)).cast("int"))))
    return rows.select("img_id", "w", "h", ink.alias("ink"))


def _out(df: DataFrame, value) -> DataFrame:
    """One row a pixel of a value array."""
    return grid.pixels(df.select("img_id", "w", "h", value.alias("v")))


@query(f"{_RGB} SELECT img_id, x::INT AS x, y::INT AS y, ((r * 30 + g * 59 + b * 11) // 100)::INT AS v FROM rgb")
def luma(spark, sf_dir):
    return _out(coloured(spark, sf_dir), grid.gray(*map(F.col, "rgb")))


@query(f"{_PX} SELECT img_id, x::INT AS x, y::INT AS y, 255 - v AS v FROM px")
def inverted(spark, sf_dir):
    return _out(images(spark, sf_dir), grid.invert(F.col("v")))


_STRETCH = "SELECT img_id, x::INT AS x, y::INT AS y, ((v - min(v) OVER p) * 255 // greatest(1, max(v) OVER p - min(v) OVER p))::INT AS v FROM {} WINDOW p AS (PARTITION BY img_id)"


@query(f"{_PX} {_STRETCH.format('px')}")
def stretch(spark, sf_dir):
    return _out(images(spark, sf_dir), grid.stretch(F.col("v")))


@query(f"{_RGB} {_STRETCH.format('(SELECT img_id, x, y, least(r, g, b) AS v FROM rgb)')}")
def min_channel(spark, sf_dir):
    return _out(coloured(spark, sf_dir), grid.min_channel(*map(F.col, "rgb")))


@query(f"{_RGB} {_STRETCH.format('(SELECT img_id, x, y, 255 - (greatest(r, g, b) - least(r, g, b)) AS v FROM rgb)')}")
def chroma_as_dark(spark, sf_dir):
    return _out(coloured(spark, sf_dir), grid.chroma_as_dark(*map(F.col, "rgb")))


@query(f"{_RGB} {_STRETCH.format('(SELECT img_id, x, y, 255 - greatest(r, g, b) AS v FROM rgb)')}")
def inverted_max(spark, sf_dir):
    return _out(coloured(spark, sf_dir), grid.inverted_max(*map(F.col, "rgb")))


def _pct(f: float) -> str:
    return f"list_sort(list(v))[greatest(1, floor(count(*) * {f} + 0.5))::INT]"


@query(f"{_PX} SELECT img_id, {_pct(0.02)} AS p2, {_pct(0.5)} AS p50, {_pct(0.98)} AS p98 FROM px GROUP BY img_id")
def percentile(spark, sf_dir):
    return images(spark, sf_dir).select("img_id", *[grid.percentile(F.col("v"), p / 100).alias(f"p{p}") for p in (2, 50, 98)])


# images of 8 x 8 have no inset and a step of 1, so every pixel counts
_DARK = "SELECT img_id, sum((v <= 80)::INT) * 5 >= count(*) * 2 OR (sum((v <= 80)::INT) > sum((v >= 150)::INT) AND sum(v) // count(*) < 120) AS dark FROM {} GROUP BY img_id"
_LUMA = "(SELECT *, (r * 30 + g * 59 + b * 11) // 100 AS l FROM rgb)"


@query(f"{_PX} {_DARK.format('px')}")
def mostly_dark(spark, sf_dir):
    return images(spark, sf_dir).select("img_id", grid.mostly_dark(F.col("v"), F.col("w"), F.col("h")).alias("dark"))


@query(f"""{_RGB}, d AS ({_DARK.format("(SELECT img_id, (r * 30 + g * 59 + b * 11) // 100 AS v FROM rgb)")}), e AS (SELECT img_id, x, y, CASE WHEN dark THEN 255 - greatest(r, g, b) ELSE l END AS v FROM {_LUMA} JOIN d USING (img_id)),
q AS (SELECT img_id, {_pct(0.02)} AS lo, {_pct(0.98)} AS hi, min(v) AS mn, max(v) AS mx FROM e GROUP BY img_id), k AS (SELECT img_id, CASE WHEN hi - lo < 24 THEN mn ELSE lo END AS lo, CASE WHEN hi - lo < 24 THEN mx ELSE hi END AS hi FROM q)
SELECT img_id, x::INT AS x, y::INT AS y, trunc((v - lo) * 255 / greatest(1, hi - lo))::INT AS v FROM e JOIN k USING (img_id)""")
def enhanced(spark, sf_dir):
    return _out(coloured(spark, sf_dir), grid.enhance(*map(F.col, "rgb"), F.col("w"), F.col("h")))


@query(f"""{_RGB}, d AS ({_DARK.format("(SELECT img_id, (r * 30 + g * 59 + b * 11) // 100 AS v FROM rgb)")}), s AS (SELECT img_id, x, y, 255 - greatest(r, g, b) AS v FROM rgb), t AS ({_STRETCH.format("s")})
SELECT img_id, l.x::INT AS x, l.y::INT AS y, (CASE WHEN dark THEN t.v ELSE l.l END)::INT AS v FROM {_LUMA} l JOIN d USING (img_id) JOIN t ON t.img_id = l.img_id AND t.x = l.x AND t.y = l.y""".replace("SELECT img_id, l.x", "SELECT l.img_id, l.x"))
def dark_on_light(spark, sf_dir):
    return _out(coloured(spark, sf_dir), grid.dark_on_light(*map(F.col, "rgb"), F.col("w"), F.col("h")))


_INK = "CASE WHEN img_id % 2 = 0 THEN ((r * 30 + g * 59 + b * 11) // 100 >= 155 OR (greatest(r, g, b) >= 165 AND greatest(r, g, b) - least(r, g, b) >= 28)) ELSE (r * 30 + g * 59 + b * 11) // 100 <= 92 END::INT"


@query(f"""{_RGB}, p AS (SELECT img_id, y, sum({_INK})::INT AS ink FROM rgb GROUP BY img_id, y) SELECT img_id, y::INT AS y, ink, (sum(ink) OVER n // count(*) OVER n)::INT AS smooth FROM p WINDOW n AS (PARTITION BY img_id ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def projection(spark, sf_dir):
    ink = grid._zip(*map(F.col, "rgb"), lambda r, g, b: grid.is_ink(r, g, b, F.col("img_id") % 2 == 0).cast("int"))
    rows = coloured(spark, sf_dir).select("img_id", grid.row_projection(ink, F.col("w"), F.col("h")).alias("p"))
    return rows.select("img_id", F.posexplode(F.arrays_zip(F.col("p").alias("ink"), grid.smooth3(F.col("p")).alias("smooth"))).alias("y", "s")).select("img_id", "y", "s.ink", "s.smooth")


def _blur() -> str:
    def one(s: str, along: str, n: str) -> str:
        return " + ".join(f"(SELECT max(q.v) FROM {s} q WHERE q.img_id = p.img_id AND q.{'y' if along == 'x' else 'x'} = p.{'y' if along == 'x' else 'x'} AND q.{along} = greatest(0, least(p.{n} - 1, p.{along} + {d})))" + f" * {k}" for d, k in zip(range(-2, 3), grid.KERNEL, strict=True))

    return f"{_PX}, a AS (SELECT img_id, x, y, w, h, ({one('px', 'x', 'w')}) // 16 AS v FROM px p), bl AS (SELECT img_id, x, y, w, h, (({one('a', 'y', 'h')}) // 16)::INT AS v FROM a p)"


_BLUR = _blur()


@query(f"{_BLUR} SELECT img_id, x::INT AS x, y::INT AS y, v FROM bl")
def blur(spark, sf_dir):
    return _out(images(spark, sf_dir), grid.blur(F.col("v"), F.col("w"), F.col("h")))


def _around(s: str, v: str = "v", width: int = 8) -> str:
    """Neighbour values n(dx)(dy) of each pixel by windows over rows of width."""
    cols = []
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            k = dy * width + dx
            f = "lag" if k < 0 else "lead"
            cols.append(f"{f}({v}, {abs(k)}) OVER o AS n{dx + 1}{dy + 1}")
    return f"SELECT *, {', '.join(cols)} FROM {s} WINDOW o AS (PARTITION BY img_id ORDER BY y, x)"


_GX = "n20 - n00 + 2 * n21 - 2 * n01 + n22 - n02"
_GY = "n02 + 2 * n12 + n22 - n00 - 2 * n10 - n20"
_IN = "x > 0 AND y > 0 AND x < w - 1 AND y < h - 1"


def _sobel_of(px: str, width: int) -> str:
    return f"""{px}, s AS (SELECT img_id, x, y, w, h, CASE WHEN {_IN} THEN sqrt((({_GX}) * ({_GX}) + ({_GY}) * ({_GY}))::DOUBLE) ELSE 0 END AS mag, CASE WHEN {_IN} THEN degrees(atan2(({_GY})::DOUBLE, ({_GX})::DOUBLE)) ELSE 0 END AS a0 FROM ({_around('px', width=width)})),
so AS (SELECT *, CASE WHEN a < 22.5 OR a >= 157.5 THEN 0 WHEN a < 67.5 THEN 1 WHEN a < 112.5 THEN 2 ELSE 3 END AS dir FROM (SELECT *, CASE WHEN a0 < 0 THEN a0 + 180 ELSE a0 END AS a FROM s))"""


_SOBEL = _sobel_of(_PX, 8)


def _sobel(spark, sf_dir, of=images) -> DataFrame:
    return of(spark, sf_dir).select("img_id", "w", "h", grid.sobel(F.col("v"), F.col("w"), F.col("h")).alias("g"))


@query(f"{_SOBEL} SELECT img_id, x::INT AS x, y::INT AS y, round(mag, 6) AS mag, dir FROM so")
def sobel(spark, sf_dir):
    flat = F.transform("g", lambda g, i: F.struct((i % 8).alias("x"), F.floor(i / 8).cast("int").alias("y"), F.round(g["mag"], 6).alias("mag"), g["dir"].alias("dir")))
    return _sobel(spark, sf_dir).select("img_id", F.inline(flat))


def _nms_of(px: str, width: int) -> str:
    return f"""{_sobel_of(px, width)}, nm AS (SELECT *, {_IN} AND mag > 0 AND mag >= CASE dir WHEN 0 THEN n01 WHEN 1 THEN n20 WHEN 2 THEN n10 ELSE n00 END AND mag >= CASE dir WHEN 0 THEN n21 WHEN 1 THEN n02 WHEN 2 THEN n12 ELSE n22 END AS keep FROM ({_around('so', 'mag', width)}))"""


_NMS = _nms_of(_PX, 8)


@query(f"{_NMS} SELECT img_id, x::INT AS x, y::INT AS y, coalesce(keep, FALSE) AS v FROM nm")
def nms(spark, sf_dir):
    return _out(_sobel(spark, sf_dir), grid.thin(F.col("g"), F.col("w"), F.col("h")))


def _classes_of(px: str, width: int) -> str:
    return f"{_nms_of(px, width)}, cl AS (SELECT img_id, x, y, w, h, mag, CASE WHEN NOT coalesce(keep, FALSE) THEN 0 WHEN mag >= hi THEN 2 WHEN mag >= 0.4 * hi THEN 1 ELSE 0 END AS c FROM (SELECT *, greatest(28, 0.18 * max(mag) OVER (PARTITION BY img_id)) AS hi FROM nm))"


_CLASSES = _classes_of(_PX, 8)


@query(f"""WITH RECURSIVE {_CLASSES.removeprefix("WITH ")}, gr AS (SELECT img_id, x, y FROM cl WHERE c = 2 UNION SELECT c.img_id, c.x, c.y FROM gr JOIN cl c ON c.img_id = gr.img_id AND c.c = 1 AND abs(c.x - gr.x) <= 1 AND abs(c.y - gr.y) <= 1)
SELECT img_id, x::INT AS x, y::INT AS y FROM gr""")
def hysteresis(spark, sf_dir):
    from ..operators.contours import with_edges

    rows = _sobel(spark, sf_dir).select("img_id", "w", "h", grid.edge_classes(F.col("g"), F.col("w"), F.col("h")).alias("classes"))
    return grid.pixels(with_edges(rows), value="edges").where("edges").drop("edges")


@query(f"{_PX} SELECT img_id, x::INT AS x, y::INT AS y, {_IN} AND coalesce(n00, FALSE) OR {_IN} AND (n10 OR n20 OR n01 OR n11 OR n21 OR n02 OR n12 OR n22) AS v FROM ({_around('(SELECT *, v > 180 AS b FROM px)', 'b')})")
def dilated(spark, sf_dir):
    return _out(images(spark, sf_dir), grid.dilate(F.transform(F.col("v"), lambda v: v > 180), F.col("w"), F.col("h")))


@query(f"{_CLASSES} SELECT img_id, t::INT AS theta, floor(x * cos(radians(t)) + y * sin(radians(t)) + 0.5)::INT AS rho, count(*)::INT AS votes FROM cl, range(180) r(t) WHERE c = 2 AND mag >= 20 AND {_IN} GROUP BY ALL")
def hough_votes(spark, sf_dir):
    return hough.votes(_edges(spark, sf_dir))


def _edges(spark, sf_dir, of=images) -> DataFrame:
    rows = _sobel(spark, sf_dir, of)
    both = F.arrays_zip(F.col("g").alias("g"), grid.edge_classes(F.col("g"), F.col("w"), F.col("h")).alias("c"))
    px = rows.select("img_id", "w", "h", F.posexplode(both).alias("i", "p")).where("p.c = 2")
    return px.select("img_id", "w", "h", (F.col("i") % F.col("w")).alias("x"), F.expr("cast(i div w as int)").alias("y"), F.col("p.g.mag").alias("mag"))


_VOTES = f"SELECT img_id, w, h, t::INT AS theta, floor(x * cos(radians(t)) + y * sin(radians(t)) + 0.5)::INT AS rho, count(*)::INT AS votes FROM cl, range(180) r(t) WHERE c = 2 AND mag >= 20 AND {_IN} GROUP BY ALL"


@query(f"""{_classes_of(_DRAWN, 48)}, vt AS ({_VOTES}), st AS (SELECT * FROM (SELECT *, max(votes) OVER (PARTITION BY img_id) AS most FROM vt) WHERE votes >= greatest(18, floor(0.22::DOUBLE * most)) AND abs(rho) < ceil(sqrt((w * w + h * h)::DOUBLE)))
SELECT * FROM (SELECT img_id, theta, rho, votes, row_number() OVER (PARTITION BY img_id ORDER BY votes DESC, theta, rho)::INT AS rank FROM st a
    WHERE NOT EXISTS (SELECT 1 FROM vt b WHERE b.img_id = a.img_id AND (b.theta - a.theta + 182) % 180 <= 4 AND abs(b.rho - a.rho) <= 2 AND b.votes > a.votes)) WHERE rank <= 24""")
def hough_peaks(spark, sf_dir):
    """The strongest lines of drawn images."""
    classed = grid.gradients(drawn(spark, sf_dir), blurred=False)
    return hough.strongest(classed.withColumn("edges", F.transform("classes", lambda c: c == 2)))


@query(f"""{_SOBEL}, en AS (SELECT img_id, 'r' AS k, y AS i, h AS n, sum(mag) AS e FROM so GROUP BY ALL UNION ALL SELECT img_id, 'c', x, w, sum(mag) FROM so GROUP BY ALL),
sm AS (SELECT img_id, k, i, n, CASE WHEN i > 0 AND i < n - 1 THEN (lag(e) OVER o + 2 * e + lead(e) OVER o) / 4 ELSE e END AS e FROM en WINDOW o AS (PARTITION BY img_id, k ORDER BY i))
SELECT img_id, k AS axis, i::INT AS place, round(e, 6) AS energy FROM sm""")
def side_energy(spark, sf_dir):
    g = _sobel(spark, sf_dir).select("img_id", "w", "h", F.transform("g", lambda x: x["mag"]).alias("v"))
    px = grid.pixels(g)
    rows = px.groupBy("img_id", F.lit("r").alias("axis"), F.col("y").alias("place")).agg(F.sum("v").alias("e"))
    cols = px.groupBy("img_id", F.lit("c").alias("axis"), F.col("x").alias("place")).agg(F.sum("v").alias("e"))
    arrays = rows.union(cols).groupBy("img_id", "axis").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "e"))), lambda s: s["e"]).alias("e"))
    smooth = F.transform("e", lambda v, i: F.when((i > 0) & (i < F.size("e") - 1), (F.get("e", i - 1) + v * 2 + F.get("e", i + 1)) / 4).otherwise(v))
    return arrays.select("img_id", "axis", F.posexplode(smooth).alias("place", "energy")).withColumn("energy", F.round("energy", 6))


@query()
def side_scan(spark, sf_dir):
    """Sides of drawn images; sums of magnitudes decide, whose last digits depend on their order, so it is tested against plain sums."""
    return grid.side_quads(drawn(spark, sf_dir))


#: Quads made of suppliers' numbers in an image of 100 x 80.
_QUADS = "SELECT s_suppkey AS img_id, (s_suppkey % 20)::DOUBLE AS x0, (s_suppkey * 7 % 20)::DOUBLE AS y0, (99 - s_suppkey * 3 % 30)::DOUBLE AS x1, (s_suppkey * 11 % 20)::DOUBLE AS y1, (99 - s_suppkey * 5 % 40)::DOUBLE AS x2, (79 - s_suppkey * 13 % 30)::DOUBLE AS y2, (s_suppkey * 17 % 40)::DOUBLE AS x3, (79 - s_suppkey * 19 % 40)::DOUBLE AS y3 FROM supplier"
_CROSSES = [f"(x{(i + 1) % 4} - x{i}) * (y{(i + 2) % 4} - y{(i + 1) % 4}) - (y{(i + 1) % 4} - y{i}) * (x{(i + 2) % 4} - x{(i + 1) % 4})" for i in range(4)]
_SIDE = [f"sqrt((x{(i + 1) % 4} - x{i}) ** 2 + (y{(i + 1) % 4} - y{i}) ** 2)" for i in range(4)]


def _quads(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    values = [k % 20, k * 7 % 20, 99 - k * 3 % 30, k * 11 % 20, 99 - k * 5 % 40, 79 - k * 13 % 30, k * 17 % 40, 79 - k * 19 % 40]
    return spread(table(spark, sf_dir, "supplier").select("s_suppkey")).select(k.alias("img_id"), F.array(*[v.cast("double") for v in values]).alias("q"))


_AREA = "abs(" + " + ".join(f"x{i} * y{(i + 1) % 4} - x{(i + 1) % 4} * y{i}" for i in range(4)) + ") / 2"
_COS = " + ".join(f"abs((x{(i + 1) % 4} - x{i}) * (x{(i + 2) % 4} - x{(i + 1) % 4}) + (y{(i + 1) % 4} - y{i}) * (y{(i + 2) % 4} - y{(i + 1) % 4})) / ({_SIDE[i]} * {_SIDE[(i + 1) % 4]})" for i in range(4))


@query(f"""SELECT img_id, round({_AREA}, 6) AS area, (least({', '.join(_CROSSES)}) >= 1 OR greatest({', '.join(_CROSSES)}) <= -1) AS convex, round(greatest(0, 1 - ({_COS}) / 4), 6) AS rectangular,
    floor(greatest({_SIDE[0]}, {_SIDE[2]}) + 0.5)::INT AS crop_w, floor(greatest({_SIDE[3]}, {_SIDE[1]}) + 0.5)::INT AS crop_h, (least({', '.join(_CROSSES)}) >= 8 OR greatest({', '.join(_CROSSES)}) <= -8) AND least({', '.join(_SIDE)}) >= 40 AS valid FROM ({_QUADS})""")
def quad_geometry(spark, sf_dir):
    q = F.col("q")
    size = quads.crop_size(q, 1, 1600)
    return _quads(spark, sf_dir).select("img_id", F.round(quads.area(q), 6).alias("area"), quads.convex(q).alias("convex"), F.round(quads.rectangularity(q), 6).alias("rectangular"), size["w"].alias("crop_w"), size["h"].alias("crop_h"), quads.valid_crop(q, 40.0).alias("valid"))


def _edge() -> str:
    parts = []
    for e in range(4):
        a, b = e, (e + 1) % 4
        parts.append(f"SELECT img_id, floor(x{a} + (x{b} - x{a}) * (s / 24) + 0.5) AS px, floor(y{a} + (y{b} - y{a}) * (s / 24) + 0.5) AS py FROM qs, range(25) r(s)")
    return " UNION ALL ".join(parts)


@query(f"""WITH qs AS ({_QUADS}), ed AS (SELECT img_id, least(1.0, avg((px * 3 + py * 5) % 90) / 80) AS e FROM ({_edge()}) GROUP BY img_id)
SELECT img_id, round(CASE WHEN (least({', '.join(_CROSSES)}) >= 1 OR greatest({', '.join(_CROSSES)}) <= -1) AND {_AREA} > 16 AND {_AREA} / 8000 BETWEEN 0.08 AND 0.97 THEN {_AREA} / 8000 * (0.35 + 0.65 * greatest(0, 1 - ({_COS}) / 4)) * (0.4 + 0.6 * e) ELSE -1 END, 6) AS score FROM qs JOIN ed USING (img_id)""")
def quad_score(spark, sf_dir):
    mag = F.transform(F.sequence(F.lit(0), F.lit(7999)), lambda i: ((i % 100 * 3 + F.floor(i / 100) * 5) % 90).cast("double"))
    return _quads(spark, sf_dir).withColumn("mag", mag).select("img_id", F.round(quads.score(F.col("q"), F.col("mag"), F.lit(100), F.lit(80)), 6).alias("score"))


_NEAR = [f"sqrt((x{i} - 30) ** 2 + (y{i} - 20) ** 2)" for i in range(4)]


@query(f"SELECT img_id, CASE WHEN least({', '.join(_NEAR)}) > 45 THEN -1 " + " ".join(f"WHEN {_NEAR[i]} = least({', '.join(_NEAR)}) THEN {i}" for i in (3, 2, 1, 0)) + f" END::INT AS corner FROM ({_QUADS})")
def nearest_corner(spark, sf_dir):
    return _quads(spark, sf_dir).select("img_id", quads.nearest_corner(F.col("q"), F.lit(30.0), F.lit(20.0), F.lit(45.0)).cast("int").alias("corner"))


_SZ = "p_partkey * 13 % 3000 + 40"
_SZ2 = "p_partkey * 29 % 2500 + 60"
_SCALE = f"CASE WHEN greatest(w, h) * CASE WHEN least(w, h) < 560 THEN 560 / least(w, h) ELSE 1.0 END > 1600 THEN 1600 / greatest(w, h) WHEN least(w, h) < 560 THEN 560 / least(w, h) ELSE 1.0 END"


@query(f"""SELECT p_partkey, CASE WHEN abs(s - 1) < 0.01 THEN w ELSE greatest(1, floor(w * s + 0.5)) END::INT AS fit_w, CASE WHEN abs(s - 1) < 0.01 THEN h ELSE greatest(1, floor(h * s + 0.5)) END::INT AS fit_h,
    CASE WHEN greatest(w, h) // 4 >= 512 THEN 4 WHEN greatest(w, h) // 2 >= 512 THEN 2 ELSE 1 END AS sample, round(least(1080.0 / w, 1920.0 / h)::DOUBLE, 6) AS scale, w >= 12 AND h >= 8 AND w / h BETWEEN 1.15 AND 5.8 AND w * 100 <= 4000 * 46 AND h * 100 <= 3000 * 38 AS number_band
    FROM (SELECT *, ({_SCALE})::DOUBLE AS s FROM (SELECT p_partkey, ({_SZ})::INT AS w, ({_SZ2})::INT AS h FROM part))""")
def image_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(f"cast({_SZ} as int)").alias("w"), F.expr(f"cast({_SZ2} as int)").alias("h"))
    fit = grid.fit_size(F.col("w"), F.col("h"))
    view = quads.fit_to_view(F.col("w"), F.col("h"), F.lit(1080.0), F.lit(1920.0))
    return rows.select("p_partkey", fit["w"].alias("fit_w"), fit["h"].alias("fit_h"), grid.sample_size(F.col("w"), F.col("h"), 512).alias("sample"), F.round(view["scale"], 6).alias("scale"), grid.number_band(F.col("w"), F.col("h"), F.lit(4000), F.lit(3000)).alias("number_band"))


@query()
def cover_quads(spark, sf_dir):
    """The whole cover detection of drawn images, which mixes expressions, votes and searches within an image."""
    return settled(spark, lambda: covers.detect(drawn(spark, sf_dir)), "covers")


@query()
def text_bands(spark, sf_dir):
    """Rectangles of text: a fold over runs of rows and columns, tested on drawn pages."""
    rows = lined(spark, sf_dir)
    return rows.select("img_id", F.inline(grid.text_bands(F.col("ink"), F.col("w"), F.col("h"))))


#: The quads with their corners moved on by one, two or three places.
_TURNED = f"SELECT img_id, list_concat(xs[k + 1:], xs[:k]) AS xs, list_concat(ys[k + 1:], ys[:k]) AS ys FROM (SELECT img_id, (img_id % 4)::INT AS k, [x0, x1, x2, x3] AS xs, [y0, y1, y2, y3] AS ys FROM ({_QUADS}))"
_PICKED = ", ".join(f"list_position(s, list_{f}(s)) AS {n}" if v == "s" else f"list_position(d, list_{f}(d)) AS {n}" for n, v, f in (("a", "s", "min"), ("b", "d", "max"), ("c", "s", "max"), ("e", "d", "min")))


@query(f"""SELECT img_id, [{', '.join(f'greatest(0.0::DOUBLE, least({m}::DOUBLE, {v}[{n}]))' for n in 'abce' for v, m in (('xs', 79), ('ys', 59)))}] AS q
    FROM (SELECT *, {_PICKED} FROM (SELECT *, list_transform([1, 2, 3, 4], lambda i: xs[i] + ys[i]) AS s, list_transform([1, 2, 3, 4], lambda i: xs[i] - ys[i]) AS d FROM ({_TURNED})))""")
def quad_order(spark, sf_dir):
    """Corners put in order and held within an image of 80 x 60."""
    k = (F.col("img_id") % 4).cast("int")
    turned = F.concat(F.slice("q", 2 * k + 1, F.lit(8)), F.slice("q", F.lit(1), 2 * k))
    rows = _quads(spark, sf_dir).select("img_id", turned.alias("q"))
    return rows.select("img_id", quads.ordered(F.col("q")).alias("q")).select("img_id", quads.clamped(F.col("q"), F.lit(80), F.lit(60)).alias("q"))


_BIG = [f"greatest(0.0::DOUBLE, least({119 if a == 'x' else 199}::DOUBLE, {a}{i} * {1.5 if a == 'x' else 2.5}::DOUBLE))" for i in range(4) for a in "xy"]
_HELD = f"SELECT img_id, {', '.join(f'{v} AS {a}{i}' for v, (i, a) in zip(_BIG, [(i, a) for i in range(4) for a in 'xy'], strict=True))} FROM ({_QUADS})"


@query(f"SELECT img_id, CASE WHEN least({', '.join(_CROSSES)}) >= 1 OR greatest({', '.join(_CROSSES)}) <= -1 THEN [x0, y0, x1, y1, x2, y2, x3, y3] ELSE [9.6, 16.0, 110.4, 16.0, 110.4, 184.0, 9.6, 184.0]::DOUBLE[] END AS q FROM ({_HELD})")
def quad_scale(spark, sf_dir):
    """Quads scaled to an image of 120 x 200; the inset quad where that is not convex."""
    return _quads(spark, sf_dir).select("img_id", quads.scaled(F.col("q"), F.lit(1.5), F.lit(2.5), F.lit(120), F.lit(200)).alias("q"))


def _far(i: int) -> str:
    j = (i + 1) % 4
    dx, dy = f"(x{j} - x{i})", f"(y{j} - y{i})"
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((30 - x{i}) * {dx} + (20 - y{i}) * {dy}) / greatest({dx} * {dx} + {dy} * {dy}, 1)))"
    return f"sqrt((x{i} + {t} * {dx} - 30) ** 2 + (y{i} + {t} * {dy} - 20) ** 2)"


@query(f"SELECT img_id, CASE WHEN least(f0, f1, f2, f3) > 12 THEN -1 " + " ".join(f"WHEN f{i} = least(f0, f1, f2, f3) THEN {i}" for i in (3, 2, 1, 0)) + f" END::INT AS edge FROM (SELECT img_id, {', '.join(f'{_far(i)} AS f{i}' for i in range(4))} FROM ({_QUADS}))")
def nearest_edge(spark, sf_dir):
    return _quads(spark, sf_dir).select("img_id", quads.nearest_edge(F.col("q"), F.lit(30.0), F.lit(20.0), F.lit(12.0)).cast("int").alias("edge"))


def _turn(i: int) -> str:
    j = (i + 1) % 4
    side = f"(x{j} - x{i}) * (py + 0.5 - y{i}) - (px + 0.5 - x{i}) * (y{j} - y{i})"
    return f"CASE WHEN y{i} <= py + 0.5 AND y{j} > py + 0.5 AND {side} > 0 THEN 1 WHEN y{i} > py + 0.5 AND y{j} <= py + 0.5 AND {side} < 0 THEN -1 ELSE 0 END"


@query(f"""SELECT img_id, l AS "left", t AS top, r AS "right", b AS bottom, r - l + 32 AS out_w, b - t + 32 AS out_h, round(avg(((wn <> 0)::INT)), 6) AS coverage, avg((wn <> 0)::INT) >= 0.18 AS masked FROM (
    SELECT *, {' + '.join(_turn(i) for i in range(4))} AS wn FROM (SELECT *, unnest(range(l, r)) AS px FROM (SELECT *, unnest(range(t, b)) AS py FROM (
        SELECT *, floor(least(x0, x1, x2, x3))::INT AS l, floor(least(y0, y1, y2, y3))::INT AS t, ceil(greatest(x0, x1, x2, x3))::INT AS r, ceil(greatest(y0, y1, y2, y3))::INT AS b FROM ({_QUADS})))))
    GROUP BY ALL""")
def lasso_crop(spark, sf_dir):
    """Crops of lassos with four corners in an image of 100 x 80; they are small enough that every pixel is sampled."""
    corner = lambda d: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get(F.col("q"), 2 * i + d))
    rows = _quads(spark, sf_dir).select("img_id", corner(0).alias("xs"), corner(1).alias("ys"))
    made = once(rows, m=quads.lasso(F.lit(100), F.lit(80), F.col("xs"), F.col("ys"))).where("m is not null").select("img_id", "m.*")
    return made.withColumn("coverage", F.round("coverage", 6))


def _listed(px: str) -> str:
    """Arrays of the pixels of a relation px, as im."""
    return f"im AS (SELECT img_id, max(w)::INT AS w, max(h)::INT AS h, list(v ORDER BY y, x) AS v FROM {px} GROUP BY img_id)"


def _bilinear(places: str) -> str:
    """Values at the places sx, sy of arrays v."""
    near = lambda dx, dy: f"v[(greatest(0, least(h - 1, gy + {dy})) * w + greatest(0, least(w - 1, gx + {dx})))::INT + 1]"
    return f"""SELECT img_id, x, y, floor(({near(0, 0)} * (1 - fx) + {near(1, 0)} * fx) * (1 - fy) + ({near(0, 1)} * (1 - fx) + {near(1, 1)} * fx) * fy + 5e-1)::INT AS v
    FROM (SELECT *, floor(sx - 5e-1) AS gx, floor(sy - 5e-1) AS gy, sx - 5e-1 - floor(sx - 5e-1) AS fx, sy - 5e-1 - floor(sy - 5e-1) AS fy FROM ({places}))"""


def _grown(rel: str, w2: str, h2: str) -> str:
    return _bilinear(f"SELECT *, (x + 5e-1) * w / ({w2}) AS sx, (y + 5e-1) * h / ({h2}) AS sy FROM (SELECT *, p % ({w2}) AS x, p // ({w2}) AS y FROM (SELECT *, unnest(range(({w2}) * ({h2}))) AS p FROM {rel}))")


@query(f"{_PX}, {_listed('px')} SELECT img_id, x::INT AS x, y::INT AS y, v FROM ({_grown('im', '13 + img_id % 5', '5 + img_id % 7')})")
def scaled_image(spark, sf_dir):
    """Images drawn anew in sizes that grow one side and shrink the other."""
    rows = images(spark, sf_dir).withColumns({"tw": (13 + F.col("img_id") % 5).cast("int"), "th": (5 + F.col("img_id") % 7).cast("int")})
    drawn_anew = resample.scaled(F.col("v"), F.col("w"), F.col("h"), F.col("tw"), F.col("th"))
    return grid.pixels(resample.redrawn(rows, F.struct(F.col("tw").alias("w"), F.col("th").alias("h")), drawn_anew))


_TURNS = {2: ("w - 1 - x", "y"), 3: ("w - 1 - x", "h - 1 - y"), 4: ("x", "h - 1 - y"), 5: ("y", "x"), 6: ("h - 1 - y", "x"), 7: ("h - 1 - y", "w - 1 - x"), 8: ("y", "w - 1 - x")}


def _turned(rel: str, code: str) -> str:
    """Where each pixel goes."""
    case = lambda k: " ".join(f"WHEN {c} THEN {p[k]}" for c, p in _TURNS.items())
    across = f"{code} BETWEEN 5 AND 8"
    return f"SELECT img_id, CASE {code} {case(0)} ELSE x END AS x, CASE {code} {case(1)} ELSE y END AS y, CASE WHEN {across} THEN h ELSE w END AS w, CASE WHEN {across} THEN w ELSE h END AS h, v FROM {rel}"


@query(f"{_PX} SELECT img_id, x::INT AS x, y::INT AS y, w::INT AS w, v FROM ({_turned('(SELECT img_id, x, y, w, 5 AS h, v FROM px WHERE y < 5)', 'img_id % 9')})")
def turned_image(spark, sf_dir):
    """The upper five rows of images in all orientations."""
    code = (F.col("img_id") % 9).cast("int")
    rows = images(spark, sf_dir).select("img_id", "w", F.lit(5).alias("h"), F.slice("v", 1, 40).alias("v"))
    out = resample.redrawn(rows, resample.turned_size(F.col("w"), F.col("h"), code), resample.turned(F.col("v"), F.col("w"), F.col("h"), code))
    return grid.pixels(out).join(out.select("img_id", "w"), "img_id")


_SMALL = "SELECT img_id, x // 2 AS x, y // 2 AS y, 24 AS w, 30 AS h, floor(avg(v) + 5e-1)::INT AS v FROM px GROUP BY ALL"
_LOADED = f"{_DRAWN}, sm AS ({_SMALL}), up AS ({_turned('sm', 'CASE WHEN img_id % 9 IN (3, 6, 8) THEN img_id % 9 ELSE 1 END')}), {_listed('up')}"


@query(f"{_LOADED} SELECT img_id, x::INT AS x, y::INT AS y, v FROM ({_grown('im', 'CASE WHEN w > h THEN 20 ELSE 16 END', 'CASE WHEN w > h THEN 16 ELSE 20 END')})")
def loaded_image(spark, sf_dir):
    """Drawn images of 48 x 60 as they are loaded for 20 pixels a side: halved, turned upright, held."""
    code = (F.col("img_id") % 9).cast("int")
    return grid.pixels(resample.loaded(drawn(spark, sf_dir).withColumn("orientation", code), 20))


#: Corners within a drawn image.
_CORNERS = {"x0": "4 + img_id % 7", "y0": "5 + img_id * 3 % 9", "x1": "42 - img_id * 5 % 8", "y1": "3 + img_id % 5", "x2": "44 - img_id % 6", "y2": "54 - img_id * 7 % 10", "x3": "2 + img_id % 4", "y3": "50 - img_id % 9"}
_MAPPED = f"""qd AS (SELECT *, {', '.join(f'({c})::DOUBLE AS {n}' for n, c in _CORNERS.items())} FROM im),
dt AS (SELECT *, (x1 - x2) * (y3 - y2) - (y1 - y2) * (x3 - x2) AS d, x0 - x1 + x2 - x3 AS ex, y0 - y1 + y2 - y3 AS ey,
    floor(greatest({_SIDE[0]}, {_SIDE[2]}) + 5e-1)::INT AS ow, floor(greatest({_SIDE[3]}, {_SIDE[1]}) + 5e-1)::INT AS oh FROM qd),
hm AS (SELECT *, (ex * (y3 - y2) - ey * (x3 - x2)) / d AS pg, ((x1 - x2) * ey - (y1 - y2) * ex) / d AS ph FROM dt),
pl AS (SELECT *, (x + 5e-1) / ow AS pu, (y + 5e-1) / oh AS pt FROM (SELECT *, p % ow AS x, p // ow AS y FROM (SELECT *, unnest(range(ow * oh)) AS p FROM hm)))"""


@query(f"""{_DRAWN}, {_listed('px')}, {_MAPPED} SELECT img_id, x::INT AS x, y::INT AS y, v FROM ({_bilinear("SELECT img_id, x, y, w, h, v, ((x1 - x0 + pg * x1) * pu + (x3 - x0 + ph * x3) * pt + x0) / (pg * pu + ph * pt + 1) AS sx, ((y1 - y0 + pg * y1) * pu + (y3 - y0 + ph * y3) * pt + y0) / (pg * pu + ph * pt + 1) AS sy FROM pl")})""")
def warped_cover(spark, sf_dir):
    """A quadrilateral of each drawn image, straightened."""
    rows = drawn(spark, sf_dir).withColumn("quad", F.array(*[F.expr(c).cast("double") for c in _CORNERS.values()]))
    return grid.pixels(resample.warped(rows, least=8))


_PHOTO = "(x * 3 + y * 5 + img_id) % 251"


@query(f"""WITH bx AS (SELECT *, floor(least(x0, x1, x2, x3))::INT AS l, floor(least(y0, y1, y2, y3))::INT AS t, ceil(greatest(x0, x1, x2, x3))::INT AS r, ceil(greatest(y0, y1, y2, y3))::INT AS b FROM ({_QUADS})),
al AS (SELECT *, {' + '.join(_turn(i) for i in range(4))} AS wn FROM (SELECT *, unnest(range(l, r)) AS px FROM (SELECT *, unnest(range(t, b)) AS py FROM bx))),
mk AS (SELECT img_id, avg((wn <> 0)::INT) >= 0.18 AS masked FROM al GROUP BY img_id),
cv AS (SELECT al.img_id, px - l + 16 AS x, py - t + 16 AS y, CASE WHEN wn <> 0 OR NOT masked THEN (px * 3 + py * 5 + al.img_id) % 251 ELSE 255 END AS v, r - l + 32 AS w, b - t + 32 AS h FROM al JOIN mk ON mk.img_id = al.img_id),
rw AS (SELECT img_id, y, sum(v - 255)::BIGINT AS s, sum((v - 255) * x)::BIGINT AS sx FROM cv GROUP BY ALL),
sz AS (SELECT DISTINCT img_id, w, h FROM cv), ys AS (SELECT img_id, w, unnest(range(h)) AS y FROM sz)
SELECT ys.img_id, ys.y::INT AS y, w::INT AS w, (coalesce(s, 0) + 255 * w)::BIGINT AS total, (coalesce(sx, 0) + 255 * w * (w - 1) // 2)::BIGINT AS weighted FROM ys LEFT JOIN rw ON rw.img_id = ys.img_id AND rw.y = ys.y""")
def lasso_pixels(spark, sf_dir):
    """Lassos with four corners cut out of photos of 100 x 80: sums of each row's pixels, plain and weighted by their place."""
    corner = lambda d: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get(F.col("q"), 2 * i + d))
    photo = grid.each(F.lit(100), F.lit(80), lambda x, y: (x * 3 + y * 5 + F.col("img_id").cast("int")) % 251)
    rows = _quads(spark, sf_dir).select("img_id", F.lit(100).alias("w"), F.lit(80).alias("h"), photo.alias("v"), corner(0).alias("xs"), corner(1).alias("ys"))
    out = resample.lassoed(rows).where("v is not null")
    line = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda y: F.slice("v", y * F.col("w") + 1, F.col("w")))
    total = lambda at: F.aggregate(at, F.lit(0).cast("long"), lambda a, p: a + p)
    each = out.select("img_id", "w", F.posexplode(line).alias("y", "p"))
    return each.select("img_id", "y", "w", total(F.col("p")).alias("total"), total(F.transform("p", lambda v, i: v * i)).alias("weighted"))


def _hex(value, digits: int):
    return F.lpad(F.hex(value), digits, "0")


@query(f"""SELECT p_partkey, CASE WHEN NOT broken THEN CASE kind WHEN 0 THEN 'png' ELSE 'jpeg' END END AS format, CASE WHEN NOT broken THEN w END AS w, CASE WHEN NOT broken THEN h END AS h,
    CASE WHEN broken THEN NULL WHEN kind = 1 THEN turned ELSE 1 END AS orientation
    FROM (SELECT p_partkey, p_partkey % 3 AS kind, p_partkey % 10 = 9 AS broken, (p_partkey % 8 + 1)::INT AS turned, ({_SZ})::INT AS w, ({_SZ2})::INT AS h FROM part)""")
def image_headers(spark, sf_dir):
    """Headers of PNG files, and of JPEG files with and without orientation, made from parts; one in ten is cut short."""
    k, w, h = F.col("p_partkey"), F.expr(_SZ), F.expr(_SZ2)
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _hex(w, 8), _hex(h, 8), F.lit("080200000000000000"))
    exif = F.concat(F.lit("FFE10022" + "457869660000" + "4D4D002A00000008" + "0001" + "0112000300000001"), _hex(k % 8 + 1, 4), F.lit("0000" + "00000000"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000"), F.when(k % 3 == 1, exif).otherwise(F.lit("")), F.lit("FFDB0004FFFFFFC0001108"), _hex(h, 4), _hex(w, 4), F.lit("03012200021101031101FFDA"))
    data = F.when(k % 3 == 0, png).otherwise(jpeg)
    cut = F.when(k % 10 == 9, F.substring(data, 1, 36)).otherwise(data)
    return table(spark, sf_dir, "part").select("p_partkey", header(F.unhex(cut)).alias("h")).select("p_partkey", "h.*")
