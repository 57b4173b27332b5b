"""Edges grown from strong to weak pixels, and the best quadrilateral contour of an image.

Both are searches within one image, whose order no expression has; each image is a row, handled in an Arrow batch. Rows are
spread over tasks as Spark deals them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import grid

FRACTIONS = (0.02, 0.03, 0.04, 0.06, 0.08, 0.1, 0.12)
LEAST_POINTS = 40


def _near(mask):
    """mask or any of its eight neighbours, for images (images, rows, columns)."""
    import numpy as np

    p = np.pad(mask, ((0, 0), (1, 1), (1, 1)))
    p = p[:, :-2] | p[:, 1:-1] | p[:, 2:]
    return p[:, :, :-2] | p[:, :, 1:-1] | p[:, :, 2:]


def components(mask):
    """Runs of set pixels of images (images, rows, columns) in order, as their first places and those after them, and the first run of each one's component.

    Places count a blank row and a blank column more an image, so that nothing touches across a border. Runs that touch take the lesser of their
    components' first runs, until all agree.
    """
    import numpy as np

    n, h, w = mask.shape
    wide = w + 1
    p = np.zeros((n, h + 1, wide), "i1")
    p[:, :h, :w] = mask
    ends = np.nonzero(np.diff(p.ravel(), prepend=0))[0]
    start, stop = ends[::2], ends[1::2]
    low, high = np.searchsorted(stop, start + wide - 1, "right"), np.searchsorted(start, stop + wide, "right")  # those below that touch
    many = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(start)), many)
    b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    first = np.arange(len(start))
    while (first[a] != first[b]).any():
        one, other = first[a], first[b]
        np.minimum.at(first, np.maximum(one, other), np.minimum(one, other))
        while (first[first] != first).any():
            first = first[first]
    return start, stop, first


def grow(classes):
    """Strong pixels (2) and the weak ones (1) that are connected to them, of one image or of images (images, rows, columns)."""
    import numpy as np

    c = classes if classes.ndim == 3 else classes[None]
    start, stop, first = components(c > 0)
    out = c > 0
    if len(start):
        strong = np.add.reduceat((c[out] == 2).astype(int), np.cumsum(stop - start) - (stop - start))
        out[out] = np.repeat((np.bincount(first, strong) > 0)[first], stop - start)
    return out.reshape(classes.shape)


def labels(mask):
    """Component of each set pixel (the least index in it), -1 elsewhere."""
    import numpy as np

    start, stop, first = components(mask[None])
    ids, size = np.full(mask.shape, -1), stop - start
    ids[mask] = np.repeat(np.nonzero(mask.ravel())[0][np.cumsum(size) - size][first], size)
    return ids


def hull(points):
    """Convex hull of (x, y) rows, anticlockwise in a y-down image, without points on its sides."""
    pts = sorted(set(map(tuple, points)))
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def chain(seq):
        out = []
        for p in seq:
            while len(out) >= 2 and turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return chain(pts) + chain(pts[::-1]) if len(pts) > 1 else pts


def _distance(p, a, b) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    long = dx * dx + dy * dy
    t = 0.0 if long < 1 else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / long))
    return ((p[0] - a[0] - t * dx) ** 2 + (p[1] - a[1] - t * dy) ** 2) ** 0.5


def simplify(ring, epsilon: float):
    """Corners of a closed ring that lie further than epsilon from the chords between kept ones; starts at its first point."""
    n = len(ring)
    far = max(range(1, n), key=lambda i: ((ring[i][0] - ring[0][0]) ** 2 + (ring[i][1] - ring[0][1]) ** 2, -i))
    keep, todo = {0, far}, [(0, far), (far, n)]
    while todo:
        a, b = todo.pop()
        inside = range(a + 1, min(b, n))
        if not inside:
            continue
        far = max(inside, key=lambda i: (_distance(ring[i], ring[a], ring[b % n]), -i))
        if _distance(ring[far], ring[a], ring[b % n]) > epsilon:
            keep.add(far)
            todo += [(a, far), (far, b)]
    return [ring[i] for i in sorted(keep)]


def four_corners(ring):
    """Four points for a hull: itself, its first simplification to four, or its extreme points; None for fewer than four."""
    if len(ring) < 4:
        return None
    if len(ring) > 4:
        around = sum(_distance(ring[i], ring[i - 1], ring[i - 1]) for i in range(len(ring)))
        for f in FRACTIONS:
            if len(found := simplify(ring, f * around)) == 4:
                return found
    if len(ring) == 4:
        return ring
    total, slope = (lambda p: p[0] + p[1]), (lambda p: p[0] - p[1])
    return [min(ring, key=total), max(ring, key=slope), max(ring, key=total), min(ring, key=slope)]


def contours(edges):
    """The quad of largest area among the contours of twice widened edges, for each of images (images, rows, columns); None without.

    Of each row of a component its ends suffice, as no other pixel is a corner of the hull.
    """
    import numpy as np

    def widen(m):
        out = np.zeros_like(m)
        if min(m.shape[1:]) > 2:
            out[:, 1:-1, 1:-1] = _near(m)[:, 1:-1, 1:-1]
        return out

    n, h, w = edges.shape
    start, stop, first = components(widen(widen(edges)))
    best, most = [None] * n, [0.0] * n
    big = (np.bincount(first, stop - start) >= LEAST_POINTS)[first]
    if not big.any():
        return best
    order = np.nonzero(big)[0][np.argsort(first[big], kind="stable")]
    label, row, left, right = first[order], start[order] // (w + 1), start[order] % (w + 1), (stop[order] - 1) % (w + 1)
    new = np.diff(label, prepend=-1) != 0
    begins = np.nonzero(new | (np.diff(row, prepend=-1) != 0))[0]  # the first run in each row of a component
    left, right = left[begins], right[np.append(begins[1:], len(order)) - 1]
    image, y, cuts = row[begins] // (h + 1), row[begins] % (h + 1), np.nonzero(new[begins])[0]
    total, slope = (lambda p: p[0] + p[1]), (lambda p: p[0] - p[1])
    for a, b in zip(cuts, [*cuts[1:], len(begins)], strict=True):
        ys, i = y[a:b].tolist(), image[a]
        if (corners := four_corners(hull([*zip(left[a:b].tolist(), ys, strict=True), *zip(right[a:b].tolist(), ys, strict=True)]))) is None:
            continue
        q = [min(corners, key=total), max(corners, key=slope), max(corners, key=total), min(corners, key=slope)]
        size = abs(sum(q[k][0] * q[(k + 1) % 4][1] - q[(k + 1) % 4][0] * q[k][1] for k in range(4))) / 2
        if size > most[i]:
            most[i], best[i] = size, [float(c) for p in q for c in p]
    return best


def contour(edges):
    """contours() of one image."""
    return contours(edges[None])[0]


def with_edges(images: DataFrame, drop: tuple[str, ...] = ("classes",)) -> DataFrame:
    """images (w, h, classes and others) with edges (array of booleans) and contour (quad or null), without the columns of drop; a missing image has no edges."""

    def find(batch):
        import numpy as np
        import pyarrow as pa

        edges, quads = [np.zeros(0, bool)] * batch.num_rows, [None] * batch.num_rows
        for at, classes in grid.alike(*map(batch.column, ("w", "h", "classes"))):
            grown = grow(classes)
            for i, e, q in zip(at, grown, contours(grown), strict=True):
                edges[i], quads[i] = e.ravel(), q
        return [pa.array(edges, pa.list_(pa.bool_())), pa.array(quads, pa.list_(pa.float64()))]

    return grid.found(images, "edges array<boolean>, contour array<double>", find, drop)
