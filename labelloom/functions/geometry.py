"""Box and polygon column expressions.

Boxes are four double columns ``x1,y1,x2,y2`` (optionally prefixed); polygons
are ``ARRAY<STRUCT<x DOUBLE, y DOUBLE>>``.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

POINTS = "array<struct<x:double,y:double>>"
BOX = ("x1", "y1", "x2", "y2")


def finite(c: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def box_ok(p: str = "") -> Column:
    """Four finite coordinates with positive width and height.

    A side length that is positive and below infinity proves both its ends
    finite (NaN sorts above infinity), which keeps the predicate short enough to
    be compiled with whatever it is pushed into.
    """
    w, h = F.col(p + "x2") - F.col(p + "x1"), F.col(p + "y2") - F.col(p + "y1")
    inf = F.lit(float("inf"))
    return (w > 0) & (w < inf) & (h > 0) & (h < inf)


def box_area(p: str = "") -> Column:
    """Area of a box, 0 for an inverted one."""
    w = F.greatest(F.lit(0.0), F.col(p + "x2") - F.col(p + "x1"))
    h = F.greatest(F.lit(0.0), F.col(p + "y2") - F.col(p + "y1"))
    return w * h


def iou_of(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> Column:
    """Intersection over union of two usable boxes given as eight columns."""
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(ax2, bx2) - F.greatest(ax1, bx1)) * F.greatest(
        zero, F.least(ay2, by2) - F.greatest(ay1, by1))
    return inter / ((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter)


def iou(pa: str, pb: str, checked: bool = False) -> Column:
    """IoU of the boxes with column prefixes ``pa`` and ``pb``; 0 for unusable boxes unless ``checked``."""
    names = ("x1", "y1", "x2", "y2")
    value = iou_of(*[F.col(pa + c) for c in names], *[F.col(pb + c) for c in names])
    return value if checked else F.when(box_ok(pa) & box_ok(pb), value).otherwise(0.0)


def _next_points(poly: Column) -> Column:
    n = F.size(poly)
    return F.concat(F.slice(poly, 2, F.greatest(n - 1, F.lit(0))), F.slice(poly, 1, 1))


def shoelace(poly: Column) -> Column:
    """Unsigned polygon area; 0 below three points."""
    terms = F.zip_with(poly, _next_points(poly), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    return F.when(F.size(poly) < 3, F.lit(0.0)).otherwise(F.abs(total) / 2)


def perimeter(poly: Column) -> Column:
    """Closed polygon length; 0 below three points."""
    sides = F.zip_with(poly, _next_points(poly), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))
    total = F.aggregate(sides, F.lit(0.0), lambda acc, t: acc + t)
    return F.when(F.size(poly) < 3, F.lit(0.0)).otherwise(total)


def compactness(poly: Column) -> Column:
    """Isoperimetric quotient 4*pi*A/P^2 in [0, 1]; 0 for areas up to one pixel."""
    a, p = shoelace(poly), perimeter(poly)
    q = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 4 * F.pi() * a / (p * p)))
    return F.when((a <= 1.0) | (p <= 0.0), F.lit(0.0)).otherwise(q)


def _hull_area(xs: np.ndarray, ys: np.ndarray) -> float:
    """Area of the convex hull, by walking the lower and upper chains."""
    pts = np.unique(np.stack([xs, ys], axis=1), axis=0)
    if len(pts) < 3:
        return -1.0

    def chain(seq: np.ndarray) -> list[np.ndarray]:
        kept: list[np.ndarray] = []
        for p in seq:
            while len(kept) > 1:
                u, v = kept[-1] - kept[-2], p - kept[-2]
                if u[0] * v[1] - u[1] * v[0] > 0:
                    break
                kept.pop()
            kept.append(p)
        return kept[:-1]

    hull = np.array(chain(pts) + chain(pts[::-1]))
    if len(hull) < 3:
        return 0.0
    nxt = np.roll(hull, -1, axis=0)
    return abs(float(np.sum(hull[:, 0] * nxt[:, 1] - nxt[:, 0] * hull[:, 1]))) / 2


def _next_in_row(lengths: np.ndarray) -> np.ndarray:
    """Index of the following point of the same polygon, cyclic, for points stored row after row."""
    ends = np.cumsum(lengths)
    nxt = np.arange(1, int(ends[-1]) + 1 if len(ends) else 1)
    full = lengths > 0
    nxt[ends[full] - 1] = (ends - lengths)[full]
    return nxt


def _ring(x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Area and length of every ring; 0 below three points."""
    rows, nxt, n = np.repeat(np.arange(len(lengths)), lengths), _next_in_row(lengths), len(lengths)
    area = np.abs(np.bincount(rows, x * y[nxt] - x[nxt] * y, n)) / 2
    length = np.bincount(rows, np.hypot(x[nxt] - x, y[nxt] - y), n)
    short = lengths < 3
    area[short] = length[short] = 0.0
    return area, length


def _without_repeats(x, y, lengths):
    """Points without consecutive repeats and without a closing copy of the first point."""
    rows, n = np.repeat(np.arange(len(lengths)), lengths), len(lengths)
    first = np.zeros(len(x), dtype=bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    keep = first | (x != np.roll(x, 1)) | (y != np.roll(y, 1))
    x, y, rows = x[keep], y[keep], rows[keep]
    counts = np.bincount(rows, minlength=n)
    ends = np.cumsum(counts)
    closed = np.flatnonzero(counts > 2)
    same = (x[ends[closed] - 1] == x[(ends - counts)[closed]]) & (y[ends[closed] - 1] == y[(ends - counts)[closed]])
    gone = ends[closed[same]] - 1
    return np.delete(x, gone), np.delete(y, gone), np.bincount(np.delete(rows, gone), minlength=n)


def _span(v: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Extent of the values of each row and their number of distinct values at one decimal."""
    n = len(lengths)
    rows = np.repeat(np.arange(n), lengths)
    order = np.lexsort((v, rows))
    v = v[order]
    full = lengths > 0
    ends = np.cumsum(lengths)
    width = np.zeros(n)
    width[full] = v[ends[full] - 1] - v[(ends - lengths)[full]]
    tenth = np.round(v, 1)
    new = np.ones(len(v), dtype=bool)
    new[1:] = (tenth[1:] != tenth[:-1]) | (rows[1:] != rows[:-1])
    return width, np.bincount(rows, new, n).astype("int64")


def _concave(x, y, lengths):
    """Rows whose outline turns both ways or does not wind exactly once, so that the hull must be computed."""
    rows, nxt, n = np.repeat(np.arange(len(lengths)), lengths), _next_in_row(lengths), len(lengths)
    dx, dy = x[nxt] - x, y[nxt] - y
    turn = dx * dy[nxt] - dx[nxt] * dy
    both = (np.bincount(rows, turn > 0, n) > 0) & (np.bincount(rows, turn < 0, n) > 0)
    # The turning angles of an outline that winds once add up to one revolution.
    turned = np.bincount(rows, np.arctan2(turn, dx * dx[nxt] + dy * dy[nxt]), n)
    return both | (np.abs(np.abs(turned) - 2 * np.pi) > 1e-6)


OUTLINE = StructType([
    *[StructField(c, LongType()) for c in ("n", "clean_n", "nx", "ny")],
    *[StructField(c, DoubleType()) for c in ("area", "length", "clean_area", "w", "h", "hull")]])


@F.arrow_udf(OUTLINE)
def outline_stats(polys: pa.Array) -> pa.Array:
    """Measures of polygons, a whole Arrow batch at a time.

    Area and length of the polygon as given; point count, area, extent and
    distinct coordinates after dropping repeats; hull area (its own area when
    convex). Array functions give the same numbers but run interpreted, about
    twenty times slower.
    """
    missing = polys.is_null().to_numpy(zero_copy_only=False)
    flat = polys.flatten()
    lengths = np.where(missing, 0, polys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype("int64")
    x, y = (flat.field(i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 1))
    area, length = _ring(x, y, lengths)
    cx, cy, kept = _without_repeats(x, y, lengths)
    clean_area, _ = _ring(cx, cy, kept)
    (w, nx), (h, ny) = _span(cx, kept), _span(cy, kept)
    hull, starts = area.copy(), np.cumsum(lengths) - lengths
    for i in np.flatnonzero(_concave(x, y, lengths)):
        hull[i] = _hull_area(x[starts[i]:starts[i] + lengths[i]], y[starts[i]:starts[i] + lengths[i]])
    cols = {"n": lengths, "clean_n": kept, "nx": nx, "ny": ny, "area": area, "length": length,
            "clean_area": clean_area, "w": w, "h": h, "hull": hull}
    arrays = [pa.array(cols[f.name], pa.int64() if isinstance(f.dataType, LongType) else pa.float64(), mask=missing)
              for f in OUTLINE]
    return pa.StructArray.from_arrays(arrays, names=[f.name for f in OUTLINE])


def convexity(area: Column, hull: Column) -> Column:
    """Area over hull area in [0, 1]; 1 for hulls up to one pixel, 0 for areas up to one pixel."""
    return (
        F.when(area <= 1.0, 0.0)
        .when(hull <= 1.0, 1.0)
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), area / hull)))
    )


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row: as a variable of a lambda it is read as often as ``use`` likes.

    An expression that a lambda refers to is computed again for every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def drop_repeats(poly: Column) -> Column:
    """Polygon without consecutive repeats and without a closing copy of the first point."""
    def opened(kept: Column) -> Column:
        closed = (F.size(kept) > 2) & (F.element_at(kept, 1) == F.element_at(kept, -1))
        return F.when(closed, F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)

    kept = _once(poly, lambda whole: F.filter(whole, lambda p, i: (i == 0) | (p != F.get(whole, i - 1))))
    return _once(kept, opened)


def extent(poly: Column) -> Column:
    """Bounds and the numbers of distinct x and y (at one decimal) of the points, in one struct."""
    xs, ys = F.transform(poly, lambda q: q["x"]), F.transform(poly, lambda q: q["y"])

    def distinct(vals: Column) -> Column:
        return F.size(F.array_distinct(F.transform(vals, lambda v: F.bround(v, 1))))

    return F.struct(
        (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"),
        distinct(xs).alias("nx"), distinct(ys).alias("ny"))


def crude_from(n: Column, area: Column, w: Column, h: Column, nx: Column, ny: Column, p: str = "") -> Column:
    """True when a cleaned polygon is missing or is only its box in disguise.

    Rules: fewer than three points, area up to one pixel, at most two distinct x
    and y, 4-5 points covering 85 percent or up to 8 points covering 90 percent
    of the annotation's box or of the polygon's own extent.
    """
    own = F.greatest(F.lit(1.0), w * h)
    given = F.greatest(F.lit(1.0), F.col(p + "x2") - F.col(p + "x1")) * F.greatest(
        F.lit(1.0), F.col(p + "y2") - F.col(p + "y1"))
    fill = area / F.least(given, own)
    return (
        F.when(n.isNull() | (n < 3), True)
        .when(area <= 1.0, True)
        .when((nx <= 2) & (ny <= 2), True)
        .when(n.isin(4, 5) & (fill >= 0.85), True)
        .when((n <= 8) & (fill >= 0.90), True)
        .otherwise(False)
    )


def crude_box(poly: Column, p: str = "") -> Column:
    """``crude_from`` over array functions, for occasional use."""
    clean = drop_repeats(poly)
    e = extent(clean)
    return crude_from(F.when(poly.isNotNull(), F.size(clean)), shoelace(clean), e["w"], e["h"], e["nx"], e["ny"], p)


def spiky(n_points: Column, q: Column, c: Column) -> Column:
    """Spiky outline: six or more points with very low compactness, or low compactness and convexity."""
    return (n_points >= 6) & ((q < 0.15) | ((c < 0.35) & (q < 0.30)))


def ramp(value: Column, low: float = 0.05, high: float = 0.20) -> Column:
    """0 up to ``low``, 1 from ``high``, linear between; 0 for unusable numbers."""
    return (
        F.when(~finite(value) | (value <= low), 0.0)
        .when(value >= high, 1.0)
        .otherwise((value - low) / (high - low))
    )


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def flat_to_points(flat: Column, digits: int = 2) -> Column:
    """``[x0,y0,x1,y1,...]`` to points; null below three points."""
    idx = F.sequence(F.lit(0), F.size(flat) - 2, F.lit(2))
    pts = F.transform(idx, lambda i: point(F.bround(F.get(flat, i), digits), F.bround(F.get(flat, i + 1), digits)))
    return F.when(F.size(flat) >= 6, pts)


def ellipse_points(p: str = "", n: int = 8, scale: float = 0.9) -> Column:
    """``n`` points of the ellipse inside the box, rounded to two decimals."""
    cx, cy = (F.col(p + "x1") + F.col(p + "x2")) / 2, (F.col(p + "y1") + F.col(p + "y2")) / 2
    rx, ry = (F.col(p + "x2") - F.col(p + "x1")) / 2 * scale, (F.col(p + "y2") - F.col(p + "y1")) / 2 * scale
    step = 2 * 3.141592653589793 / n
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: point(F.bround(cx + rx * F.cos(i * step), 2), F.bround(cy + ry * F.sin(i * step), 2)))


def clean_polygon(poly: Column, p: str = "") -> Column:
    """Repeats dropped; an ellipse in the box when fewer than three points remain."""
    # Without a polygon the clean one is null too.
    return _once(drop_repeats(poly), lambda clean: F.when(clean.isNotNull() & (F.size(clean) >= 3), clean).otherwise(ellipse_points(p)))


# Labels whose synthetic outline is a chamfered parcel, and the
# fractions that shape the canopy and parcel outlines.
PARCEL_WORDS = "field|farm|agri|crop|parcel|cropland"
CANOPY_BASE, CANOPY_SWING, CANOPY_TURN = 0.94, 0.04, 1.5
PARCEL_NEAR, PARCEL_FAR = 0.08, 0.12


def _canopy(p: str) -> Column:
    x1, y1, x2, y2 = (F.col(p + c) for c in ("x1", "y1", "x2", "y2"))
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    rx, ry = F.greatest(F.lit(1.0), x2 - x1) / 2, F.greatest(F.lit(1.0), y2 - y1) / 2

    def at(i):
        mod = CANOPY_BASE + CANOPY_SWING * F.sin(i * CANOPY_TURN)
        turn = i * (3.141592653589793 / 4)
        return point(
            F.greatest(x1, F.least(x2, F.bround(cx + rx * mod * F.cos(turn), 2))),
            F.greatest(y1, F.least(y2, F.bround(cy + ry * mod * F.sin(turn), 2))))

    return F.transform(F.sequence(F.lit(0), F.lit(7)), at)


def _parcel(p: str) -> Column:
    x1, y1, x2, y2 = (F.col(p + c) for c in ("x1", "y1", "x2", "y2"))
    w, h = F.greatest(F.lit(1.0), x2 - x1), F.greatest(F.lit(1.0), y2 - y1)
    corners = [
        (x1 + PARCEL_NEAR * w, y1), (x2 - PARCEL_NEAR * w, y1), (x2, y1 + PARCEL_FAR * h), (x2, y2 - PARCEL_NEAR * h),
        (x2 - PARCEL_FAR * w, y2), (x1 + PARCEL_NEAR * w, y2), (x1, y2 - PARCEL_FAR * h), (x1, y1 + PARCEL_NEAR * h)]
    return F.array(*[point(F.bround(x, 2), F.bround(y, 2)) for x, y in corners])


def sanitize_polygons(df: DataFrame, out: str = "outline", poly: str = "polygon", label: str = "label", p: str = "") -> DataFrame:
    """Add ``out``: a simple outline inside the box.

    Finite points are clamped to the box at two decimals, made unique and put in
    angular order around their mean. When fewer than three remain or the area is
    at most half a pixel, a canopy outline (a parcel for field-like labels) or
    the box itself is used. Each array step is a column of its own, so it is
    computed once per row.
    """
    x1, y1, x2, y2 = (F.col(p + c) for c in ("x1", "y1", "x2", "y2"))
    usable = F.filter(poly, lambda q: finite(q["x"]) & finite(q["y"]))
    inside = F.array_distinct(F.transform(usable, lambda q: point(
        F.greatest(x1, F.least(x2, F.bround(q["x"], 2))), F.greatest(y1, F.least(y2, F.bround(q["y"], 2))))))
    row = df.withColumn("_in", inside)
    n = F.size("_in")
    row = row.withColumn("_mx", F.aggregate("_in", F.lit(0.0), lambda a, q: a + q["x"]) / n).withColumn(
        "_my", F.aggregate("_in", F.lit(0.0), lambda a, q: a + q["y"]) / n)
    row = row.withColumn("_keyed", F.array_sort(F.transform("_in", lambda q, i: F.struct(
        F.atan2(q["y"] - F.col("_my"), q["x"] - F.col("_mx")).alias("t"), i.alias("i"), q["x"].alias("x"), q["y"].alias("y")))))
    row = row.withColumn("_around", F.transform("_keyed", lambda k: point(k["x"], k["y"]))).withColumn(
        "_fits", F.col(poly).isNotNull() & (F.size(poly) >= 3) & (n >= 3) & (shoelace(F.col("_around")) > 0.5))
    parcel = F.lower(F.coalesce(F.col(label), F.lit(""))).rlike(PARCEL_WORDS)
    row = row.withColumn("_made", F.when(~F.coalesce("_fits", F.lit(False)), F.when(parcel, _parcel(p)).otherwise(_canopy(p))))
    box = F.array(*[point(F.bround(x, 2), F.bround(y, 2)) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))])
    done = F.when(F.col("_fits"), F.col("_around")).when(shoelace(F.col("_made")) > 0.5, F.col("_made")).otherwise(box)
    return row.withColumn(out, done).drop("_in", "_mx", "_my", "_keyed", "_around", "_fits", "_made")


def crossing_edges(df: DataFrame, key: list[str], poly: str = "polygon") -> DataFrame:
    """Keys of polygons with two non-adjacent edges that meet. A narrow job: no join, no shuffle."""
    return df.where(self_crossing(F.col(poly))).select(*key)


def _meeting_edges(pts: np.ndarray) -> np.ndarray:
    """For polygons of equal size, shape (polygons, points, 2): whether two non-adjacent edges meet."""
    n = pts.shape[1]
    i, j = np.triu_indices(n, 2)
    apart = ~((i == 0) & (j == n - 1))
    i, j = i[apart], j[apart]
    ends = np.roll(pts, -1, axis=1)
    a, b, c, d = pts[:, i], ends[:, i], pts[:, j], ends[:, j]

    def turn(p, q, r):
        return (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])

    def on(t, p, q, r):
        return (t == 0) & np.all((np.minimum(p, q) <= r) & (r <= np.maximum(p, q)), axis=-1)

    t1, t2, t3, t4 = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    proper = (np.sign(t1) * np.sign(t2) < 0) & (np.sign(t3) * np.sign(t4) < 0)
    return (proper | on(t1, a, b, c) | on(t2, a, b, d) | on(t3, c, d, a) | on(t4, c, d, b)).any(axis=1)


@F.arrow_udf(BooleanType())
def self_crossing(polys: pa.Array) -> pa.Array:
    """True when two non-adjacent edges of a polygon meet.

    Polygons of equal size are tested together, in blocks of about a million edge pairs.
    """
    missing = polys.is_null().to_numpy(zero_copy_only=False)
    lengths = np.where(missing, 0, polys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype("int64")
    flat = polys.flatten()
    xy = np.stack([flat.field(k).to_numpy(zero_copy_only=False).astype(float) for k in (0, 1)], axis=1)
    starts, out = np.cumsum(lengths) - lengths, np.zeros(len(lengths), dtype=bool)
    for n in np.unique(lengths[lengths > 3]):
        rows = np.flatnonzero(lengths == n)
        step = max(1, 1_000_000 // int(n * n))
        for k in range(0, len(rows), step):
            block = rows[k:k + step]
            out[block] = _meeting_edges(xy[starts[block][:, None] + np.arange(n)])
    return pa.array(out)


def _filled(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, cols: np.ndarray, rows: np.ndarray, base: np.ndarray, size: int) -> np.ndarray:
    """Even-odd fill of many outlines at pixel centres, one flat mask for all.

    Outline i has a grid of ``rows`` by ``cols`` + 1 cells from ``base`` on. Every edge marks, in each row
    whose centre line it crosses, the first column beyond the crossing; a running parity along the
    row fills the inside. A row has an even number of marks, so it ends at zero.
    """
    shape, nxt = np.repeat(np.arange(len(lengths)), lengths), _next_in_row(lengths)
    low, high = np.minimum(y, y[nxt]), np.maximum(y, y[nxt])
    first = np.clip(np.ceil(low - 0.5), 0, rows[shape]).astype(np.int64)
    count = np.clip(np.ceil(high - 0.5), 0, rows[shape]).astype(np.int64) - first
    edge = np.repeat(np.arange(len(x)), count)
    row = np.arange(len(edge)) - np.repeat(np.cumsum(count) - count, count) + first[edge]
    to = nxt[edge]
    cross = x[edge] + (row + 0.5 - y[edge]) * (x[to] - x[edge]) / (y[to] - y[edge])
    wide = cols[shape[edge]]
    column = np.clip(np.ceil(cross - 0.5), 0, wide).astype(np.int64)
    marks = np.bincount(base[shape[edge]] + row * (wide + 1) + column, minlength=size)
    return (np.cumsum(marks) & 1).astype(bool)


def _flat(polys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    points = polys.flatten()
    lengths = polys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
    return *(points.field(i).to_numpy(zero_copy_only=False).astype(float) for i in (0, 1)), lengths


# Pairs drawn at a time, so that their masks stay within a few tens of megabytes.
_DRAWN = 128


@F.arrow_udf(DoubleType())
def outline_overlap(a: pa.Array, b: pa.Array, x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array, grid: pa.Array) -> pa.Array:
    """IoU of two outlines drawn inside a box on a grid of at most ``grid`` cells per side; null without both."""
    x1, y1, x2, y2, grid = (v.to_numpy(zero_copy_only=False).astype(float) for v in (x1, y1, x2, y2, grid))
    missing = a.is_null().to_numpy(zero_copy_only=False) | b.is_null().to_numpy(zero_copy_only=False)
    out = np.zeros(len(x1))
    w, h = np.ceil(x2 - x1), np.ceil(y2 - y1)
    scale = np.minimum(1.0, grid / np.maximum(np.maximum(w, h), 1.0))
    cols, rows = (np.maximum(1, np.rint(v * scale)).astype(np.int64) for v in (w, h))
    todo = np.flatnonzero(~missing & (w > 0) & (h > 0))
    for lo in range(0, len(todo), _DRAWN):
        part = todo[lo:lo + _DRAWN]
        c, r, s = cols[part], rows[part], scale[part]
        cells = r * (c + 1)
        base, size = np.cumsum(cells) - cells, int(cells.sum())
        masks = []
        for polys in (a, b):
            px, py, n = _flat(polys.take(pa.array(part)))
            owner = np.repeat(np.arange(len(part)), n)
            masks.append(_filled((px - x1[part][owner]) * s[owner], (py - y1[part][owner]) * s[owner], n, c, r, base, size))
        both, either = (np.add.reduceat(m.astype(np.int64), base) for m in (masks[0] & masks[1], masks[0] | masks[1]))
        out[part] = np.where(either > 0, both / np.maximum(either, 1), 0.0)
    return pa.array(out, mask=missing)


def outline_iou(a: Column, b: Column, grid: int = 256) -> Column:
    """IoU of the outlines ``a`` and ``b`` of the boxes a_ and b_ inside their joint box; that of the boxes without both outlines.

    Pixels whose centre lies on an edge may differ from other rasterisers.
    """
    joint = [F.least("a_x1", "b_x1"), F.least("a_y1", "b_y1"), F.greatest("a_x2", "b_x2"), F.greatest("a_y2", "b_y2")]
    drawn = outline_overlap(a, b, *[c.cast("double") for c in joint], F.lit(float(grid)))
    return F.coalesce(drawn, iou("a_", "b_"))


def raster_iou(df: DataFrame, grid: int = 256) -> DataFrame:
    """Add ``raster_iou`` of polygons ``a_poly`` and ``b_poly``."""
    return df.withColumn("raster_iou", outline_iou(F.col("a_poly"), F.col("b_poly"), grid))
