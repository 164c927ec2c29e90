"""Contours as arrays of points struct<x, y> (C11, C12, E9, E10, G3, M4), projective maps (M5), sharpness of pixel arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.vectors import bound

# The limits that results depend on.
MIN_AREA_SHARE = 0.14
SIDE_RATIO = (0.58, 0.82)
WHOLE_IMAGE_RATIO = (0.62, 0.78)


def _first_by(points: Column, key, largest: bool) -> Column:  # noqa: ANN001
    """The point with the least or largest key; of equal ones the first."""
    keyed = F.transform(points, lambda p, i: F.struct((-key(p) if largest else key(p)).alias("k"), i.alias("i"), p.alias("p")))
    return F.array_min(keyed)["p"]


def ordered_corners(points: Column) -> Column:
    """Top left, top right, bottom right, bottom left."""
    total, difference = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(_first_by(points, total, False), _first_by(points, difference, False), _first_by(points, total, True), _first_by(points, difference, True))


def _length(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def side_ratio(corners: Column) -> Column:
    """Shorter over longer mean side of ordered corners (E10); null for a point."""
    tl, tr, br, bl = (F.get(corners, F.lit(k)) for k in range(4))
    across, along = (_length(tl, tr) + _length(bl, br)) / 2, (_length(tl, bl) + _length(tr, br)) / 2
    return F.try_divide(F.least(across, along), F.greatest(across, along))


def area(points: Column) -> Column:
    """Shoelace area of a contour of any number of points in turn; 0 for fewer than three."""
    n = F.size(points)
    crossed = F.transform(points, lambda p, i: p["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * p["y"])
    return F.abs(F.aggregate(crossed, F.lit(0.0), lambda total, c: total + c)) / 2


def perimeter(points: Column) -> Column:
    """Length of a closed contour."""
    n = F.size(points)
    return F.aggregate(F.transform(points, lambda p, i: _length(p, F.get(points, (i + 1) % n))), F.lit(0.0), lambda total, d: total + d)


#: Share of a contour's length within which its simplified form must keep.
SIMPLIFY_SHARE = 0.025
_CONTOUR = "array<struct<x: double, y: double>>"


def simplified_rows(xs: np.ndarray, ys: np.ndarray, sizes: np.ndarray, share: float) -> np.ndarray:
    """Which points of closed contours stay, for all contours (rows, padded to one width) at once.

    A contour is opened at the point farthest from its first one and at the point farthest from that; between
    two points that stay, the point farthest from their segment stays too if it is farther than ``share`` of the contour's
    length, until none is.  Of equally far points the first counts.
    """
    rows, width = xs.shape
    at = np.arange(width)
    inside = at[None, :] < sizes[:, None]
    following = np.where(at[None, :] + 1 < sizes[:, None], at[None, :] + 1, 0)
    take = lambda m, i: np.take_along_axis(m, i, 1)
    step = np.hypot(take(xs, following) - xs, take(ys, following) - ys)
    limit = share * np.where(inside, step, 0).sum(1)

    def farthest(i: np.ndarray) -> np.ndarray:
        d = np.hypot(xs - take(xs, i[:, None]), ys - take(ys, i[:, None]))
        return np.where(inside, d, -1).argmax(1)

    one = farthest(np.zeros(rows, int))
    other = farthest(one)
    kept = np.zeros((rows, width), bool)
    some = sizes > 0
    kept[some, one[some]] = kept[some, other[some]] = True
    while True:
        # The points that stay before and behind every point, around the contour.
        index = np.where(kept, at[None, :], -1)
        before = np.maximum.accumulate(index, 1)
        last = index.max(1, keepdims=True)
        before = np.where(before < 0, last, before)
        index = np.where(kept, at[None, :], width)
        behind = np.minimum.accumulate(index[:, ::-1], 1)[:, ::-1]
        first = index.min(1, keepdims=True)
        behind = np.where(behind >= width, first, behind)
        before, behind = np.clip(before, 0, width - 1), np.clip(behind, 0, width - 1)
        ax, ay, bx, by = take(xs, before), take(ys, before), take(xs, behind), take(ys, behind)
        dx, dy = bx - ax, by - ay
        along = dx * dx + dy * dy
        with np.errstate(invalid="ignore", divide="ignore"):
            t = np.where(along > 0, np.clip(((xs - ax) * dx + (ys - ay) * dy) / along, 0, 1), 0)
        apart = np.where(inside & ~kept, np.hypot(xs - ax - t * dx, ys - ay - t * dy), -1)
        far = apart > limit[:, None]
        if not far.any():
            return kept
        # One point for each stretch between two that stay: the farthest, the first of equals around the contour.
        r, i = np.nonzero(far)
        place = np.where(i >= before[r, i], i - before[r, i], i - before[r, i] + width)
        order = np.lexsort((place, -apart[r, i], before[r, i], r))
        r, i = r[order], i[order]
        start = np.concatenate([[True], (r[1:] != r[:-1]) | (before[r[1:], i[1:]] != before[r[:-1], i[:-1]])])
        kept[r[start], i[start]] = True


def simplify(points: Column, share: float = SIMPLIFY_SHARE) -> Column:
    """A closed contour's corners, in its order (M4): splits at the farthest points, over whole Arrow batches; null stays null."""

    @F.arrow_udf(_CONTOUR)
    def run(column: pa.Array) -> pa.Array:
        flat, offsets = column.flatten(), np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)))
        sizes = np.diff(offsets)
        kept = np.zeros(len(flat), bool)
        # Contours of like size share a matrix, so that a long one does not widen all.
        for grade in np.unique(np.ceil(np.log2(np.maximum(sizes, 1)))):
            rows = np.flatnonzero(np.ceil(np.log2(np.maximum(sizes, 1))) == grade)
            width = max(1, int(sizes[rows].max()))
            index = np.minimum(offsets[rows][:, None] + np.arange(width)[None, :], max(len(flat) - 1, 0))
            if not len(flat):
                continue
            x, y = (flat.field(axis).to_numpy(zero_copy_only=False)[index] for axis in ("x", "y"))
            inside = np.arange(width)[None, :] < sizes[rows][:, None]
            found = simplified_rows(np.where(inside, x, 0), np.where(inside, y, 0), sizes[rows], share)
            kept[index[inside & found]] = True
        ends = np.append(0, np.cumsum(kept))[offsets]
        made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat.filter(pa.array(kept)))
        return pc.if_else(column.is_valid(), made, pa.scalar(None, made.type))

    return run(points.cast(_CONTOUR))


def _adjugate(m: list[Column]) -> list[Column]:
    """Of a matrix of three rows, all nine numbers; the inverse but for a factor."""
    a, b, c, d, e, f, g, h, i = m
    return [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]


def _scaled(numbers: list[Column]) -> Column:
    """Nine numbers with 1 as the last; null where that is 0."""
    return F.when(numbers[8] != 0, F.array(*[F.try_divide(x, numbers[8]) for x in numbers]))


def with_homography(df: DataFrame, corners: str, width: float, height: float, name: str = "homography") -> DataFrame:
    """df with the projective map from ordered corners to the rectangle from (0, 0) to (width, height), as nine numbers row by row (M5).

    Closed form: the map from the unit square to the corners has its perspective terms from two cross products; its
    adjugate maps back, and the rectangle scales it.  The last number is 1.  Null where three corners lie on a line.
    Steps are columns of their own, so that each is made once and in generated code.
    """
    at = [f"_{axis}{k}" for k in range(4) for axis in "xy"]
    out = df.withColumns({f"_{axis}{k}": F.get(corners, F.lit(k))[axis] for k in range(4) for axis in "xy"})
    x0, y0, x1, y1, x2, y2, x3, y3 = (F.col(c) for c in at)
    dx1, dx2, dx3 = x1 - x2, x3 - x2, x0 - x1 + x2 - x3
    dy1, dy2, dy3 = y1 - y2, y3 - y2, y0 - y1 + y2 - y3
    cross = dx1 * dy2 - dx2 * dy1
    out = out.withColumns({"_g": F.try_divide(dx3 * dy2 - dx2 * dy3, cross), "_h": F.try_divide(dx1 * dy3 - dx3 * dy1, cross)})
    g, h = F.col("_g"), F.col("_h")
    out = out.withColumns({"_a": x1 - x0 + g * x1, "_b": x3 - x0 + h * x3, "_d": y1 - y0 + g * y1, "_e": y3 - y0 + h * y3})
    back = _adjugate([F.col("_a"), F.col("_b"), x0, F.col("_d"), F.col("_e"), y0, g, h, F.lit(1.0)])
    numbers = [x * width for x in back[:3]] + [x * height for x in back[3:6]] + back[6:]
    return out.withColumn(name, _scaled(numbers)).drop(*at, "_g", "_h", "_a", "_b", "_d", "_e")


def inverse(matrix: Column) -> Column:
    """The inverse of a map of nine numbers, with 1 as its last; null where it has none."""
    return _scaled(_adjugate([F.get(matrix, F.lit(k)) for k in range(9)]))


def mapped(matrix: Column, x: Column, y: Column) -> Column:
    """Where a map takes a point, as struct<x, y>; null parts where it goes to infinity."""
    m = [F.get(matrix, F.lit(k)) for k in range(9)]
    w = m[6] * x + m[7] * y + m[8]
    return F.struct(F.try_divide(m[0] * x + m[1] * y + m[2], w).alias("x"), F.try_divide(m[3] * x + m[4] * y + m[5], w).alias("y"))


def is_convex(points: Column) -> Column:
    """Whether all four turns go one way."""
    p = [F.get(points, F.lit(k)) for k in range(4)]
    turns = []
    for k in range(4):
        a, b, c = p[k], p[(k + 1) % 4], p[(k + 2) % 4]
        turns.append((b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"]))
    return (F.least(*turns) >= 0) | (F.greatest(*turns) <= 0)


def plausible(points: Column, image_area: Column, corners: Column | None = None) -> Column:
    """Whether a contour may be a card: large enough, four corners, convex, card-like sides (C11).  ``corners`` are its ordered corners, where a column has them."""
    ratio = bound(ordered_corners(points), side_ratio) if corners is None else side_ratio(corners)
    good = (area(points) >= image_area * MIN_AREA_SHARE) & is_convex(points) & ratio.between(*SIDE_RATIO)
    return F.when(F.size(points) == 4, F.coalesce(good, F.lit(False))).otherwise(F.lit(False))


def whole_image_is_card(width: Column, height: Column) -> Column:
    """Whether the whole picture has a card's shape."""
    ratio = F.try_divide(F.least(width, height).cast("double"), F.greatest(width, height).cast("double"))
    return F.coalesce(ratio.between(*WHOLE_IMAGE_RATIO), F.lit(False))


def largest_contours(contours: Column, keep: int = 2) -> Column:
    """The ``keep`` contours of largest area, largest first; of equal ones the earlier first."""
    keyed = F.transform(contours, lambda c, i: F.struct((-area(c)).alias("a"), i.alias("i"), c.alias("c")))
    return F.transform(F.slice(F.array_sort(keyed), 1, keep), lambda k: k["c"])


def laplacian_variance(pixels: Column, width: int) -> Column:
    """Variance of the four-neighbour Laplacian of a grey image, given row by row (E8); null for fewer than two rows or columns.

    Beyond an edge the image is mirrored about its outermost pixels.
    """
    w, n = F.lit(width), F.size(pixels)
    at = lambda i: F.get(pixels, i).cast("double")

    def response(i: Column) -> Column:
        left, right = F.when(i % w == 0, i + 1).otherwise(i - 1), F.when(i % w == w - 1, i - 1).otherwise(i + 1)
        up, down = F.when(i < w, i + w).otherwise(i - w), F.when(i >= n - w, i - w).otherwise(i + w)
        return at(left) + at(right) + at(up) + at(down) - at(i) * 4

    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda total, x: total + x) / n

    def variance(responses: Column) -> Column:
        return bound(mean(responses), lambda m: mean(F.transform(responses, lambda x: (x - m) * (x - m))))

    return F.when((n >= 2 * w) & (w >= 2) & (n % w == 0), bound(F.transform(F.sequence(F.lit(0), n - 1), response), variance))
