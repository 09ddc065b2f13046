"""Geometry on the globe and in a camera's view."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
#: Usual widths of vehicles in metres, and of any other kind.
WIDTH_M, OTHER_WIDTH_M = {"car": 1.75, "motorcycle": 0.8, "bus": 2.55, "truck": 2.5, "van": 1.9, "auto_rickshaw": 1.4}, 1.75
#: The eight compass points from north, clockwise.
COMPASS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = F.sin(F.radians(lat2 - lat1) / 2)
    across = F.sin(F.radians(lon2 - lon1) / 2)
    h = half * half + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * across * across
    return 2 * EARTH_M * F.asin(F.sqrt(h))


def path_length_m(points: Column) -> Column:
    """Length of an array of (lat, lon) arrays."""
    legs = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points), F.lit(1))), lambda a, b: F.when(b.isNotNull(), haversine_m(a[0], a[1], b[0], b[1])).otherwise(0.0))
    return F.aggregate(legs, F.lit(0.0), lambda s, x: s + x)


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    d = F.radians(lon2 - lon1)
    a, b = F.radians(lat1), F.radians(lat2)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + 360, F.lit(360.0))


def compass(degrees: Column) -> Column:
    at = F.floor((F.pmod(degrees, F.lit(360.0)) + 22.5) / 45) % 8
    return F.element_at(F.array(*[F.lit(x) for x in COMPASS]), (at + 1).cast("int"))


def opposite(degrees: Column) -> Column:
    return F.pmod(degrees + 180, F.lit(360.0))


def planar_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a plane scaled by the cosine of the mean latitude: close for city distances."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return F.hypot(x, y) * EARTH_M


def box_iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes (x1, y1, x2, y2) as intersection over union."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.try_divide(w * h, area(a) + area(b) - w * h)


def fitted_speed_kmh(t: Column, x: Column, z: Column, least_samples: int = 3, least_span_s: float = 0.4) -> Column:
    """Aggregate: speed from least-squares slopes of ground positions over time; null with too few samples or too short a span."""
    enough = (F.count(t) >= least_samples) & (F.max(t) - F.min(t) >= least_span_s)
    return F.when(enough, F.hypot(F.regr_slope(x, t), F.regr_slope(z, t)) * 3.6)


def ground_m(cx: Column, bottom: Column, box_width: Column, kind: Column, frame_width: float, focal_px: float | None = None) -> Column:
    """(x, z) in metres of a box's foot before a pinhole camera, by the width that its kind of vehicle usually has."""
    focal = focal_px or frame_width
    width = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in WIDTH_M.items() for v in pair]), kind), F.lit(OTHER_WIDTH_M))
    z = focal * width / F.greatest(box_width, F.lit(1.0))
    return F.struct(((cx - frame_width / 2) * z / focal).alias("x"), z.alias("z"))


def ground_by_homography(cx: Column, bottom: Column, h: list[list[float]]) -> Column:
    """(x, z) in metres of a box's foot by a homography of the image to the ground, given as three rows."""
    row = lambda r: cx * r[0] + bottom * r[1] + r[2]
    w = row(h[2])
    return F.struct(F.try_divide(row(h[0]), w).alias("x"), F.try_divide(row(h[1]), w).alias("z"))


def lane(cx: Column, cy: Column, frame: tuple[float, float], vanishing: tuple[float, float], bounds: list[float]) -> Column:
    """Lane from 1 of a point in the image: followed from the vanishing point (as a share of the frame) to the bottom row.

    ``bounds`` are the lanes' edges there, as shares of the width; points beyond them are of the outer lanes. Null above
    the vanishing point.
    """
    width, height = frame
    vx, vy = vanishing[0] * width, vanishing[1] * height
    share = (vx + (cx - vx) * (height - vy) / (cy - vy)) / width
    inner = sum((F.when(share >= b, 1).otherwise(0) for b in bounds[1:-1]), F.lit(1))
    return F.when(cy > vy + 1, inner)
