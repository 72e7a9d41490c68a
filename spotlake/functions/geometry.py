"""Column expressions of wafer and image geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(c: Column | str) -> Column:
    """The value, null where it is NaN or infinite."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def wafer_coordinates(x_px, y_px, center_x, center_y, mm_per_px) -> dict[str, Column]:
    """Pixel to wafer coordinates: y points up, the angle runs counter-clockwise in [0, 360)."""
    x = (col(x_px) - col(center_x)) * col(mm_per_px)
    y = -(col(y_px) - col(center_y)) * col(mm_per_px)
    return {"x_mm": x, "y_mm": y, **polar(x, y)}


def polar(x_mm, y_mm) -> dict[str, Column]:
    x, y = col(x_mm), col(y_mm)
    return {"radial_distance_mm": F.hypot(x, y), "polar_angle_deg": F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))}


def edge_distance_mm(radius_px, radial_px, mm_per_px) -> Column:
    """Signed distance to the fitted circle, positive inside."""
    return (col(radius_px) - col(radial_px)) * col(mm_per_px)


def pixel_scale(diameter_mm, radius_px) -> dict[str, Column]:
    mm = F.try_divide(col(diameter_mm), 2 * col(radius_px))
    return {"mm_per_px": mm, "cm_per_px": mm / 10, "pixel_area_cm2": (mm / 10) * (mm / 10)}


def disc_area_cm2(diameter_mm) -> Column:
    return math.pi * F.pow(col(diameter_mm) / 20, F.lit(2.0))


def to_global(box: Column | str, x0, y0) -> Column:
    """A tile-local box (x0, y0, x1, y1) in image coordinates."""
    b = col(box)
    return F.array(b[0] + col(x0), b[1] + col(y0), b[2] + col(x0), b[3] + col(y0))


def box_or_around(box: Column | str, x, y, diameter, least: float = 1.0) -> Column:
    """The box if it has four values, else the square of half width max(least, diameter / 2) around the centre."""
    half = F.greatest(F.lit(float(least)), F.coalesce(present(diameter), F.lit(0.0)) / 2)
    around = F.array(F.floor(col(x) - half), F.floor(col(y) - half), F.ceil(col(x) + half), F.ceil(col(y) + half))
    return F.when(F.size(col(box)) == 4, F.transform(col(box), lambda v: v.cast("bigint"))).otherwise(around)


def true_box(box: Column | str) -> Column:
    """The box as doubles, or null if it has not four finite values or no area; nothing is put in its place."""
    b = F.transform(col(box), lambda v: v.cast("double"))
    sound = (F.size(b) == 4) & F.forall(b, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v)) & (F.get(b, F.lit(2)) > F.get(b, F.lit(0))) & (F.get(b, F.lit(3)) > F.get(b, F.lit(1)))
    return F.when(sound, b)


def box_iou(a: Column | str, b: Column | str) -> Column:
    """Intersection over union of half-open boxes; 0 where they do not meet or have no area."""
    a, b = col(a), col(b)
    wide = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])).cast("double")
    high = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1])).cast("double")
    size = lambda c: ((c[2] - c[0]) * (c[3] - c[1])).cast("double")
    common = wide * high
    return F.coalesce(F.try_divide(common, size(a) + size(b) - common), F.lit(0.0))


def circularity(area, perimeter) -> Column:
    """4 pi A / P^2, not clipped at 1; null without a perimeter."""
    return F.try_divide(4 * math.pi * col(area), col(perimeter) * col(perimeter))


def aspect_ratio(major, minor) -> Column:
    """Infinite where the minor axis vanishes."""
    return F.when(col(minor) > 1e-12, col(major) / col(minor)).otherwise(F.lit(float("inf")))


def field_index(x_mm, y_mm, radius_mm: float, field_mm: float) -> tuple[Column, Column, int]:
    """Column from the left, row from the top and the number of fields per side of a square grid over the wafer."""
    side = max(1, math.ceil(2 * radius_mm / field_mm))
    clip = lambda c: F.greatest(F.lit(0), F.least(c, F.lit(side - 1))).cast("int")
    return clip(F.floor((col(x_mm) + radius_mm) / field_mm)), clip(F.floor((radius_mm - col(y_mm)) / field_mm)), side


def map_pixel(v, full, preview) -> Column:
    """A pixel centre of a preview in the full image."""
    return (col(v) + 0.5) * col(full) / col(preview) - 0.5


def bin_of(value, low: float, high: float, bins: int) -> Column:
    """Bin number of equal-width half-open bins whose last is closed; null outside."""
    v = col(value)
    raw = F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1))
    return F.when((v >= low) & (v <= high), raw).cast("int")
