"""Geometry of boxes [x0, y0, x1, y1] and zones as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FOOT_CM = 30.48


def corner(box: Column, i: int) -> Column:
    return F.get(box, F.lit(i)).cast("double")


def is_box(box: Column) -> Column:
    """Four coordinates, none NULL."""
    return F.coalesce((F.size(box) >= 4) & ~F.exists(F.slice(box, 1, 4), lambda x: x.isNull()), F.lit(False))


def area(box: Column) -> Column:
    return F.greatest(corner(box, 2) - corner(box, 0), F.lit(0.0)) * F.greatest(corner(box, 3) - corner(box, 1), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for short or NULL boxes and for two empty ones."""
    w = F.least(corner(a, 2), corner(b, 2)) - F.greatest(corner(a, 0), corner(b, 0))
    h = F.least(corner(a, 3), corner(b, 3)) - F.greatest(corner(a, 1), corner(b, 1))
    inter = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = area(a) + area(b) - inter
    return F.when(is_box(a) & is_box(b) & (union > 0), inter / union).otherwise(0.0)


def translate(box: Column, dx: Column, dy: Column) -> Column:
    """Tile to image coordinates (or back with negative offsets); short boxes become NULL."""
    moved = F.array(corner(box, 0) + dx, corner(box, 1) + dy, corner(box, 2) + dx, corner(box, 3) + dy)
    return F.when(is_box(box), moved)


def to_xywh(box: Column) -> Column:
    moved = F.array(corner(box, 0), corner(box, 1), corner(box, 2) - corner(box, 0), corner(box, 3) - corner(box, 1))
    return F.when(is_box(box), moved)


def to_percent(xywh: Column, width: Column, height: Column) -> Column:
    """[x, y, w, h] in percent of an image."""
    return F.array(*[100.0 * F.get(xywh, F.lit(i)) / (width if i % 2 == 0 else height) for i in range(4)])


def expand(box: Column, by: Column, width: Column, height: Column) -> Column:
    """Grown by `by` pixels on all sides and clipped to the image."""
    grown = F.array(
        F.greatest(corner(box, 0) - by, F.lit(0.0)),
        F.greatest(corner(box, 1) - by, F.lit(0.0)),
        F.least(corner(box, 2) + by, width.cast("double")),
        F.least(corner(box, 3) + by, height.cast("double")),
    )
    return F.when(is_box(box), grown)


def feet_to_pixels(feet: float, gsd_cm: Column) -> Column:
    """Whole pixels, cut toward zero; 0 where the ground sample distance is not positive or unknown."""
    return F.when(gsd_cm > 0, (F.lit(feet) * FOOT_CM / gsd_cm).cast("int")).otherwise(0)


def zone_of_point(x: Column, y: Column, boxes: Sequence[tuple[str, Column]], outside: str | None = None) -> Column:
    """Name of the first box (innermost first) that holds the point, edges included; `outside` if none does."""
    out: Column | None = None
    for name, b in boxes:
        hit = is_box(b) & x.between(corner(b, 0), corner(b, 2)) & y.between(corner(b, 1), corner(b, 3))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(outside) if out is None else out.otherwise(F.lit(outside))


def zone_by_distance(dx: Column, dy: Column, limits: Sequence[tuple[str, Column]], slack: Column, outside: str | None = None) -> Column:
    """Name of the first limit that the distance, less the slack (half a tile), stays within."""
    d = F.sqrt(dx * dx + dy * dy) - slack
    out: Column | None = None
    for name, limit in limits:
        out = F.when(d <= limit, name) if out is None else out.when(d <= limit, name)
    return F.lit(outside) if out is None else out.otherwise(F.lit(outside))


def zone_by_height(mean_height: Column, above: float = 1.5, tall: str = "Zone_0", low: str = "Zone_1") -> Column:
    """Zone by the height at a tile's centre; no valid pixel counts as low."""
    return F.when(mean_height > above, tall).otherwise(low)


def stretched(value: Column, low: Column, high: Column) -> Column:
    """Linear stretch of low..high to 0..255, cut toward zero; 0 where the band is constant, NULL for NULL."""
    span = high - low
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(255.0), (value - low) / span * 255.0)).cast("int")
    return F.when(value.isNotNull(), F.when(span > 0, scaled).otherwise(0))
