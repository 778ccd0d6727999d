"""Boxes and rectangles as Column expressions. A box is a struct (x, y, w, h), a rectangle (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x="x", y="y", w="w", h="h") -> Column:
    c = lambda v: (F.col(v) if isinstance(v, str) else v).cast("double")
    return F.struct(c(x).alias("x"), c(y).alias("y"), c(w).alias("w"), c(h).alias("h"))


def box_area(b: Column) -> Column:
    """Negative sides count as none."""
    zero = F.lit(0.0)
    return F.greatest(b["w"], zero) * F.greatest(b["h"], zero)


def _overlap(lo1, hi1, lo2, hi2) -> Column:
    return F.greatest(F.least(hi1, hi2) - F.greatest(lo1, lo2), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 if the union is empty."""
    both = _overlap(a["x"], a["x"] + a["w"], b["x"], b["x"] + b["w"]) * _overlap(a["y"], a["y"] + a["h"], b["y"], b["y"] + b["h"])
    union = box_area(a) + box_area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def rect(x1, y1, x2, y2) -> Column:
    return F.struct(*[(F.col(v) if isinstance(v, str) else v).cast("double").alias(n) for n, v in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))])


def box_to_rect(b: Column) -> Column:
    return rect(b["x"], b["y"], b["x"] + b["w"], b["y"] + b["h"])


def rect_to_box(x1, y1, x2, y2) -> Column:
    """Corner form to box form."""
    return box(x1, y1, x2 - x1, y2 - y1)


def rect_overlap(a: Column, b: Column) -> Column:
    """Shared area; touching rectangles share none."""
    return _overlap(a["x1"], a["x2"], b["x1"], b["x2"]) * _overlap(a["y1"], a["y2"], b["y1"], b["y2"])


def occupancy(r: Column, boxes: Column) -> Column:
    """Largest share of rectangle ``r`` that one of the rectangles in array ``boxes`` covers; 0 without any or if
    ``r`` has no area."""
    area = (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    most = F.array_max(F.transform(boxes, lambda b: rect_overlap(r, b)))
    return F.when((area > 0) & most.isNotNull(), most / area).otherwise(F.lit(0.0))


def clamp_box(b: Column, width, height) -> Column:
    """Pixel rectangle of a box inside an image; coordinates are cut towards zero before they are clamped."""
    low = lambda v: F.greatest(F.lit(0), v.cast("int"))
    high = lambda v, m: F.least(F.lit(m) if not isinstance(m, Column) else m, v.cast("int"))
    return F.struct(low(b["x"]).alias("x1"), low(b["y"]).alias("y1"), high(b["x"] + b["w"], width).alias("x2"), high(b["y"] + b["h"], height).alias("y2"))


def crop_box(b: Column, width, height, margin: float = 0.05, smallest: int = 4) -> Column:
    """Box grown by a share of its sides on all of them, as a pixel rectangle; null if a side is below ``smallest``."""
    grown = box(b["x"] - b["w"] * margin, b["y"] - b["h"] * margin, b["w"] * (1 + 2 * margin), b["h"] * (1 + 2 * margin))
    r = clamp_box(grown, width, height)
    return F.when((r["x2"] - r["x1"] >= smallest) & (r["y2"] - r["y1"] >= smallest), r)


def scaled(b: Column, sx, sy=None) -> Column:
    sy = sx if sy is None else sy
    return box(b["x"] * sx, b["y"] * sy, b["w"] * sx, b["h"] * sy)


def interval_overlap(s1, e1, s2, e2) -> Column:
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0.0))


def interval_iou(s1, e1, s2, e2) -> Column:
    """Overlap of two intervals over their union; 0 if the union is empty."""
    both = interval_overlap(s1, e1, s2, e2)
    union = F.greatest(e1 - s1, F.lit(0.0)) + F.greatest(e2 - s2, F.lit(0.0)) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))
