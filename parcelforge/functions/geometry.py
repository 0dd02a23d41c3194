"""Boxes and rings of geographic features as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelforge.functions.binding import let

# Fixed value: largest area of a box that is asked for, in square degrees.
MAX_AREA = 0.1


def outer_ring(kind: Column, coordinates: Column) -> Column:
    """Outer ring of the first polygon, array of [x, y]; null for other kinds."""
    polygon = F.from_json(coordinates, "array<array<array<double>>>")
    multi = F.from_json(coordinates, "array<array<array<array<double>>>>")
    return F.when(kind == "Polygon", F.try_element_at(polygon, F.lit(1))).when(kind == "MultiPolygon", F.try_element_at(F.try_element_at(multi, F.lit(1)), F.lit(1)))


def envelope(ring: Column) -> Column:
    """struct(min_x, min_y, max_x, max_y) of a ring; null without points."""
    at = lambda k: F.transform(ring, lambda p: p[k])
    box = F.struct(F.array_min(at(0)).alias("min_x"), F.array_min(at(1)).alias("min_y"), F.array_max(at(0)).alias("max_x"), F.array_max(at(1)).alias("max_y"))
    return F.when(F.size(ring) > 0, box)


def coordinate_text(x: Column) -> Column:
    """A number in full, without an exponent: the fewest digits that tell it apart, one after the point at least."""
    plain = F.regexp_replace(x.cast("decimal(38,20)").cast("string"), r"0+$", "")
    return F.when((x == 0) | ((F.abs(x) >= 1e-3) & (F.abs(x) < 1e7)), x.cast("string")).otherwise(plain)


def bbox_text(ring: Column) -> Column:
    """`min_x,min_y,max_x,max_y` in full."""
    return let(envelope(ring), lambda b: F.when(b.isNotNull(), F.concat_ws(",", *[coordinate_text(b[k]) for k in ("min_x", "min_y", "max_x", "max_y")])))


def parse_bbox(text: Column) -> Column:
    """struct of four doubles out of `a,b,c,d`; null unless there are four numbers. An empty part is 0."""
    parts = F.transform(F.split(text, ","), lambda p: F.when(F.trim(p) == "", F.lit(0.0)).otherwise(F.trim(p).try_cast("double")))
    return let(parts, lambda p: F.when((F.size(p) == 4) & ~F.exists(p, lambda x: x.isNull()), F.struct(p[0].alias("min_x"), p[1].alias("min_y"), p[2].alias("max_x"), p[3].alias("max_y"))))


def adjust_bbox(min_x: Column, min_y: Column, max_x: Column, max_y: Column, max_area: float = MAX_AREA) -> Column:
    """The box, shrunk about its centre to max_area if it is larger; null if its corners are the wrong way round."""
    area = (max_x - min_x) * (max_y - min_y)
    k = F.when(area > max_area, F.sqrt(F.lit(max_area) / area)).otherwise(F.lit(1.0))

    def side(low: Column, high: Column, sign: int) -> Column:
        shrunk = (low + high) / 2 + sign * (high - low) * k / 2
        return F.when(area > max_area, shrunk).otherwise(low if sign < 0 else high)

    box = F.struct(side(min_x, max_x, -1).alias("min_x"), side(min_y, max_y, -1).alias("min_y"), side(min_x, max_x, 1).alias("max_x"), side(min_y, max_y, 1).alias("max_y"))
    return F.when((min_x < max_x) & (min_y < max_y), box)


def boxes_meet(a_min_x, a_min_y, a_max_x, a_max_y, b_min_x, b_min_y, b_max_x, b_max_y) -> Column:  # noqa: ANN001
    return (a_min_x <= b_max_x) & (a_max_x >= b_min_x) & (a_min_y <= b_max_y) & (a_max_y >= b_min_y)


def basic_auth(user: Column, password: Column) -> Column:
    return F.base64(F.encode(F.concat(user, F.lit(":"), password), "UTF-8"))
