"""Pixel boxes: scaling, padding, gates, and text zones that no table covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Least area of a contour, least size of a zone, least share of a page for a table, share that counts as covered.
LEAST_CONTOUR, ZONE_WIDTH, ZONE_HEIGHT = 500, 250, 60
TABLE_AREA, TABLE_WIDTH = 0.03, 0.2
COVERED = 0.5


def scaled(x: Column, factor: Column) -> Column:
    """Multiplied, cut towards zero."""
    return (x * factor).cast("int")


def padded(df: DataFrame, padding: int, width: int, height: int) -> DataFrame:
    """(.., x0, y0, x1, y1): boxes with a margin, clamped to the image."""
    return df.withColumns(
        {
            "x0": F.greatest(F.lit(0), F.col("x") - padding),
            "y0": F.greatest(F.lit(0), F.col("y") - padding),
            "x1": F.least(F.lit(width), F.col("x") + F.col("w") + padding),
            "y1": F.least(F.lit(height), F.col("y") + F.col("h") + padding),
        }
    )


def zones(boxes: DataFrame) -> DataFrame:
    """Boxes large enough for a zone of text."""
    return boxes.where((F.col("w") * F.col("h") >= LEAST_CONTOUR) & (F.col("w") >= ZONE_WIDTH) & (F.col("h") >= ZONE_HEIGHT))


def table_regions(boxes: DataFrame, width: int, height: int) -> DataFrame:
    return boxes.where((F.col("w") * F.col("h") >= TABLE_AREA * width * height) & (F.col("w") >= TABLE_WIDTH * width))


def uncovered(boxes: DataFrame, tables: DataFrame) -> DataFrame:
    """Boxes of which no table of their page covers half; the share is of the box, and touching edges don't overlap."""
    t = tables.select("doc_id", "page_no", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("w").alias("tw"), F.col("h").alias("th"))
    across = F.least(F.col("x") + F.col("w"), F.col("tx") + F.col("tw")) - F.greatest("x", "tx")
    down = F.least(F.col("y") + F.col("h"), F.col("ty") + F.col("th")) - F.greatest("y", "ty")
    same = (boxes.doc_id == t.doc_id) & (boxes.page_no == t.page_no)
    return boxes.join(t, same & (across > 0) & (down > 0) & (across * down >= COVERED * F.col("w") * F.col("h")), "left_anti")
