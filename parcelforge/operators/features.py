"""Geographic features asked for by box, commune or layer, with the columns and the number of features wanted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.functions import geometry as G
from parcelforge.functions.text import null_if_empty

# Features returned where no number is asked for.
MOST_FEATURES, MOST_OF_COMMUNE = 1_000, 5_000

Box = tuple[float, float, float, float]
CORNERS = ("min_x", "min_y", "max_x", "max_y")


def limited(df: DataFrame, most: int | None, order: Sequence[str]) -> DataFrame:
    """The first `most` rows in an order that must tell all rows apart, so that the same ones come on every run; None keeps all. Each
    task keeps its first rows only, so nothing is sorted as a whole."""
    if most is None:
        return df
    if most < 0:
        raise ValueError(f"a number of features below 0: {most}")
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(most)


def with_envelope(features: DataFrame) -> DataFrame:
    """`features` with the corners of the outer ring of their geometry, null without one. Written with the table once, the four columns
    let a scan skip row groups."""
    ring = G.outer_ring(F.col("geometry.type"), F.col("geometry.coordinates"))
    rows = features.withColumn("_e", F.explode(F.array(G.envelope(ring))))
    return rows.select(*features.columns, *[F.col(f"_e.{c}").alias(c) for c in CORNERS])


def _projected(df: DataFrame, columns: Sequence[str] | None, order: Sequence[str], most: int | None) -> DataFrame:
    got = limited(df, most, order)
    return got.select(*columns) if columns else got


def in_box(features: DataFrame, box: Box, columns: Sequence[str] | None = None, most: int | None = MOST_FEATURES, order: Sequence[str] = ("idu", "code_parcelle")) -> DataFrame:
    """Features (with corners) that meet a box, at most `most` of them in order; `columns` are those wanted, all by default. A box whose
    corners are the wrong way round is an error; features without a geometry meet none."""
    if not (box[0] <= box[2] and box[1] <= box[3]):
        raise ValueError(f"corners the wrong way round: {box}")
    meets = G.boxes_meet(*[F.col(c) for c in CORNERS], *map(F.lit, box))
    return _projected(features.where(meets), columns, order, most)


def of_commune(features: DataFrame, code: str, columns: Sequence[str] | None = None, most: int | None = MOST_OF_COMMUNE, order: Sequence[str] = ("idu", "code_parcelle")) -> DataFrame:
    """Features (with corners) within the envelope of a commune's own ones that belong to it or name no commune, at most `most` in order.
    The envelope is one row, met by an equality join on a constant; nothing comes to the driver."""
    low, high = [F.min(c).alias(f"_c_{c}") for c in CORNERS[:2]], [F.max(c).alias(f"_c_{c}") for c in CORNERS[2:]]
    box = features.where(F.col("code_insee") == code).agg(*low, *high).withColumn("_one", F.lit(1))
    rows = features.where(null_if_empty(F.col("code_insee")).isNull() | (F.col("code_insee") == code)).withColumn("_one", F.lit(1))
    met = rows.join(F.broadcast(box), "_one").where(G.boxes_meet(*[F.col(c) for c in CORNERS], *[F.col(f"_c_{c}") for c in CORNERS]))
    return _projected(met.select(*features.columns), columns, order, most)


def layer(features: DataFrame, equal: Mapping[str, object] | None = None, box: Box | None = None, columns: Sequence[str] | None = None, most: int | None = MOST_FEATURES, order: Sequence[str] = ()) -> DataFrame:
    """Rows of a layer whose columns equal the given values and, where a box is given, whose corners meet it. Values are literals of
    their column's type, so that they reach the scan and can't be read as an expression. `order` must tell rows apart; it is every
    column where none is given."""
    rows = features
    for name, value in (equal or {}).items():
        rows = rows.where(F.col(f"`{name}`") == F.lit(value))
    if box is not None:
        return in_box(rows, box, columns, most, order or rows.columns)
    return _projected(rows, columns, order or rows.columns, most)
