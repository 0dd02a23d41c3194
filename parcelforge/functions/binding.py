"""Ways to have Catalyst evaluate a costly expression once a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` bound to a lambda variable, so that naming it several times doesn't copy its expression."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """`withColumns`, behind a one-row generator: later filters on the new columns are not pushed below it, which would
    compute them a second time."""
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    out = df.select("*", packed)
    return out.select(*df.columns, *[F.col(f"_once.{n}").alias(n) for n in columns])
