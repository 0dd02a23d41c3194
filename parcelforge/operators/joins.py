"""Join helpers whose choice rests on a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType


def row_bytes(df: DataFrame) -> F.Column:
    """About how many bytes a row takes in memory: its texts, nested values as written, eight for any other."""
    out = F.lit(16)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        text = c if isinstance(f.dataType, StringType) else F.to_json(c) if isinstance(f.dataType, ArrayType | MapType | StructType) else None
        out = out + (F.lit(8) if text is None else F.coalesce(F.octet_length(text), F.lit(0)) + 8)
    return out


def bounded(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 64 << 20) -> DataFrame:
    """`df` marked for broadcast if it has at most max_rows rows of max_bytes together; beyond, Spark chooses a shuffled join.
    `df` is read once for the count, so a costly one is materialised before."""
    met = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if met["n"] <= max_rows and met["b"] <= max_bytes else df
