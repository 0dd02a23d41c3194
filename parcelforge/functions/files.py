"""What a file's name says about a deed, and what its text says about the kind of act."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelforge.functions.text import normalize_match, null_if_empty

# Fixed format: site code, act type and date in a file name.
NAME_PATTERN = r"([0-9]{5})_([A-Za-z]{2,})_([0-9]{8})"

# Wording, code and label of each kind of act.
ACTS = ((r"\bBAIL\s+EMPHYTEOTIQUE\b", "BE", "BAIL EMPHYTEOTIQUE"),)


def file_stem(name: Column) -> Column:
    """Name without directories and without its last suffix."""
    base = F.substring_index(name, "/", -1)
    return F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)


def filename_parts(name: Column) -> Column:
    """struct(site_code, document_type, document_date, source_filename); the first three null when the name is off the pattern.
    The date is text: no calendar is asked."""
    part = lambda k: null_if_empty(F.regexp_extract(file_stem(name), NAME_PATTERN, k))
    day = part(3)
    return F.struct(
        part(1).alias("site_code"),
        F.upper(part(2)).alias("document_type"),
        F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2)).alias("_d"),
        F.substring_index(name, "/", -1).alias("source_filename"),
    )


def with_filename(df, column: str = "filename"):
    """`df` with site_code, document_type, document_date, source_filename."""
    p = filename_parts(F.col(column))
    return df.withColumn("_p", p).select(
        *df.columns, "_p.site_code", "_p.document_type", F.when(F.col("_p.site_code").isNotNull(), F.col("_p._d")).alias("document_date"), "_p.source_filename"
    )


def detected_act(text: Column) -> tuple[Column, Column]:
    """(code, label) of the first kind of act whose wording the text holds; a phrase may run over a line's end."""
    code, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    flat = normalize_match(text)
    for pattern, c, n in reversed(ACTS):
        code, label = F.when(flat.rlike(pattern), c).otherwise(code), F.when(flat.rlike(pattern), n).otherwise(label)
    return code, label
