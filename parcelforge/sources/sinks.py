"""Text and JSON sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the rule between a document's record and its text.
RULE = "=" * 72


def json_text(record: Column) -> Column:
    """A record as JSON text; nulls are kept and non-ASCII characters stay as they are."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def headed_text(record: Column, text: Column) -> Column:
    """The record, a rule, and the document's text."""
    return F.concat(json_text(record), F.lit("\n" + RULE + "\n\n"), F.coalesce(text, F.lit("")))


def write_texts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """One folder a document, its text in UTF-8; an earlier run's files are replaced."""
    df.select(F.col(text).alias("value"), F.col(key).alias("_key")).write.mode("overwrite").partitionBy("_key").text(path)


def write_records(df: DataFrame, path: str) -> None:
    """Records as JSON lines, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
