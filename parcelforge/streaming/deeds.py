"""Row-local operators on a stream of deeds: an addition, there is no batch state to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parcelforge.functions.files import detected_act, with_filename

DEED = "doc_id bigint, filename string, text string, received_at timestamp"


def deed_stream(spark: SparkSession, path: str, files_a_trigger: int = 64) -> DataFrame:
    """New Parquet files of deeds under a folder, each deed once within a day of its arrival, with what its file name and text say."""
    rows = spark.readStream.schema(DEED).option("maxFilesPerTrigger", files_a_trigger).parquet(path)
    once = rows.withWatermark("received_at", "1 day").dropDuplicatesWithinWatermark(["doc_id"])
    code, label = detected_act(F.coalesce("text", F.lit("")))
    return with_filename(once).withColumn("document_type", F.coalesce("document_type", code)).withColumn("document_type_label", label)


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet folder, each row exactly once; what has arrived is written, then the query ends."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
