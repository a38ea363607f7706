"""Page files that keep arriving: each micro-batch is redacted and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kpimill.operators.masking import redact_by_patterns

PAGE_SCHEMA = "doc_id string, page_no int, text string"


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def redact_stream(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Redacts pages as they arrive.  It only maps rows, so a batch needs no state; the file sink keeps each once."""
    pages = redact_by_patterns(page_stream(spark, folder)).withColumn("seen", F.current_timestamp())
    return pages.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
