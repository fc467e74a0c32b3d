"""Incremental ingestion of landing files: each file once, whatever the number of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrylake.contracts import raw_event_schema
from quarrylake.sources.landing import with_identity


def landing_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Raw records of files as they land, with lineage and identity. A rewritten path isn't read again."""
    rows = spark.readStream.schema(raw_event_schema()).option("header", True).option("pathGlobFilter", "*.csv").csv(folder)
    rows = rows.select(*rows.columns, F.current_timestamp().alias("_ingested_at"), F.col("_metadata.file_path").alias("_source_file"))
    return with_identity(rows)


def ingest(spark: SparkSession, folder: str, bronze: str, checkpoint: str) -> StreamingQuery:
    """Appends what landed since the last run to the bronze table and ends. The checkpoint is the memory of what was read: incremental files and backfills share it."""
    stream = landing_stream(spark, folder).writeStream.format("parquet").outputMode("append")
    return stream.option("checkpointLocation", checkpoint).option("path", bronze).trigger(availableNow=True).start()
