"""Incremental ingestion: new record files become canonical rows, each key written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinweave.operators.canonical import canonical_tables
from kinweave.session import stage
from kinweave.sources.records import parse_lines
from kinweave.sources.sinks import merge_graph


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every new file below ``folder`` with their position."""
    lines = spark.readStream.text(folder)
    return lines.select(
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).alias("place"), "value"
    )


def merge_batch(batch: DataFrame, number: int, target: str) -> None:
    """First writer wins, across batches and within one; repeating a batch changes nothing."""
    ordered = batch.select(F.struct("place", F.monotonically_increasing_id().alias("row")).alias("doc_ord"), "value")
    records = stage(parse_lines(ordered).where(F.col("doc").isNotNull()), "batch")
    merge_graph(target, canonical_tables(records), number)


def start_ingest(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Process all files present, then stop; run again for later files."""
    return (
        read_stream(spark, folder).writeStream.foreachBatch(lambda df, number: merge_batch(df, number, target))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
