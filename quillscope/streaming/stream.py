"""A3: snippets arriving over time, each classified independently.

``detect`` keeps a file in its row and aggregates nothing, so it runs on the
streaming plan itself, in append mode and without state: planned once, and
committed once per batch by the file sink's own log in ``output_dir``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.detect import detect
from ..sources.files import snippets_from


def detect_stream(stream: DataFrame, output_dir: str, checkpoint: str, trigger_once: bool = False, **kw):
    """Start the streaming job over a streaming DataFrame of
    ``(file_id, code[, language])`` rows; returns the StreamingQuery.

    Results are Parquet in ``output_dir``; a reader of the folder sees the
    batches that were committed, each once, also after a restart."""
    writer = detect(snippets_from(stream), **kw).writeStream.format("parquet").outputMode("append").option("path", output_dir).option("checkpointLocation", checkpoint)
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def conversation_stream(spark: SparkSession, sf_dir: str, output_dir: str, checkpoint: str) -> DataFrame:
    """Conversation turns as a stream of JavaScript snippets (key: conv_id * 2^20 + turn)."""
    schema = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
    src = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
        .parquet(f"{sf_dir}/conversations.parque[t]")  # a file or a folder of files
    )
    snippets = src.select(
        (F.col("conv_id") * 2**20 + F.col("turn")).alias("file_id"), F.col("text").alias("code"),
        F.lit("javascript").alias("language"))
    q = detect_stream(snippets, output_dir, checkpoint, trigger_once=True)
    q.awaitTermination()
    return spark.read.parquet(output_dir)
