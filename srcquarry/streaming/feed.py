"""Chunks and slices of files that arrive as a stream of Parquet rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import row_id
from ..operators.slicing import prepare


def slice_stream(spark: SparkSession, path: str, schema: str, *, delay: str = "7 days") -> DataFrame:
    """Slices of a stream of chunks; a chunk delivered again within the watermark counts once."""
    chunks = spark.readStream.schema(schema).parquet(path)
    fresh = chunks.withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["chunk_id"])
    out = prepare(fresh)
    return out.withColumn("id", row_id(F.col("relative_path"), F.col("file_sha256"), F.concat_ws(":", "chunk_ordinal", "source_field", "char_start")))


def write_batches(stream: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None):
    """Each micro-batch goes to a folder named by its number, so a batch that is run again replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        (transform(batch) if transform else batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
