"""Extension: the same scoring on a stream, and windowed counts with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from braidflow.operators import scoring, serving
from braidflow.operators.models import LinearPairs


def read(spark: SparkSession, path: str, schema: StructType, files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def verdicts(rows: DataFrame, model: LinearPairs) -> DataFrame:
    """row_id, x -> the classifier's verdicts; stateless, so it runs on streams and batches alike."""
    return serving.plain(scoring.score(rows, model)).select("row_id", "predicted_class", "predicted_label", "confidence")


def counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """ts, event_type, value -> windowed counts and sums; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def each_batch(stream: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]):
    """Every micro-batch, transformed, to its own folder: a batch that is run again replaces its own result."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
