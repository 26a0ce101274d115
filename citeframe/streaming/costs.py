"""Cost totals over a query log that is still being appended to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.costs import cost_by_model, with_cost
from ..sources.querylog import SCHEMA, measured_calls, readable


def cost_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Per-model summary of the log so far, equal to the batch summary once all files are read.

    State is one row per model.
    """
    lines = (
        spark.readStream.schema(SCHEMA).option("mode", "PERMISSIVE")
        .option("maxFilesPerTrigger", files_per_trigger).json(path)
    )
    return cost_by_model(with_cost(measured_calls(readable(lines))))


def keep_latest(summary: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Rewrites ``target`` (Parquet, a row per model) after every trigger."""

    def replace(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).coalesce(1).write.mode("overwrite").parquet(target)

    return (
        summary.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(replace).start()
    )
