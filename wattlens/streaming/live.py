"""Live panels: the batch definitions of case state and activity, kept up to date from appended event files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wattlens.operators.ops import latest


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Event files as they are appended to a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def latest_case_events(events: DataFrame) -> DataFrame:
    """Newest event per case; the state holds one row per case."""
    return latest(events, "case_id", "event_time")


def start_panel(state: DataFrame, target: str, checkpoint: str, every: str = "6 seconds") -> StreamingQuery:
    """Write the panel's table after every batch as a version of its own, as often as the pages look at it.

    A version counts once its number stands in the list of finished ones, so a reader never meets a half-written table
    and a failed batch changes nothing. There is no watermark: the state holds one row per case and cases never expire.
    """
    def publish(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/versions/{number}")
        done = batch.sparkSession.range(1).select(F.lit(number).cast("long").alias("version"))
        done.coalesce(1).write.mode("append").parquet(f"{target}/finished")

    return (state.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
            .trigger(processingTime=every).foreachBatch(publish).start())


def read_panel(spark: SparkSession, target: str) -> DataFrame:
    """The newest finished version of the panel's table."""
    newest = spark.read.parquet(f"{target}/finished").agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{target}/versions/{newest}")
