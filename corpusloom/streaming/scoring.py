"""Streaming forms of scoring and step statistics (an addition: the batch forms are the reference for results)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, score

ROLLOUT = "id string, pos int, text string, golds array<string>, at timestamp"


def read_rollouts(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Rollouts as they arrive as JSON lines files."""
    return spark.readStream.schema(ROLLOUT).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def scored(rollouts: DataFrame) -> DataFrame:
    """Each rollout with its answer and rewards; stateless."""
    rows = score.with_rewards(rollouts.withColumn("extracted_answer", extract.think_answer(F.col("text"))))
    return rows.withColumn("f1", score.rounded(F.col("f1")))


def windowed_scores(events: DataFrame, width: str = "1 day", late: str = "1 day", key: str = "event_id") -> DataFrame:
    """Mean score by window and class of events (key, ts, cls, score); repeats within the watermark count once."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    return once.groupBy(F.window("ts", width), "cls").agg(F.avg("score").alias("avg_score"), F.count("*").alias("n"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Process what is there now and stop; a rerun goes on where it stopped."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
