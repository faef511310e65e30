"""A table of finished stages: rows are only added, the latest of a stage counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The stages in order, and the samples wanted for each dataset and length.
STAGES = ("generated", "trajectories", "converted", "filtered", "merged")
WANTED = 2500


def record(manifest: DataFrame | None, dataset: str, length: int, stage: str, samples: int | None, file: str | None, at: str, spark) -> DataFrame:
    """``manifest`` with one more row; an unknown stage is an error."""
    if stage not in STAGES:
        raise ValueError(f"unknown stage: {stage}")
    row = spark.createDataFrame([(dataset, length, stage, samples, file)], "dataset string, length int, stage string, samples bigint, file string").withColumn("updated_at", F.lit(at).cast("timestamp"))
    return row if manifest is None else manifest.unionByName(row)


def latest(manifest: DataFrame) -> DataFrame:
    """The last row of each dataset, length and stage."""
    order = W.partitionBy("dataset", "length", "stage").orderBy(F.col("updated_at").desc(), F.col("samples").desc_nulls_last(), F.col("file").desc_nulls_last())
    return manifest.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def status(manifest: DataFrame, expected: DataFrame) -> DataFrame:
    """dataset, length, status, current_stage, samples (of the filtered stage) for every expected dataset and length."""
    done = latest(manifest).groupBy("dataset", "length").agg(
        F.max(F.col("stage") == "merged").alias("merged"), F.max_by("stage", F.struct("updated_at", "stage")).alias("current_stage"), F.max(F.when(F.col("stage") == "filtered", F.col("samples"))).alias("samples"), F.count("*").alias("stages")
    )
    state = F.when(F.col("merged"), "complete").when(F.col("stages") > 0, "in_progress").otherwise("pending")
    return expected.join(done, ["dataset", "length"], "left").select("dataset", "length", state.alias("status"), F.coalesce("current_stage", F.lit("-")).alias("current_stage"), F.coalesce("samples", F.lit(0)).alias("samples"))


def roll_up(states: DataFrame) -> DataFrame:
    """One row: complete, in_progress, pending, total, percent_complete."""
    out = states.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("complete", "in_progress", "pending")], F.count("*").alias("total"))
    return out.withColumn("percent_complete", F.bround(100 * F.col("complete") / F.col("total"), 1))


def paired(existing: DataFrame, incremental: DataFrame) -> DataFrame:
    """dataset, length and the two files where both sides have one."""
    return existing.select("dataset", "length", F.col("file").alias("existing_file")).join(incremental.select("dataset", "length", F.col("file").alias("incremental_file")), ["dataset", "length"])
