"""Readers. Every schema is declared, none inferred; rows keep what tells them apart (file, step)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

CORRUPT = "_corrupt_record"


def json_array(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Files that each hold one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One record per line; a bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lines_lenient(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): one record per line, bad lines set aside as text with their file."""
    raw = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    parsed = raw.withColumn("r", F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()
    return parsed.where(~bad).select("r.*").drop(CORRUPT), parsed.where(bad).select("file", F.col("value").alias("line"))


def by_extension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``.json``: an array, ``.jsonl``: lines; anything else is an error."""
    if path.endswith(".jsonl"):
        return json_lines(spark, path, schema)
    if path.endswith(".json"):
        return json_array(spark, path, schema)
    raise ValueError(f"unknown file type: {path}")


def parquet(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> DataFrame:
    """Parquet files; ``paths`` may be a list or several joined by colons after their schemes; ``recursive`` looks below them."""
    listed = [paths] if isinstance(paths, str) and "://" in paths else paths.split(":") if isinstance(paths, str) else paths
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", "*.parquet") if recursive else reader).parquet(*listed)


def csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """CSV with a header line; an index column is a column like others."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def with_file(rows: DataFrame) -> DataFrame:
    """Rows of a file source with the file's name, for sources named by a pattern."""
    return rows.select("*", F.col("_metadata.file_name").alias("file_name"))


def step_logs(spark: SparkSession, folder: str, steps: range) -> tuple[DataFrame, DataFrame]:
    """(rows, missing): the rows of ``global_step_{n}.json`` (a file, or a folder of files, by any first part of the name) with their step, and the steps that have none."""
    raw = spark.read.schema(schemas.STEP_LOG).option("multiLine", True).option("recursiveFileLookup", True).json(f"{folder}/*global_step_*.json")
    rows = raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"global_step_(\d+)\.json", 1).cast("long").alias("step"), "input", "score")
    rows = rows.where((F.col("step") >= steps.start) & (F.col("step") < steps.stop))
    expected = spark.range(steps.start, steps.stop).withColumnRenamed("id", "step")
    return rows, expected.join(rows.select("step").distinct(), "step", "left_anti")


def metrics(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """A long table of run metrics: run, step, key, value."""
    rows = parquet(spark, path).select("run", F.col("step").cast("long").alias("step"), "key", F.col("value").cast("double").alias("value"))
    return rows.where(F.col("key").isin(keys)) if keys else rows


def series(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """A small table written out in code, column by column."""
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(columns))


def expected_chunks(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected chunk names (column file_name) that no file has."""
    return expected.join(found.select("file_name").distinct(), "file_name", "left_anti")


def _paired(spark: SparkSession, path: str) -> DataFrame:
    from .adapters import paired

    return paired(json_array(spark, path, schemas.PAIRED_QUESTION))


def _paragraphs(spark: SparkSession, path: str) -> DataFrame:
    from .adapters import paragraphs

    return paragraphs(json_lines(spark, path, schemas.PARAGRAPH_QUESTION))


def _articles(spark: SparkSession, path: str) -> DataFrame:
    from .adapters import articles

    return articles(json_array(spark, path, schemas.ARTICLE_QUESTION))


#: Which reader a data set takes, by a part of its path, the first that fits.
ADAPTERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"hotpot": _paired, "musique": _paragraphs, "2wikimqa": _paired, "squad": _articles}


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a known data set: id, query, outputs, passages, supporting titles or positions; NotImplementedError for others."""
    for part, reader in ADAPTERS.items():
        if part in path:
            return reader(spark, path)
    raise NotImplementedError(f"{path} is not implemented")
