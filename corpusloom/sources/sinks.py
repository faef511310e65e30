"""Writers and output names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ascii_json(rows: DataFrame) -> DataFrame:
    """value: each row as JSON (nulls kept) in ASCII alone, other characters as the ``\\uXXXX`` of their UTF-16 code units."""
    line = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    escaped = F.transform(F.split(F.col("line"), ""), lambda c: F.when(F.ascii(c) < 128, c).otherwise(F.lower(F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "(.{4})", r"\\u$1"))))
    plain = rows.select(line.alias("line"))
    return plain.select(F.when(F.col("line").rlike(r"[^\x00-\x7f]"), F.array_join(escaped, "")).otherwise(F.col("line")).alias("value"))


def json_lines(rows: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "errorifexists", ascii_only: bool = False) -> None:
    """One JSON record per line (UTF-8, or ASCII with escapes; nulls kept), in a folder for each value of ``by``."""
    if ascii_only:
        if by:
            raise ValueError("ASCII lines are written to one folder")
        return ascii_json(rows).write.mode(mode).text(path)
    writer = rows.write.mode(mode).option("ignoreNullFields", False)
    (writer.partitionBy(*by) if by else writer).json(path)


def parquet(rows: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    writer = rows.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).option("header", True).csv(path)


def summary(row: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-row table as one JSON file."""
    row.coalesce(1).write.mode(mode).json(path)


def reused(spark: SparkSession, path: str, make) -> DataFrame:
    """What is at ``path`` if a job finished there, else the result of ``make()``, written there first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def output_stem(stem: str, tag: str, suffix: str) -> str:
    """The name up to ``max_seq_N``, then tag and suffix; ValueError if there is no such part."""
    found = re.match(r"(.*max_seq_\d+)", stem)
    if not found:
        raise ValueError(f"no max_seq_N in {stem}")
    return f"{found[1]}-{tag}-{suffix}"


def output_stems(stem: Column, tag: str, suffix: str) -> Column:
    """As ``output_stem`` for a column of names; a name without that part stops the job."""
    found = F.regexp_extract(stem, r"^(.*max_seq_\d+)", 1)
    return F.when(found != "", F.concat(found, F.lit(f"-{tag}-{suffix}"))).otherwise(F.raise_error(F.concat(F.lit("no max_seq_N in "), stem)))


def merged_stem(stem: str, old: int = 1000, new: int = 2500) -> str:
    return stem.replace(f"num_sample_{old}", f"num_sample_{new}")
