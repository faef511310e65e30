"""Joins by position or key that have to be complete, and checks that stop the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(ok: Column | bool, message: str, rows: DataFrame | None = None) -> None:
    """Stops with AssertionError if ``ok`` is false, or false for a row of ``rows``."""
    if rows is not None:
        ok = rows.where(~F.coalesce(ok, F.lit(False))).isEmpty()
    if not ok:
        raise AssertionError(message)


def zipped(left: DataFrame, right: DataFrame, key: str = "row_idx") -> DataFrame:
    """One row for each key, which both sides must have exactly once."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    require((F.col("l") == 1) & (F.col("r") == 1), "the two sides do not have the same rows", sides.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r")))
    return left.join(right, key)


def union_counted(parts: list[DataFrame], expected: int) -> DataFrame:
    """All parts by name; their rows must be as many as expected."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    require(out.count() == expected, f"the parts do not have {expected} rows")
    return out


def differences(left: DataFrame, right: DataFrame, column: str = "input", key: str = "row_idx") -> DataFrame:
    """key, left_value, right_value where the two differ; sides of different length are an error."""
    require(left.count() == right.count(), "the two sides differ in length")
    both = left.select(key, F.col(column).alias("left_value")).join(right.select(key, F.col(column).alias("right_value")), key, "full_outer")
    return both.where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def with_reasoning(samples: DataFrame, reasoned: DataFrame, key: str = "index") -> DataFrame:
    """Samples with the first of their reasonings; both sides must have the same keys and inputs."""
    right = reasoned.select(key, F.col("input").alias("__input"), F.try_element_at("reasonings", F.lit(1)).alias("reasoning"))
    both = zipped(samples, right, key)
    require(F.col("input").eqNullSafe(F.col("__input")), "inputs differ", both)
    return both.drop("__input")
