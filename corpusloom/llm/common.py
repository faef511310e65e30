"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import cut_lineage, remove, shared_folder  # noqa: F401

#: White space as the contracts define it: U+0020 and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names`` with underscores before them until none is a column in ``taken`` (in any case)."""
    known = {t.lower() for t in taken}
    while any(n.lower() in known for n in names):
        names = tuple(f"_{n}" for n in names)
    return list(names)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's rows per Arrow batch to ``rows`` (never raises it; Spark bounds the bytes).

    Whole texts pass between the JVM and its workers in such batches; at Spark's default of 10,000 rows
    the buffers on both sides, which grow by doubling, take some hundred megabytes of an executor. A
    plan reads the setting when it runs, which may be long after the operator has returned it, so the
    session keeps it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small record batches, so that a worker holds few decoded texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
