"""The folder that driver and executors share, and tables cut off from how they were made."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder if Spark runs in one process, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return folder or chosen.get()
    if not folder:
        if not re.match(r"local(\[.*\])?\Z", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="corpusloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def remove(spark: SparkSession, path: str) -> None:
    """Delete what is at ``path``, in whatever store, if anything is."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there (survives lost executors, is made once)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
