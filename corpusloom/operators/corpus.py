"""The passage corpus: distinct texts, ids by rank, and the way from texts to ids and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import cut_lineage


#: Bytes of keys that a range partition is sized for.
PART_BYTES = 128 << 20


def key_bytes(rows: DataFrame, key: str) -> int:
    return rows.agg(F.sum(F.octet_length(F.col(key).cast("string")))).first()[0] or 0


def ranked(rows: DataFrame, key: str, rank: str, size: int | None = None) -> DataFrame:
    """Dense ranks from 0 by ``key`` without ordering the whole table in one task.

    Rows go to range partitions of the sort order and are numbered within each; the partitions' sizes,
    summed up, give each one's first rank. There is a partition for each ``PART_BYTES`` of keys (``size``
    in all, counted if not given), and as many as a shuffle has at least. The partitioned rows are
    written once, as sampled range borders may differ between two evaluations. Rows with equal keys get
    their ranks in no set order.
    """
    size = key_bytes(rows, key) if size is None else size
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    ordered = rows.repartitionByRange(parts, key).sortWithinPartitions(key)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    spread = cut_lineage(ordered.withColumn("__part", F.spark_partition_id()).withColumn("__place", place))
    counts = spread.groupBy("__part").agg(F.count("*").alias("n"))
    starts = counts.withColumn("__start", F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    # one row for each partition: their number bounds what is broadcast
    return spread.join(F.broadcast(starts), "__part").withColumn(rank, F.col("__start") + F.col("__place")).drop("__part", "__place", "__start")


def distinct_passages(passages: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, text: the distinct texts in code-point order, numbered from 0. Equal means equal to the last character."""
    known = passages.select(text).where(F.col(text).isNotNull())
    return ranked(known.distinct(), text, "doc_id", key_bytes(known, text)).select("doc_id", text)


def encode(questions: DataFrame, corpus: DataFrame, passages: str = "passages", key: str = "qid") -> DataFrame:
    """key, context: the ids of a question's passages in their order. Texts meet by digest and are then compared."""
    rows = questions.select(key, F.posexplode(passages).alias("pos", "text")).withColumn("digest", F.md5("text"))
    ids = corpus.select("doc_id", F.col("text").alias("known"), F.md5("text").alias("digest"))
    met = rows.join(ids, "digest").where(F.col("text") == F.col("known")).select(key, "pos", "doc_id")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "doc_id")))
    return met.groupBy(key).agg(F.transform(ordered, lambda s: s["doc_id"]).alias("context"))


def with_texts(placed: DataFrame, corpus: DataFrame, key: str = "qid", ids: str = "context") -> DataFrame:
    """key, passages: the texts of a list of ids, in its order; ids travel alone until the last join."""
    rows = placed.select(key, F.posexplode(ids).alias("pos", "doc_id")).join(corpus.select("doc_id", "text"), "doc_id")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return rows.groupBy(key).agg(F.transform(ordered, lambda s: s["text"]).alias("passages"))


def keep_listed(questions: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Questions whose key is listed."""
    return questions.join(ids.select(key).distinct(), key, "left_semi")


def supporting(questions: DataFrame, corpus: DataFrame, key: str = "qid") -> DataFrame:
    """key, supporting_facts: ids of the supporting passages (column support: their positions), duplicates kept."""
    chosen = questions.select(key, F.transform("support", lambda i: F.element_at("passages", i + 1)).alias("passages"))
    return encode(chosen, corpus, key=key).withColumnRenamed("context", "supporting_facts")
