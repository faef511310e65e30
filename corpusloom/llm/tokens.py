"""Token counts of whole texts (overlap resynchronisation for huge documents)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizer
from .common import bounded_batches, slices, text_or_empty


def count_tokens(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", limit: int = 512, chunk: int = 16384, overlap: int = 256
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    Nothing is shuffled: each text is encoded where it is read, longer ones than ``chunk`` characters
    as overlapping chunks (see ``tokenizer.encode``), so that a worker holds the ids of one chunk.
    A null text counts as empty (0 bytes, 0 tokens). Null and repeated ids are kept as they are,
    other columns are ignored, an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer.load(vocabulary)
        for batch in slices(batches):
            n = [sum(map(len, tokenizer.encode(encoder, text, chunk, overlap))) for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(counted, f"doc_id {id_type}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
