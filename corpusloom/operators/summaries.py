"""Summary requests out of a chat corpus, as training rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import counting
from ..functions.extract import without_role_tags
from ..functions.text import first_truthy, tail_has_any
from .sft import message

#: What the end of a request for a summary says.
KEYWORDS = ("can you write an appropriate summary", "write a summary", "summarize the above", "provide a summary", "write an appropriate summary")


def summary_rows(records: DataFrame, keywords: tuple[str, ...] = KEYWORDS, tail: int = 300, least_in: int = 4096, least_out: int = 20, counter: Callable[[Column], Column] = counting.native) -> DataFrame:
    """``records`` (question, answer, word counts) with messages, word_count, token counts and reject_reason.

    A record is rejected, for the first reason that holds, if its tail asks for no summary or question
    or answer has too few tokens.
    """
    answer = F.col("answer") if records.schema["answer"].dataType.simpleString() == "string" else F.coalesce(F.try_element_at("answer", F.lit(1)), F.lit(""))
    counts = [F.col(c) for c in ("word count", "word_count") if c in records.columns] or [F.lit(None).cast("long")]
    question = without_role_tags(F.col("question"))
    rows = records.select("*", question.alias("request"), answer.alias("reply"), first_truthy(*counts).alias("words"))
    rows = rows.withColumn("input_tokens", counter(F.col("request"))).withColumn("output_tokens", counter(F.col("reply")))
    reason = F.when(~F.coalesce(tail_has_any(F.col("question"), keywords, tail), F.lit(False)), "no_keyword").when(F.col("input_tokens") < least_in, "input_too_short").when(F.col("output_tokens") < least_out, "output_too_short")
    return rows.withColumn("reject_reason", reason).withColumn("messages", F.array(message("user", F.col("request")), message("assistant", F.col("reply"))))


def reject_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
