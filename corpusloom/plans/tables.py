"""The driver's tables seen as this library's entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, messages in order of turns."""
    rows = table(spark, sf_dir, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def _first_words(n: int | Column) -> Column:
    return F.array_join(F.slice(F.split("text", " "), 1, n), " ")


def rolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    r"""Assistant turns as rollouts: id, pos, text (a trace and an answer), golds.

    Golds are the first two words of the turn and the third, the first two alone, or none. By hash, of
    twelve rollouts four answer with the first gold, one with part of it, one with more, six with
    something else; of ten, five give a sentence and a box, one neither, one an answer without an end,
    one no closing tag, one a box with a blank, one a second closing tag and braces within the box.
    """
    from ..operators.sampling import number

    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    kind, shape, golds_kind = (number(seed, "conv_id", "turn") % n for seed, n in (("roll", 12), ("shape", 10), ("golds", 6)))
    word = lambda i: F.coalesce(F.try_element_at(F.split("text", " "), F.lit(i)), F.lit(""))
    rows = rows.withColumn("said", F.when(kind < 4, _first_words(2)).when(kind == 4, _first_words(1)).when(kind == 5, _first_words(3)).otherwise(F.concat(F.lit("wrong "), word(5))))
    said, lit = F.col("said"), F.lit
    end = (
        F.when(shape < 5, F.concat(lit("</think>The answer is **"), said, lit("**. Done. \\boxed{"), said, lit("}")))
        .when(shape == 5, lit("</think>Done."))
        .when(shape == 6, F.concat(lit("</think>The answer is **"), said, lit("**")))
        .when(shape == 7, F.concat(lit(" The answer is **"), said, lit("**. \\boxed{"), said, lit("}")))
        .when(shape == 8, F.concat(lit("</think>So \\boxed {"), said, lit("}")))
        .otherwise(F.concat(lit("</think>hm</think>\\boxed{{"), said, lit("}}")))
    )
    golds = F.when(golds_kind == 0, F.array().cast("array<string>")).when(golds_kind == 1, F.array(_first_words(2))).otherwise(F.array(_first_words(2), word(3)))
    return rows.select(F.col("conv_id").alias("id"), F.col("turn").cast("int").alias("pos"), F.concat(lit("<think>"), "text", end).alias("text"), golds.alias("golds"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rollouts by conversation: source_index, input, context, answers, length, trajectories."""
    from ..functions import extract, score

    rows = score.with_rewards(rolls(spark, sf_dir).withColumn("extracted_answer", extract.think_answer(F.col("text"))))
    ordered = F.array_sort(F.collect_list(F.struct("pos", score.scored().alias("t"))))
    grouped = rows.groupBy("id").agg(F.transform(ordered, lambda s: s["t"]).alias("trajectories"), F.max("golds").alias("answers"))
    return grouped.select(
        F.col("id").alias("source_index"), F.concat(F.lit("What is "), F.col("id").cast("string"), F.lit("?")).alias("input"), F.concat(F.lit("Passage 1:\n"), F.coalesce(F.try_element_at("answers", F.lit(1)), F.lit(""))).alias("context"), "answers",
        (4096 * F.pow(F.lit(2.0), F.col("id") % 4)).cast("int").alias("length"), "trajectories",
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a training log: step (day of the month), cls, input, score (0 or 1)."""
    rows = table(spark, sf_dir, "events")
    return rows.select(F.dayofmonth("ts").cast("long").alias("step"), F.col("event_type").alias("cls"), F.col("user_id").alias("input"), F.pmod(F.floor("value"), F.lit(2)).cast("double").alias("score"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as run metrics: run (event type), step (day), key (mean, right, wrong), value."""
    per = steps(spark, sf_dir).groupBy(F.col("cls").alias("run"), "step").agg(F.avg("score").alias("mean"), F.count_if((F.col("score") == 1) & (F.col("input") % 2 == 0)).cast("double").alias("right"), F.count_if((F.col("score") == 0) & (F.col("input") % 2 == 0)).cast("double").alias("wrong"))
    return per.unpivot(["run", "step"], ["mean", "right", "wrong"], "key", "value")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions: qid, query, and passages, four documents' texts taken by number of each."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def own_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with passages: texts of four documents drawn for each."""
    from ..operators.sampling import number

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = docs.count()
    drawn = questions(spark, sf_dir).select("qid", "query", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos"))
    drawn = drawn.withColumn("doc_id", number("own", "qid", "pos") % n)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return drawn.join(docs, "doc_id").groupBy("qid", "query").agg(F.transform(ordered, lambda s: s["text"]).alias("passages"))
