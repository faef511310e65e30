"""Rollouts: the boundary to a model, their scores by question, and difficulty bands."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract, score


def generate(prompts: DataFrame, start: Callable[[], Callable[[str, int], list[str]]], n: int, key: str = "id", prompt: str = "prompt", attempts: int = 5, wait: float = 1.0, batch: int = 64, threads: int = 1, errors: bool = False) -> DataFrame:
    """key, pos, text: ``n`` texts of a model for each prompt; with ``errors`` also error.

    ``start`` is called once for each task and returns the model, called with prompt and n, by up to
    ``threads`` threads at once (for a model behind a network). A call that fails is tried again, up to
    ``attempts`` times with doubling waits; after that its texts are empty, or, with ``errors``, it has one
    row, at pos -1, with an empty text and what went wrong (error is null in all others).
    """
    kind = prompts.schema[key].dataType.simpleString()

    def answered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = start()
        with ThreadPoolExecutor(threads) as pool:
            for frame in frames:
                for at in range(0, len(frame), batch):
                    part = frame.iloc[at : at + batch]
                    answers = pool.map(lambda p: _tried(model, p, n, attempts, wait), part[prompt])
                    rows = [row for k, (texts, wrong) in zip(part[key], answers) for row in ([(k, -1, "", wrong)] if errors and wrong else [(k, i, t, None) for i, t in enumerate(texts)])]
                    yield pd.DataFrame(rows, columns=[key, "pos", "text", "error"])[columns]

    columns = [key, "pos", "text"] + ["error"] * errors
    return prompts.select(key, prompt).mapInPandas(answered, f"{key} {kind}, pos int, text string" + ", error string" * errors)


def _tried(model: Callable[[str, int], list[str]], prompt: str, n: int, attempts: int, wait: float) -> tuple[list[str], str | None]:
    """The texts, and what went wrong at the last attempt if none succeeded."""
    wrong = None
    for attempt in range(attempts):
        try:
            return (list(model(prompt, n)) + [""] * n)[:n], None
        except Exception as error:  # a model client may fail in any way
            wrong = f"{type(error).__name__}: {error}"
            if attempt + 1 < attempts:
                time.sleep(wait * 2**attempt)
    return [""] * n, wrong


def fake_model() -> Callable[[str, int], list[str]]:
    """A stand-in for tests: words of the prompt, drawn by its text."""

    def model(prompt: str, n: int) -> list[str]:
        words = prompt.split() or [""]
        return [f"<think>{random.Random(f'{prompt}:{i}').choice(words)}</think>The answer is {random.Random(f'{i}:{prompt}').choice(words)}." for i in range(n)]

    return model


def cem_scores(rollouts: DataFrame, text: str = "text", golds: str = "golds") -> DataFrame:
    """``rollouts`` with pred, cem_score and f1_score of the difficulty filter."""
    return score.with_cover(rollouts.withColumn("pred", extract.after_first(F.col(text))), "pred", golds)


def by_question(scored: DataFrame, key: str = "id", high: float = 0.75) -> DataFrame:
    """Per question: avg_cem_score, total_cem_score, avg_f1_score, high_f1_count."""
    return scored.groupBy(key).agg(
        F.avg("cem_score").alias("avg_cem_score"), F.sum("cem_score").alias("total_cem_score"), F.avg("f1_score").alias("avg_f1_score"), F.sum((F.col("f1_score") > high).cast("long")).alias("high_f1_count")
    )


def histogram(rows: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """value, n: how often each value occurs; with ``most`` for every value from 0 to it."""
    counts = rows.groupBy(F.col(column).cast("long").alias("value")).agg(F.count("*").alias("n"))
    if most is None:
        return counts
    return rows.sparkSession.range(most + 1).select(F.col("id").alias("value")).join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def bands(questions: DataFrame, rolls: int = 8) -> DataFrame:
    """``questions`` with band: all_wrong (0), mixed (1 to rolls - 2), or neither (null), and not_extreme (neither none nor all right)."""
    total = F.col("total_cem_score")
    return questions.withColumn("band", F.when(total == 0, "all_wrong").when(total.between(1, rolls - 2), "mixed")).withColumn("not_extreme", (total != 0) & (total != rolls))


def selected(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """Questions for training: mixed for the first model, or all wrong for it but neither none nor all right for the second."""
    mixed = first.where("band = 'mixed'").select(key)
    rescued = second.where("not_extreme").join(first.where("band = 'all_wrong'").select(key), key, "left_semi").select(key)
    return mixed.unionByName(rescued)


def summarised(records: DataFrame, key: str = "id", correct: str = "is_correct") -> DataFrame:
    """key, num_correct, pass_rate (4 digits, half to even; 0 without rollouts)."""
    counts = records.groupBy(key).agg(F.coalesce(F.sum(correct), F.lit(0)).alias("num_correct"), F.count(correct).alias("n"))
    return counts.select(key, "num_correct", F.when(F.col("n") > 0, F.bround(F.col("num_correct") / F.col("n"), 4)).otherwise(0.0).alias("pass_rate"))


def file_summary(scored: DataFrame, key: str = "id") -> DataFrame:
    """One row: questions, any_correct, any_correct_rate, avg_f1 over all rollouts."""
    per = scored.groupBy(key).agg(F.max("is_correct").alias("any"), F.sum("f1").alias("f1"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("questions"), F.sum("any").alias("any_correct"), (F.sum("any") / F.count("*")).alias("any_correct_rate"), (F.sum("f1") / F.sum("n")).alias("avg_f1"))


def judged(rollouts: DataFrame, text: str = "text", golds: str = "golds") -> DataFrame:
    """``rollouts`` with reason (the judge's answer) and is_correct; a failed extraction and an empty gold list score 0."""
    rows = rollouts.withColumn("reason", extract.judged(F.col(text)))
    return rows.withColumn("is_correct", F.when(F.col("reason") == extract.NO_BOX, 0).otherwise(score.judge_match(F.col("reason"), F.col(golds))))


def by_judge(judged_rows: DataFrame, key: str = "id") -> DataFrame:
    """Per question: avg_acc and any_correct; none without rollouts count 0."""
    return judged_rows.groupBy(key).agg(F.coalesce(F.avg("is_correct"), F.lit(0.0)).alias("avg_acc"), (F.coalesce(F.max("is_correct"), F.lit(0)) > 0).alias("any_correct"))


def judge_summary(per_question: DataFrame) -> DataFrame:
    """One row: macro_avg_acc, micro_any_correct, num_samples."""
    return per_question.agg(F.avg("avg_acc").alias("macro_avg_acc"), F.avg(F.col("any_correct").cast("double")).alias("micro_any_correct"), F.count("*").alias("num_samples"))


def not_perfect(per_question: DataFrame) -> DataFrame:
    return per_question.where(F.col("avg_acc") < 1.0)
