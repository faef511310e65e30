"""Scores of an answer against gold answers, as native column expressions.

Three families are kept apart on purpose: the difficulty filter (punctuation first, one-way
containment), the judge (punctuation first, two-way) and the trajectory reward (articles first, two-way).
Golds are normalised once per row; the best over them counts. An answer that normalises to nothing is
contained in every gold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalize_articles_first, normalize_punctuation_first, words


def bag_f1(p: Column, g: Column) -> Column:
    """F1 of two word lists as bags; 0 if they share none."""
    shared = F.aggregate(F.array_distinct(p), F.lit(0), lambda s, w: s + F.least(F.size(F.filter(p, lambda x: x == w)), F.size(F.filter(g, lambda x: x == w))))
    precision, recall = shared / F.size(p), shared / F.size(g)
    return F.when(shared > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of two normalised texts as bags of words."""
    return bag_f1(words(pred), words(gold))


def prepared(rows: DataFrame, answer: str, golds: str, normalise: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with answer and golds normalised and cut into words, as columns of their own.

    Expressions inside higher-order functions are evaluated again for every element, so what they use
    has to be a column before them: over whole tables score with ``with_rewards`` and ``with_cover``.
    """
    rows = rows.withColumn("__p", normalise(F.col(answer))).withColumn("__g", F.transform(golds, normalise))
    return rows.withColumn("__pw", words(F.col("__p"))).withColumn("__gw", F.transform("__g", words)).withColumn("__none", F.coalesce(F.col(answer), F.lit("")) == "")


_PREPARED = ("__p", "__g", "__pw", "__gw", "__none")


def with_rewards(rows: DataFrame, answer: str = "extracted_answer", golds: str = "golds") -> DataFrame:
    """``rows`` with sub_em, em and f1 as of ``rewards``."""
    rows = prepared(rows, answer, golds, normalize_articles_first)
    none = F.col("__none") | (F.coalesce(F.size(golds), F.lit(0)) < 1)
    f1 = _best(F.col("__gw"), lambda g: bag_f1(F.col("__pw"), g), F.lit(0.0))
    rows = rows.withColumn("sub_em", F.when(none, 0).otherwise(_best(F.col("__g"), lambda g: _either_way(F.col("__p"), g), F.lit(0))))
    rows = rows.withColumn("em", F.when(none, 0).otherwise(_best(F.col("__g"), lambda g: (g == F.col("__p")).cast("int"), F.lit(0))))
    return rows.withColumn("f1", F.when(none, 0.0).otherwise(f1)).drop(*_PREPARED)


def with_cover(rows: DataFrame, pred: str = "pred", golds: str = "golds") -> DataFrame:
    """``rows`` with cem_score and f1_score as of ``covered`` and ``covered_f1``."""
    rows = prepared(rows, pred, golds, normalize_punctuation_first)
    hit = _best(F.col("__g"), lambda g: F.contains(g, F.col("__p")).cast("double"), F.lit(0.0))
    f1 = _best(F.col("__gw"), lambda g: bag_f1(F.col("__pw"), g), F.lit(0.0))
    return rows.withColumn("cem_score", F.when(F.col("__none"), 0.0).otherwise(hit)).withColumn("f1_score", F.when(F.col("__none"), 0.0).otherwise(f1)).drop(*_PREPARED)


def _best(golds: Column, score: Callable[[Column], Column], zero: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(golds, score)), zero)


def covered(pred: Column, golds: Column) -> Column:
    """1.0 if the answer is part of a gold (one way only); an empty answer scores 0."""
    p = normalize_punctuation_first(pred)
    hit = _best(golds, lambda g: F.contains(normalize_punctuation_first(g), p).cast("double"), F.lit(0.0))
    return F.when(F.coalesce(pred, F.lit("")) == "", 0.0).otherwise(hit)


def covered_f1(pred: Column, golds: Column) -> Column:
    p = normalize_punctuation_first(pred)
    best = _best(golds, lambda g: token_f1(p, normalize_punctuation_first(g)), F.lit(0.0))
    return F.when(F.coalesce(pred, F.lit("")) == "", 0.0).otherwise(best)


def _either_way(p: Column, g: Column) -> Column:
    return (F.contains(g, p) | F.contains(p, g)).cast("int")


def judge_match(pred: Column, golds: Column) -> Column:
    """1 if answer and a gold contain each other in one way at least; 0 without golds."""
    p = normalize_punctuation_first(pred)
    return _best(golds, lambda g: _either_way(p, normalize_punctuation_first(g)), F.lit(0))


def rewards(pred: Column, golds: Column) -> Column:
    """struct(sub_em, em, f1) of the trajectory reward; all zero for a null or empty answer or without golds."""
    p = normalize_articles_first(pred)
    g = F.transform(golds, normalize_articles_first)
    none = (F.coalesce(pred, F.lit("")) == "") | (F.coalesce(F.size(golds), F.lit(0)) < 1)
    best = lambda score, zero: F.when(none, zero).otherwise(_best(g, score, zero))
    return F.struct(
        best(lambda x: _either_way(p, x), F.lit(0)).alias("sub_em"),
        best(lambda x: (x == p).cast("int"), F.lit(0)).alias("em"),
        best(lambda x: token_f1(p, x), F.lit(0.0)).alias("f1"),
    )


def scored(text: str = "text", answer: str = "extracted_answer", digits: int = 4) -> Column:
    """struct(text, extracted_answer, sub_em, em, f1, is_correct) of rows ``with_rewards``, f1 rounded (see ``rounded``)."""
    return F.struct(F.col(text).alias("text"), F.col(answer).alias("extracted_answer"), "sub_em", "em", rounded(F.col("f1"), digits).alias("f1"), F.col("sub_em").alias("is_correct"))


def rounded(x: Column, digits: int = 4) -> Column:
    """The one rounding of scores, half to even; best-of-n ranks by it."""
    return F.bround(x, digits)


def any_judge(*judges: Column) -> Column:
    """Whether one judge at least said yes; missing ones said no."""
    return F.greatest(*[F.coalesce(j.cast("int"), F.lit(0)) for j in judges], F.lit(0)) > 0
