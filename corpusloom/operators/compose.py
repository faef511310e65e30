"""Contexts within a token budget: choice of passages, their order and place, and their text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.storage import cut_lineage
from . import sampling


def candidates(questions: DataFrame, corpus_size: int, fillers: int, seed: str | int, key: str = "qid") -> DataFrame:
    """key, doc_id, tier, r: a question's own passages (context: tier 0, more_context: tier 1) and ``fillers`` others (tier 2) in drawn order.

    Fillers are drawn by number from the corpus ids 0 to ``corpus_size`` - 1 and anti-joined with the
    own ones; no question meets the whole corpus. A third more than needed, and 32, are drawn; if
    repeats leave a question short, the draw doubles for all, until a draw is as long as sixteen corpora:
    then every id is taken, in drawn order, which is less than such a draw. Own passages and fillers
    are written once.
    """
    more = F.coalesce(F.col("more_context"), F.array().cast("array<bigint>")) if "more_context" in questions.columns else F.array().cast("array<bigint>")
    own = questions.select(key, F.explode(F.concat(F.transform(F.array_distinct("context"), lambda d: F.struct(d.alias("doc_id"), F.lit(0).alias("tier"))), F.transform(F.array_except(more, "context"), lambda d: F.struct(d.alias("doc_id"), F.lit(1).alias("tier"))))).alias("c")).select(key, "c.*")
    own = cut_lineage(own.withColumn("r", F.row_number().over(W.partitionBy(key, "tier").orderBy(sampling.draw(seed, key, "doc_id"), "doc_id"))))
    draws = fillers + fillers // 3 + 32
    while True:
        if draws >= 16 * corpus_size:
            tries = questions.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(corpus_size - 1).cast("long"))).alias("doc_id")).withColumn("i", sampling.number(seed, key, "doc_id"))
        else:
            tries = questions.select(key, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("i")).withColumn("doc_id", sampling.number(seed, key, "i") % corpus_size)
        first = tries.groupBy(key, "doc_id").agg(F.min("i").alias("i")).join(own.select(key, "doc_id"), [key, "doc_id"], "left_anti")
        ranks = cut_lineage(first.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy("i", "doc_id"))).where(F.col("r") <= fillers))
        room = questions.select(key, F.least(F.lit(fillers), F.lit(corpus_size) - F.size(F.array_union("context", more))).alias("want"))
        got = ranks.groupBy(key).agg(F.count("*").alias("got"))
        short = room.join(got, key, "left").where(F.coalesce("got", F.lit(0)) < F.col("want"))
        if draws >= 16 * corpus_size or short.isEmpty():
            return own.unionByName(ranks.select(key, "doc_id", F.lit(2).alias("tier"), "r"))
        draws *= 2


def chosen(candidate_rows: DataFrame, n: Column | int, key: str = "qid") -> DataFrame:
    """The first ``n`` candidates of each question by tier, then drawn order, with pos from 0."""
    rows = candidate_rows.withColumn("pos", F.row_number().over(W.partitionBy(key).orderBy("tier", "r", "doc_id")) - 1)
    return rows.where(F.col("pos") < n)


def fit(candidate_rows: DataFrame, doc_tokens: DataFrame, max_tokens: int, to_generate: int, step: int = 10, key: str = "qid", most: int | None = None) -> DataFrame:
    """key, num_docs, tokens, fits: the largest multiple of ``step`` of a question's candidates that keeps tokens and those to generate within ``max_tokens``.

    All candidates are taken if all fit. ``most`` caps the number, as the first question's fit does for a
    whole run. A question of which not even ``step`` fit gets 0 and fits = false.
    """
    rows = chosen(candidate_rows, 1 << 30, key).join(doc_tokens.select("doc_id", "n_tokens"), "doc_id")
    total = F.sum("n_tokens").over(W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("total", total).withColumn("all", F.count("*").over(W.partitionBy(key)))
    limit = F.lit(most if most is not None else 1 << 30)
    ok = (F.col("total") + to_generate <= max_tokens) & (F.col("pos") + 1 <= limit) & (((F.col("pos") + 1) % step == 0) | (F.col("pos") + 1 == F.col("all")))
    best = rows.groupBy(key).agg(F.max(F.when(ok, F.struct((F.col("pos") + 1).alias("n"), F.col("total")))).alias("b"))
    return best.select(key, F.coalesce("b.n", F.lit(0)).cast("int").alias("num_docs"), F.coalesce("b.total", F.lit(0)).cast("long").alias("tokens"), F.col("b").isNotNull().alias("fits"))


def shuffled_context(chosen_rows: DataFrame, seed: str | int, key: str = "qid") -> DataFrame:
    """key, context: the chosen ids in an order drawn for each question."""
    ordered = F.array_sort(F.collect_list(F.struct(sampling.draw(seed, key, "doc_id").alias("d"), F.col("doc_id"))))
    return chosen_rows.groupBy(key).agg(F.transform(ordered, lambda s: s["doc_id"]).alias("context"))


def centred_slots(questions: DataFrame, n: str, k: str, seed: str | int, sigma: float = 0.30, clamp: float = 0.95, key: str = "qid") -> DataFrame:
    """key, slot, core_rank: ``k`` distinct slots of 0 to n-1 for each question, most of them near the middle, sorted.

    Up to 50 * k normal draws of mean 0, cut off at ``clamp``, are mapped to slots, the first k distinct
    ones count; what is missing then is drawn evenly from the free slots.
    """
    tries = questions.select(key, n, k, F.explode(F.sequence(F.lit(0), 50 * F.col(k) - 1)).alias("i")).where(F.col(k) > 0)
    normal = F.sqrt(-2 * F.log(sampling.uniform(f"{seed}a", key, "i"))) * F.cos(2 * math.pi * sampling.uniform(f"{seed}b", key, "i"))
    x = F.greatest(F.lit(-clamp), F.least(F.lit(clamp), normal * sigma))
    slot = ((x + clamp) / (2 * clamp) * (F.col(n) - 1)).cast("int")
    drawn = tries.withColumn("slot", slot).groupBy(key, n, k, "slot").agg(F.min("i").alias("order"))
    free = questions.select(key, n, k, F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("slot")).where(F.col(k) > 0)
    free = free.join(drawn.select(key, "slot"), [key, "slot"], "left_anti").withColumn("order", 50 * F.col(k) + sampling.number(f"{seed}c", key, "slot"))
    every = drawn.select(key, "slot", k, F.col("order").cast("long").alias("order")).unionByName(free.select(key, "slot", k, F.col("order").cast("long").alias("order")))
    best = every.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy("order", "slot"))).where(F.col("r") <= F.col(k))
    return best.select(key, "slot", (F.row_number().over(W.partitionBy(key).orderBy("slot")) - 1).alias("core_rank"))


def place_core(chosen_rows: DataFrame, seed: str | int, sigma: float = 0.30, clamp: float = 0.95, key: str = "qid") -> DataFrame:
    """key, context: the chosen ids with a question's own ones (tier 0) around the middle and the others, in drawn order, in the slots left."""
    chosen_rows = cut_lineage(chosen_rows)  # used four times
    sizes = chosen_rows.groupBy(key).agg(F.count("*").cast("int").alias("n"), F.sum((F.col("tier") == 0).cast("int")).cast("int").alias("k"))
    slots = cut_lineage(centred_slots(sizes, "n", "k", seed, sigma, clamp, key))
    rank = F.row_number().over(W.partitionBy(key, F.col("tier") == 0).orderBy(sampling.draw(seed, key, "doc_id"), "doc_id")) - 1
    rows = chosen_rows.withColumn("rank", rank)
    core = rows.where("tier = 0").join(slots.withColumnRenamed("core_rank", "rank"), [key, "rank"]).select(key, "doc_id", "slot")
    every = sizes.select(key, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot")).join(slots.select(key, "slot"), [key, "slot"], "left_anti")
    every = every.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("slot")) - 1)
    other = rows.where("tier <> 0").select(key, "doc_id", "rank").join(every, [key, "rank"]).select(key, "doc_id", "slot")
    ordered = F.array_sort(F.collect_list(F.struct("slot", "doc_id")))
    return core.unionByName(other).groupBy(key).agg(F.transform(ordered, lambda s: s["doc_id"]).alias("context"))


def first_distinct(ids: str | Column, n: int) -> Column:
    """The first ``n`` distinct ids of a list."""
    return F.slice(F.array_distinct(ids), 1, n)
