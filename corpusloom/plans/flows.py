"""The long ways through the library: from questions to training rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import counting
from ..functions.text import collapse as collapsed
from ..functions.text import fill, numbered
from ..operators import chains, compare, compose, corpus, rollouts, sampling, sft
from ..sources.storage import cut_lineage

Counter = Callable[[Column], Column]


def synthesise(
    questions: DataFrame, max_seq: int, to_generate: int = 128, seed: int = 42, pre_samples: int = 0, num_samples: int = -1, ids: DataFrame | None = None, core_in_middle: bool = False,
    collapse: bool = False, counter: Counter = counting.native, step: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """(samples, misfits): long-context samples of ``questions`` (id, query, outputs, passages) within ``max_seq`` tokens.

    Questions are filtered by ``ids``, shuffled and sliced; each one's context holds its own passages and
    fillers from the corpus of all passages, as many (in steps) as fit, the first question's number at
    most. Contexts are counted again as they are rendered; samples that do not fit, or of which not even
    one step of passages fits, are misfits (id, length) and never written over length.
    """
    base = cut_lineage(corpus.distinct_passages(questions.select(F.explode("passages").alias("text"))))
    n = base.count()
    rows = corpus.keep_listed(questions, ids) if ids is not None else questions
    rows = sampling.shuffled(rows, seed, "id")
    rows = rows.withColumn("source_index", F.col("shuffle_pos")).withColumn("index", F.col("shuffle_pos") - pre_samples).where(F.col("index") >= 0)
    rows = cut_lineage(rows.where(F.col("index") < num_samples) if num_samples >= 0 else rows)
    if num_samples >= 0:
        compare.require(rows.count() == num_samples, f"there are no {num_samples} questions after the first {pre_samples}")
    encoded = cut_lineage(corpus.encode(rows, base, key="index"))
    tokens = cut_lineage(base.select("doc_id", (counter(F.col("text")) + 3).alias("n_tokens")))  # three for the line before a passage
    mean = tokens.agg(F.avg("n_tokens")).first()[0] or 1
    fillers = min(n, int(1.5 * max_seq / mean) + 2 * step)
    while True:
        all_rows = cut_lineage(compose.candidates(encoded, n, fillers, seed, "index"))
        fitted = compose.fit(all_rows, tokens, max_seq, to_generate, step, "index")
        used_up = fitted.join(all_rows.groupBy("index").agg(F.count("*").alias("all")), "index").where((F.col("num_docs") == F.col("all")) & (F.col("all") < n))
        if fillers >= n or used_up.isEmpty():
            break
        fillers = min(n, 2 * fillers)
    first = fitted.orderBy("index").first()
    fitted = cut_lineage(compose.fit(all_rows, tokens, max_seq, to_generate, step, "index", first["num_docs"] if first and first["fits"] else None))
    chosen = compose.chosen(all_rows.join(fitted.where("fits").select("index", "num_docs"), "index"), F.col("num_docs"), "index")
    placed = compose.place_core(chosen, seed, key="index") if core_in_middle else compose.shuffled_context(chosen, seed, "index")
    contexts = corpus.with_texts(placed, base, "index").select("index", numbered(F.col("passages")).alias("context"))
    contexts = contexts.withColumn("context", collapsed(F.col("context"))) if collapse else contexts
    made = rows.join(contexts, "index", "left").withColumn("length", (counter(F.col("context")) + to_generate).cast("int"))
    good = F.col("context").isNotNull() & (F.col("length") <= max_seq)
    samples = made.where(good).select("index", "source_index", "id", F.col("query").alias("input"), "context", F.col("outputs").alias("answers"), "length")
    return samples, made.where(~good).select("id", "length")


def synthesise_all(datasets: dict[str, DataFrame], lengths: list[int], **options) -> DataFrame:
    """The samples of every dataset at every length in one table with dataset and max_seq, to be written by those columns."""
    parts = [synthesise(questions, n, **options)[0].withColumn("dataset", F.lit(name)).withColumn("max_seq", F.lit(n)) for name, questions in datasets.items() for n in lengths]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def relevant_only(questions: DataFrame, seed: int = 42) -> DataFrame:
    """Samples whose context is the question's supporting passages (duplicates kept) in drawn order."""
    support = questions.select("id", F.posexplode("support").alias("k", "i"), "passages").select("id", "k", F.element_at("passages", F.col("i") + 1).alias("text"))
    drawn = F.array_sort(F.collect_list(F.struct(sampling.draw(seed, "id", "k").alias("d"), "text")))
    contexts = support.groupBy("id").agg(numbered(F.transform(drawn, lambda s: s["text"])).alias("context"))
    return questions.join(contexts, "id").select("id", F.col("query").alias("input"), "context", F.col("outputs").alias("answers"))


def hide_questions(samples: DataFrame, questions: DataFrame, max_seq: int, seed: int = 42, form: str | int = chains.SHORT_ID) -> tuple[DataFrame, DataFrame]:
    """(samples, rejected): contexts with the question behind a chain, decoy chains around it.

    The sample's input tells the head of its chain (chain_head); rejected are those whose context has
    fewer stoppers than there are pairs.
    """
    decoys = sampling.sample_others(questions.select(F.col("id"), F.col("query")), sampling.decoy_count(max_seq), seed, "id", "query")
    rows = samples.join(decoys, "id")
    made = cut_lineage(chains.chains(rows, max_seq, seed, "index", form=form))
    placed, rejected = chains.insert(rows, made.select("index", F.explode("pairs").alias("pair")), seed, "index")
    heads = made.where("chain = 0").select("index", F.col("head").alias("chain_head"))
    return rows.join(placed, "index").join(heads, "index"), rejected


def difficulty(questions: DataFrame, first_model, second_model, n: int = 8, template: str = sft.READ_AND_SAY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(selected ids, first bands, second bands): questions (id, query, outputs, context) banded by two models' rollouts.

    The second model only answers what the first got all wrong. Its own rollouts are scored and counted.
    """
    prompts = questions.select("id", fill(template, context=F.col("context"), input=F.col("query")).alias("prompt"))
    golds = questions.select("id", F.col("outputs").alias("golds"))

    def banded(some: DataFrame, model) -> DataFrame:
        rolls = cut_lineage(rollouts.generate(some, model, n))  # a model is asked once
        return cut_lineage(rollouts.bands(rollouts.by_question(rollouts.cem_scores(rolls.join(golds, "id"))), n))

    first = banded(prompts, first_model)
    second = banded(prompts.join(first.where("band = 'all_wrong'").select("id"), "id", "left_semi"), second_model)
    return rollouts.selected(first, second), first, second


def not_solved_again(rows: DataFrame, model, n: int = 8) -> DataFrame:
    """Rows (id, asked, gold) with avg_acc, without those that a model's rollouts always get right."""
    rolls = cut_lineage(rollouts.generate(rows.select("id", F.col("asked").alias("prompt")), model, n))
    judged = rollouts.judged(rolls.join(rows.select("id", F.col("gold").alias("golds")), "id"))
    return rows.join(rollouts.not_perfect(rollouts.by_judge(judged)).select("id", "avg_acc"), "id")


def trajectories(samples: DataFrame, model, n: int = 4, model_tag: str = "model", template: str = sft.READ) -> DataFrame:
    """Records of ``samples`` with n scored rollouts each, num_correct and pass_rate."""
    from ..functions import extract, score

    prompts = samples.select("index", fill(template, context=F.col("context"), input=F.col("input")).alias("prompt"))
    rolls = cut_lineage(rollouts.generate(prompts, model, n, "index"))
    answered = rolls.withColumn("extracted_answer", extract.think_answer(F.col("text"))).join(samples.select("index", "answers"), "index")
    scored = score.with_rewards(answered, golds="answers").select("index", "pos", score.scored().alias("t"))
    grouped = scored.groupBy("index").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda s: s["t"]).alias("trajectories"), F.sum("t.is_correct").alias("num_correct"), F.count("*").alias("n"))
    rates = grouped.withColumn("pass_rate", F.bround(F.col("num_correct") / F.col("n"), 4)).drop("n")
    return samples.join(rates, "index").withColumn("model", F.lit(model_tag))


def incremental(existing: DataFrame, samples: DataFrame, model, dataset: str, model_tag: str, n: int = 4) -> tuple[DataFrame, DataFrame]:
    """(merged rows, rejected): new samples rolled out, their best traces cleaned, checked, and added to the existing rows."""
    rows, rejected = sft.fused(trajectories(samples, model, n, model_tag), dataset, model_tag)
    bad = F.size(sft.rule_errors(F.col("messages"))) > 0
    return sft.merged(existing, rows.where(~bad)), rejected.unionByName(rows.where(bad))


def longest_model_input(lengths: list[int], to_generate: int) -> int:
    """The context a model has to be started with to serve all ``lengths``."""
    return max(lengths) + to_generate
