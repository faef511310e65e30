"""One query for each operator of the survey, over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import counting, extract, score, text
from ..operators import analytics, chains, compare, compose, corpus, manifest, rollouts, sampling, sft, summaries
from ..sources import adapters, readers, sinks
from ..sources.storage import cut_lineage, remove, shared_folder
from . import flows
from . import tables as t
from .tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SEED = 42
#: Bytes of records in a file of a JSON array, about.
ARRAY_BYTES = 4 << 20


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# -- messages and rules --------------------------------------------------------


@query
def v1_validate_rows(spark, sf):
    errors = sft.rule_errors(F.col("messages"))
    return t.chats(spark, sf).select("conv_id", F.size(errors).cast("long").alias("n_errors"), F.coalesce(F.try_element_at(errors, F.lit(1)), F.lit("")).alias("first_error"))


@query
def a22_error_counts(spark, sf):
    return sft.error_counts(t.chats(spark, sf))


# -- strings -------------------------------------------------------------------


@query
def f1_normalize_punctuation_first(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalize_punctuation_first(F.col("text"))).alias("digest"))


@query
def f2_normalize_articles_first(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.normalize_articles_first(F.col("text"))).alias("digest"))


@query
def p11_collapse_spaces(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.collapse(F.col("text"))).alias("digest"))


@query
def f3_answer_after_first(spark, sf):
    return t.rolls(spark, sf).select("id", "pos", extract.after_first(F.col("text")).alias("answer"))


@query
def f4_answer_after_last(spark, sf):
    return t.rolls(spark, sf).select("id", "pos", extract.after_last(F.col("text")).alias("answer"))


@query
def f10_last_boxed(spark, sf):
    return t.rolls(spark, sf).select("id", "pos", extract.last_boxed(F.col("text")).alias("boxed"))


@query
def f14_think_answer(spark, sf):
    return t.rolls(spark, sf).select("id", "pos", extract.think_answer(F.col("text")).alias("answer"))


@query
def f15_judge_answer(spark, sf):
    return rollouts.judged(t.rolls(spark, sf)).select("id", "pos", "reason", "is_correct")


@query
def f17_clean_trace(spark, sf):
    return sft.clean(t.rolls(spark, sf))[0].select("id", "pos", F.md5("cleaned").alias("digest"))


@query
def f18_option_letter(spark, sf):
    """The options that traces end with, told in one of seven ways, in each mode."""
    ends = ("\nFinal answer: (b)", "\nAnswer: C", "\nAnswer: **D**.", "\nAnswer: (A)", "\nThe correct answer is (B)", "\n\\boxed{(c) so}", "")
    said = F.concat("text", F.element_at(F.array(*map(F.lit, ends)), ((F.col("id") + F.col("pos")) % len(ends) + 1).cast("int")))
    given = F.lit(None).cast("string")
    rows = t.rolls(spark, sf).select("id", "pos", said.alias("said"))
    return rows.select("id", "pos", *[extract.option(F.col("said"), given, mode).alias(mode) for mode in ("standard", "boxed", "mix", "original")])


@query
def p24_before_marker(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(analytics.before_marker(F.col("text"), ". ")).alias("digest"))


@query
def p9_fill_prompt(spark, sf):
    r = t.records(spark, sf)
    return r.select("source_index", text.fill(sft.READ, context=F.col("context"), input=F.col("input")).alias("prompt"))


@query
def p10_numbered_passages(spark, sf):
    return t.own_passages(spark, sf).select("qid", F.md5(text.numbered(F.col("passages"))).alias("digest"))


@query
def p26_size_label(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.size_label(F.col("n_chars") * 37).alias("label"), text.size_label(F.col("n_chars") * 37, True).alias("thousands"))


@query
def f20_token_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", counting.native(F.col("text")).alias("n_tokens"))


# -- scores and bands ----------------------------------------------------------


@query
def f5_f7_f8_rewards(spark, sf):
    rows = t.rolls(spark, sf).withColumn("extracted_answer", extract.after_last(F.col("text")))
    return score.with_rewards(rows).select("id", "pos", "sub_em", "em", "f1")


@query
def f6_covered_match(spark, sf):
    return rollouts.cem_scores(t.rolls(spark, sf)).select("id", "pos", "cem_score", "f1_score")


@query
def f9_judge_match(spark, sf):
    return t.rolls(spark, sf).select("id", "pos", score.judge_match(extract.think_answer(F.col("text")), F.col("golds")).alias("hit"))


@query
def f19_any_judge(spark, sf):
    rows = table(spark, sf, "labels")
    return rows.select("doc_id", score.any_judge(F.col("quality"), F.col("toxic")).alias("any_yes"))


def _covered(spark, sf):
    return score.with_cover(t.rolls(spark, sf).withColumn("pred", extract.after_last(F.col("text"))))


@query
def a2_question_stats(spark, sf):
    return rollouts.by_question(_covered(spark, sf)).select("id", "avg_cem_score", "total_cem_score", F.bround("avg_f1_score", 6).alias("avg_f1_score"), "high_f1_count")


@query
def a3_score_histogram(spark, sf):
    return rollouts.histogram(rollouts.by_question(_covered(spark, sf)), "total_cem_score", 8)


@query
def p21_bands(spark, sf):
    return rollouts.bands(rollouts.by_question(_covered(spark, sf))).select("id", F.coalesce("band", F.lit("none")).alias("band"), "not_extreme")


@query
def u3_selected_questions(spark, sf):
    first = rollouts.bands(rollouts.by_question(_covered(spark, sf)))
    second = rollouts.bands(rollouts.by_question(_covered(spark, sf).withColumn("cem_score", (F.col("pos") % 2).cast("double"))))
    return rollouts.selected(first, second)


def _scored(spark, sf):
    return t.records(spark, sf).select(F.col("source_index").alias("id"), F.explode("trajectories").alias("s")).select("id", "s.*")


@query
def a4_pass_rate(spark, sf):
    return rollouts.summarised(_scored(spark, sf)).select("id", "num_correct", F.bround("pass_rate", 3).alias("pass_rate"))


@query
def a5_file_summary(spark, sf):
    return rollouts.file_summary(_scored(spark, sf)).select("questions", "any_correct", F.bround("any_correct_rate", 6).alias("any_correct_rate"), F.bround("avg_f1", 6).alias("avg_f1"))


@query
def a6_judge_summary(spark, sf):
    out = rollouts.judge_summary(rollouts.by_judge(rollouts.judged(t.rolls(spark, sf))))
    return out.select(F.bround("macro_avg_acc", 6).alias("macro_avg_acc"), F.bround("micro_any_correct", 6).alias("micro_any_correct"), "num_samples")


@query
def a7_accuracy_histogram(spark, sf):
    per = rollouts.by_judge(rollouts.judged(t.rolls(spark, sf)))
    return per.groupBy(F.bround("avg_acc", 6).alias("avg_acc")).agg(F.count("*").alias("n"))


@query
def p22_not_perfect(spark, sf):
    return rollouts.not_perfect(rollouts.by_judge(rollouts.judged(t.rolls(spark, sf)))).select("id")


# -- chat rows -----------------------------------------------------------------


def _rows(spark, sf):
    return sft.convert(t.records(spark, sf), "chat", "model")


@query
def p14_convert_rows(spark, sf):
    return _rows(spark, sf).select("source_index", "traj_pos", "sub_em", "em", "extracted_answer", F.md5(F.col("messages")[0]["content"]).alias("prompt"), F.md5(F.col("messages")[1]["content"]).alias("reply"))


@query
def a8_best_of_n(spark, sf):
    return sft.best_of(_rows(spark, sf)).select("source_index", "length", "traj_pos", "extracted_answer")


@query
def p27_rl_rows(spark, sf):
    rows = sft.rl_rows(t.records(spark, sf).select("input", "context", "answers"))
    return rows.select("question", "answer", F.md5(F.col("messages")[0]["content"]).alias("prompt"))


def _halves(spark, sf):
    rows = _rows(spark, sf).select("dataset", "length", "source_index", "traj_pos")
    return rows.where(F.col("traj_pos") == 0), rows.where(F.col("traj_pos") > 0)


@query
def u2_merged_rows(spark, sf):
    return sft.merged(*_halves(spark, sf)).select("dataset", "length", "source_index", "traj_pos", "origin")


@query
def a20_merge_counts(spark, sf):
    return sft.merge_counts(*_halves(spark, sf)).select(F.coalesce("dataset", F.lit("total")).alias("dataset"), F.coalesce("length", F.lit(0)).alias("length"), "existing", "incremental", "merged")


@query
def p16_p20_summary_rows(spark, sf):
    """Documents as requests, each with the next document as the reply, under the default thresholds."""
    docs = table(spark, sf, "documents")
    asked = docs.select("doc_id", F.concat(F.lit("User: "), F.col("text"), F.lit("\n\nQ: "), F.element_at(F.array(F.lit("Write a summary"), F.lit("What is it?")), (F.col("doc_id") % 2 + 1).cast("int")), F.lit("\n\nAssistant:")).alias("question"), F.col("n_chars").alias("word_count"))
    replies = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("answer"))
    rows = summaries.summary_rows(asked.join(replies, "doc_id", "left"))
    return rows.select("doc_id", F.coalesce("reject_reason", F.lit("kept")).alias("reason"), F.md5("request").alias("request"), "input_tokens", "output_tokens", F.col("words"))


# -- corpus and questions ------------------------------------------------------


@query
def a1_corpus_distinct(spark, sf):
    return corpus.distinct_passages(table(spark, sf, "documents")).select("doc_id", F.md5("text").alias("digest"))


def _encoded(spark, sf):
    base, own = corpus.distinct_passages(table(spark, sf, "documents")), t.own_passages(spark, sf)
    return own, base, cut_lineage(corpus.encode(own, base))


@query
def j1_dictionary_encode(spark, sf):
    return _encoded(spark, sf)[2].select("qid", F.array_join("context", ",").alias("context"))


@query
def j2_texts_by_id(spark, sf):
    _, base, encoded = _encoded(spark, sf)
    return corpus.with_texts(encoded, base).select("qid", F.md5(F.array_join("passages", "\n")).alias("digest"))


@query
def p8_flat_questions(spark, sf):
    rows = t.own_passages(spark, sf).select(F.col("qid").alias("id"), "query", F.array("query").alias("outputs"), "passages", F.lit("hard").alias("level"))
    return adapters.flattened(rows).select("id", F.md5("context").alias("digest"), "level")


@query
def j3_listed_questions(spark, sf):
    ids = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("qid"))
    return corpus.keep_listed(t.questions(spark, sf), ids, "qid")


@query
def j6_containing_passages(spark, sf):
    """Which of a question's passages contain its first word (a support title), by position."""
    rows = t.own_passages(spark, sf).withColumn("facts", F.slice(F.split("query", " "), 1, 2))
    support = F.flatten(F.transform("passages", lambda c, i: F.transform(F.filter("facts", lambda f: F.contains(c, f)), lambda f: i)))
    return rows.select("qid", F.array_join(support, ",").alias("support"))


# -- samples -------------------------------------------------------------------


@query
def o1_shuffled_slice(spark, sf):
    rows = sampling.shuffled(table(spark, sf, "documents").select("doc_id"), SEED, "doc_id")
    return sampling.disjoint_slice(rows, 50, 100).select("doc_id", "index", "source_index")


@query
def p12_slice(spark, sf):
    return sampling.sliced(table(spark, sf, "documents").select("doc_id"), 100, -1, "doc_id")


@query
def p13_chunks(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id")
    return rows.select("doc_id", sampling.chunk_of("doc_id", rows.count(), 7).alias("node"))


@query
def o16_length_mix(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("index"), F.explode(F.array(F.lit(4096), F.lit(8192), F.lit(16384))).alias("length"))
    return sampling.length_mix(rows, {4096: 0.1, 8192: 0.1, 16384: 0.8}, SEED)


@query
def o10_decoy_questions(spark, sf):
    out = sampling.sample_others(t.questions(spark, sf), 8, SEED)
    return out.select("qid", F.md5(F.array_join("distract_questions", "|")).alias("digest"))


def _candidates(spark, sf, fillers: int = 60):
    _, base, encoded = _encoded(spark, sf)
    return base, compose.candidates(encoded, base.count(), fillers, SEED)


@query
def j4_filler_passages(spark, sf):
    return _candidates(spark, sf)[1].select("qid", "doc_id", "tier", "r")


@query
def o2_budget_fit(spark, sf):
    base, rows = _candidates(spark, sf)
    tokens = base.select("doc_id", (counting.native(F.col("text")) + 4).alias("n_tokens"))
    return compose.fit(rows, tokens, 16384, 1024)


@query
def o5_shuffled_context(spark, sf):
    rows = compose.chosen(_candidates(spark, sf)[1], 20)
    return compose.shuffled_context(rows, SEED).select("qid", F.array_join("context", ",").alias("context"))


@query
def o6_o7_core_in_the_middle(spark, sf):
    rows = compose.chosen(_candidates(spark, sf)[1], 60)
    return compose.place_core(rows, SEED).select("qid", F.array_join("context", ",").alias("context"))


def _with_decoys(spark, sf, k: int = 16):
    q = t.questions(spark, sf).select(F.col("qid").alias("index"), F.col("query").alias("input"))
    return q.join(sampling.sample_others(q, k, SEED, "index", "input"), "index")


@query
def o11_chain_pairs(spark, sf):
    rows = chains.chains(_with_decoys(spark, sf), 2048, SEED)
    return rows.select("index", "chain", "head", F.md5(F.array_join("pairs", "|")).alias("digest"))


@query
def o14_chain_walk(spark, sf):
    rows = chains.chains(_with_decoys(spark, sf), 2048, SEED)
    pairs = rows.select("index", F.explode("pairs").alias("pair"))
    return chains.walk(pairs, rows.where("chain = 0").select("index", "head"))


@query
def o12_insert_pairs(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("index"), F.col("text").alias("context"))
    pairs = docs.select("index", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).select("index", chains.pair(chains.identifier(SEED, "index", "i", form=8), chains.identifier("end", "index", "i", form=8)).alias("pair"))
    placed, _ = chains.insert(docs, pairs, SEED)
    return placed.select("index", F.md5("distractor_context").alias("digest"))


@query
def o12_too_few_stoppers(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("index"), F.col("text").alias("context"))
    pairs = docs.select("index", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).select("index", F.concat(F.lit("p"), F.col("i").cast("string")).alias("pair"))
    return chains.insert(docs, pairs, SEED)[1]


@query
def o13_identifiers(spark, sf):
    return t.questions(spark, sf).select("qid", chains.identifier(SEED, "qid").alias("long_id"), chains.identifier(SEED, "qid", form=8).alias("short_id"))


@query
def o15_tree_pairs(spark, sf):
    rows = t.questions(spark, sf).select("qid", F.col("query").alias("input")).withColumn("ids", chains.tree_ids(3, 2, SEED, "qid", form=8))
    return chains.tree_pairs(rows, SEED, "qid").select("qid", "pos", "pair")


# -- integrity -----------------------------------------------------------------


@query
def j8_zipped(spark, sf):
    rows = table(spark, sf, "documents")
    return compare.zipped(rows.select(F.col("doc_id").alias("row_idx"), "lang"), rows.select(F.col("doc_id").alias("row_idx"), "source"))


@query
def j9_first_reasoning(spark, sf):
    r = t.records(spark, sf).select(F.col("source_index").alias("index"), "input", F.transform("trajectories", lambda x: x["text"]).alias("reasonings"))
    return compare.with_reasoning(r.select("index", "input"), r).select("index", F.md5("reasoning").alias("digest"))


@query
def j10_differences(spark, sf):
    rows = table(spark, sf, "labels")
    return compare.differences(rows.select(F.col("doc_id").alias("row_idx"), F.col("quality").alias("input")), rows.select(F.col("doc_id").alias("row_idx"), F.col("toxic").alias("input")))


@query
def j14_paired_files(spark, sf):
    r = t.records(spark, sf).select(F.lit("chat").alias("dataset"), "length", F.col("source_index").cast("string").alias("file"))
    some = r.groupBy("dataset", "length").agg(F.min("file").alias("file"))
    return manifest.paired(some, some.where("length > 4096"))


# -- analytics -----------------------------------------------------------------


@query
def a9_length_stats(spark, sf):
    rows = table(spark, sf, "documents").select(counting.native(F.col("text")).alias("n_tokens"))
    return analytics.length_stats(rows, "n_tokens").withColumn("mean", F.bround("mean", 6))


@query
def a10_token_report(spark, sf):
    out = analytics.token_report(table(spark, sf, "documents"), "n_chars")
    return out.select([F.bround(c, 4).alias(c) if c in ("mean", "std", "median") or c.startswith("p") else F.col(c) for c in out.columns])


@query
def a10_token_ranges(spark, sf):
    return analytics.token_ranges(table(spark, sf, "documents"), "n_chars", [0, 1000, 2000, 4000, 8000])


def _judged_docs(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")


@query
def a11_accuracy_by_bin(spark, sf):
    rows = _judged_docs(spark, sf).withColumn("length", F.col("n_chars") * 8)
    return analytics.accuracy_by_bin(rows, "length", "quality", analytics.STORY_BINS).select("bin", "total", "correct", F.bround("accuracy", 6).alias("accuracy"))


@query
def j12_choice_bins(spark, sf):
    rows = _judged_docs(spark, sf).withColumn("length", F.col("n_chars") * 8)
    return analytics.accuracy_by_bin(rows, "length", "quality", analytics.CHOICE_BINS, 0.0).select("bin", "total", "correct", F.bround("accuracy", 6).alias("accuracy"))


@query
def a12_accuracy_by_group(spark, sf):
    return analytics.accuracy_by_group(_judged_docs(spark, sf), "quality", ("lang", "source", "toxic")).select("grouping", F.coalesce("value", F.lit("")).alias("value"), "right", "n")


@query
def a13_step_scores(spark, sf):
    return analytics.step_scores(t.steps(spark, sf)).select("step", "cls", F.bround("avg_score", 6).alias("avg_score"), "inputs", "varied_inputs")


@query
def a14_occurrence_bins(spark, sf):
    return analytics.occurrence_bins(analytics.per_input(t.steps(spark, sf)), 4)


@query
def a15_score_bins(spark, sf):
    return analytics.score_bins(analytics.per_input(t.steps(spark, sf)), 4)


@query
def a16_fixed_reward(spark, sf):
    return analytics.reward_series(t.metrics(spark, sf), "mean", "right", "wrong").withColumn("reward", F.bround("reward", 6))


@query
def a17_mean_series(spark, sf):
    return analytics.mean_series(t.metrics(spark, sf), ["right", "wrong"])


@query
def a18_joined_stages(spark, sf):
    series = t.metrics(spark, sf).where("key = 'right'").groupBy("step").agg(F.sum("value").alias("value"))
    return analytics.joined_stages([(series, 1, 10), (series, 5, 20)])


@query
def a19_depth_pivot(spark, sf):
    rows = t.steps(spark, sf).select((F.col("input") % 5).alias("depth"), (F.pmod("step", F.lit(3)) * 1000).alias("context_length"), "score")
    out = analytics.depth_pivot(rows, [0, 1000, 2000])
    return out.select("depth", *[F.bround(F.col(str(c)), 6).alias(f"len_{c}") for c in (0, 1000, 2000)])


@query
def a19_unpivot(spark, sf):
    wide = t.steps(spark, sf).groupBy("step").agg(F.sum("score").alias("len_1"), F.count("*").cast("double").alias("len_2"))
    return analytics.unpivoted(wide, ["step"], ["len_1", "len_2"])


@query
def a21_manifest_status(spark, sf):
    rows = t.records(spark, sf).select(F.lit("chat").alias("dataset"), "length", F.element_at(F.array(*map(F.lit, manifest.STAGES)), (F.col("source_index") % 5 + 1).cast("int")).alias("stage"), F.col("source_index").alias("samples"), F.lit("f").alias("file"), F.timestamp_seconds(F.col("source_index")).alias("updated_at"))
    expected = rows.select("dataset", F.explode(F.array(F.lit(4096), F.lit(8192), F.lit(16384), F.lit(32768), F.lit(65536))).alias("length")).distinct()
    return manifest.status(rows, expected)


@query
def a23_stage_middles(spark, sf):
    return analytics.stage_middles(t.steps(spark, sf).select("step").distinct(), (7, 20), 25)


@query
def p23_classify(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.concat(F.element_at(F.array(F.lit("Passage 2: "), F.lit("passage 2: UUID "), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int")), F.col("text")).alias("prompt"))
    return rows.select("doc_id", F.coalesce(analytics.classify(F.col("prompt")), F.lit("other")).alias("cls"))


@query
def p25_stage_labels(spark, sf):
    return t.steps(spark, sf).select("step").distinct().select("step", analytics.stage_of(F.col("step") * 10).alias("small"), analytics.stage_of(F.col("step") * 10, analytics.STAGES_LARGE).alias("large"))


# -- sources and sinks ---------------------------------------------------------


def _through_files(spark, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    """What ``read`` finds in a new folder of the shared one after ``write``; the folder is gone afterwards."""
    path = f"{shared_folder(spark)}/io-{uuid.uuid4().hex}"
    try:
        write(path)
        return cut_lineage(read(path))
    finally:
        remove(spark, path)


def _write_arrays(records: DataFrame, path: str, *by: str) -> None:
    """JSON arrays of the column record (JSON text): for each value of ``by`` (few) a folder of as many files as its bytes need, whatever keys the records have.

    ``records`` is read twice and comes straight from a scan: a record's place in it decides its file.
    """
    needed = records.groupBy(*[F.col(b).alias(f"of_{b}") for b in by]).agg(F.greatest(F.ceil(F.sum(F.octet_length("record")) / ARRAY_BYTES), F.lit(1)).alias("files"))
    same = reduce(and_, [F.col(b).eqNullSafe(F.col(f"of_{b}")) for b in by], F.lit(True))
    placed = records.withColumn("place", F.xxhash64(F.monotonically_increasing_id())).join(F.broadcast(needed), same)
    rows = placed.groupBy(*by, F.pmod("place", "files").alias("part")).agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("record")), ", "), F.lit("]")).alias("value"))
    writer = rows.select(*by, "value").write.option("maxRecordsPerFile", 1)
    (writer.partitionBy(*by) if by else writer).text(path)


@query
def s2_k2_json_lines(spark, sf):
    """Conversations written as JSON lines by role and read back, a bad line being an error."""
    rows = table(spark, sf, "conversations")
    return _through_files(spark, lambda path: sinks.json_lines(rows, path, by=("role",)), lambda path: readers.json_lines(spark, path, "conv_id bigint, turn bigint, text string, role string"))


@query
def s3_json_lines_lenient(spark, sf):
    """Documents as JSON lines of which every tenth is cut off: those that can be read."""
    line = F.to_json(F.struct("doc_id", "lang", "n_chars"))
    rows = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 10 == 3, F.substring(line, 1, 12)).otherwise(line).alias("value"))
    return _through_files(spark, lambda path: rows.write.text(path), lambda path: readers.json_lines_lenient(spark, path, "doc_id bigint, lang string, n_chars bigint")[0])


@query
def s6_k4_csv(spark, sf):
    rows = table(spark, sf, "labels")
    return _through_files(spark, lambda path: sinks.csv(rows, path), lambda path: readers.csv(spark, path, "doc_id bigint, quality int, toxic int"))


@query
def s7_k3_parquet(spark, sf):
    rows = table(spark, sf, "labels")
    return _through_files(spark, lambda path: sinks.parquet(rows, f"{path}/a"), lambda path: readers.parquet(spark, path, recursive=True))


@query
def s1_s4_json_arrays(spark, sf):
    """Labels as files that each hold a JSON array, read by their extension."""
    rows = table(spark, sf, "labels").select(F.to_json(F.struct("doc_id", "quality", "toxic")).alias("record"))
    read = lambda path: readers.by_extension(spark, f"{path}/labels.json", "doc_id bigint, quality int, toxic int")
    return _through_files(spark, lambda path: _write_arrays(rows, f"{path}/labels.json"), read)


@query
def s8_files_by_pattern(spark, sf):
    """Documents written to a folder for each source and read by a pattern, each row with its file's name."""
    rows = table(spark, sf, "documents").select("doc_id", "source")

    def read(path):
        found = readers.with_file(spark.read.option("basePath", path).parquet(f"{path}/source=*"))
        return found.select("doc_id", F.col("source").cast("string").alias("source"), F.col("file_name").rlike(r"^part-.*\.parquet$").alias("named"))

    return _through_files(spark, lambda path: sinks.parquet(rows, path, by=("source",)), read)


def _step_logs(spark, sf, pick: Callable[[tuple[DataFrame, DataFrame]], DataFrame]) -> DataFrame:
    rows = t.steps(spark, sf).select(F.concat(F.lit("global_step_"), F.col("step").cast("string"), F.lit(".json")).alias("log"), F.to_json(F.struct(F.col("cls").alias("input"), "score")).alias("record"))
    return _through_files(spark, lambda path: _write_arrays(rows, path, "log"), lambda path: pick(readers.step_logs(spark, path, range(1, 41))))


@query
def s9_step_logs(spark, sf):
    """Events as logs by step, read back with the step of their file's name, and counted."""
    return _step_logs(spark, sf, lambda found: found[0].groupBy("step", "input").agg(F.count("*").alias("n"), F.sum("score").alias("total")))


@query
def s9_missing_steps(spark, sf):
    return _step_logs(spark, sf, lambda found: found[1])


@query
def s11_metric_history(spark, sf):
    rows = t.metrics(spark, sf)
    return _through_files(spark, lambda path: sinks.parquet(rows, path), lambda path: readers.metrics(spark, path, ["right"]))


@query
def s13_p1_question_set(spark, sf):
    """Documents as questions of a data set known by its path: a title and two sentences each, supported twice by the title."""
    json = lambda x: F.expr(f"substring(to_json(array({x})), 2, length(to_json(array({x}))) - 2)")
    half = "CAST(length(text) / 2 AS INT)"
    context = F.concat(F.lit("[["), json("lang"), F.lit(", "), F.expr(f"to_json(array(substring(text, 1, {half}), substring(text, {half} + 1)))"), F.lit("]]"))
    facts = F.concat(F.lit("[["), json("lang"), F.lit(", 0], ["), json("lang"), F.lit(", 1]]"))
    record = F.concat(F.lit('{"_id": "'), F.col("doc_id").cast("string"), F.lit('", "question": '), json("source"), F.lit(', "answer": '), json("lang"), F.lit(', "context": '), context, F.lit(', "supporting_facts": '), facts, F.lit(', "level": "hard"}'))
    rows = table(spark, sf, "documents").select(record.alias("record"))

    def read(path):
        found = readers.questions(spark, f"{path}/hotpot/train.json")
        return found.select("id", "query", F.col("outputs")[0].alias("answer"), F.md5(F.array_join("passages", "|")).alias("digest"), F.array_join("support", ",").alias("support"), "level")

    return _through_files(spark, lambda path: _write_arrays(rows, f"{path}/hotpot/train.json"), read)


@query
def s14_literal_table(spark, sf):
    return readers.series(spark, {"step": [1, 2, 5], "score": [0.25, 0.5, 0.125]})


@query
def k1_ascii_lines(spark, sf):
    """Documents as JSON lines in ASCII, and read back."""
    rows = table(spark, sf, "documents").select("doc_id", "lang", "text")

    def read(path):
        lines = spark.read.text(path)
        return lines.select(F.from_json("value", "doc_id bigint, lang string, text string").alias("r"), (~F.col("value").rlike(r"[^\x00-\x7f]")).alias("ascii")).select("r.doc_id", "r.lang", F.md5("r.text").alias("digest"), "ascii")

    return _through_files(spark, lambda path: sinks.json_lines(rows, path, ascii_only=True), read)


@query
def k5_summary_file(spark, sf):
    row = a5_file_summary(spark, sf)
    return _through_files(spark, lambda path: sinks.summary(row, path), lambda path: spark.read.schema(row.schema).json(path))


@query
def k6_output_names(spark, sf):
    stem = F.concat(F.lit("train-num_sample_"), F.col("user_id").cast("string"), F.lit("-max_seq_"), F.col("event_id").cast("string"), F.lit("-"), F.col("event_type"))
    return table(spark, sf, "events").select("event_id", sinks.output_stems(stem, "tag", "cleaned").alias("name"))


@query
def k7_reused_output(spark, sf):
    """Labels written once; the second call reads what is there and makes nothing."""
    rows = table(spark, sf, "labels")

    def write(path):
        sinks.reused(spark, path, lambda: rows)

    return _through_files(spark, write, lambda path: sinks.reused(spark, path, lambda: rows.limit(0)))


@query
def p4_possible_questions(spark, sf):
    """Documents as articles of two paragraphs, every third with a question that cannot be answered."""
    qas = "array(named_struct('question', lang, 'is_impossible', doc_id % 3 = 0, 'answers', array(named_struct('text', source))))"
    none = "CAST(array() AS array<struct<question:string,is_impossible:boolean,answers:array<struct<text:string>>>>)"
    article = f"array(named_struct('paragraphs', array(named_struct('context', concat('A: ', text), 'qas', {qas}), named_struct('context', concat('B: ', doc_id), 'qas', {none}))))"
    out = adapters.articles(table(spark, sf, "documents").select(F.expr(article).alias("data")))
    return out.select("query", F.col("outputs")[0].alias("answer"), F.md5(F.col("passages")[0]).alias("digest"), F.array_join("more", "|").alias("more"))


@query
def f13_unwrapped_text(spark, sf):
    wrapped = F.expr(r"CASE doc_id % 4 WHEN 0 THEN concat('\\text{', text, '}') WHEN 1 THEN concat('\\text{', text, '} and} more') WHEN 2 THEN text ELSE concat('\\text ', text) END")
    return table(spark, sf, "documents").select("doc_id", wrapped.alias("x")).select("doc_id", F.md5(extract.unwrap_text(F.col("x"))).alias("digest"))


@query
def f21_sequence_length(spark, sf):
    return table(spark, sf, "documents").select("doc_id", counting.sequence_length(counting.native(F.col("text")), 128).alias("length"))


@query
def o3_back_off(spark, sf):
    """As many tens of passages as fit into a small budget; none, and told so, where not even ten do."""
    base, rows = _candidates(spark, sf)
    tokens = base.select("doc_id", (counting.native(F.col("text")) + 4).alias("n_tokens"))
    return compose.fit(rows, tokens, 4096, 1024)


@query
def v2_schema_check(spark, sf):
    """The columns in which rows that lack the model and hold a long length differ from the declared chat rows."""
    rows = _rows(spark, sf).drop("model").withColumn("length", F.col("length").cast("long"))
    return spark.createDataFrame([(c,) for c in sft.conforms(rows, schemas.CHAT_ROW)], "name string")


def _half_deaf():
    def model(prompt: str, n: int) -> list[str]:
        if len(prompt) % 2:
            raise ValueError(f"{len(prompt)} characters")
        return [f"{i}: {prompt}" for i in range(n)]

    return model


@query
def i6_failed_calls(spark, sf):
    """Calls of a model that fails for prompts of odd length: a row that says so instead of the texts."""
    prompts = t.questions(spark, sf).select(F.col("qid").alias("id"), F.col("query").alias("prompt"))
    return rollouts.generate(prompts, _half_deaf, 2, attempts=2, wait=0.0, errors=True)


def _sayings(spark, sf) -> DataFrame:
    """Benchmark items as questions that tell their answer and the length of their text to the models below."""
    gold = F.concat(F.lit("w"), F.col("item_id").cast("string"))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.concat(gold, F.lit(" "), F.length("text").cast("string")).alias("query"), F.array(gold).alias("outputs"), F.lit("nothing").alias("context"))


def _right(turns: int):
    """A model that gives the answer in as many of its first texts as the length is over the last multiple of ``turns``, and something else in the others."""

    def start():
        def model(prompt: str, n: int) -> list[str]:
            gold, length = prompt.split()[-2:]
            said = [gold if i < int(length) % turns else "zzz" for i in range(n)]
            return [f"<think>x</think>\\boxed{{{w}}} The answer is {w}" for w in said]

        return model

    return start


@query
def i2_difficulty(spark, sf):
    """Questions of middling difficulty for one model, or too hard for it but not for a second one."""
    return flows.difficulty(_sayings(spark, sf), _right(9), _right(5), 8)[0]


@query
def i3_trajectories(spark, sf):
    rows = _sayings(spark, sf).select(F.col("id").alias("index"), F.col("query").alias("input"), "context", F.col("outputs").alias("answers"), F.lit(4096).alias("length"))
    out = flows.trajectories(rows, _right(5), 4)
    return out.select("index", "num_correct", "pass_rate", F.array_join(F.transform("trajectories", lambda x: x["extracted_answer"]), ",").alias("answers"), "model")


@query
def i7_not_solved_again(spark, sf):
    rows = _sayings(spark, sf).select("id", F.col("query").alias("asked"), F.col("outputs").alias("gold"))
    return flows.not_solved_again(rows, _right(5), 4).select("id", "avg_acc")


def _forgetful():
    """A model that fails the first time it sees a prompt; one for each task."""
    seen: set[str] = set()

    def model(prompt: str, n: int) -> list[str]:
        if prompt not in seen:
            seen.add(prompt)
            raise TimeoutError(prompt)
        return [f"{prompt} {i}" for i in range(n)]

    return model


@query
def i4_i5_retried_calls(spark, sf):
    """Calls that fail once and are tried again, by several threads of one model for each task."""
    prompts = t.questions(spark, sf).select(F.col("qid").alias("id"), F.col("query").alias("prompt"))
    return rollouts.generate(prompts, _forgetful, 3, attempts=2, wait=0.0, threads=4)


@query
def s12_missing_chunks(spark, sf):
    """Of the chunk names expected for seven nodes those that no document falls into, all documents lying in the chunks of five."""
    docs = table(spark, sf, "documents")
    rows = docs.select(F.concat(F.lit("chunk_"), sampling.chunk_of("doc_id", docs.count(), 5).cast("string")).alias("file_name"))
    expected = spark.range(7).select(F.concat(F.lit("chunk_"), F.col("id").cast("string")).alias("file_name"))
    return readers.expected_chunks(rows, expected)


# -- further projections and sets ----------------------------------------------


@query
def p3_p5_hard_answerable(spark, sf):
    rows = table(spark, sf, "documents").select(F.concat((F.col("doc_id") % 3 + 2).cast("string"), F.lit("hop__"), F.col("doc_id").cast("string")).alias("id"), F.lit("q").alias("question"), F.col("lang").alias("answer"), (F.col("n_chars") > 500).alias("answerable"), F.expr("array(named_struct('idx', 7, 'title', source, 'paragraph_text', lang))").alias("paragraphs"), F.expr("array(named_struct('paragraph_support_idx', 7))").alias("question_decomposition"))
    out = adapters.paragraphs(rows, hard_only=True)
    return out.select("id", F.col("outputs")[0].alias("answer"), F.col("passages")[0].alias("passage"), F.col("support")[0].alias("support"))


@query
def p6_as_list(spark, sf):
    raw = F.when(F.col("doc_id") % 3 == 0, F.lit('["a", "b"]')).when(F.col("doc_id") % 3 == 1, F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.as_list(raw), "|").alias("items"))


@query
def p7_p20_first_value(spark, sf):
    rows = table(spark, sf, "labels")
    return rows.select("doc_id", text.first_filled(F.nullif("quality", F.lit(0)), F.col("toxic")).alias("filled"), text.first_truthy(F.col("toxic"), F.col("quality") + 5).alias("truthy"))


@query
def j11_lengths(spark, sf):
    lengths = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("length"))
    return analytics.with_lengths(table(spark, sf, "labels"), lengths, "doc_id")


@query
def o8_first_distinct(spark, sf):
    rows = t.chats(spark, sf).select("conv_id", F.transform("messages", lambda m: m["role"]).alias("roles"))
    return rows.select("conv_id", F.array_join(compose.first_distinct("roles", 2), ",").alias("roles"))


@query
def o9_supporting_only(spark, sf):
    rows = t.own_passages(spark, sf).select(F.col("qid").alias("id"), "query", F.array("query").alias("outputs"), "passages", F.array(F.lit(0), F.lit(2), F.lit(2)).alias("support"))
    return flows.relevant_only(rows).select("id", F.md5("context").alias("digest"))


@query
def o17_o18_last_rows(spark, sf):
    return sampling.head(table(spark, sf, "documents").select("doc_id", "lang"), 25, "doc_id", last_first=True)


@query
def u1_union_counted(spark, sf):
    rows = table(spark, sf, "labels")
    return compare.union_counted([rows.where("quality = 1"), rows.where("quality = 0")], rows.count())


@query
def u4_not_listed(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query
def m1_latest_stage(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("dataset"), (F.col("user_id") % 4).cast("int").alias("length"), F.lit("filtered").alias("stage"), F.col("event_id").alias("samples"), F.lit("f").alias("file"), F.col("ts").alias("updated_at"))
    return manifest.latest(rows).select("dataset", "length", "stage", "samples")


@query
def i1_rollouts(spark, sf):
    prompts = t.questions(spark, sf).select(F.col("qid").alias("id"), F.col("query").alias("prompt"))
    return rollouts.generate(prompts, rollouts.fake_model, 4, threads=4)


# -- end to end ----------------------------------------------------------------


def _long_questions(spark, sf):
    return t.own_passages(spark, sf).select(F.col("qid").cast("string").alias("id"), "query", F.array("query").alias("outputs"), "passages")


@query
def flow_synthesis(spark, sf):
    """Contexts of 16,384 tokens with the questions' own passages around the middle."""
    return flows.synthesise(_long_questions(spark, sf), 16384, 128, core_in_middle=True)[0]


@query
def flow_hidden_questions(spark, sf):
    samples, _ = flows.synthesise(_long_questions(spark, sf), 4096, 128, step=2)
    return flows.hide_questions(samples, _long_questions(spark, sf), 1024)[0].drop("distract_questions")
