"""Chat rows for fine-tuning: from rollouts to rows, the best of several, cleaning, checks, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import extract
from ..functions.text import fill, strip

#: Prompt templates, by use.
READ = "The following are given passages.\n{context}\n\nQuestion: {input}"
READ_AND_SAY = (
    "The following are given passages.\n{context}\n\nAnswer the question based on the given passages. Please think step by step before answering. "
    "After thinking, output the final answer in the format of 'The answer is <your answer here>'\n\nQuestion: {input}"
)
ANSWER_FIRST = "Answer the question based on the given passages.\n\nThe following are given passages.\n{context}\n\nNow, answer the question: {input}"
REASON_WITH_MARKERS = (
    "Answer the question based on the given passages following these steps: \n\n Start with a `<think>` and break down the question into key elements;\n"
    " As you reason, use the marker `wait` to pause and reflect on details when necessary;\n"
    " Provide a clear, step-by-step explanation of your reasoning, ensuring each step is backed by the passages;\n"
    " End your response with a final line starting with `Answer:` followed by your answer.\n Keep your reasoning rigorous, precise, and succinct.\n\n"
    " The following are given passages.\n {context}\n\n Question: {input}"
)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(context: Column, question: Column, answer: Column, template: str = READ) -> Column:
    return F.array(message("user", fill(template, context=context, input=question)), message("assistant", answer))


def convert(records: DataFrame, dataset: Column | str, model_tag: Column | str, skip_empty: bool = True, template: str = READ) -> DataFrame:
    """One chat row for each trajectory of a record, in order (traj_pos); blank ones left out unless kept on purpose."""
    rows = records.select("*", F.posexplode("trajectories").alias("traj_pos", "t"))
    if skip_empty:
        rows = rows.where(F.length(strip(F.col("t.text"))) > 0)
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(
        chat(F.col("context"), F.col("input"), F.col("t.text"), template).alias("messages"), "t.is_correct", "t.sub_em", "t.em", "t.f1", "t.extracted_answer", "answers", "source_index",
        lit(dataset).alias("dataset"), "length", lit(model_tag).alias("model"), "traj_pos",
    )


def best_of(rows: DataFrame, keys: tuple[str, ...] = ("dataset", "length", "source_index"), position: str = "traj_pos") -> DataFrame:
    """Of each group the right row (sub_em 1) with the highest f1, the first one on a tie; groups without a right row vanish."""
    order = W.partitionBy(*keys).orderBy(F.col("f1").desc(), F.col(position))
    return rows.where("sub_em = 1").withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def clean(rows: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(cleaned, rejected): traces as ``<think>...</think>answer`` in column cleaned; those without a closing tag are rejected."""
    marked = rows.withColumn("cleaned", extract.clean_trace(F.col(text)))
    return marked.where("cleaned IS NOT NULL"), marked.where("cleaned IS NULL").drop("cleaned")


def fused(records: DataFrame, dataset: str, model_tag: str, template: str = READ) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): of each record the best trajectory, cleaned, as a chat row."""
    best = best_of(convert(records, dataset, model_tag, False, template))
    good, bad = clean(best.withColumn("text", F.element_at("messages", 2)["content"]))
    answer = F.array(F.element_at("messages", 1), message("assistant", F.col("cleaned")))
    return good.withColumn("messages", answer).drop("cleaned", "text"), bad.drop("text")


def rule_errors(messages: Column) -> Column:
    """What is wrong with a row's messages, as a list of texts; empty if nothing is."""
    # fixed values: the texts of the errors
    checks = F.transform(
        messages,
        lambda m, i: F.when(m["role"].isNull() | m["content"].isNull(), F.concat(F.lit("message["), i.cast("string"), F.lit("] missing 'role' or 'content'"))).when(
            m["content"] == "", F.concat(F.lit("message["), i.cast("string"), F.lit("] has empty content"))
        ),
    )
    last = F.element_at(messages, -1)["role"]
    role = F.when(~last.eqNullSafe(F.lit("assistant")), F.concat(F.lit("last message role must be 'assistant', got '"), F.coalesce(last, F.lit("None")), F.lit("'")))
    found = F.filter(F.concat(checks, F.array(role)), lambda e: e.isNotNull())
    return F.when(messages.isNull(), F.array(F.lit("missing 'messages' field"))).when(F.size(messages) == 0, F.array(F.lit("'messages' must be a non-empty list"))).otherwise(found)


def error_counts(rows: DataFrame, messages: str = "messages") -> DataFrame:
    """rule, n: how often each rule is broken; message numbers are left out of the rule."""
    errors = rows.select(F.explode(rule_errors(F.col(messages))).alias("e"))
    return errors.groupBy(F.regexp_replace("e", r"\[\d+\]", "").alias("rule")).agg(F.count("*").alias("n"))


def conforms(rows: DataFrame, schema: str) -> list[str]:
    """The columns of ``schema`` (DDL) that ``rows`` lack or hold in another type."""
    from pyspark.sql.types import StructType

    have = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return [f.name for f in StructType.fromDDL(schema).fields if have.get(f.name) != f.dataType.simpleString()]


def merged(existing: DataFrame, incremental: DataFrame) -> DataFrame:
    """Both, in full, with origin and origin_order (existing first); nothing is taken for a duplicate."""
    tag = lambda rows, name, i: rows.withColumn("origin", F.lit(name)).withColumn("origin_order", F.lit(i))
    return tag(existing, "existing", 0).unionByName(tag(incremental, "incremental", 1), allowMissingColumns=True)


def merge_counts(existing: DataFrame, incremental: DataFrame, keys: tuple[str, ...] = ("dataset", "length")) -> DataFrame:
    """keys, existing, incremental, merged for the groups that both sides have, and a total row (keys null)."""
    counts = merged(existing.select(*keys), incremental.select(*keys)).groupBy(*keys).agg(F.count_if(F.col("origin") == "existing").alias("existing"), F.count_if(F.col("origin") == "incremental").alias("incremental"))
    both = counts.where("existing > 0 AND incremental > 0")
    both = both.rollup(*keys).agg(F.sum("existing").alias("existing"), F.sum("incremental").alias("incremental"), F.grouping_id().alias("g"))
    return both.where(F.col("g").isin(0, 2 ** len(keys) - 1)).select(*keys, "existing", "incremental", (F.col("existing") + F.col("incremental")).alias("merged"))


def rl_rows(samples: DataFrame, template: str = REASON_WITH_MARKERS) -> DataFrame:
    """question, context, answers, answer (the first one), messages with the filled prompt."""
    prompt = fill(template, context=F.col("context"), input=F.col("input"))
    return samples.select(F.col("input").alias("question"), "context", "answers", F.try_element_at("answers", F.lit(1)).alias("answer"), F.array(message("user", prompt)).alias("messages"))
