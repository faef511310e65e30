"""From raw question sets to one shape: id, query, outputs, passages, support (positions in passages), level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_list, passage


def _pairs(column: Column) -> Column:
    """A JSON array of two-element arrays as structs (a, b) of text; ``b`` is the JSON of the second element."""
    return F.transform(F.from_json(column, "array<array<string>>"), lambda p: F.struct(p[0].alias("a"), p[1].alias("b")))


def paired(raw: DataFrame) -> DataFrame:
    """Passages are titles and their sentences; a passage supports for each supporting title that its text contains (so it may count twice)."""
    context = F.transform(_pairs(F.col("context")), lambda p: passage(p["a"], F.array_join(F.from_json(p["b"], "array<string>"), "")))
    rows = raw.select(F.col("_id").alias("id"), F.col("question").alias("query"), as_list(F.col("answer")).alias("outputs"), context.alias("passages"), _pairs(F.col("supporting_facts")).alias("facts"), "level")
    support = F.flatten(F.transform("passages", lambda c, i: F.transform(F.filter("facts", lambda f: F.contains(c, f["a"])), lambda f: i)))
    return rows.withColumn("support", support).drop("facts")


def paragraphs(raw: DataFrame, hard_only: bool = False) -> DataFrame:
    """Answerable questions; ``hard_only``: of three or four hops. Support comes by way of the decomposition's paragraph numbers."""
    rows = raw.where("answerable")
    if hard_only:
        rows = rows.where(F.col("id").rlike("[34]hop"))
    texts = F.transform("paragraphs", lambda p: passage(p["title"], p["paragraph_text"]))
    places = F.map_from_entries(F.transform("paragraphs", lambda p, i: F.struct(p["idx"], i)))
    support = F.filter(F.transform("question_decomposition", lambda d: F.try_element_at(places, d["paragraph_support_idx"])), lambda x: x.isNotNull())
    return rows.select("id", F.col("question").alias("query"), as_list(F.col("answer")).alias("outputs"), texts.alias("passages"), support.alias("support"), F.lit(None).cast("string").alias("level"))


def articles(raw: DataFrame) -> DataFrame:
    """Possible questions, each with its own paragraph; the other paragraphs of its article are ``more``."""
    article = raw.select(F.explode("data").alias("a")).select("a.paragraphs", F.transform("a.paragraphs", lambda p: p["context"]).alias("all"))
    paragraph = article.select(F.explode("paragraphs").alias("p"), "all").select("p.context", "p.qas", "all")
    rows = paragraph.select("context", "all", F.explode("qas").alias("q")).where(~F.col("q.is_impossible"))
    return rows.select(
        F.lit(None).cast("string").alias("id"), F.col("q.question").alias("query"), F.transform("q.answers", lambda a: a["text"]).alias("outputs"), F.array("context").alias("passages"),
        F.array(F.lit(0)).alias("support"), F.lit(None).cast("string").alias("level"), F.filter("all", lambda t: t != F.col("context")).alias("more"),
    )


def flattened(questions: DataFrame) -> DataFrame:
    """One row per question with its passages joined by line breaks."""
    return questions.select("id", "query", "outputs", F.array_join("passages", "\n").alias("context"), "level")


def normal_rl(rows: DataFrame) -> DataFrame:
    """``rows`` with asked, the question, and gold, the list of gold answers (null without any).

    The question is the first of question, prompt (a text, or a list of messages whose first one counts)
    and input that is there and not null; the golds are the first of outputs, answers, gold, label and
    the reward model's ground_truth, a single text as a list of one. Of these columns any may be missing; a column
    gold or asked gives way.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    asked = [F.try_element_at("prompt", F.lit(1))["content"] if c == "prompt" and kinds[c].startswith("array") else F.col(c) for c in ("question", "prompt", "input") if c in kinds]
    found = [(F.col(c), kinds[c]) for c in ("outputs", "answers", "gold", "label") if c in kinds]
    if kinds.get("reward_model", "").startswith("struct") and "ground_truth" in rows.schema["reward_model"].dataType.names:
        found.append((F.col("reward_model.ground_truth"), rows.select("reward_model.ground_truth").schema[0].dataType.simpleString()))
    golds = [c.cast("array<string>") if kind.startswith("array") else F.when(c.isNotNull(), F.array(c.cast("string"))) for c, kind in found]
    none = F.lit(None)
    return rows.withColumns({"asked": F.coalesce(*asked, none.cast("string")), "gold": F.coalesce(*golds, none.cast("array<string>"))})
