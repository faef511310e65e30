"""Tables of training runs and benchmarks: accuracy by bins, step histograms, rewards, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper ends and labels of the length bins of two benchmarks; the first drops what is over its last bin.
STORY_BINS = ((16384, "0-16k"), (32768, "16k-32k"), (49152, "32k-48k"), (65536, "48k-64k"))
CHOICE_BINS = ((16384, "0-16k"), (32768, "16k-32k"), (65536, "32k-64k"), (None, ">64k"))
#: Last steps of the training stages of two runs, and where a plotted series is cut.
STAGES_SMALL, STAGES_LARGE, LAST_PLOTTED_STEP = (43, 212), (169,), 342


def bin_of(length: Column, bins=STORY_BINS) -> Column:
    """The label of the first bin whose upper end is above ``length``; null past the last one."""
    label = F.lit(None).cast("string")
    for top, name in reversed(bins):
        label = F.lit(name) if top is None else F.when(length < top, name).otherwise(label)
    return F.when(length.isNotNull() & (length >= 0), label)


def with_lengths(rows: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """``rows`` with the length that ``lengths`` (key, length) has for them; those without one are left out."""
    return rows.join(lengths.select(key, "length").dropDuplicates([key]), key)


def accuracy_by_bin(rows: DataFrame, length: str, correct: str, bins=STORY_BINS, empty: float | None = None) -> DataFrame:
    """bin, total, correct, accuracy for every label; bins without rows have null (or ``empty``) accuracy."""
    stats = rows.withColumn("bin", bin_of(F.col(length), bins)).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("total"), F.sum(F.col(correct).cast("long")).alias("correct"))
    labels = rows.sparkSession.createDataFrame([(i, b[1]) for i, b in enumerate(bins)], "ord int, bin string")
    out = labels.join(stats, "bin", "left")
    filled = lambda c: F.coalesce(c, F.lit(0)) if empty is not None else F.col(c)
    return out.select("ord", "bin", filled("total").alias("total"), filled("correct").alias("correct"), F.coalesce(F.col("correct") / F.col("total"), F.lit(empty).cast("double")).alias("accuracy"))


def percent(right: Column, n: Column) -> Column:
    return F.when(n > 0, F.bround(100 * right / n, 1)).otherwise(0.0)


def accuracy_by_group(rows: DataFrame, judge: str, groups: tuple[str, ...]) -> DataFrame:
    """grouping, value, right, n, percent for each value of each of ``groups`` and over all rows, in one pass."""
    sets = ", ".join(f"({g})" for g in groups) + ", ()"
    from pyspark.sql.functions import expr

    names = ", ".join(groups)
    view = rows.select(*groups, F.col(judge).cast("long").alias("__judge"))
    label = "CASE " + " ".join(f"WHEN grouping({g}) = 0 THEN '{g}'" for g in groups) + " ELSE 'overall' END"
    value = "CASE " + " ".join(f"WHEN grouping({g}) = 0 THEN CAST({g} AS STRING)" for g in groups) + " END"
    out = rows.sparkSession.sql(f"SELECT {label} AS grouping, {value} AS value, sum(__judge) AS right, count(*) AS n FROM {{v}} GROUP BY GROUPING SETS ({sets})" if names else "", v=view)
    return out.withColumn("percent", percent(expr("right"), expr("n")))


def classify(prompt: Column) -> Column:
    """``long_qa`` for prompts with a second passage, ``long_qa_chain`` if they speak of uuids too, else null."""
    low = F.lower(prompt)
    return F.when(F.contains(low, F.lit("passage 2:")), F.when(F.contains(low, F.lit("uuid")), "long_qa_chain").otherwise("long_qa"))


def before_marker(text: Column, marker: str) -> Column:
    from ..functions.text import strip

    return strip(F.substring_index(text, marker, 1))


def per_input(log: DataFrame) -> DataFrame:
    """step, cls, input, n, total, different: one row for each input of a step and class."""
    return log.groupBy("step", "cls", "input").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.count_distinct("score").alias("different"))


def step_scores(log: DataFrame) -> DataFrame:
    """step, cls, avg_score, inputs, varied_inputs (inputs with more than one score)."""
    per = log.groupBy("step", "cls", "input").agg(F.count("score").alias("n"), F.sum("score").alias("total"), F.min("score").alias("low"), F.max("score").alias("high"))
    return per.groupBy("step", "cls").agg((F.sum("total") / F.sum("n")).alias("avg_score"), F.count("*").alias("inputs"), F.count_if(F.col("low") < F.col("high")).alias("varied_inputs"))


def occurrence_bins(inputs: DataFrame, repeats: int = 16) -> DataFrame:
    """step, cls, bin_0 ... bin_N: inputs by how often they occur, more than N counted as N."""
    rows = inputs.withColumn("bin", F.least("n", F.lit(repeats)).cast("int"))
    return _wide(rows, repeats)


def score_bins(inputs: DataFrame, repeats: int = 16) -> DataFrame:
    """step, cls, bin_0 ... bin_N: inputs by the sum of their scores, rounded half to even; others count in no bin."""
    return _wide(inputs.withColumn("bin", F.bround("total", 0).cast("int")), repeats)


def _wide(rows: DataFrame, repeats: int) -> DataFrame:
    return rows.groupBy("step", "cls").agg(*[F.count_if(F.col("bin") == i).alias(f"bin_{i}") for i in range(repeats + 1)])


def fixed_reward(mean: Column, right: Column, wrong: Column, batch: int = 512) -> Column:
    """The mean reward of a whole batch of which ``right`` and ``wrong`` inputs were left out as all right or all wrong."""
    return (mean * (batch - wrong - right) + right) / batch


def reward_series(metrics: DataFrame, mean: str, right: str, wrong: str, batch: int = 512) -> DataFrame:
    """run, step, reward for the steps that have all three metrics."""
    wide = metrics.groupBy("run", "step").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(a) for k, a in ((mean, "m"), (right, "r"), (wrong, "w"))])
    return wide.where("m IS NOT NULL AND r IS NOT NULL AND w IS NOT NULL").select("run", "step", fixed_reward(F.col("m"), F.col("r"), F.col("w"), batch).alias("reward"))


def mean_series(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """run, step, value: the mean over several metrics."""
    return metrics.where(F.col("key").isin(keys)).groupBy("run", "step").agg(F.avg("value").alias("value"))


def joined_stages(stages: list[tuple[DataFrame, int, int]]) -> DataFrame:
    """Series (step, value) one after another: of each the steps [first, last], its steps shifted by the lengths before it."""
    out, offset = None, 0
    for i, (series, first, last) in enumerate(stages):
        part = series.where(F.col("step").between(first, last)).select(F.lit(i).alias("stage"), (F.col("step") - first + offset).alias("x"), "value")
        out = part if out is None else out.unionByName(part)
        offset += last - first + 1
    return out


def stage_of(step: Column, ends: tuple[int, ...] = STAGES_SMALL) -> Column:
    stage = F.lit(len(ends) + 1)
    for i, end in reversed(list(enumerate(ends))):
        stage = F.when(step <= end, i + 1).otherwise(stage)
    return stage


def stage_middles(rows: DataFrame, ends: tuple[int, ...] = STAGES_SMALL, last: int | None = None) -> DataFrame:
    """stage, mid_x, steps: the middle between first and last step of each stage."""
    rows = rows.where(F.col("step") <= last) if last is not None else rows
    return rows.groupBy(stage_of(F.col("step"), ends).alias("stage")).agg(((F.min("step") + F.max("step")) / 2).alias("mid_x"), F.count("*").alias("steps"))


def unpivoted(wide: DataFrame, keys: list[str], columns: list[str], name: str = "context_length", value: str = "score") -> DataFrame:
    """Long rows of numeric columns; the name as a number."""
    return wide.unpivot(keys, columns, name, value).withColumn(name, F.regexp_extract(name, r"(\d+)", 1).cast("long"))


def depth_pivot(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """depth and, in numeric order, one column for each length with the mean score."""
    return rows.groupBy("depth").pivot("context_length", lengths).agg(F.avg("score"))


def length_stats(rows: DataFrame, tokens: str) -> DataFrame:
    return rows.agg(F.min(tokens).alias("min"), F.max(tokens).alias("max"), F.avg(tokens).alias("mean"), F.count(tokens).alias("n"))


def token_report(rows: DataFrame, tokens: str) -> DataFrame:
    """One row: n, min, max, mean, median, std (of a sample) and percentiles, linearly interpolated."""
    p = lambda q: F.percentile(tokens, F.lit(q))
    return rows.agg(
        F.count(tokens).alias("n"), F.min(tokens).alias("min"), F.max(tokens).alias("max"), F.avg(tokens).alias("mean"), p(0.5).alias("median"), F.stddev_samp(tokens).alias("std"),
        p(0.25).alias("p25"), p(0.75).alias("p75"), p(0.9).alias("p90"), p(0.95).alias("p95"), p(0.99).alias("p99"),
    )


def token_ranges(rows: DataFrame, tokens: str, edges: list[int]) -> DataFrame:
    """range_start, n, percent of the rows from each edge up to the next."""
    start = F.lit(None).cast("long")
    for edge in edges:
        start = F.when(F.col(tokens) >= edge, edge).otherwise(start)
    counts = rows.groupBy(start.cast("long").alias("range_start")).agg(F.count("*").alias("n")).where("range_start IS NOT NULL")
    total = counts.agg(F.sum("n").alias("all"))
    return counts.join(F.broadcast(total)).select("range_start", "n", F.bround(100 * F.col("n") / F.col("all"), 1).alias("percent"))
