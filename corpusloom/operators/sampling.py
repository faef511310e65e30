"""Sampling and order by hashes of seed and key: the same on every run, partitioning and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .corpus import ranked


def draw(seed: str | int, *keys: str | Column) -> Column:
    """A hexadecimal digest of seed and keys, to order by."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def number(seed: str | int, *keys: str | Column) -> Column:
    """32 bits of ``draw`` as a number."""
    return F.conv(F.substring(draw(seed, *keys), 1, 8), 16, 10).cast("long")


def uniform(seed: str | int, *keys: str | Column) -> Column:
    """A number between 0 and 1, neither included."""
    return (number(seed, *keys) + 0.5) / F.lit(float(1 << 32))


def shuffled(rows: DataFrame, seed: str | int, key: str) -> DataFrame:
    """``rows`` with shuffle_pos, their place (from 0) in an order drawn by ``key``; equal keys come one after another in no set order."""
    drawn = rows.withColumn("__draw", F.concat(draw(seed, key), F.lit(":"), F.col(key).cast("string")))
    return ranked(drawn, "__draw", "shuffle_pos").drop("__draw")


def sliced(rows: DataFrame, start: int, end: int, position: str = "row_idx") -> DataFrame:
    """Rows of positions [start, end); end -1: to the last. A start at or past the end is an error."""
    if end != -1 and start >= end:
        raise ValueError(f"empty slice [{start}, {end})")
    rows = rows.where(F.col(position) >= start)
    return rows if end == -1 else rows.where(F.col(position) < end)


def head(rows: DataFrame, n: int, *by: str, last_first: bool = False) -> DataFrame:
    """The first ``n`` rows (or last, from the end) in the order of ``by``."""
    return rows.orderBy(*[F.col(c).desc() if last_first else F.col(c) for c in by]).limit(n)


def disjoint_slice(shuffled_rows: DataFrame, pre_samples: int, num_samples: int) -> DataFrame:
    """A slice of a shuffled table with index (from 0) and source_index (its place in the shuffle)."""
    part = sliced(shuffled_rows, pre_samples, pre_samples + num_samples, "shuffle_pos")
    return part.withColumn("source_index", F.col("shuffle_pos")).withColumn("index", F.col("shuffle_pos") - pre_samples).drop("shuffle_pos")


#: For each context length the places in the shuffle of the first samples and of the later ones.
LENGTH_RANGES = {4096: ((0, 1000), (4000, 5500)), 8192: ((1000, 2000), (5500, 7000)), 16384: ((2000, 3000), (7000, 8500)), 32768: ((3000, 4000), (8500, 10000))}


def chunk_of(position: str, total: Column | int, nodes: int) -> Column:
    """Which of ``nodes`` contiguous chunks of rounded-up size a row falls into."""
    size = F.ceil((F.lit(total) if isinstance(total, int) else total) / nodes)
    return F.floor(F.col(position) / size).cast("int")


def chunk_ranges(spark, total: int, nodes: int) -> DataFrame:
    """node, start, end of each chunk; chunks past the rows are empty."""
    size = -(-total // nodes)
    rows = spark.range(nodes).select(F.col("id").cast("int").alias("node"))
    return rows.select("node", F.least(F.lit(total), F.col("node") * size).cast("long").alias("start"), F.least(F.lit(total), (F.col("node") + 1) * size).cast("long").alias("end"))


def length_mix(rows: DataFrame, weights: dict[int, float], seed: str | int, shuffle: bool = True) -> DataFrame:
    """Of questions that exist at each length (columns length, index), ``int(share * N)`` for each length.

    Shuffled: disjoint indices, in the order of ``weights``. Not shuffled: the first of each length, so
    indices overlap.
    """
    whole = sum(weights.values())
    indices = rows.select("index").distinct()
    n = indices.count()
    taken = [int(w / whole * n) for w in weights.values()]
    place = shuffled(indices, seed, "index") if shuffle else ranked(indices, "index", "shuffle_pos")
    bounds, at = [], 0
    for length, k in zip(weights, taken):
        bounds.append((F.col("length") == length) & (F.col("shuffle_pos") >= at) & (F.col("shuffle_pos") < at + k))
        at += k if shuffle else 0
    keep = F.lit(False)
    for b in bounds:
        keep = keep | b
    return rows.join(place, "index").where(keep).drop("shuffle_pos")


def decoy_count(max_seq: int) -> int:
    """Decoy questions for a context length: 16 for each 1024 tokens, 16 at least."""
    return max(16, max_seq // 1024 * 16)


def sample_others(questions: DataFrame, k: int, seed: str | int, key: str = "qid", text: str = "query") -> DataFrame:
    """key, distract_questions: for each question ``k`` others, drawn without replacement, own key and own text left out.

    Candidates are drawn by number, some more than needed, and joined by number: no question meets all
    others. Where repeats leave too few, more are drawn for all until every question has its k. If some
    question has fewer than k others of another text, that is an error; an empty table gives an empty result.
    """
    texts = questions.groupBy(F.col(text).alias("otext")).agg(F.count("*").alias("same"))
    n, same = texts.agg(F.coalesce(F.sum("same"), F.lit(0)), F.coalesce(F.max("same"), F.lit(0))).first()
    if n and n - same < k:
        raise ValueError(f"{k} decoys need as many other questions; of {n} questions, {same} share one text")
    if not n:
        return questions.select(F.col(key), F.array(F.col(text)).alias("distract_questions"))
    numbered = ranked(questions.select(F.col(key).alias("okey"), F.col(text).alias("otext")), "okey", "number")
    own = questions.select(F.col(key).alias("qkey"), F.col(text).alias("qtext"))
    draws = -(-3 * k // 2) + 32
    while True:
        tries = own.select("qkey", "qtext", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("i")).withColumn("number", number(seed, "qkey", "i") % n)
        first = tries.groupBy("qkey", "qtext", "number").agg(F.min("i").alias("i"))
        met = first.join(numbered, "number").where((F.col("okey") != F.col("qkey")) & (F.col("otext") != F.col("qtext")))
        ranks = met.withColumn("r", F.row_number().over(W.partitionBy("qkey").orderBy("i"))).where(F.col("r") <= k)
        enough = ranks.groupBy("qkey").agg(F.count("*").alias("got"))
        if own.select("qkey").join(enough.where(F.col("got") == k), "qkey", "left_anti").isEmpty():
            ordered = F.array_sort(F.collect_list(F.struct("r", "otext")))
            return ranks.groupBy(F.col("qkey").alias(key)).agg(F.transform(ordered, lambda s: s["otext"]).alias("distract_questions"))
        draws *= 2
