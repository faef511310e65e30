"""Mixing sources to target weights by a low-discrepancy schedule of equal-word blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, WORD, cut_lineage, fresh

#: 2**32 divided by the golden ratio, rounded to an odd number: its multiples modulo 2**32 are the golden-ratio points.
GOLDEN = 2654435769
#: From one run of 2**31 points to the next they shift by this, 2**31 times the golden ratio's fraction modulo 1, so that no run repeats another.
SHIFT = ((1 << 31) * 0x9E3779B97F4A7C15 % (1 << 64)) / (1 << 64)


@dataclass(frozen=True)
class Mix:
    """Weights repeat over the sources in code-point order, null last."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5  # words of the mix, as a multiple of all words
    most: float = 2.0  # no source (hence no document) is taken more often than this
    block: int = 512  # words of a block of the schedule
    seed: str = "mix"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: str = "source") -> Column:
    """Sorts as the source by code point, null last, and is never null."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source)))


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per source (skey, source_size): its target. Shares by weight, stopped at ``most`` times the size, the excess reshared by weight.

    The rows are sources, not documents, so the windows over all of them stay small.
    """
    everything = W.partitionBy(F.lit(0))
    turn = (F.row_number().over(everything.orderBy("skey")) - 1) % len(mix.weights) + 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, mix.weights))), turn.cast("int")))
    rows = rows.withColumn("most", F.col("source_size") * F.lit(float(mix.most))).withColumn("fills_at", F.col("most") / F.col("weight"))
    by_fill = everything.orderBy("fills_at", "skey")
    filled = F.coalesce(F.sum("most").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("rank", F.row_number().over(by_fill)).withColumn("level", (F.sum("source_size").over(everything) * F.lit(mix.share) - filled) / open_weight)
    first = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("rank", "level"))).over(everything)
    rows = rows.withColumn("target", F.least(F.col("most"), F.col("weight") * first["level"]))
    return rows.select("skey", "source_size", "target", F.round("target").cast("long").alias("words"))


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, tag (hash of the text), skey, size (words) of each row, and the columns ``keep`` as kept_..."""
    tag = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), tag.alias("tag"), source_key(source_col).alias("skey"), word_count(text_col).alias("size"), *[F.col(c).alias(f"kept_{c}") for c in keep])


def source_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("skey").agg(F.sum("size").alias("source_size"))


def bucket_digits(n: int, per: int = 50000) -> int:
    """Hexadecimal digits that cut ``n`` rows into buckets of about ``per`` or fewer; 3 at least."""
    return max(3, len(f"{max(1, n // per):x}"))


def lay_out(rows: DataFrame, mix: Mix = Mix(), digits: int = 3) -> DataFrame:
    """Each ``counted`` row with its place in its source's shuffled stream of words: bucket, row in it, start.

    The order in a source is by md5 of seed, id and text, so rows that share an id (or have none) spread
    as others do. Rows go to buckets of that order by its first ``digits``, which change no place; the
    start of a bucket is a running sum over bucket totals, the place within it a running sum over the
    bucket, so no source, however large, meets in one task.
    """
    rows = rows.withColumn("order", F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("doc_id").cast("string"), "tag"))).withColumn("bucket", F.substring("order", 1, digits))
    totals = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("bucket_size"))
    so_far = W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(so_far), F.lit(0))).drop("bucket_size")
    within = W.partitionBy("skey", "bucket").orderBy("order", F.col("doc_id").asc_nulls_last(), "size")
    rows = rows.withColumn("row", F.row_number().over(within)).withColumn("before", F.coalesce(F.sum("size").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(starts, ["skey", "bucket"]).withColumn("start", F.col("bucket_start") + F.col("before")).drop("bucket_start", "before", "order", "tag")


def schedule(goals: DataFrame, mix: Mix = Mix(), grid: int = 4096, run: int = 65536) -> DataFrame:
    """Slots of the mix: (skey, turn, slot), the ``turn``-th block of each source in its place.

    Slot s holds the golden-ratio point of s; cumulative targets map the point to a source. A source's
    slots are ranked by runs of ``run`` slots (counts per run, running sums over runs, ranks within a
    run). Blocks still due when the points are used up come at the end.
    """
    everything = W.partitionBy(F.lit(0))
    goals = goals.where(F.col("words") > 0).withColumn("turns", F.ceil(F.col("words") / mix.block).cast("long"))
    upto = F.sum("words").over(everything.orderBy("skey"))
    all_words = F.sum("words").over(everything)
    goals = goals.withColumn("low", (upto - F.col("words")) / all_words).withColumn("high", upto / all_words)
    goals = goals.withColumn("slots", F.sum("turns").over(everything))
    cells = goals.select("skey", "turns", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * grid), F.least(F.floor(F.col("high") * grid), F.lit(grid - 1)))).alias("cell"))
    slots = _count_up(goals.agg(F.max("slots").alias("slots")), run)
    point = ((F.col("slot") % F.lit(1 << 31)) * F.lit(GOLDEN)).bitwiseAND(F.lit((1 << 32) - 1)) / F.lit(float(1 << 32))
    point = (point + F.floor(F.col("slot") / F.lit(1 << 31)) * F.lit(SHIFT)) % 1.0
    slots = slots.withColumn("point", point).withColumn("cell", F.floor(F.col("point") * grid))
    # Spark takes the exploded tables for small ones; merging keeps it from broadcasting what grows with the data
    hit = slots.join(cells.hint("merge"), "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))).select("skey", "turns", "slot", F.floor(F.col("slot") / run).alias("run"))
    counts = hit.groupBy("skey", "run").agg(F.count("*").alias("n"))
    counts = counts.withColumn("earlier", F.coalesce(F.sum("n").over(W.partitionBy("skey").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = hit.withColumn("rank", F.row_number().over(W.partitionBy("skey", "run").orderBy("slot")) - 1)
    ranked = ranked.join(counts.select("skey", "run", "earlier").hint("merge"), ["skey", "run"]).withColumn("turn", F.col("rank") + F.col("earlier"))
    timely = ranked.where(F.col("turn") < F.col("turns")).select("skey", F.col("turn").cast("long").alias("turn"), "slot")
    given = counts.groupBy("skey").agg(F.sum("n").alias("given"))
    late = goals.join(given, "skey", "left").withColumn("given", F.coalesce("given", F.lit(0))).where(F.col("given") < F.col("turns"))
    late = late.select("skey", F.explode(F.sequence(F.col("given"), F.col("turns") - 1)).alias("turn"), "slots")
    late = late.select("skey", F.col("turn").cast("long").alias("turn"), (F.col("slots") + F.row_number().over(everything.orderBy("turn", "skey")) - 1).alias("slot"))
    return timely.unionByName(late)


def _count_up(total: DataFrame, run: int) -> DataFrame:
    """0, 1, ... up to the one number in ``total``, by runs; rows spread over the tasks, none from the driver."""
    runs = total.select(F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / run))).alias("run"), "slots").repartition("run")
    return runs.select(F.explode(F.sequence(F.col("run") * run, F.least((F.col("run") + 1) * run, F.col("slots")) - 1)).alias("slot"))


def pieces(laid: DataFrame, slots: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Rows of ``laid``, one for each block that takes words of them: slot, pass, first word, words (null slot: nothing taken).

    A source's stream repeats (pass 0, 1, ...) and its blocks take it in order, the last one cut at the
    source's target.
    """
    passes = F.sequence(F.lit(0), F.lit(int(-(-mix.most // 1)) - 1))
    spread = laid.withColumn("pass", F.explode(passes)).withColumn("at", F.col("start") + F.col("pass") * F.col("source_size"))
    taken = F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - F.col("at")))
    spread = spread.withColumn("left", taken).where((F.col("left") > 0) | (F.col("pass") == 0))
    first, last = F.floor(F.col("at") / mix.block), F.floor((F.col("at") + F.col("left") - 1) / mix.block)
    spread = spread.withColumn("turn", F.explode_outer(F.when(F.col("left") > 0, F.sequence(first, last))))
    low = F.greatest(F.col("at"), F.col("turn") * mix.block)
    high = F.least(F.col("at") + F.col("left"), (F.col("turn") + 1) * mix.block)
    spread = spread.withColumn("first_word", low - F.col("at")).withColumn("n_words", high - low).drop("at", "left")
    return spread.join(slots.hint("merge"), ["skey", "turn"], "left")


def mix_sources(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as pieces of documents: doc_id, source, slot, pass, first_word, n_words, size, source_size, target and the row's place.

    Sort by slot and first_word to read it. Rows of which nothing is taken have a null slot. Documents
    of one source come in an order fixed by their ids and texts, so reruns agree; equal rows are interchangeable.
    A null text has no words; null ids and sources are values like others (null source last); other
    columns are ignored; an empty table gives an empty mix.
    """
    out = _mixed(counted(docs, id_col, text_col, source_col), mix)
    source = F.when(F.col("skey") == "1", F.lit(None)).otherwise(F.expr("substring(skey, 2)"))
    return out.select("doc_id", source.alias("source"), "slot", "pass", "first_word", "n_words", "size", "source_size", "target", "skey", "bucket", "row")


def _mixed(rows: DataFrame, mix: Mix) -> DataFrame:
    """``pieces`` of ``counted`` rows, which are written once."""
    rows = cut_lineage(rows)
    goals = cut_lineage(targets(source_sizes(rows), mix))
    return pieces(lay_out(rows, mix, bucket_digits(rows.count())).join(goals, "skey"), schedule(goals, mix), mix)


def taken_words(mixed: DataFrame) -> DataFrame:
    """Per document of a mix: size, source_size, target, taken (the words that the mix holds of it), and the first of the n_blocks blocks that hold them.

    An empty mix gives an empty result; a document of which nothing is taken has taken 0, a null
    first_slot and no blocks.
    """
    rows = mixed.groupBy("skey", "bucket", "row", "doc_id", "size", "source_size", "target")
    return rows.agg(F.sum(F.when(F.col("slot").isNotNull(), F.col("n_words")).otherwise(0)).alias("taken"), F.min("slot").alias("first_slot"), F.count("slot").alias("n_blocks"))


def mixed_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Documents as the mix holds them, with the columns of ``docs``: one row for each pass that takes a document.

    A whole take keeps the row as it is. The last document of a source may be cut: its first words with
    the white space between them, and n_chars (where there is such a column) counted anew. Documents
    without words (null and empty texts) are in no block and so in no mix. Null ids and sources count as
    in ``mix_sources``, each of several equal rows is taken for itself, other columns stay as they are,
    whatever their names; an empty table gives an empty result.
    """
    k1, k2, whole, cut, i, j = fresh(docs.columns, "__k1", "__k2", "__whole", "__cut", "__i", "__j")
    content = [x for f in docs.schema.fields for x in (F.col(f.name).isNull(), F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name))]
    keyed = docs.withColumn(k1, F.xxhash64(F.lit(1), *content)).withColumn(k2, F.xxhash64(F.lit("b"), *content))
    # the mix is made of ids and hashes; rows of equal content share a hash, and at most one take of them is cut
    takes = _mixed(counted(keyed, keep=(k1, k2)), mix).where(F.col("slot").isNotNull())
    takes = takes.groupBy(F.col(f"kept_{k1}").alias(k1), F.col(f"kept_{k2}").alias(k2), "skey", "bucket", "row", "pass", "size").agg(F.sum("n_words").alias("taken"))
    takes = takes.groupBy(k1, k2).agg(F.count_if(F.col("taken") == F.col("size")).alias(whole), F.max(F.when(F.col("taken") < F.col("size"), F.col("taken"))).alias(cut))
    # texts are shuffled once, to meet their takes; equal rows stand together then, and one stands for all
    rows = keyed.join(takes, [k1, k2]).dropDuplicates([k1, k2])
    times = F.col(whole) + F.col(cut).isNotNull().cast("long")
    rows = rows.withColumn(i, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((times - 1) / 1000))))
    rows = rows.withColumn(j, F.explode(F.sequence(F.col(i) * 1000, F.least(times, (F.col(i) + 1) * 1000) - 1)))
    in_part = F.col(j) == F.col(whole)
    word_and_space = F.lit(rf"{WORD}[{SPACE}]*")
    start = F.array_join(F.slice(F.regexp_extract_all("text", word_and_space, F.lit(0)), 1, F.col(cut).cast("int")), "")
    out = {"text": F.when(in_part, start).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(in_part, F.char_length(start)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select([out[c].alias(c) if c in out else F.col(c) for c in docs.columns])
