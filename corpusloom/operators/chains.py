"""Key-to-value chains that hide a question, decoy chains, trees, and their insertion into a context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sampling import draw

#: Hops of a chain, chains for each 1024 tokens, hexadecimal digits of a short id.
HOPS, CHAINS_PER_1024, SHORT_ID = 4, 4, 8
#: A stretch of text up to and with a stopper (line break, full stop, question mark), or the rest.
SEGMENT = r"[^\n.?]*[\n.?]|[^\n.?]+"


def identifier(seed: str | int, *keys: str | Column, form: str | int = "default") -> Column:
    """An id made from seed and keys: ``default`` (8-4-4-4-12), the first n (1 to 32) hexadecimal digits, or ``nano`` / ``nano n`` letters, digits, - and _ (21 or n)."""
    digest = draw(seed, *keys)
    if form == "default":
        return F.concat_ws("-", *[F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    if isinstance(form, int) and 1 <= form <= 32:
        return F.substring(digest, 1, form)
    if isinstance(form, str) and form.split()[:1] == ["nano"]:
        n = int(form.split()[1]) if len(form.split()) > 1 else 21
        letters = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_-"
        one = lambda i: F.substring(F.lit(letters), (F.conv(F.substring(draw(seed, *keys, F.lit(i)), 1, 2), 16, 10).cast("int") % 64) + 1, F.lit(1))
        return F.concat(*[one(i) for i in range(n)])
    raise ValueError(f"unknown id form: {form}")


def chain_count(max_seq: int) -> int:
    return CHAINS_PER_1024 * max_seq // 1024


def pair(key: Column, value: Column) -> Column:
    return F.concat(F.lit('{"'), key, F.lit('": "'), value, F.lit('"}'))


def chain_pairs(ids: Column, end: Column | None) -> Column:
    """The pairs of a chain of ids, and one from the last id to ``end``, whose text is not escaped (none if null)."""
    inner = F.transform(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))), lambda x, i: pair(x, F.element_at(ids, i + 2)))
    if end is None:
        return inner
    return F.when(end.isNotNull(), F.concat(inner, F.array(pair(F.element_at(ids, -1), end)))).otherwise(inner)


def chains(samples: DataFrame, max_seq: int, seed: str | int, key: str = "index", question: str = "input", decoys: str = "distract_questions", hops: int = HOPS, form: str | int = SHORT_ID) -> DataFrame:
    """key, chain, head, pairs: the chains of each sample. Chain 0 ends in its question, chain i in decoy i.

    Decoy 0 is not used, so a sample needs as many decoys as chains; too few are an error in the data
    (the job stops).
    """
    n = chain_count(max_seq)
    rows = samples.select(key, question, decoys, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("chain"))
    decoy = F.try_element_at(decoys, F.col("chain") + 1)
    end = F.when(F.col("chain") == 0, F.col(question)).otherwise(F.coalesce(decoy, F.raise_error(F.lit("a sample has fewer decoy questions than chains"))))
    ids = F.array(*[identifier(seed, key, "chain", F.lit(h), form=form) for h in range(hops)])
    rows = rows.withColumn("ids", ids).withColumn("end", end)
    return rows.select(key, "chain", F.element_at("ids", 1).alias("head"), chain_pairs(F.col("ids"), F.col("end")).alias("pairs"))


def walk(pairs: DataFrame, heads: DataFrame, hops: int = HOPS, key: str = "index") -> DataFrame:
    """key, reached: where ``hops`` steps from each sample's head lead (pairs: key, pair; heads: key, head)."""
    edges = pairs.select(key, F.regexp_extract("pair", r'^\{"([^"]*)": "', 1).alias("at"), F.regexp_extract("pair", r'(?s)^\{"[^"]*": "(.*)"\}\z', 1).alias("to"))
    now = heads.select(key, F.col("head").alias("at"))
    for _ in range(hops):
        now = now.join(edges, [key, "at"]).select(key, F.col("to").alias("at"))
    return now.withColumnRenamed("at", "reached")


def insert(samples: DataFrame, pairs: DataFrame, seed: str | int, key: str = "index", context: str = "context") -> tuple[DataFrame, DataFrame]:
    """(placed, rejected): each sample's pairs (key, pair) after distinct drawn stoppers of its context.

    placed: key, distractor_context; a pair follows its stopper as `` pair.`` (without the blank after a
    line break). rejected: key, stoppers, pairs of the samples with fewer stoppers than pairs. Samples
    without pairs keep their context.
    """
    order = F.row_number().over(W.partitionBy(key).orderBy(draw(seed, key, "pair"), "pair"))
    ranked = pairs.select(key, "pair").withColumn("turn", order)
    wanted = pairs.groupBy(key).agg(F.count("*").alias("pairs"))
    segments = samples.select(key, F.posexplode(F.regexp_extract_all(context, F.lit(SEGMENT), F.lit(0))).alias("pos", "segment"))
    stops = F.col("segment").rlike(r"[\n.?]\z")
    counts = segments.groupBy(key).agg(F.sum(stops.cast("int")).alias("stoppers"))
    needs = samples.select(key, F.col(context).alias("__context")).join(counts, key, "left").join(wanted, key, "left").withColumn("stoppers", F.coalesce("stoppers", F.lit(0))).withColumn("pairs", F.coalesce("pairs", F.lit(0)))
    rejected = needs.where(F.col("stoppers") < F.col("pairs")).select(key, "stoppers", "pairs")
    turn = F.row_number().over(W.partitionBy(key, stops).orderBy(draw(seed, key, F.lit("stop"), "pos"), "pos"))
    ranked_segments = segments.withColumn("turn", F.when(stops, turn))
    joined = ranked_segments.join(ranked, [key, "turn"], "left")
    gap = F.when(F.col("segment").endswith("\n"), "").otherwise(" ")
    piece = F.when(F.col("pair").isNotNull(), F.concat("segment", gap, "pair", F.lit("."))).otherwise(F.col("segment"))
    text = joined.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))), lambda s: s["piece"]), "").alias("distractor_context"))
    placed = needs.where(F.col("stoppers") >= F.col("pairs")).join(text, key, "left").select(key, F.coalesce("distractor_context", "__context").alias("distractor_context"))
    return placed, rejected


def tree_ids(levels: int, children: int, seed: str | int, *keys: str, form: str | int = "default") -> Column:
    """The ids of a complete tree, by heap position."""
    n = levels if children == 1 else (children**levels - 1) // (children - 1)
    return F.array(*[identifier(seed, *keys, F.lit(i), form=form) for i in range(max(n, 0))])


def tree_pairs(trees: DataFrame, seed: str | int, key: str, ids: str = "ids", question: str = "input") -> DataFrame:
    """key, pos, pair: parent-to-child pairs of binary trees by heap position, and from each leaf a pair to a fresh id, from one drawn leaf to the question."""
    n = F.size(ids)
    nodes = trees.select(key, ids, question, n.alias("n"), F.posexplode(ids).alias("i", "node"))
    children = nodes.select(key, ids, "i", "n", "node", F.explode(F.array(2 * F.col("i") + 1, 2 * F.col("i") + 2)).alias("child")).where(F.col("child") < F.col("n"))
    inner = children.select(key, F.col("child").alias("pos"), pair(F.col("node"), F.element_at(ids, F.col("child") + 1)).alias("pair"))
    leaves = nodes.where(F.col("i") >= F.floor(F.col("n") / 2)).withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(draw(seed, key, "i"))))
    end = F.when(F.col("r") == 1, F.col(question)).otherwise(identifier(f"{seed}end", key, "i"))
    return inner.unionByName(leaves.select(key, (F.col("n") + F.col("i")).alias("pos"), pair(F.col("node"), end).alias("pair")))
