"""SimHash fingerprints and their near duplicates, compared on bit planes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut_lineage, fresh, slices, text_or_empty
from .components import connected, forest

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """64 bits: bit i is 1 if it is set in over half of the XXH64 of the ``width``-word shingles; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        hashes = [xxh64_intdigest(line, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-width] + 1).tolist()]
        hashes = [xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())]
    octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag, fp): the fingerprint of every row's whole text as a signed 64-bit integer, and a hash that tells texts apart; null text: as empty."""
    bounded_batches(docs.sparkSession)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tag"], pa.array(fps)], names=["doc_id", "tag", "fp"])

    return rows.mapInArrow(made, f"doc_id {id_type}, tag long, fp long")


def close_pairs(fps: np.ndarray, group: np.ndarray, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of fingerprints of one group (equal values stand together) at most ``radius`` bits apart.

    The 64 bit planes are bit vectors over positions. For each lag, a plane xor itself shifted by the
    lag tells for every position whether the bit differs from that of the position ``lag`` further on;
    carry-save counters add these vectors up, and the lag is abandoned once every position exceeds the radius.
    """
    counters = radius.bit_length()
    if radius + 1 != 1 << counters:
        raise ValueError("the radius has to be one less than a power of two")
    n = len(fps)
    planes = [int.from_bytes(np.packbits((fps >> np.uint64(b)) & np.uint64(1), bitorder="little").tobytes(), "little") for b in range(64)]
    left, right = [], []
    for lag in range(1, n):
        same = group[:-lag] == group[lag:]
        if not same.any():
            break
        full = (1 << (n - lag)) - 1
        over = full ^ int.from_bytes(np.packbits(same, bitorder="little").tobytes(), "little")
        sums = [0] * counters
        for b, plane in enumerate(planes):
            carry = plane ^ (plane >> lag)
            for i in range(counters):
                sums[i], carry = sums[i] ^ carry, sums[i] & carry
            over |= carry
            if b % 8 == 7 and over & full == full:
                break
        if hits := full ^ (over & full):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(hits.to_bytes((n - lag + 7) // 8, "little"), np.uint8), bitorder="little"))
            left.append(at)
            right.append(at + lag)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _linked(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each linked fingerprint of a group with the first of its local component: links enough to join them."""
    sizes = np.bincount(group)
    size_class = np.frexp(sizes.astype(float))[1][group]  # groups of about equal size are compared together
    a, b = [], []
    for k in np.unique(size_class[sizes[group] > 1]):
        part = np.flatnonzero((size_class == k) & (sizes[group] > 1))
        i, j = close_pairs(fps[part], group[part], radius)
        if len(i):
            root = forest(len(part), i, j)
            moved = np.flatnonzero(root != np.arange(len(part)))
            a.append(fps[part[moved]])
            b.append(fps[part[root[moved]]])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def masks(n: int, radius: int = 3) -> list[int]:
    """Bit masks such that fingerprints within the radius agree on one of them at least.

    64 bits in m blocks: at most ``radius`` blocks differ, so some m - radius blocks agree. More
    fingerprints take more blocks and so longer keys, which keeps groups short; every choice is exact.
    """
    m = radius + (1 if n <= 1 << 22 else 2 if n <= 1 << 31 else 3)
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(m)]
    return [sum(chosen) for chosen in combinations(blocks, m - radius)]


def links(distinct: DataFrame, n: int, radius: int = 3, group_rows: int = 4096) -> DataFrame:
    """(a, b) among the distinct fingerprints (column fp; about ``n`` of them): enough links to join all within the radius.

    Every fingerprint goes to one group for each mask. Groups of over ``group_rows`` are cut into parts
    by hash and all pairs of parts are compared, so no task holds more than two parts of a group.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(n, radius)]
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])).alias("g")).select("fp", "g.*")
    sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = keyed.join(sizes, ["mask", "key"]).withColumn("parts", F.ceil(F.col("n") / group_rows).cast("long"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    rows = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("mask", "key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "fp")
    rows = rows.repartition("mask", "key", "p", "q").sortWithinPartitions("mask", "key", "p", "q")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            here = np.column_stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "key", "p", "q", "fp")])
            if not len(here):
                continue
            here = np.concatenate([*held, here])
            last = np.flatnonzero((here[:, :4] != here[-1, :4]).any(axis=1))
            cut = last[-1] + 1 if len(last) else 0  # the last group may go on in the next batch
            held = [here[cut:]]
            if cut:
                yield from found(here[:cut])
        if held:
            yield from found(held[0])

    def found(block: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.concatenate([[0], np.cumsum((np.diff(block[:, :4], axis=0) != 0).any(axis=1))])
        a, b = _linked(block[:, 4].copy().view(np.uint64), group, radius)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return rows.mapInArrow(compared, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at ``radius`` or fewer differing bits, equal ones always; component_id is the
    smallest id reachable. A null text counts as empty; texts without words have fingerprint zero and
    link like any other. Rows with a null id take part, but a null id never names a component that has
    another id. Repeated rows are copies. Other columns are ignored; an empty table gives an empty result.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col))
    named = _roots(rows, radius)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _roots(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, first, root) for each distinct fingerprint: its smallest doc_id and the least fingerprint of its component."""
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected(links(distinct.select("fp"), distinct.count(), radius)).withColumnRenamed("node", "fp")
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def keep_first(docs: DataFrame, radius: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null ids last, equal ids by a hash of the text).

    A null text counts as empty; texts without words are near each other and one of them stays. Of rows
    that repeat id and text one stays. Other columns stay as they are, whatever their names; an empty
    table gives an empty result. Components are settled on ids and hashes; the texts are shuffled once,
    to meet the rows that stay.
    """
    rows = cut_lineage(fingerprints(docs))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tag")
    first = rows.groupBy("fp").agg(F.min(order).alias("row"))  # copies are many, so they are settled before the join
    first = first.join(_roots(rows, radius).select("fp", "root"), "fp").groupBy("root").agg(F.min("row").alias("row"))
    id_key, tag = fresh(docs.columns, "__id", "__tag")
    named = lambda doc_id: F.xxhash64(doc_id.isNull(), doc_id)
    first = first.select(named(F.col("row.doc_id")).alias(id_key), F.col("row.tag").alias(tag))
    tagged = docs.withColumn(id_key, named(F.col("doc_id"))).withColumn(tag, F.xxhash64(text_or_empty("text")))
    # rows that repeat one as it is stand together after the join: no second shuffle
    return tagged.join(first, [id_key, tag], "left_semi").dropDuplicates([id_key, tag]).select(docs.columns)
