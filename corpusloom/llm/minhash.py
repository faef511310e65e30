"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty

BINS, BITS, SHINGLE = 512, 4, 5


@lru_cache(maxsize=2)
def _probes(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin an order of all bins, fixed by a seed, and every bin's rank in that order."""
    order = np.argsort(np.random.default_rng(20240501).random((bins, bins)), axis=1).astype(np.int32)
    return order, np.argsort(order, axis=1).astype(np.int32)


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each ``width``-word shingle, A-Z lower-cased; a shorter text is one shingle, a text without words none."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(line)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-width] + 1).tolist()]
    return np.array([xxh64_intdigest(line[a:b]) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def signature(hashes: np.ndarray, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """Low ``bits`` of each bin's least hash; an empty bin takes the hash of the first filled one in its own probe order.

    The probe order of a bin is a permutation that does not depend on the text, so two texts borrow
    alike, and independently for each bin (optimal densification). A hash is mixed with its bin's number
    before its bits are kept, or two hashes that agree by chance in them would agree in every bin that
    borrows them. Zeros if there are no hashes.
    """
    if not len(hashes):
        return np.zeros(bins, np.uint8)
    low, rest = hashes % np.uint64(bins), hashes // np.uint64(bins)
    least = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, low, rest)
    filled = np.zeros(bins, bool)
    filled[low] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        order, rank = _probes(bins)
        early = filled[order[empty, :8]]
        source = order[empty, early.argmax(axis=1)]
        late = np.flatnonzero(~early.any(axis=1))
        if len(late):
            full = np.flatnonzero(filled)
            source[late] = full[rank[empty[late][:, None], full].argmin(axis=1)]
        least[empty] = least[source]
    at = np.arange(bins, dtype=np.uint64)
    mixed = (least ^ at * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - bits)).astype(np.uint8)


def packed(values: np.ndarray, bits: int = BITS) -> str:
    return np.packbits((values[:, None] >> np.arange(bits, dtype=np.uint8)) & 1).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None, bits: int = BITS) -> float:
    """The Jaccard estimate: the share of equal values, corrected for equal low bits by chance, 0 to 1. None: a text without words."""
    if a is None or b is None:
        return float(a is b)
    chance = 0.5**bits
    return float(np.clip(((a == b).mean() - chance) / (1 - chance), 0, 1))


def edited(text: str, following: str) -> str:
    """``text`` with its last half (code points, rounded down) replaced by as many first ones of ``following`` (or all it has)."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 1000, most_ranges: int = 65536) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one that follows by descending doc_id (null ids last, equal ids by hash of
    the text); after the last comes the first. Documents are dealt out by ranges of ids of about
    ``rows_per_range`` rows (more if that made over ``most_ranges``); the first row of each range goes to
    the range before it too, so neighbours meet with one shuffle of the texts. An id, or null, that many
    rows share has several ranges, by hash of the text. Only the ranges' ends come to the driver. A null text counts as empty; a text without words is like one without words
    only. Other columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    ranges = _Ranges(rows, rows_per_range, most_ranges)
    keyed = rows.withColumn("h", F.xxhash64("text"))
    # the hash decides only where an id is split; a scan for it reads the texts
    ends = (keyed.select("doc_id", "h") if ranges.split else rows.select("doc_id", F.lit(0).cast("long").alias("h"))).mapInArrow(ranges.named, "range long, doc_id long, h long")
    ends = ends.groupBy("range").agg(F.min(F.struct(F.bitwise_not("doc_id").alias("i"), "h")).alias("first")).collect()
    first = {r["range"]: (None if r["first"]["i"] is None else ~r["first"]["i"], r["first"]["h"]) for r in ends}
    used = sorted(first)
    before = {r: used[i - 1] for i, r in enumerate(used)}  # the very first row also follows the last range
    split = ranges.split

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown: set[int] = set()  # ranges whose first row this task has sent on: rows that repeat it are not sent again
        for batch in batches:
            own = ranges.of(batch["doc_id"], batch["h"])
            guests = []
            for i, (r, d, h) in enumerate(zip(own.tolist(), batch["doc_id"].to_pylist(), batch["h"].to_pylist())):
                if first[r] == (d, h if split else 0) and (not split or r not in shown):
                    guests.append(i)
                    shown.add(r)
            home = np.concatenate([own, np.array([before[own[i]] for i in guests], own.dtype)])
            all_rows = batch.take(pa.array([*range(batch.num_rows), *guests], pa.int64()))
            guest = np.repeat(np.array([0, 1], np.int32), [batch.num_rows, len(guests)])
            yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(guest), *all_rows.columns], names=["home", "guest", "doc_id", "text", "h"])

    spread = keyed.mapInArrow(dealt, "home long, guest int, doc_id long, text string, h long").repartition(max(1, len(used) // 2), "home")  # more ranges than tasks even out what hashing puts together
    spread = spread.sortWithinPartitions("home", "guest", F.col("doc_id").desc_nulls_last(), "h")
    return spread.mapInArrow(_digest, f"doc_id long, {_RESULT}")


class _Ranges:
    """Ranges of ids, the largest first, null ids last. An id (or null) with several ranges' worth of rows is split by hash of the text."""

    SUB = 1 << 24  # ranges of one id, at most

    def __init__(self, rows: DataFrame, rows_per_range: int, most: int):
        total, known = rows.agg(F.count("*"), F.count("doc_id")).first()
        n = min(most, max(1, round(total / rows_per_range)))
        per = max(rows_per_range, total / n)
        named = max(1, round(known / per))
        cuts = rows.select("doc_id").where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / named for i in range(1, named)], 0.2 / named) if named > 1 else []
        # quantiles come back as doubles, which hold ids up to 2**53 exactly; beyond, ranges are a little uneven
        self.cuts, self.times = np.unique(np.array(cuts, float).astype(np.int64), return_counts=True) if cuts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.nulls = min(self.SUB - 1, max(1, round((total - known) / per)))
        self.split = bool((self.times > 1).any()) or self.nulls > 1

    def of(self, doc_ids: pa.Array, hashes: pa.Array) -> np.ndarray:
        """The number of each row's range; it grows with the place in the order."""
        null = doc_ids.is_null().to_numpy(zero_copy_only=False)
        ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.searchsorted(self.cuts, ids, side="right")
        if self.split:
            part = hashes.to_numpy(zero_copy_only=False) / 2.0**64 + 0.5
            place = np.maximum(at - 1, 0)
            hot = (self.cuts[place] == ids) & (self.times[place] > 1) & (at > 0) if len(self.cuts) else np.zeros(len(ids), bool)
            times = self.times[place] if len(self.cuts) else np.ones(len(ids), np.int64)
            sub = np.where(hot, 1 + np.minimum((part * times).astype(np.int64), times - 1), 0)
            sub = np.where(null, np.minimum((part * self.nulls).astype(np.int64), self.nulls - 1), sub)
        else:
            sub = np.zeros(len(ids), np.int64)
        return np.where(null, len(self.cuts) + 1, len(self.cuts) - at) * self.SUB + sub

    def named(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(self.of(batch["doc_id"], batch["h"])), batch["doc_id"], batch["h"]], names=["range", "doc_id", "h"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by home, guest and order: each own row is finished by the row after it; of the guests only the first counts."""
    waiting, home, over = None, None, False

    def sign(text: str) -> np.ndarray | None:
        hashes = shingles(text)
        return signature(hashes) if len(hashes) else None

    for batch in batches:
        out: list[tuple] = []
        id_type = batch["doc_id"].type
        for own, guest, doc, text in zip(*(batch[c].to_pylist() for c in ("home", "guest", "doc_id", "text"))):
            if own != home:
                waiting, home, over = None, own, False
            if over:
                continue
            mine = sign(text)
            if waiting is not None:
                last_doc, last_text, last_sign = waiting
                changed = edited(last_text, text)
                new = sign(changed)
                none = np.zeros(BINS, np.uint8)
                out.append(
                    (last_doc, len(last_text), hashlib.sha256(changed.encode()).hexdigest(), packed(none if last_sign is None else last_sign), packed(none if new is None else new), likeness(last_sign, new), likeness(last_sign, mine))
                )
            waiting, over = (doc, text, mine), guest == 1
        kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)
