"""Language identification by nearest centroids of TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, slices

#: The answer for texts without letters, and for rejected texts in ``keep_known``.
UNKNOWN = "und"
#: Texts of 2**LONG characters or more are judged alike: by the least cosine of all of them, as few rows of a corpus are of the greatest lengths.
LONG = 9


@dataclass(frozen=True)
class Settings:
    fit_rows: int = 600  # rows of each language that the model is fitted on, at most
    clusters: int = 4  # centroids of each language
    buckets: int = 8192  # hash buckets of character 1- to 3-grams
    slack: float = 0.7  # rejected: nearer to nothing than this share of the least cosine among texts of about that length


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray  # least cosine that is accepted, by the binary logarithm of the length
    buckets: int


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _grams(text: str, buckets: int) -> list[np.ndarray]:
    """Hash buckets of the 1-, 2- and 3-grams of the lower-cased letters; other characters count as one break. Empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, 0).astype(np.uint32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes = codes[keep]
    if not codes.any():
        return []
    a = np.concatenate([[0], codes[int(codes[0] == 0) :], [0]]).astype(np.uint32)
    one = a[a != 0] * np.uint32(0x9E3779B1)
    two = (a[:-1] * np.uint32(0x85EBCA77)) ^ (a[1:] * np.uint32(0xC2B2AE3D))
    three = (two[:-1] * np.uint32(0x27D4EB2F)) ^ (a[2:] * np.uint32(0x165667B1))
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    return [(h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) >> shift for h in (one, two, three)]


def ngram_counts(text: str, buckets: int) -> np.ndarray:
    """How often each bucket occurs among the n-grams of a text."""
    return sum((np.bincount(h, minlength=buckets) for h in _grams(text, buckets)), np.zeros(buckets, np.int64))


def _size(text: str) -> int:
    return max(0, len(text).bit_length() - 1)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of log term frequency times idf, of length one (or zero)."""
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _clusters(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread starts; fewer centroids if there are fewer rows."""
    picked = [int(np.argmax(v @ v.mean(axis=0)))]
    while len(picked) < min(k, len(v)):
        picked.append(int(np.argmin((v @ v[picked].T).max(axis=1))))
    centroids = v[picked]
    for _ in range(rounds):
        nearest = (v @ centroids.T).argmax(axis=1)
        sums = np.stack([v[nearest == i].sum(axis=0) if (nearest == i).any() else centroids[i] for i in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def in_fold(doc_id: str, fold: int = 1, folds: int = 3):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold


def fit(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from rows with a language that are not held out (crc32 of the id modulo 3 is not 1).

    Centroids come from at most ``fit_rows`` rows of each language, those with the least hash of their
    id, that reach the driver as sparse n-gram counts and become vectors one language at a time; that
    bound and the number of languages are all its memory depends on. Document frequencies and least cosines are aggregated over all of the rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & ~in_fold("doc_id") & F.col("text").isNotNull()).withColumn("draw", F.xxhash64(F.lit("fit"), "doc_id"))
    totals = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not totals:
        return Model((), np.zeros((0, settings.buckets)), np.zeros(settings.buckets), np.zeros(1), settings.buckets)
    share = F.create_map(*[x for r in totals for x in (F.lit(r["lang"]), F.lit(min(1.0, (1.3 * settings.fit_rows + 30) / r["n"])))])
    chosen = rows.where(F.pmod("draw", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    order = W.partitionBy("lang").orderBy(F.pmod("draw", F.lit(1 << 30)), "doc_id", "text")
    chosen = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.fit_rows).select("lang", "text")
    buckets = settings.buckets

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                c = ngram_counts(text, buckets)
                at = np.flatnonzero(c).astype(np.int32)
                out.append((lang, at, c[at].astype(np.int32)))
            ints = pa.list_(pa.int32())
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), ints, ints))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "at", "n"])

    sample = chosen.mapInArrow(counted, "lang string, at array<int>, n array<int>").toArrow()
    sample = sample.combine_chunks()
    at, n = ([x.values.to_numpy() for x in sample[c]] for c in ("at", "n"))
    whole = sorted((r for r in zip(sample["lang"].to_pylist(), at, n) if len(r[1])), key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    idf = inverse_frequencies(rows, buckets)
    names, centroids = [], []
    for lang, some in groupby(whole, key=lambda r: r[0]):  # the vectors of one language at a time
        some = list(some)
        counts = np.zeros((len(some), buckets), np.float32)
        for i, (_, at, n) in enumerate(some):
            counts[i, at] = n
        centroids.append(_clusters(vectors(counts, idf).astype(np.float32), settings.clusters))
        names += [lang] * len(centroids[-1])
    centroids = np.concatenate(centroids) if centroids else np.zeros((0, buckets))
    least = least_cosines(rows, centroids, idf) if names else {}
    floors = [least.get(size, 0.0) * settings.slack for size in range(1 + max(least, default=0))]
    return Model(tuple(names), centroids, idf, np.array(floors), buckets)


def inverse_frequencies(rows: DataFrame, buckets: int) -> np.ndarray:
    """Of each bucket, over all ``rows`` (text) that have a letter."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets + 1, np.int64)  # the last counts the texts
        for batch in slices(batches):
            for text in batch["text"].to_pylist():
                c = ngram_counts(text, buckets) > 0
                total[:-1] += c
                total[-1] += c.any()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["at", "n"])

    total = np.zeros(buckets + 1, np.int64)
    for r in rows.select("text").mapInArrow(held, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[r["at"]] = r["n"]
    return np.log((1 + total[-1]) / (1 + total[:-1])).astype(np.float32) + 1


def _occurring(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that occur among the n-grams of a text, and how often."""
    if len(text) < 4096:  # sorting is faster up to there
        grams = _grams(text, buckets)
        return np.unique(np.concatenate(grams or [np.zeros(0, np.uint32)]), return_counts=True)
    counts = ngram_counts(text, buckets)
    at = np.flatnonzero(counts)
    return at, counts[at]


def least_cosines(rows: DataFrame, centroids: np.ndarray, idf: np.ndarray) -> dict[int, float]:
    """The least cosine to the nearest centroid by size, the binary logarithm of the length up to LONG, among all ``rows`` (text): of the whole texts and of their beginnings of 1, 2, 4 and so on characters, however long."""
    buckets, near = len(idf), np.ascontiguousarray(centroids.T.astype(np.float32))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, float] = {}
        known: set[str] = set()
        for batch in slices(batches):
            for text in batch["text"].to_pylist():
                for end in {*(1 << size for size in range(_size(text) + 1)), len(text)} if text else ():
                    part = text[:end]
                    if part in known:
                        continue
                    if len(part) < 8 and len(known) < 100000:  # short ones come again and again
                        known.add(part)
                    at, n = _occurring(part, buckets)
                    if len(at):
                        v = np.log1p(n) * idf[at]
                        cosine = float((v @ near[at]).max() / np.sqrt(v @ v))
                        size = min(_size(part), LONG)
                        least[size] = min(cosine, least.get(size, 1.0))
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.float64())], names=["size", "least"])

    found = rows.select("text").mapInArrow(nearest, "size int, least double").groupBy("size").agg(F.min("least").alias("least"))
    return {r["size"]: r["least"] for r in found.collect()}


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, ...] = ("__lang", "__score", "__rejected")) -> DataFrame:
    """``docs`` with three columns under ``names``: the language, the cosine to the nearest centroid (0 to 1), and whether the text is rejected (no letters, or farther than the model allows).

    The new names must not be columns of ``docs``; rows with a null or empty text are rejected as ``und``.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.columns
    schema = docs.select(*kept).schema.add(names[0], "string").add(names[1], "double").add(names[2], "boolean")

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = model.centroids.astype(np.float32)
        for batch in slices(batches):
            texts = [t or "" for t in batch[text_col].to_pylist()]
            counts = np.stack([ngram_counts(t, model.buckets) for t in texts])
            near = vectors(counts, model.idf).astype(np.float32) @ centroids.T
            letters = counts.any(axis=1)
            any_letter = letters & (near.shape[1] > 0)
            best = near.argmax(axis=1) if near.shape[1] else np.zeros(len(counts), int)
            score = np.where(any_letter, np.clip(near.max(axis=1, initial=0.0), 0, 1), 0.0).astype(float)
            langs = [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, any_letter)]
            size = np.minimum([_size(t) for t in texts], len(model.floors) - 1)
            rejected = ~letters | (score < model.floors[size])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs), pa.array(score), pa.array(rejected)], names=[*kept, *names])

    return docs.mapInArrow(predicted, schema)


def identify(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, rejected.

    ``und`` with score 0 if the text is null or has no letter (or nothing could be learned); other texts
    get the language of the nearest centroid, also when they are so far from all that ``rejected`` is
    set; if nothing could be learned, only null texts and those without a letter are. A row with a null id is neither held out nor learned from. Other columns are ignored, repeated
    rows are kept, an empty table gives an empty result.
    """
    model = fit(docs, settings, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = predict(rows, model).withColumn("held_out", F.coalesce(in_fold("doc_id"), F.lit(False)))
    return found.select("doc_id", "held_out", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__rejected").alias("rejected"))


def keep_known(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows that are rejected; lang is filled in where it was null.

    If nothing could be learned (no row has a language, or all that do are held out), only null texts
    and those without a letter are rejected, and ``und`` is filled in. Repeated rows are judged alike
    and stay repeated, null ids are kept, other columns stay as they are, whatever their names; an empty
    table gives an empty result.
    """
    lang, score, rejected = fresh(docs.columns, "__lang", "__score", "__rejected")
    found = predict(docs, fit(docs, settings), names=(lang, score, rejected)).where(~F.col(rejected))
    return found.withColumn("lang", F.coalesce("lang", lang)).select(docs.columns)
