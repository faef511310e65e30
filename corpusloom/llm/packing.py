"""Packing token sequences: bounded-space online best fit per partition, then merging what is left."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizer
from .common import bounded_batches, cut_lineage, slices, text_or_empty

#: Sequence numbers: those of the merging step, then the task or group, then a number within it.
_MERGED, _TASK = 1 << 62, 1 << 32


class _Piece:
    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, n: int) -> tuple[_Piece, _Piece]:
        return _Piece(self.doc, self.start, self.ids[:n], self.total), _Piece(self.doc, self.start + n, self.ids[n:], self.total)


class Packer:
    """Places pieces online into at most ``slots`` open windows of ``length``; ``done`` holds finished ones as lists of pieces."""

    def __init__(self, length: int, slots: int, least_cut: int):
        self.length, self.slots, self.least_cut = length, slots, least_cut
        self.free: list[tuple[int, int]] = []  # (free places, window), sorted
        self.open: dict[int, list[_Piece]] = {}
        self.next = 0
        self.done: list[list[_Piece]] = []

    def add(self, piece: _Piece) -> None:
        n = len(piece.ids)
        if n == self.length:
            self.done.append([piece])
            return
        at = bisect_left(self.free, (n, -1))  # best fit: the fullest window with enough room
        if at == len(self.free) and len(self.open) == self.slots:
            room, fullest = self.free.pop(0)
            window = self.open.pop(fullest)
            if room >= self.least_cut:  # a gap worth a cut takes the head of the piece
                head, piece = piece.cut(room)
                window.append(head)
            self.done.append(window)
            return self.add(piece)
        if at == len(self.free):
            window, room = self.next, self.length
            self.next += 1
            self.open[window] = []
        else:
            room, window = self.free.pop(at)
        self.open[window].append(piece)
        if room == n:
            self.done.append(self.open.pop(window))
        else:
            insort(self.free, (room - n, window))

    def rest(self) -> list[_Piece]:
        """Ends the run: windows nearly full are done, the others' pieces are laid end to end and cut; returns those of the last, partial one."""
        loose: list[_Piece] = []
        for room, window in self.free:
            if room < self.least_cut:
                self.done.append(self.open[window])
            else:
                loose += self.open[window]
        finished, left = end_to_end(loose, self.length)
        self.done += finished
        return left


def end_to_end(pieces: list[_Piece], length: int) -> tuple[list[list[_Piece]], list[_Piece]]:
    """Full sequences of ``pieces`` one after another, cut where a sequence is full, and the rest."""
    done, now, room = [], [], length
    for piece in pieces:
        while len(piece.ids) >= room:
            head, piece = piece.cut(room)
            done.append([*now, head])
            now, room = [], length
        if len(piece.ids):
            now.append(piece)
            room -= len(piece.ids)
    return done, now


def powers_of_two(pieces: list[_Piece]) -> list[list[_Piece]]:
    """Sequences of ``pieces`` one after another, each as long as the largest power of two that is left: none needs padding."""
    left, done = sum(len(p.ids) for p in pieces), []
    while left:
        length = 1 << left.bit_length() - 1
        (first, *_), pieces = end_to_end(pieces, length) if length < left else ([pieces], [])
        done.append(first)
        left -= length
    return done


def _document(encoder: tokenizer.Encoder, doc, text: str, end_id: int, length: int) -> list[_Piece]:
    """Pieces of ``length`` ids and a last, shorter one (maybe none) of a document and its end id."""
    pieces, rest, start = [], np.zeros(0, np.uint32), 0
    for run in [*tokenizer.encode(encoder, text), [end_id]]:
        rest = np.concatenate([rest, np.array(run, np.uint32)])
        while len(rest) >= length:
            pieces.append(_Piece(doc, start, rest[:length], 0))
            start, rest = start + length, rest[length:]
    if len(rest):
        pieces.append(_Piece(doc, start, rest, 0))
    total = start + len(rest)
    for piece in pieces:
        piece.total = total
    return pieces


_COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, task long, place int, ids binary"


def _rows(windows: list[list[_Piece]], first: int, id_type: pa.DataType, task: int, keep_ids: bool = False) -> pa.RecordBatch:
    out: list[tuple] = []
    for i, window in enumerate(windows):
        offset = 0
        for piece in window:
            raw = piece.ids.astype("<u4").tobytes()
            out.append((piece.doc, piece.start, len(piece.ids), zlib.crc32(raw), piece.total, None if keep_ids else first + i, None if keep_ids else offset, task, len(out), raw if keep_ids else None))
            offset += len(piece.ids)
    kinds = [id_type, *[pa.int64()] * 7, pa.int32(), pa.binary()]
    names = ["doc_id", *(c.split()[0] for c in _COLUMNS.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)


def pack(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", length: int = 2048, end_id: int = 1, open_windows: int = 64, least_cut: int = 1, merge_tasks: int = 64,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``length`` ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``. Each task keeps ``open_windows`` windows open, puts a piece
    where it leaves least room and, if it fits nowhere, finishes the fullest window (with the head of
    the piece if the gap has ``least_cut`` places). At its end a task lays its open windows' pieces end
    to end; what fills no sequence goes on, with its ids, to a step that merges the rests of
    ``merge_tasks`` tasks at a time; what is left of such a group fills sequences whose lengths are
    powers of two. With ``least_cut`` 1 no sequence needs padding.

    A null text counts as empty (the end id alone). Null and repeated ids are kept: each row is a
    document of its own. Other columns are ignored; an empty table gives no sequences.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {_COLUMNS}"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = tokenizer.load(vocabulary), TaskContext.get().partitionId()
        packer, made, id_type = Packer(length, open_windows, least_cut), task * _TASK, None
        for batch in slices(batches):
            id_type = batch["doc_id"].type
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                for piece in _document(encoder, doc, text, end_id, length):
                    packer.add(piece)
            yield _rows(packer.done, made, id_type, task)
            made += len(packer.done)
            packer.done = []
        if id_type is not None:
            left = packer.rest()
            yield _rows(packer.done, made, id_type, task)
            yield _rows([left], 0, id_type, task, keep_ids=True)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, made, id_type = None, [], 0, None
        for batch in batches:
            id_type = batch["doc_id"].type
            for r in batch.to_pylist():
                if r["task"] // merge_tasks != group:
                    if held:
                        yield _rows(powers_of_two(held), _MERGED + group * _TASK + made, id_type, -1)
                    group, held, made = r["task"] // merge_tasks, [], 0
                done, held = end_to_end([*held, _Piece(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])], length)
                yield _rows(done, _MERGED + group * _TASK + made, id_type, -1)
                made += len(done)
        if held:
            yield _rows(powers_of_two(held), _MERGED + group * _TASK + made, id_type, -1)

    first = cut_lineage(rows.mapInArrow(packed, schema))
    group = F.floor(F.col("task") / merge_tasks)
    rest = first.where(F.col("ids").isNotNull()).repartition(group).sortWithinPartitions(group, "task", "place")
    return first.where(F.col("ids").isNull()).unionByName(rest.mapInArrow(merged, schema)).drop("task", "place", "ids")
