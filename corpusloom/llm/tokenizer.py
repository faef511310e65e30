"""Tokenizers of the public vocabulary files, and exact encoding of huge texts in chunks.

``byte_bpe_50k.json`` has a twin that holds the same vocabulary as ranks; the rank encoder
gives the same ids about six times as fast (compared over every Unicode code point and, in
the tests, over random texts with special strings), so it does the work for that file.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

#: Vocabulary files for which an equal rank file exists, with their special token.
TWINS = {"byte_bpe_50k.json": ("byte_bpe_50k.tiktoken", {"<|endoftext|>": 50256})}
#: Places where byte-level pretokenizers always split, whatever stands before or after: a non-space
#: before ASCII white space, and a letter before a mark of punctuation (none of their pieces holds a
#: letter and then something else than a letter). Special strings hold no white space, and a letter only
#: before another or a bar, which is left out. Letters are those of large scripts, which every version
#: of Unicode knows as such, so texts without white space have such places too.
STABLE = re.compile(r"(?<=\S)(?=[ \t\n\r])|(?<=[A-Za-zÀ-ÖØ-öø-ʯΑ-Ωα-ωа-яА-Яあ-ゖァ-ヺ一-鿋가-힣])(?=[.,;:!?()\[\]\"'\-、。「」『』（），．！？；：…·])")


class Encoder:
    """``ids(text)`` of a whole text; ``lengths`` gives UTF-8 bytes per id if ids tile the text."""

    def __init__(self, ids: Callable[[str], list[int]], lengths: np.ndarray | None):
        self.ids, self.lengths = ids, lengths


@lru_cache(maxsize=4)
def load(name: str) -> Encoder:
    import public_tokenizers

    if name in TWINS:
        import tiktoken

        ranks_file, special = TWINS[name]
        with open(public_tokenizers.path(ranks_file), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        core = tiktoken.Encoding("twin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        lengths = np.zeros(1 + max(*ranks.values(), *special.values()), np.int64)
        for piece, rank in ranks.items():
            lengths[rank] = len(piece)
        for piece, rank in special.items():
            lengths[rank] = len(piece.encode())
        (marker,) = special

        def ids(text: str) -> list[int]:
            return core.encode(text, allowed_special="all") if marker in text else core.encode_ordinary(text)

        return Encoder(ids, lengths)
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return Encoder(lambda text: model.encode(text, num_threads=1), None)
    if name.endswith(".json"):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        slow.no_truncation()
        slow.no_padding()
        return Encoder(lambda text: slow.encode(text, add_special_tokens=False).ids, None)
    raise ValueError(f"unknown tokenizer file: {name}")


class _Chunk:
    """A stretch of a text with its ids and the byte offset, within the stretch, after each id."""

    def __init__(self, encoder: Encoder, text: str, start: int, end: int):
        self.start, self.end, self.text = start, end, text[start:end]
        self.ids = encoder.ids(self.text)
        self.ends = np.cumsum(encoder.lengths[self.ids]) if self.ids else np.zeros(0, np.int64)

    def index(self, at: int) -> int | None:
        """How many ids end at or before character ``at`` of the text; None if an id straddles it."""
        byte = len(self.text[: at - self.start].encode())
        if byte == 0:
            return 0
        i = int(np.searchsorted(self.ends, byte))
        return i + 1 if i < len(self.ends) and self.ends[i] == byte else None


def _common(a: _Chunk, b: _Chunk, after: int) -> int | None:
    """The first place past ``after`` that is a boundary of both chunks and stable by proof."""
    low = max(b.start, after) + 1
    if low >= a.end:
        return None
    window = a.text[low - 1 - a.start :]
    for found in STABLE.finditer(window):
        at = low - 1 + found.start()
        if at > after and at < a.end and a.index(at) is not None and b.index(at) is not None:
            return at
    return None


def encode(encoder: Encoder, text: str, chunk: int = 16384, overlap: int = 256) -> Iterator[list[int]]:
    """The ids of ``text``, exactly as of one call over the whole text, in runs of bounded length.

    A text of more than ``chunk`` characters is encoded as chunks that overlap; two neighbours
    are spliced at a place that both hold as a boundary and that the pretokenizer always splits.
    Without such a place the overlap doubles, at last up to the whole text.
    """
    if encoder.lengths is None or len(text) <= chunk:
        yield encoder.ids(text)
        return
    done = 0
    a = _Chunk(encoder, text, 0, chunk)
    while a.end < len(text):
        wide, at = overlap, None
        while at is None:
            if a.end - wide <= done:  # nothing left to widen into: the chunk itself grows
                a = _Chunk(encoder, text, a.start, min(len(text), a.end + (a.end - a.start)))
                wide = overlap
                if a.end == len(text):
                    break
            b = _Chunk(encoder, text, a.end - wide, min(len(text), a.end - wide + chunk + wide))
            at = _common(a, b, done)
            wide *= 2
        if at is None:
            break
        yield a.ids[a.index(done) : a.index(at)]
        a, done = b, at
    yield a.ids[a.index(done) :]
