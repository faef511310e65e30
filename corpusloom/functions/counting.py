"""Token counters by name: a native default and vocabulary back ends behind one interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def native(text: Column) -> Column:
    """Word runs and single other signs; adds up over texts that are joined by white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]")), F.lit(0)).cast("long")


def _vocabulary(load: Callable[[], Callable[[str], int]]) -> Callable[[Column], Column]:
    def counter(text: Column) -> Column:
        @F.pandas_udf("long")
        def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            one = load()
            for batch in batches:
                yield batch.map(lambda t: one(t) if t else 0)

        return count(text)

    return counter


def byte_pair(path: str) -> Callable[[Column], Column]:
    """Counts by a ``tokenizers`` JSON file, loaded once for each task."""

    def load() -> Callable[[str], int]:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        return lambda t: len(model.encode(t, add_special_tokens=False).ids)

    return _vocabulary(load)


def sentence_pieces(path: str) -> Callable[[Column], Column]:
    def load() -> Callable[[str], int]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t, num_threads=1))

    return _vocabulary(load)


def ranked_bytes(path: str, pattern: str, special: dict[str, int] | None = None) -> Callable[[Column], Column]:
    """Counts by a ``tiktoken`` rank file (base64 of a token and its rank in each line) and the pattern that splits texts; special strings count as plain text unless named."""

    def load() -> Callable[[str], int]:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special or {})
        return lambda t: len(model.encode(t, allowed_special="all" if special else set(), disallowed_special=()))

    return _vocabulary(load)


def named_encoding(name: str) -> Callable[[Column], Column]:
    """Counts by an encoding or model that ``tiktoken`` knows by name (its file has to be in that library's cache: nothing is fetched here on purpose)."""

    def load() -> Callable[[str], int]:
        import tiktoken

        try:
            model = tiktoken.get_encoding(name)
        except ValueError:
            model = tiktoken.encoding_for_model(name)
        return lambda t: len(model.encode(t, disallowed_special=()))

    return _vocabulary(load)


def counter(kind: str = "native", path: str | None = None, pattern: str | None = None) -> Callable[[Column], Column]:
    """A function from a text column to its token count, by the kind of back end; for "named", ``path`` is the name."""
    kinds = {"native": lambda: native, "byte_pair": lambda: byte_pair(path), "sentence_pieces": lambda: sentence_pieces(path), "ranks": lambda: ranked_bytes(path, pattern), "named": lambda: named_encoding(path)}
    if kind not in kinds:
        raise ValueError(f"unknown tokenizer kind: {kind}")
    return kinds[kind]()


def sequence_length(context_tokens: Column, to_generate: int) -> Column:
    """Tokens of a sample as the budget counts them: those of the context and those still to be generated."""
    return context_tokens + F.lit(to_generate)
