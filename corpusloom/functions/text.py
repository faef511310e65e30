"""String building blocks as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ``str.split`` knows it, as a Java regex class body.
SPACES = r"\u0009-\u000d\u001c-\u0020\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The ASCII punctuation, as a regex class.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
_ARTICLE = r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])"


def strip(x: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(x, rf"^[{SPACES}]+|[{SPACES}]+\z", "")


def strip_end(x: Column) -> Column:
    return F.regexp_replace(x, rf"[{SPACES}]+\z", "")


def collapse(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, rf"[{SPACES}]+", " "))


def normalize_punctuation_first(x: Column) -> Column:
    """Lower case, punctuation dropped, then articles, then white space collapsed (``a-b`` gives ``ab``)."""
    return collapse(F.regexp_replace(F.regexp_replace(F.lower(x), PUNCTUATION, ""), _ARTICLE, " "))


def normalize_articles_first(x: Column) -> Column:
    """Lower case, articles dropped, then punctuation, then white space collapsed (``a-b`` gives ``b``)."""
    return collapse(F.regexp_replace(F.regexp_replace(F.lower(x), _ARTICLE, " "), PUNCTUATION, ""))


def words(x: Column) -> Column:
    """The words of a collapsed text; none for an empty one."""
    return F.filter(F.split(x, " "), lambda w: w != "")


def as_list(x: Column) -> Column:
    """A string that may hold a JSON list of strings, as a list: null gives none, a plain string itself."""
    return F.when(x.isNull(), F.array().cast("array<string>")).when(x.startswith("["), F.coalesce(F.from_json(x, "array<string>"), F.array(x))).otherwise(F.array(x))


def first_filled(*candidates: Column) -> Column:
    """The first candidate that is not null."""
    return F.coalesce(*candidates)


def first_truthy(*candidates: Column) -> Column:
    """The first candidate that is neither null nor zero (for numbers) nor empty (for strings)."""
    return F.coalesce(*[F.when(c.cast("string").isin("", "0", "0.0"), None).otherwise(c) for c in candidates])


def fill(template: str, **values: Column) -> Column:
    """``template`` with each ``{name}`` replaced, in one pass: braces inside values stay as they are."""
    import re

    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p])


def passage(title: Column, body: Column, separator: str = "\n") -> Column:
    """Title, line break, body; a list of sentences is joined without separators."""
    return F.concat(title, F.lit(separator), body)


def numbered(passages: Column) -> Column:
    """``Passage 1:`` and so on before each passage, blank lines between."""
    return F.array_join(F.transform(passages, lambda d, i: F.concat(F.lit("Passage "), (i + 1).cast("string"), F.lit(":\n"), d)), "\n\n")


def tail_has_any(x: Column, keywords: tuple[str, ...], tail: int = 300) -> Column:
    """Whether the lower-cased last ``tail`` characters hold one of the keywords."""
    end = F.lower(F.substring(x, -tail, tail))
    found = F.lit(False)
    for word in keywords:
        found = found | F.contains(end, F.lit(word))
    return found


def size_label(x: Column, thousands: bool = False) -> Column:
    """A context size as 1K, 10K, 128K, or the next tens of K, or M; with ``thousands`` simply rounded to K."""
    k = F.bround(x / 1000).cast("long")
    if thousands:
        return F.concat(k.cast("string"), F.lit("K"))
    return (
        F.when(x > 990000, F.concat(F.bround(x / 1000000).cast("long").cast("string"), F.lit("M")))
        .when(x <= 10000, F.when(x > 5000, "10K").otherwise("1K"))
        .when(k == 128, "128K")
        .otherwise(F.concat((F.bround(x / 10000).cast("long") * 10).cast("string"), F.lit("K")))
    )
