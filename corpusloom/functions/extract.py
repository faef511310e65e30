"""Answers out of model output, as native column expressions (null: nothing found)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES, strip, strip_end

#: What marks an answer in model output, and the reason given where none is found.
_MARK = "the answer is"
NO_BOX = "boxed extraction failed"


def after_first(text: Column) -> Column:
    """All that follows the first "the answer is" in any case, stripped; an empty string without it."""
    at = F.locate(_MARK, F.lower(text))
    return F.when(at > 0, strip(F.substr(text, at + len(_MARK)))).otherwise("")


def after_last(text: Column) -> Column:
    """What follows the last "the answer is": asterisks dropped, a leading colon too, cut at a line end or full stop; null if empty."""
    found = F.regexp_extract(F.replace(text, F.lit("*"), F.lit("")), rf"(?is)^.*{_MARK}(.*)\z", 1)
    found = strip(F.regexp_replace(strip(found), "^:+", ""))
    cut = strip(F.regexp_extract(found, rf"(?s)\A(.*?)(?:\n|\.(?:[{SPACES}]|\z)|\z)", 1))
    return F.when(cut != "", cut)


def _balanced(tail: Column) -> Column:
    """``tail`` up to the brace that closes its first open one; null if none does. One fold over the characters."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        seen = s["seen"] + F.length(c)
        closes = (c == "}") & (s["depth"] == 1) & (s["end"] == 0)
        depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(depth.alias("depth"), seen.alias("seen"), F.when(closes, seen).otherwise(s["end"]).alias("end"))

    end = F.aggregate(F.split(tail, ""), start, step)["end"]
    return F.when(end > 0, F.substr(tail, F.lit(1), end))


def _from_last(text: Column, mark: str) -> Column:
    return F.when(F.contains(text, F.lit(mark)), F.concat(F.lit(mark), F.substring_index(text, mark, -1)))


def last_boxed(text: Column) -> Column:
    r"""The last ``\boxed{...}`` with its braces matched; null if there is none or it stays open."""
    return _balanced(_from_last(text, r"\boxed"))


def last_boxed_or_framed(text: Column) -> Column:
    r"""As ``last_boxed``, but ``\boxed `` (with a blank) runs to the next dollar sign, and ``\fbox`` stands in for a missing ``\boxed``."""
    spaced = F.concat(F.lit(r"\boxed "), F.substring_index(F.substring_index(text, r"\boxed ", -1), "$", 1))
    tail = F.coalesce(_from_last(text, r"\boxed"), _from_last(text, r"\fbox"))
    return F.when(F.contains(text, F.lit(r"\boxed ")), spaced).otherwise(_balanced(tail))


def unbox(boxed: Column) -> Column:
    r"""The content of ``\boxed{...}``, or what follows ``\boxed `` (with a blank); other strings as they are."""
    inside = boxed.startswith(r"\boxed{") & boxed.endswith("}")
    spaced = boxed.startswith(r"\boxed ")
    return F.when(spaced, F.substr(boxed, F.lit(8))).when(inside, F.substr(boxed, F.lit(8), F.length(boxed) - 8)).otherwise(boxed)


def unbox_any(boxed: Column) -> Column:
    r"""The content of ``\boxed ...``, ``\boxed{...}`` or ``\fbox{...}`` (whose content is not cut short)."""
    return (
        F.when(boxed.startswith(r"\boxed "), F.substr(boxed, F.lit(8)))
        .when(boxed.startswith(r"\fbox{"), F.substr(boxed, F.lit(7), F.length(boxed) - 7))
        .otherwise(F.substr(boxed, F.lit(8), F.length(boxed) - 8))
    )


def unwrap_text(x: Column) -> Column:
    r"""The content of a leading ``\text{...}`` or of a ``\text `` anywhere."""
    braced = x.startswith(r"\text{")
    close = F.length(x) - F.length(F.substring_index(x, "}", -1))
    return F.when(F.contains(x, F.lit(r"\text ")), F.substr(x, F.lit(7))).when(braced & F.contains(x, F.lit("}")), F.substr(x, F.lit(7), close - 7)).when(braced, F.substr(x, F.lit(7), F.greatest(F.lit(0), F.length(x) - 7))).otherwise(x)


def think_answer(text: Column) -> Column:
    r"""The content of the last box after the last ``</think>``, asterisks dropped; null without either."""
    after = F.replace(strip(F.substring_index(text, "</think>", -1)), F.lit("*"), F.lit(""))
    return F.when(F.contains(text, F.lit("</think>")), unbox(last_boxed(after)))


def judged(text: Column) -> Column:
    """The judge's answer: the lower-cased text's last box, else what follows its last "the answer is", else ``NO_BOX``."""
    lower = F.replace(F.lower(text), F.lit(r"\boxed{}"), F.lit(""))
    boxed = unbox_any(last_boxed_or_framed(lower))
    plain = F.replace(lower, F.lit("*"), F.lit(""))
    said = strip(F.regexp_replace(strip(F.substring_index(plain, _MARK, -1)), r"^\.+|\.+\z", ""))
    return F.when(boxed.isNotNull(), boxed).when(F.contains(plain, F.lit(_MARK)), said).otherwise(NO_BOX)


def clean_trace(text: Column) -> Column:
    """``<think>...</think>`` and the unboxed answer (or all that follows); null if the closing tag is missing."""
    tag = "</think>"
    after = strip(F.substring_index(text, tag, -1))
    before = F.substr(text, F.lit(1), F.length(text) - F.length(F.substring_index(text, tag, -1)) - len(tag))
    answer = F.coalesce(unbox(last_boxed(after)), after)
    return F.when(F.contains(text, F.lit(tag)), F.concat(F.lit("<think>"), strip(before), F.lit(tag), answer))


def _letter(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def option_standard(text: Column) -> Column:
    """The option letter after "final answer:" or "answer:", bare, bold or in parentheses, in that order of patterns."""
    # fixed values: the patterns by which options are told
    patterns = (r"(?i)final answer:\s*\(([A-Za-z])\)", r"(?i)answer:\s*([A-Za-z])", r"(?i)answer:\s*\*\*([A-Za-z])\*\*\.?", r"(?i)answer:\s*\(([A-Za-z])\)")
    return F.coalesce(*[_letter(text, p) for p in patterns])


def option_original(text: Column) -> Column:
    plain = F.replace(text, F.lit("*"), F.lit(""))
    return F.coalesce(_letter(plain, r"The correct answer is \(([A-D])\)"), _letter(plain, r"The correct answer is ([A-D])"))


def option_boxed(text: Column) -> Column:
    r"""The letter in parentheses inside the last ``boxed{...}`` (or ``\fbox{...}``), in upper case."""
    found = _balanced(F.coalesce(_from_last(text, "boxed"), _from_last(text, r"\fbox")))
    return F.upper(_letter(found, r"\((\w)\)"))


def option(text: Column, given: Column, mode: str) -> Column:
    """The chosen option by mode: standard (``given``, else from the text), boxed, mix (boxed, else standard) or original."""
    standard = F.coalesce(given, option_standard(text))
    modes = {"standard": standard, "boxed": option_boxed(text), "mix": F.coalesce(option_boxed(text), standard), "original": option_original(text)}
    if mode not in modes:
        raise ValueError(f"unknown mode: {mode}")
    return modes[mode]


def without_role_tags(question: Column) -> Column:
    """Without a leading ``User: `` and one trailing ``Assistant:`` with the line breaks before it."""
    body = F.regexp_replace(question, "^User: ", "")
    tagged = body.endswith("Assistant:")
    return F.when(tagged, strip_end(F.regexp_replace(body, r"(?:\n\n|\n|)Assistant:\z", ""))).otherwise(body)
