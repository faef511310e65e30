"""Personal data: pattern spans, and further ones proposed by loose generators and chosen by boosted trees."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, boost, threshold
from .common import bounded_batches, slices, text_or_empty

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a digit run that fails at its start fails all through
_POINT = re.compile(r"[0-9]\.[0-9]")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(doubled[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The pattern matches of each kind, leftmost and non-overlapping, those that fail their check dropped; by kind, then start."""
    spans: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            spans.append(("email", start, end := found.end()))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text) if _POINT.search(text) else ():
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            spans.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return spans


#: The generators. They aim at recall: written-out and spaced addresses, bracketed or colon-separated
#: network addresses, digit groups of cards and telephones in any common notation. Their spans may overlap.
_AT = re.compile(r"@|＠|[\[({<]\s?at\s?[\])}>]|(?<=\s)at(?=\s)", re.I)
_BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?\Z")
_HOST = re.compile(r"\s?[A-Za-z0-9-]{1,63}")
_NEXT_PART = re.compile(r"\s?(?:\.|[\[({<]\s?dot\s?[\])}>]|(?<=\s)dot(?=\s))\s?[A-Za-z0-9-]{2,24}(?![A-Za-z0-9-])", re.I)
_GENERATORS = (
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\.)\s?[0-9]{1,3}){3}(?![0-9.]*[0-9])")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{2,6}){2,4}(?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+])(?:\+|00)?(?:\(?[0-9]{1,5}\)?[ ./-]{1,2}){1,5}[0-9]{2,9}(?![0-9A-Za-z])")),
)
#: For each generator a piece of it that every match holds: a text without it needs no search.
_NEEDED = (
    re.compile(r"[0-9]\s?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\.)\s?[0-9]"),
    re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    re.compile(r"[0-9][ ./_-]{1,2}[0-9]"),
    re.compile(r"[0-9]\)?[ ./-]{1,2}[0-9]"),
)
#: Ends of host names that are seen most.
_TLDS = frozenset("com org net edu gov info io co uk de fr es it eu us ca".split())
_CUES = {
    "email": re.compile(r"mail|contact|write|reach|kontakt|correo|courriel", re.I),
    "ip": re.compile(r"\bip\b|address|server|host|login|adress|direcc", re.I),
    "card": re.compile(r"card|visa|credit|payment|karte|tarjeta|carte", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax|whatsapp|anruf|llam|appel", re.I),
}
_AGAINST = re.compile(r"version|release|isbn|order|invoice|chapter|page|date|price|score|build|total|ratio|section|[$€£=#v]\s?$", re.I)


def _emails(text: str) -> Iterator[Span]:
    """From each way to write an at sign the longest name before it, and after it hosts of two to five parts."""
    for at in _AT.finditer(text):
        host = _HOST.match(text, at.end())
        part = host and _NEXT_PART.match(text, host.end())
        name = part and _BEFORE_AT.search(text[max(0, at.start() - 65) : at.start()])
        for _ in range(4 if name else 0):
            yield "email", at.start() - len(name[0]), part.end()
            part = _NEXT_PART.match(text, part.end())
            if not part:
                break


def candidates(text: str) -> list[Span]:
    found = list(_emails(text))
    return found + [(kind, m.start(), m.end()) for (kind, pattern), needed in zip(_GENERATORS, _NEEDED) if needed.search(text) for m in pattern.finditer(text)]


def features(text: str, spans: list[Span]) -> np.ndarray:
    """Format and context of each span, as numbers."""
    rows = []
    for kind, start, end in spans:
        span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 12]
        digits = _digits(span)
        groups = [int(g) for g in re.findall(r"[0-9]{1,9}", span)]
        sizes = [len(g) for g in re.findall(r"[0-9]+", span)]
        marks = set(re.findall(r"[^0-9A-Za-z\s]", span))
        tld = re.search(r"(?:\.\s?|dot[\])}>]?\s?)([A-Za-z]{2,24})$", span, re.I)
        rows.append(
            [
                KINDS.index(kind), len(span), len(digits), len(groups), max(sizes, default=0), min(sizes, default=0), len(marks), span.count(" "), span.count("."), span.count("-"), span.count("/"), span.count(":"),
                span.startswith(("+", "00")), "(" in span, "[" in span, luhn(digits) if 13 <= len(digits) <= 19 else 0, max(groups, default=0), kind == "ip" and ":" not in span and len(groups) == 4 and max(groups, default=999) <= 255,
                len(tld[1]) if tld else 0, "@" in span or "＠" in span, bool(re.search(r"[\[({<]\s?at", span, re.I)), bool(re.search(r"dot", span, re.I)), bool(_CUES[kind].search(before)), bool(_AGAINST.search(before)),
                before[-1:].isalnum() or before[-1:] in "=/#$-_", after[:1].isalnum() or after[:1] in "%/-_", 1900 <= (groups[0] if groups else 0) <= 2099 or 1900 <= (groups[-1] if groups else 0) <= 2099, len(re.findall(r"[A-Fa-f]", span)) if kind == "ip" else 0,
                bool(tld) and tld[1].lower() in _TLDS, bool(tld) and tld[1][0].isupper(), len(re.findall(r"\.\s", span)), "\n" in span,
            ]
        )
    return np.array(rows, float).reshape(len(rows), 32)


#: Short words of running text in several languages, those that look like a written-out address among them.
_SHORT = "the of and to in is it was for on that at dot with he as his they be by der die und das ist ein zu den von la el de que y en los una le les des est et du un pour dans".split()


class _Writer:
    """Made-up texts of a fixed seed, with personal data at known places.

    What is written does not follow the generators: some notations none of them proposes, and most of
    what they propose in plain text is prose, dates, numbers and codes. ``unseen`` writes some notations
    and look-alikes that the trees were not fitted on.
    """

    def __init__(self, seed: int, unseen: bool = False):
        self.rng = random.Random(seed)
        self.unseen = unseen

    def pick(self, *options):
        return self.rng.choice(options)

    def digits(self, *sizes: int) -> list[str]:
        return [f"{self.rng.randrange(10**n):0{n}d}" for n in sizes]

    def word(self) -> str:
        letters = self.pick("abcdefghilmnoprstuv", "aeioulmnrstch", "eitrnsadhcgub")
        return "".join(self.rng.choices(letters, k=self.rng.randrange(2, 9)))

    def prose(self, least: int = 3, most: int = 14) -> str:
        """Words with punctuation; names and hosts do not occur, ``at`` and full stops do."""
        out, capital = [], self.rng.random() < 0.5
        for _ in range(self.rng.randrange(least, most)):
            w = self.pick(*_SHORT) if self.rng.random() < 0.45 else "at" if self.rng.random() < 0.08 else self.word()
            out.append(w.capitalize() if capital else w)
            capital = self.rng.random() < 0.12
            if capital:
                out[-1] += self.pick(".", ".", ".", ".\n", "?", ",")
        return " ".join(out)

    def email(self) -> str:
        name = self.word() + self.pick("", "", ".", "_", "-") + self.pick("", self.word(), *self.digits(2))
        name = name.rstrip("._-") + "x" * (not name.rstrip("._-"))
        at = self.pick(" at ", " (at) ", " [at] ", "[at]", "(at)", " AT ", " @ ", "@ ", "＠", "{at}")
        dot = self.pick(".", ".", " dot ", "[dot]", " [dot] ", "(dot)", " (dot) ", " . ", " DOT ")
        if self.unseen:
            at, dot = self.pick("-at-", " <at> ", " arroba ", "( at )", at), self.pick(" punkt ", "{dot}", dot, dot)
        host = [self.word() + self.pick("", "", "-" + self.word(), *self.digits(1)), self.pick(*sorted(_TLDS - {"co", "uk"}))]
        if at.strip() == "@" and dot == ".":
            at = " @ "  # else the patterns have it
        return name + at + dot.join(host)

    def ip(self) -> str:
        if self.rng.random() < 0.5:
            parts = [str(self.rng.randrange(1, 255)) for _ in range(4)]
            return self.pick("[.]", "(.)", "[dot]", " . ", " dot " if self.unseen else "[.]").join(parts)
        groups = [f"{self.rng.randrange(16, 65535):x}" for _ in range(8)]
        return ":".join(groups) if self.rng.random() < 0.6 else ":".join(groups[:3]) + "::" + ":".join(groups[3 : 3 + self.rng.randrange(1, 4)])

    def card(self) -> str:
        body = (self.pick("4", "51", "55", "6011") + "".join(self.digits(15)))[:15]
        number = body + next(d for d in "0123456789" if luhn(body + d))
        separator = self.pick(".", "/", "_", "  ", " - ", *(("·", ".-") if self.unseen else ()))
        return separator.join(number[i : i + 4] for i in range(0, 16, 4))

    def phone(self) -> str:
        a, b, c, d, e = self.digits(3, 3, 4, 2, 7)
        pair = self.digits(2, 2, 2, 2)
        forms = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{self.pick('49', '33', '34', '44')} {a} {e}", f"0{d}/{e}", f"0{d[0]} {' '.join(pair)}", f"({a}){b}-{c}"]
        if self.unseen:
            forms += [f"0{d}-{e}", f"{a} {b} {c}", f"00 {d} ({a}) {b} {c}"]
        return self.pick(*forms)

    def other(self) -> str:
        """What looks like personal data and is none."""
        rng, n = self.rng, self.digits
        year, month, day = rng.randrange(1900, 2030), rng.randrange(1, 13), rng.randrange(1, 29)
        forms = [
            lambda: f"{year}-{month:02d}-{day:02d}", lambda: f"{day}/{month}/{year}", lambda: f"{day}. {month}. {year}", lambda: f"{year}-{year + 4}", lambda: ".".join(n(1, 1, 2)), lambda: ".".join(n(2, 2, 2, 2, 2)),
            lambda: f"{rng.randrange(300, 999)}.{rng.randrange(9)}.{n(1)[0]}.{n(2)[0]}", lambda: "978-" + "-".join(n(1, 4, 4, 1)), lambda: ":".join(n(2, 2, 2)), lambda: ":".join(f"{rng.randrange(256):02x}" for _ in range(6)),
            lambda: " ".join(n(4, 4, 4, 4)), lambda: "-".join(n(4, 4, 4, 4)), lambda: ".".join(n(4, 4, 4, 4)), lambda: " ".join(n(3, 3)), lambda: " - ".join(n(2, 2)), lambda: f"{n(1)[0]} 000 000", lambda: " ".join(n(2, 2, 2, 2, 2, 2)),
            lambda: "-".join(n(4, 4)), lambda: "/".join(n(5, 2)), lambda: " ".join(n(4, 2, 3, 2)), lambda: f"{n(2)[0]}.{n(4)[0]}, {n(1)[0]}.{n(4)[0]}", lambda: "/".join(n(1, 2)) + " " + n(3)[0], lambda: "-".join(n(3, 2, 4)) + self.pick("A", "%", " kg"),
            lambda: f"{self.word()} at {self.word()}. {self.word().capitalize()}", lambda: f"{self.word()} at {self.word()} dot {self.word()}", lambda: " ".join(n(2, 3, 2, 3, 2)), lambda: f"{n(3)[0]}/{n(3)[0]}/{n(4)[0]}",
        ]
        if self.unseen:
            forms += [lambda: f"{n(2)[0]}:{n(2)[0]}:{n(2)[0]}.{n(3)[0]}", lambda: "_".join(n(4, 4, 4)), lambda: f"{n(3)[0]} x {n(3)[0]} x {n(3)[0]}", lambda: f"{self.word()}@{self.word()}", lambda: "-".join(n(5, 3, 2, 4))]
        return self.pick(*forms)()

    def text(self) -> tuple[str, str | None, int, int]:
        """A text with the kind of the personal data in it (none if there is none), its start and end."""
        cues = {"email": ("email me:", "contact", "write to", "reach us:", "mail"), "ip": ("ip", "server", "address:", "login from", "host"), "card": ("card", "visa:", "credit card no", "payment by"), "phone": ("call", "tel.", "phone:", "mobile", "fax")}
        against = ("version", "order", "isbn", "on the date", "price", "score", "section", "page", "invoice", "total", "build", "no.")
        kind = self.rng.choice(KINDS) if self.rng.random() < 0.5 else None
        if not kind and self.rng.random() < 0.4:
            return self.prose(20, 60), None, 0, 0
        lead = self.pick(*cues[kind]) if kind and self.rng.random() < 0.6 else self.pick(*against) if not kind and self.rng.random() < 0.5 else ""
        head = f"{self.prose()} {lead}".rstrip() + " "
        put = getattr(self, kind)() if kind else self.other()
        return head + put + self.pick(" ", ". ", ", ", "\n") + self.prose(), kind, len(head), len(head) + len(put)


def _placed(span: Span, kind: str | None, start: int, end: int) -> bool:
    return bool(kind) and span[0] == kind and abs(span[1] - start) <= 1 and abs(span[2] - end) <= 1


def _free(text: str, base: list[Span]) -> list[Span]:
    """Candidates that overlap no span of the patterns."""
    found = candidates(text)
    return [s for s in found if not any(s[1] < end and start < s[2] for _, start, end in base)] if found and base else found


def _examples(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates in made-up texts beyond the patterns' spans, with whether personal data was put there."""
    writer, xs, ys = _Writer(seed), [], []
    for _ in range(n):
        text, *put = writer.text()
        found = _free(text, base_spans(text))
        if found:
            xs.append(features(text, found))
            ys += [_placed(s, *put) for s in found]
    return np.concatenate(xs), np.array(ys, float)


def quality(seed: int, n: int, unseen: bool = False) -> dict[str, tuple[float, float]]:
    """(precision, recall) by kind of the spans beyond the patterns' in made-up texts; what no generator proposes is missed."""
    writer = _Writer(seed, unseen)
    right, said, there = (dict.fromkeys(KINDS, 0) for _ in range(3))
    for _ in range(n):
        text, kind, start, end = writer.text()
        ((base, every),) = all_spans([text], *model())
        if any(s[1] < end and start < s[2] for s in base):
            continue  # the patterns have at least part of it
        added = set(every) - set(base)
        if kind:
            there[kind] += 1
            right[kind] += any(_placed(s, kind, start, end) for s in added)
        for s in added:
            said[s[0]] += 1
    return {k: (right[k] / max(1, said[k]), right[k] / max(1, there[k])) for k in KINDS}


@lru_cache(maxsize=2)
def model(rows: int = 6000, precision: float = 0.995, rarity: float = 50.0) -> tuple[Trees, tuple[float, ...]]:
    """Trees fitted on made-up texts of a fixed seed, and for each kind the threshold calibrated on others.

    The threshold is the least score from which on candidates are right at ``precision``, if wrong ones
    are ``rarity`` times as many in real texts as in the made-up ones.
    """
    trees = boost(*_examples(1, rows))
    x, y = _examples(2, 2 * rows)
    score = trees.probability(x)
    return trees, tuple(threshold(score[x[:, 0] == k], y[x[:, 0] == k], precision, rarity) for k in range(len(KINDS)))


def all_spans(texts: list[str], trees: Trees, limits: tuple[float, ...]) -> Iterator[tuple[list[Span], list[Span]]]:
    """For each text its pattern spans, and these with the candidates over their kind's threshold that overlap nothing better; by kind, then start.

    The candidates of all the texts are scored in one go.
    """
    base = [base_spans(t) for t in texts]
    proposed = [_free(t, b) for t, b in zip(texts, base)]
    rows = [features(t, p) for t, p in zip(texts, proposed) if p]
    score = trees.probability(np.concatenate(rows)) if rows else np.zeros(0)
    at = 0
    for text, own, some in zip(texts, base, proposed):
        here, at = score[at : at + len(some)], at + len(some)
        chosen: list[Span] = []
        for i in np.argsort(-here, kind="stable"):
            kind, start, end = some[i]
            if here[i] >= limits[KINDS.index(kind)] and not any(start < e and b < end for _, b, e in chosen):
                chosen.append(some[i])
        yield own, sorted([*own, *chosen], key=lambda s: (KINDS.index(s[0]), s[1])) if chosen else own


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans.

    The counts and the digest are those of the pattern spans; ``spans`` also lists what the trees added
    (``n_added`` of ``n_spans``). Positions are code points, ends exclusive. A null text counts as empty (no spans).
    Null and repeated ids are kept, other columns are ignored, an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    trees, limits = model()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts: list[list[int]] = []
            digests, spans, added = [], [], []
            for base, every in all_spans(batch["text"].to_pylist(), trees, limits):
                counts.append([sum(s[0] == k for s in base) for k in KINDS])
                digests.append(hashlib.sha256(spelled(base).encode()).hexdigest())
                spans.append(spelled(every))
                added.append(len(every) - len(base))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    rows = rows.mapInArrow(found, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    return rows.withColumn("n_spans", F.expr("n_email + n_ip + n_card + n_phone + n_added"))


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by the kind of its first one in brackets."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join(out) + text[done:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in the text, and n_chars, where present, counted anew in changed rows.

    Every row stays, repeated ones too, in all columns whatever their names; a null text stays null, an
    empty one empty; ids play no part. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    names, trees_limits = docs.columns, model()

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            old = batch[text_col].to_pylist()
            new = [t if t is None else redacted(t, spans) for t, (_, spans) in zip(old, all_spans([t or "" for t in old], *trees_limits))]
            columns = {c: batch[c] for c in names} | {text_col: pa.array(new, batch[text_col].type)}
            if "n_chars" in names:
                n = [len(b) if a != b else m for a, b, m in zip(old, new, batch["n_chars"].to_pylist())]
                columns["n_chars"] = pa.array(n, batch["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return docs.mapInArrow(cleaned, docs.schema)
