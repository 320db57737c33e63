"""Personal data in plain and in disguised form, with offsets in the source text.

Plain identifiers are matched in the text as it is. For disguised ones the text passes
through transducers that rewrite look-alike characters, spelled digits and at/dot words;
every character that comes out remembers the stretch of source characters it came from.
The same detectors then run over the rewritten text, and what they find is mapped back.
Found spans that no rewriting touched are the plain ones again and are left out.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

Span = tuple[str, int, int]

# ---------------------------------------------------------------- detectors

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a run of digits is taken whole or not at all, so a run is looked at once
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_ANY_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[Span]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        parts = m[0].split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts):
            yield "ip", m.start(), m.end()


def luhn(digits: str) -> bool:
    """Whether a number passes the Luhn check."""
    total = sum(map(int, digits[-1::-2]))
    total += sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()


def _phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()


def _in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def detect(text: str) -> list[Span]:
    """Plain identifiers as (kind, start, end), by start and kind; end exclusive."""
    found = list(_emails(text)) if "@" in text else []
    if _ANY_DIGIT.search(text):
        for detector in (_ips, _cards, _phones):
            found.extend(detector(text))
    return _in_order(found)


# ---------------------------------------------------------------- transducers


class Rewritten:
    """A text with, for each character, the source stretch it stands for."""

    def __init__(self, text: str, spans: list[tuple[int, int]] | None = None) -> None:
        self.text = text
        self.spans = [(i, i + 1) for i in range(len(text))] if spans is None else spans

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.spans[start][0], self.spans[end - 1][1]

    def replace(self, pattern: re.Pattern[str], by: Callable[[re.Match[str]], str | None]) -> Rewritten:
        """Rewrite matches; None leaves one as it is. Each new character has the match's span."""
        out, spans, last = [], [], 0
        for m in pattern.finditer(self.text):
            new = by(m)
            if new is None or m.start() == m.end():
                continue
            out.append(self.text[last : m.start()])
            spans.extend(self.spans[last : m.start()])
            out.append(new)
            spans.extend([self.source(m.start(), m.end())] * len(new))
            last = m.end()
        if not last:
            return self
        out.append(self.text[last:])
        spans.extend(self.spans[last:])
        return Rewritten("".join(out), spans)


# fixed values: Cyrillic and Greek letters that look like Latin ones
_LOOKALIKES = dict(
    pair.split(":")
    for pair in (
        "а:a е:e о:o р:p с:c у:y х:x і:i ј:j ѕ:s һ:h к:k м:m т:t в:b н:h "
        "А:A В:B Е:E К:K М:M Н:H О:O Р:P С:C Т:T Х:X "
        "α:a ο:o ρ:p ν:v ε:e ι:i κ:k τ:t"
    ).split()
)
# fixed values: spelled digits
_DIGITS = dict(
    pair.split(":")
    for pair in "zero:0 oh:0 one:1 two:2 three:3 four:4 five:5 six:6 seven:7 eight:8 nine:9".split()
)
_HIDDEN = "​‌‍⁠﻿­"
_WORDS = "|".join(_DIGITS)
# at least seven spelled digits in a row, digits as such may stand among them
_SPELLED = re.compile(
    rf"(?<![A-Za-z0-9])(?:plus[\s-]{{1,3}})?(?:(?:{_WORDS}|[0-9])[\s,.-]{{1,3}}){{6,}}(?:{_WORDS}|[0-9])(?![A-Za-z0-9])",
    re.IGNORECASE,
)
_SPELLED_WORD = re.compile(rf"(?<![A-Za-z])(?:{_WORDS}|plus|[0-9])(?![A-Za-z])", re.IGNORECASE)
_AT = re.compile(r"[\x20]{0,3}[\[({<][\x20]{0,3}(?:at|@)[\x20]{0,3}[\])}>][\x20]{0,3}", re.IGNORECASE)
_DOT = re.compile(r"[\x20]{0,3}[\[({<][\x20]{0,3}(?:dot|punkt|point|\.)[\x20]{0,3}[\])}>][\x20]{0,3}", re.IGNORECASE)
# words alone are a disguise only if both stand where an address has its signs; brackets have become signs by then
_SPOKEN = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?P<at>[\x20]{1,3}(?:at|@)[\x20]{1,3}|@)[A-Za-z0-9-]{1,63}"
    r"(?P<rest>(?:(?:[\x20]{1,3}dot[\x20]{1,3}|\.)[A-Za-z0-9-]{1,63}){1,4})(?![A-Za-z0-9-])",
    re.IGNORECASE,
)
_SPOKEN_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\x20{1,3}dot\x20{1,3}[0-9]{1,3}){3}(?![0-9])", re.IGNORECASE)
_SPOKEN_SIGN = re.compile(r"[\x20]{1,3}(at|@|dot)[\x20]{1,3}", re.IGNORECASE)
_BRACKETED = re.compile(r"[\[({<]\x20{0,3}(?:at|dot|punkt|point|[@.])\x20{0,3}[\])}>]", re.IGNORECASE)


def _plain_character(c: str) -> str | None:
    """What an unusual character stands for; None if it stands for itself."""
    if c in _HIDDEN:
        return ""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    folded = unicodedata.normalize("NFKC", c)
    # full-width and styled letters and signs, not letters with accents
    return folded if folded != c and len(folded) == 1 and folded.isascii() else None


_UNUSUAL = re.compile(r"[^\x00-\x7fÀ-ɏ]")


def _spell(m: re.Match[str]) -> str:
    parts = _SPELLED_WORD.findall(m[0])
    return "".join("+" if p.lower() == "plus" else _DIGITS.get(p.lower(), p) for p in parts)


def normalise(text: str) -> Rewritten | None:
    """The text without disguises, or None if there is none to undo."""
    out = None
    if not text.isascii():
        if any(_plain_character(c) is not None for c in set(_UNUSUAL.findall(text))):
            out = Rewritten(text).replace(_UNUSUAL, lambda m: _plain_character(m[0]))
    now = out.text if out else text
    bracketed = bool(_BRACKETED.search(now))
    if bracketed:
        out = (out or Rewritten(now)).replace(_AT, lambda _: "@").replace(_DOT, lambda _: ".")
        now = out.text
    lower = now.lower()
    if " dot " in lower or bracketed and (" at " in lower or " @ " in lower):
        spoken = out or Rewritten(now)
        spoken = _spoken_signs(spoken, [m.span() for m in _SPOKEN.finditer(spoken.text) if _hidden_dot(spoken, m)])
        spoken = _spoken_signs(spoken, [m.span() for m in _SPOKEN_IP.finditer(spoken.text)])
        out, now = spoken, spoken.text
    if sum(w in lower for w in _DIGITS) >= 1 and _SPELLED.search(now):
        out = (out or Rewritten(now)).replace(
            _SPELLED, lambda m: _spell(m) if re.search("[A-Za-z]", m[0]) else None
        )
    return out


def _hidden_dot(whole: Rewritten, m: re.Match[str]) -> bool:
    """Whether a dot of an address is disguised: prose says "at example.com" as well.

    After a plain at sign all dots must be, else a plain address stands there.
    """
    dots = [k for k in range(m.start("rest"), m.end("rest")) if whole.text[k] == "."]
    plain = [k for k in dots if whole.spans[k][1] - whole.spans[k][0] == 1]
    at, end = m.span("at")
    if end - at == 1 and whole.spans[at][1] - whole.spans[at][0] == 1 and plain:
        return False
    return len(dots) > len(plain) or " " in m["rest"]


def _spoken_signs(whole: Rewritten, stretches: list[tuple[int, int]]) -> Rewritten:
    """Signs for the words at and dot inside some stretches."""
    out, spans, last = [], [], 0
    for start, end in stretches:
        inside = Rewritten(whole.text[start:end], whole.spans[start:end]).replace(
            _SPOKEN_SIGN, lambda m: "." if m[1].lower() == "dot" else "@"
        )
        out += [whole.text[last:start], inside.text]
        spans += whole.spans[last:start] + inside.spans
        last = end
    if not stretches:
        return whole
    return Rewritten("".join(out) + whole.text[last:], spans + whole.spans[last:])


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """The plain identifiers of a text, and those that were disguised."""
    text = text or ""
    base = detect(text)
    rewritten = normalise(text)
    if rewritten is None:
        return base, []
    taken = {}
    for kind, a, b in base:
        taken.setdefault(kind, []).append((a, b))
    added = []
    for kind, start, end in detect(rewritten.text):
        a, b = rewritten.source(start, end)
        # untouched text gives what the plain detectors have judged already
        if text[a:b] == rewritten.text[start:end]:
            continue
        if not any(x <= a and b <= y for x, y in taken.get(kind, ())):
            added.append((kind, a, b))
    return base, _in_order(added)


def listed(spans: list[Span]) -> str:
    """Spans as text: kind:start:end, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = (
    "id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_disguised bigint, "
    "base string, spans string"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[] for _ in range(5)]
        plain, every = [], []
        for text in batch.column(1):
            base, added = find(text.as_py())
            for column, kind in zip(counts, KINDS, strict=False):
                column.append(sum(k == kind for k, _, _ in base))
            counts[4].append(len(added))
            plain.append(listed(base))
            every.append(listed(_in_order(base + added)))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *[pa.array(c, pa.int64()) for c in counts],
                pa.array(plain, pa.string()),
                pa.array(every, pa.string()),
            ],
            names=["id", "n_email", "n_ip", "n_card", "n_phone", "n_disguised", "base", "spans"],
        )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: counts by kind of the plain identifiers, n_disguised, base and spans.

    Offsets count code points of the source, ends are exclusive. NULL and empty texts have
    no spans; every row is judged for itself, so repeated ids and rows do not matter; no
    documents give no rows. Other columns are not looked at.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(_scan, SCHEMA)


def redact(text: str | None, mark: str = "[{}]") -> str | None:
    """A text with every identifier replaced by its kind."""
    if text is None:
        return None
    base, added = find(text)
    out, last = [], 0
    for kind, a, b in _in_order(base + added):
        if a >= last:
            out += [text[last:a], mark.format(kind)]
        last = max(last, b)
    return "".join(out) + text[last:]
