"""Personal data with offset-preserving deobfuscation.

Plain rules find plain identifiers. Disguised ones are found on a tape: the text rewritten step by step by small
transducers (look-alike letters and digits, invisible characters, spelled digits, "at" and "dot"), each output
character with the source range it stands for. The same rules run on the tape and their spans are
mapped back, so every span is in characters of the source.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import map_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]  # start, end (exclusive), kind

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits: where its start fails, so does every later digit of the run.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses. Every match holds one @, so they are looked for from there."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            out.append((start, done, "email"))
        at = text.find("@", max(at + 1, done))
    return out


def plain_spans(text: str) -> list[Span]:
    """Spans of the plain rules, ordered by start, then kind."""
    out = emails(text)
    out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 14 <= len(m[0]) <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


@dataclass
class Tape:
    """Rewritten text; character i stands for source[start[i]:end[i]]."""

    text: str
    start: list[int]
    end: list[int]

    @classmethod
    def of(cls, text: str) -> "Tape":
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)))

    def rewrite(self, pattern: re.Pattern[str], into: Callable[[re.Match[str]], list[tuple[str, int, int]] | str | None]) -> "Tape":
        """Replace matches. ``into`` gives pieces (new text, start, end), whose ranges may lie anywhere in the match, one text for the whole match, or None to leave it."""
        parts, start, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            pieces = into(m)
            if pieces is None or m.start() == m.end():
                continue
            parts.append(self.text[at: m.start()])
            start += self.start[at: m.start()]
            end += self.end[at: m.start()]
            for new, a, b in [(pieces, m.start(), m.end())] if isinstance(pieces, str) else pieces:
                parts.append(new)
                start += [self.start[a]] * len(new)
                end += [self.end[b - 1]] * len(new)
            at = m.end()
        return Tape("".join(parts) + self.text[at:], start + self.start[at:], end + self.end[at:])

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


# Letters that look like Latin ones.
_LOOKS = dict(zip("АВЕКМНОРСТХУаеорсхуіјѕһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν", "ABEKMHOPCTXYaeopcxyijshdqwABEZHIKMNOPTYXoav"))
_INVISIBLE = "­᠎​‌‍⁠﻿"
_DASHES = "‐‑‒–—−﹣"
_SPACES = "              　"
# Everything a look-alike step may change: letters above, and the blocks with compatibility forms and other digits.
_STRANGE = re.compile(f"[{_INVISIBLE}{_DASHES}{_SPACES}{''.join(_LOOKS)}٠-٩۰-۹०-९⁰-ₜ℀-⅏Ⅰ-ↈ①-⓿。！-｡﹒﹫\U0001d400-\U0001d7ff]")


def plain_letter(c: str) -> str:
    """The ASCII character a look-alike stands for; invisible ones go, others stay."""
    if c in _LOOKS:
        return _LOOKS[c]
    if c in _INVISIBLE:
        return ""
    if c in _DASHES:
        return "-"
    if c in _SPACES:
        return " "
    if c in "。｡":
        return "."
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    form = unicodedata.normalize("NFKC", c)
    return form if form.isascii() else c


# Fixed lists: the digits in four languages.
_DIGITS = {w: str(d) for d, row in enumerate((
    "zero oh null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco",
    "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve")) for w in row.split()}
_DIGIT = "(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + ")"
_SPOKEN_DOT = r"(?:dot|punkt|point|punto)"
# Numbers of digit words and numerals: what may stand between their parts, and where a spelled part is one digit.
_PART = rf"(?:[0-9]+|{_DIGIT}(?!\w))"
_RUN = re.compile(rf"(?<!\w)(?:(?:plus|\+)[ -]?)?{_PART}(?:(?:[ ,.()/-]{{1,3}}|\s+{_SPOKEN_DOT}\s+){_PART})+(?!\w)", re.IGNORECASE)
_PIECES = re.compile(rf"(?P<plus>plus[ -]?|\+[ -]?)|(?P<number>[0-9]+)|(?P<dot>\s+{_SPOKEN_DOT}\s+)|(?P<word>[^\W\d_]+)|(?P<gap>[ ,.()/-]+)", re.IGNORECASE)
# Gaps start where no gap stands before, so long ones are read once.
_OPEN, _CLOSE = r"(?<!\s)\s*[(\[{<]\s*", r"\s*[)\]}>]\s*"
_BRACKET_AT = re.compile(rf"{_OPEN}(?:at|ät|@|arroba|arobase){_CLOSE}", re.IGNORECASE)
_BRACKET_DOT = re.compile(rf"(?<=[A-Za-z0-9])\s*[(\[{{<]\s*(?:dot|punkt|point|punto|\.){_CLOSE}(?=[A-Za-z0-9])", re.IGNORECASE)
_BARE_DOT = re.compile(rf"(?<=[A-Za-z0-9])\s+{_SPOKEN_DOT}\s+(?=[A-Za-z0-9])", re.IGNORECASE)
# A bare "at" needs a mailbox before it, or a spoken dot behind: "meet me at example.com" names no mailbox.
_BARE_AT = re.compile(r"(?<=[A-Za-z0-9_+-])(?:\s+at\s+|\s+@\s*|@\s+)(?=([A-Za-z0-9-]+)((?:\.[A-Za-z0-9-]+)*))", re.IGNORECASE)
_MAILBOX = re.compile(r"(?=[A-Za-z0-9_%+-]*[A-Za-z])[A-Za-z0-9_%+-]*(?:[A-Za-z0-9][._+-][A-Za-z0-9]|[A-Za-z][0-9])[A-Za-z0-9._%+-]*$")
_TOP_LABEL = re.compile(r"\.[A-Za-z]{2,}$")
# Least spelled digits of a number, and characters of a name that are looked at before a bare "at".
_SPELLED, _LOOK_BACK = 3, 64


def _spelled_number(match: re.Match[str]) -> list[tuple[str, int, int]] | None:
    """Digit words become digits, each for its own word, and those in a row one number."""
    out: list[tuple[str, int, int]] = []
    kinds = []
    for m in _PIECES.finditer(match[0]):
        a, b = match.start() + m.start(), match.start() + m.end()
        text = {"plus": "+", "dot": ".", "word": _DIGITS.get(m[0].lower(), m[0])}.get(m.lastgroup, m[0])
        out.append((text, a, b))
        kinds.append(m.lastgroup)
    if kinds.count("word") < _SPELLED:
        return None
    # Between two words only a dot stays.
    return [x for i, x in enumerate(out) if not (kinds[i] == "gap" and 0 < i < len(out) - 1 and kinds[i - 1] == kinds[i + 1] == "word" and "." not in x[0])]


def _is_phone(digits: str) -> bool:
    """A spelled number without a plus: neither counting nor one word again and again."""
    steps = [(int(b) - int(a)) % 10 for a, b in zip(digits, digits[1:])]
    return 10 <= len(digits) <= 15 and len(set(digits)) > 2 and 2 * max(map(steps.count, steps)) < len(digits)


def hidden_spans(text: str) -> list[Span]:
    """Spans found on the tape that the text was rewritten to; empty if no step changes the text."""
    tape: Tape | None = None

    def step(pattern: re.Pattern[str], into) -> None:
        nonlocal tape
        if pattern.search(text if tape is None else tape.text):
            tape = (tape or Tape.of(text)).rewrite(pattern, into)

    step(_STRANGE, lambda m: plain_letter(m[0]))
    if any(c in (tape.text if tape else text) for c in "([{<"):
        step(_BRACKET_DOT, lambda m: ".")
        step(_BRACKET_AT, lambda m: "@")
    spoken: list[tuple[int, int]] = []

    def number(m: re.Match[str]) -> list[tuple[str, int, int]] | None:
        pieces = _spelled_number(m)
        if pieces and pieces[0][0] != "+" and _is_phone("".join(c for x, _, _ in pieces for c in x if c.isdigit())):
            spoken.append(tape.span(m.start(), m.end()) if tape else (m.start(), m.end()))
        return pieces

    step(_RUN, number)
    was = None if tape is None else tape.text
    step(_BARE_DOT, lambda m: ".")
    dotted = tape is not None and tape.text != was

    def at_sign(m: re.Match[str]) -> str | None:
        spoken_dot = dotted and bool(m[2]) and tape.end[m.end() + len(m[1])] - tape.start[m.end() + len(m[1])] > 1
        mailbox = _TOP_LABEL.search(m[2]) and _MAILBOX.search(m.string[max(0, m.start() - _LOOK_BACK): m.start()])
        return "@" if m[2] and ("@" in m[0] or spoken_dot or mailbox) else None

    step(_BARE_AT, at_sign)
    if tape is None or tape.text == text:
        return []
    out = [(*tape.span(a, b), kind) for a, b, kind in plain_spans(tape.text)]
    cards = {(a, b) for a, b, kind in out if kind == "card"}
    return out + [(a, b, "phone") for a, b in spoken if (a, b) not in cards]


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans). A hidden span is added unless another covers it; one sweep, as covering spans start no later."""
    plain = plain_spans(text) if "@" in text or any(d in text for d in "0123456789") else []
    marked = [(a, -b, 0, kind) for a, b, kind in plain] + [(a, -b, 1 + KINDS.index(kind), kind) for a, b, kind in set(hidden_spans(text))]
    found, reach = [], -1
    for a, b, hidden, kind in sorted(marked):
        if not hidden or -b > reach:
            found.append((a, -b, kind))
        reach = max(reach, -b)
    return plain, sorted(found, key=_order)


def redact(text: str, spans: list[Span]) -> str:
    """Replace spans by the name of their kind; overlapping ones by that of the first."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of (start, end, kind) in code points of the whole text, ordered by start, then kind.

    ``base`` has the plain rules' spans, ``spans`` also those of disguised identifiers. A null or empty text has none.
    Repeated rows come out each; other columns are ignored; an empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [find_spans(t or "") for t in batch.column(1).to_pylist()]
            cols = [pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in x[i]] for x in both], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "base", "spans"])

    inner = "array<struct<start: long, end: long, kind: string>>"
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, f"doc_id long, base {inner}, spans {inner}")


def redact_documents(docs: DataFrame) -> DataFrame:
    """Documents with every found span replaced by [EMAIL], [IP], [CARD] or [PHONE]; n_chars, where there is one, follows the text.

    All columns and rows stay, also repeated ones and null doc_ids; null and empty texts stay as they are; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts = [t if t is None else redact(t, find_spans(t)[1]) for t in batch.column("text").to_pylist()]
            cols = dict(zip(names, batch.columns)) | {"text": pa.array(texts, batch.schema.field("text").type)}
            if "n_chars" in names:
                old = batch.column("n_chars").to_pylist()
                cols["n_chars"] = pa.array([n if t is None else len(t) for n, t in zip(old, texts)], batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], schema=batch.schema)

    return map_batches(docs, run, docs.schema)
