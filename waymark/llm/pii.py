"""Personal data, plain and disguised, as code-point spans of the source text.

Plain identifiers are found in the text itself.  Disguised ones are found in a
normal form that a transducer writes: look-alike and full-width characters
become ASCII, zero-width characters go, spelled digits become digits, and
``at`` / ``dot`` disguises become ``@`` and ``.``.  The transducer keeps, for
each character it writes, the source span it stands for, so that what is found
in the normal form maps back to the source.  A span of the normal form counts
only if no plain span covers it wholly and some character of it was rewritten.

Null and empty texts have no spans.  Texts are scanned whole, in time that grows
with their length whatever they hold.  Repeated rows give repeated results.
Columns that are not named in ``keep`` are left out; ``redact`` keeps all.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
#: Matches end where a run of digits ends, so none starts within a run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_USER = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"

Span = tuple[int, int, str]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _emails(text: str, counts: Callable[[int, int, int], bool] | None = None) -> list[Span]:
    """Addresses, leftmost and not overlapping; each ``@`` is looked at once, with what stands around it.

    Of an address for which ``counts(start, at, end)`` is false nothing is taken.
    """
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = floor + len(text[floor:at].rstrip(_USER))
        if start < at and (host := _HOST.match(text, at + 1)) and (counts is None or counts(start, at, host.end())):
            out.append((start, host.end(), "email"))
            floor = host.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    return out


def _octet(part: str) -> bool:
    """Whether digits of any number come to at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def detect(text: str, counts: Callable[[int, int, int], bool] | None = None) -> list[Span]:
    """The plain identifiers of a text: leftmost and non-overlapping in each kind; a match that fails its check is dropped."""
    out = _emails(text, counts) if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(map(_octet, m[0].split("."))):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _only_digits(m[0])) <= 19 and _luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_only_digits(m[0])) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# Characters that look like ASCII ones.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "З": "3",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "υ": "u", "κ": "k", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ⅼ": "l", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "·": ".", "﹒": ".", "﹫": "@", "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ", "\u3000": " ",
}
# Characters of no width.
_WIDTHLESS = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Spelled digits.
_SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}


def _table() -> dict[str, str]:
    out = dict(_LOOKALIKES) | dict.fromkeys(_WIDTHLESS, "")
    out |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}  # full-width forms
    for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):  # decimal digits of other scripts and styles
        out |= {chr(zero + d): str(d) for d in range(10)}
    out |= {chr(0x2460 + d): str(d + 1) for d in range(9)} | {"⓪": "0"}
    return out


_CHARS = _table()
_ODD = re.compile("[" + "".join(map(re.escape, _CHARS)) + "]")
_NUMBER = "|".join(sorted(_SPELLED, key=len, reverse=True))
#: Two or more numbers in a row of which one at least is spelled; ``plus`` and spelled dots may stand between.
_SPELLED_RUN = re.compile(rf"(?i)(?<!\w)(?:\+|plus[ ])?(?:(?:{_NUMBER}|[0-9]++)(?:[ ,._-]{{1,3}}|[ ]?(?:dot|point)[ ]?)?){{2,}}(?!\w)")
_SPELLED_PART = re.compile(rf"(?i)(?P<word>{_NUMBER})(?![^\W\d_])|(?P<plus>plus)[ ]|(?P<dot>[ ]?(?:dot|point)[ ]?)|(?P<gap>(?<=[a-zéü])[ ,._-]{{1,3}}|[ ,._-]{{1,3}}(?=(?:{_NUMBER})(?![^\W\d_])))")
_AT, _DOT = "[Aa][Tt]", "[Dd][Oo][Tt]"


def _bracketed(word: str, sign: str) -> str:
    """A word or sign in brackets, after the bracket; words alone stand in ``<>`` and between low lines, too."""
    pairs = (("\\[", "\\]"), ("\\(", "\\)"), ("\\{", "\\}"))
    return "|".join([*(rf"(?<={a})\s*(?:{word}|{sign})\s*{b}" for a, b in pairs), rf"(?<=<)\s*{word}\s*>", rf"(?<=_){word}_"])


_DOT_MARK = rf"{_bracketed(_DOT, '[.]')}|(?<=\s[Dd])[Oo][Tt](?=\s)"
#: Every mark starts at a character of its own, so a text is scanned once whatever runs it holds.
_MARK = re.compile(rf"[\[({{<_DdAa@](?:(?P<at>{_bracketed(_AT, '@')})|(?P<dot>{_DOT_MARK})|(?P<bare>(?<=\s[Aa])[Tt](?=\s))|(?P<spaced>(?<=\s@)(?=\s)))")
#: What a text holds one of if it has marks to rewrite: a bare ``at`` or a spaced ``@`` counts only beside a dot mark.
_MARKED = re.compile(rf"[\[({{<_Dd](?:{_bracketed(_AT, '@')}|{_DOT_MARK})")
#: How a character of the normal form came about.
KEPT, REWRITTEN, BARE, SPACED = range(4)


class Tape:
    """Text with, for each character, the source span it stands for and how it came about."""

    def __init__(self, text: str):
        self.text = text
        self.starts = list(range(len(text)))
        self.ends = list(range(1, len(text) + 1))
        self.how = bytearray(len(text))

    def rewrite(self, edits: list[tuple[int, int, str, int]]) -> None:
        """Replace the given places (start, end, text, how), in order and apart from one another."""
        if not edits:
            return
        text, starts, ends, how, at = [], [], [], bytearray(), 0
        for left, right, put, kind in edits:
            text.append(self.text[at:left])
            starts += self.starts[at:left]
            ends += self.ends[at:left]
            how += self.how[at:left]
            text.append(put)
            if right > left:
                starts += [self.starts[left]] * len(put)
                ends += [self.ends[right - 1]] * len(put)
                how += bytes([kind]) * len(put)
            if not put and how:
                how[-1] = how[-1] or REWRITTEN  # what went counts as a change of its neighbour
            at = right
        self.text = "".join(text) + self.text[at:]
        self.starts, self.ends, self.how = starts + self.starts[at:], ends + self.ends[at:], how + self.how[at:]

    def changed_dot(self, start: int, end: int) -> bool:
        return any(h and c == "." for h, c in zip(self.how[start:end], self.text[start:end]))

    def address(self, start: int, at: int, end: int) -> bool:
        """Whether an address counts: a bare ``at`` needs a rewritten dot in its host, a spaced ``@`` one anywhere."""
        if self.how[at] == BARE:
            return self.changed_dot(at, end)
        return self.how[at] != SPACED or self.changed_dot(start, end)


def _digit(word: str) -> str:
    """The digit of a spelled one; letters that only case folding takes for ASCII ones are no keys."""
    return _SPELLED.get(word.lower()) or next(d for w, d in _SPELLED.items() if re.fullmatch(w, word, re.I))


def _digit_edits(text: str) -> list[tuple[int, int, str, int]]:
    out = []
    for run in _SPELLED_RUN.finditer(text):
        parts = [m for m in _SPELLED_PART.finditer(text, run.start(), run.end())]
        spelled = sum(m.lastgroup == "word" for m in parts)
        if not spelled:
            continue
        # few spelled digits stand in prose, too, where a dot and a space end a sentence
        dot = lambda gap: "." if gap.strip() == "." and (spelled >= 4 or gap == ".") else gap if "." in gap and spelled < 4 else ""
        for m in parts:
            if m.end() >= run.end() and m.lastgroup in ("gap", "dot"):
                continue
            put = {"word": lambda m: _digit(m["word"]), "plus": lambda m: "+", "dot": lambda m: ".", "gap": lambda m: dot(m[0])}[m.lastgroup](m)
            out.append((m.start(), m.end(), put, REWRITTEN))
    return out


def _mark_edits(text: str) -> list[tuple[int, int, str, int]]:
    """Marks with the white space around them."""
    out, floor = [], 0
    for m in _MARK.finditer(text):
        if m.start() < floor:
            continue
        start, end = m.span()
        while start > floor and text[start - 1].isspace():
            start -= 1
        while end < len(text) and text[end].isspace():
            end += 1
        out.append((start, end, "." if m.lastgroup == "dot" else "@", {"bare": BARE, "spaced": SPACED}.get(m.lastgroup, REWRITTEN)))
        floor = end
    return out


def disguised(text: str, plain: list[Span]) -> list[Span]:
    """Identifiers that only the normal form shows, as source spans."""
    odd = None if text.isascii() else _ODD.search(text)
    digits = None if odd else _digit_edits(text)
    if not (odd or digits or _MARKED.search(text)):
        return []
    tape = Tape(text)
    if odd:
        tape.rewrite([(m.start(), m.end(), _CHARS[m[0]], REWRITTEN) for m in _ODD.finditer(tape.text)])
        digits = _digit_edits(tape.text)
    tape.rewrite(digits)
    tape.rewrite(_mark_edits(tape.text))
    found = []
    for start, end, kind in detect(tape.text, tape.address):
        if any(tape.how[start:end]):
            left, right = tape.starts[start], tape.ends[end - 1]
            if not any(s <= left and right <= e for s, e, _ in plain):
                found.append((left, right, kind))
    return found


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans, each sorted by start, then kind."""
    plain = detect(text)
    more = disguised(text, plain)
    return plain, sorted(plain + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1])) if more else plain


def find(df: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``*keep, plain, spans``: arrays of ``struct<kind, start, end>`` in code points, end exclusive."""
    source = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), f"plain {spans}, spans {spans}"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [scan(t) for t in part.column(len(keep)).to_pylist()]
                arrays = [pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in f[i]] for f in found], kind) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *arrays], [*keep, "plain", "spans"])

    return source.mapInArrow(run, schema)


def mask(text: str) -> str:
    """The text with each span, merged where they overlap, replaced by ``<kind>``."""
    spans = scan(text)[1]
    if not spans:
        return text
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(df: DataFrame, *, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``df`` with its text masked and, when named, the length column brought up to date.  Null text stays null."""
    names = df.columns

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                i = part.schema.get_field_index(text_col)
                texts = [t if t is None else mask(t) for t in part.column(i).to_pylist()]
                columns = list(part.columns)
                columns[i] = pa.array(texts, part.schema.field(i).type)
                if length_col:
                    j = part.schema.get_field_index(length_col)
                    columns[j] = pa.array([n if t is None else len(t) for t, n in zip(texts, part.column(j).to_pylist())], part.schema.field(j).type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, df.schema)
