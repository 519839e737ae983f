"""Personal data in texts, plain and disguised, with offsets of the source.

Plain identifiers are found by patterns. For the disguised ones, transducers rewrite a text (homoglyphs and invisible
characters, spelled digits, "(at)" and "dot") and keep for every rewritten piece where it came from; the same
detectors read the rewritten text and their spans are mapped back.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from contactsheet.llm._common import slices

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits does, so these need not try every digit of a long run.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅοανρυιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTYXIJSoavpuiABEZHIKMNOPTYX", strict=True))
# Characters that show nothing, and dots and dashes of other blocks.
INVISIBLE = "­​‌‍⁠﻿"
PUNCTUATION = {"。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-"}
# Spelled digits, and endings that a domain written with bare "at" and "dot" must have.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "uk", "us", "de", "fr", "es", "eu", "ch", "at", "it", "nl")
DETERMINERS = ("the", "a", "an", "this", "that", "each", "every", "any", "some", "no", "one", "my", "your", "his", "her", "its", "our", "their", "which", "what")

_DIGIT_WORD = "(?:" + "|".join(SPELLED) + ")"
_SPELLED_RUN = re.compile(rf"(?i)\b(?:plus[\s-]+)?{_DIGIT_WORD}(?:[\s-]+(?:{_DIGIT_WORD}|dot|point))*[\s-]+{_DIGIT_WORD}\b")
_WORD = re.compile(r"[A-Za-z]+")
_OPEN, _CLOSE = r"\s?[\[({<]\s?", r"\s?[\])}>]\s?"
_AT_SIGN = re.compile(rf"(?i){_OPEN}(?:at|@){_CLOSE}")
_DOT_SIGN = re.compile(rf"(?i){_OPEN}(?:dot|\.){_CLOSE}")
_DOT = rf"(?:\s+dot\s+|{_OPEN}(?:dot|\.){_CLOSE}|\.)"
_BARE = re.compile(rf"(?i)(?:(?<=[A-Za-z0-9])\s+at\s+|{_OPEN}(?:at|@){_CLOSE}|@)(?:[a-z0-9-]{{1,63}}{_DOT}){{1,4}}(?:{'|'.join(ENDINGS)})\b")
# Both signs spelled out: any ending of letters; "at the dot" speaks of a dot.
_SPELLED_OUT = re.compile(
    rf"(?i)(?:(?<=[A-Za-z0-9])\s+at\s+|{_OPEN}at{_CLOSE})(?!(?:{'|'.join(DETERMINERS)})\s+dot\b)"
    rf"(?:[a-z0-9-]{{1,63}}{_DOT}){{0,3}}[a-z0-9-]{{1,63}}(?:\s+dot\s+|{_OPEN}dot{_CLOSE})[a-z]{{2,63}}\b"
)
_DIGIT_DOT = re.compile(r"(?i)(?<=[0-9])\s+dot\s+(?=[0-9])")
_BARE_SIGN = re.compile(rf"(?i)\s+at\s+|\s+dot\s+|{_OPEN}(?:at|@|dot|\.){_CLOSE}")


@lru_cache(maxsize=1)
def _glyphs() -> dict[str, str]:
    """What each disguised character stands for: digits by their value, compatibility forms by their plain one."""
    table = dict.fromkeys(INVISIBLE, "") | LOOKALIKES | PUNCTUATION
    for code in [*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]:
        char = chr(code)
        plain = str(unicodedata.digit(char)) if unicodedata.category(char) == "Nd" else unicodedata.normalize("NFKC", char)
        if len(plain) == 1 and " " <= plain <= "~":
            table.setdefault(char, plain)
    return table


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])) % 10 == 0


def find_plain(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain identifiers, by kind and start; leftmost and non-overlapping within a kind."""
    found: list[tuple[str, int, int]] = []
    end, sign = 0, text.find("@")
    while sign >= 0:  # the local part is what precedes the sign, back to the last match at most
        start = sign
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, sign + 1) if start < sign else None
        if domain:
            end = domain.end()
            found.append(("email", start, end))
        sign = text.find("@", max(sign + 1, end))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups()):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


class Rewritten:
    """A text with some of its pieces replaced, and the way back to offsets of the source."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        """``edits``: (start, end, replacement), sorted, not overlapping."""
        parts, self._at, self._from, self._to, length, last = [], [], [], [], 0, 0

        def add(start: int, end: int, piece: str) -> None:
            nonlocal length
            if piece:
                self._at.append(length)
                self._from.append(start)
                self._to.append(end)
                parts.append(piece)
                length += len(piece)

        for start, end, piece in edits:
            add(last, start, text[last:start])
            add(start, end, piece)
            last = end
        add(last, len(text), text[last:])
        self.text = "".join(parts)
        self._ends = [*self._at[1:], length]

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source's span of a non-empty span; a replaced piece counts as a whole."""
        i, j = bisect_right(self._at, start) - 1, bisect_right(self._at, end - 1) - 1
        kept = [self._to[k] - self._from[k] == self._ends[k] - self._at[k] for k in (i, j)]
        return self._from[i] + (start - self._at[i] if kept[0] else 0), self._from[j] + end - self._at[j] if kept[1] else self._to[j]


def _spelled(match: re.Match[str]) -> str:
    """The digits, dots and plus sign a run of words spells; to a pattern without case, ı and İ are an i."""
    signs = {"dot": ".", "point": ".", "plus": "+"}
    return "".join(SPELLED.get(w) or signs[w] for w in map(str.lower, _WORD.findall(match[0].translate({0x130: "i", 0x131: "i"}))))


def _glyph_edits(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    table = _glyphs()
    if table.keys().isdisjoint(set(text)):
        return []
    return [(i, i + 1, table[char]) for i, char in enumerate(text) if char in table]


def _word_edits(text: str) -> list[tuple[int, int, str]]:
    edits = [(*m.span(), _spelled(m)) for m in _SPELLED_RUN.finditer(text)]
    edits += [(*m.span(), "@") for m in _AT_SIGN.finditer(text)] + [(*m.span(), ".") for p in (_DOT_SIGN, _DIGIT_DOT) for m in p.finditer(text)]
    for m in (m for p in (_BARE, _SPELLED_OUT) for m in p.finditer(text)):
        edits += [(*s.span(), "@" if "at" in s[0].lower() or "@" in s[0] else ".") for s in _BARE_SIGN.finditer(text, *m.span())]
    out: list[tuple[int, int, str]] = []
    for edit in sorted(set(edits)):
        if not out or edit[0] >= out[-1][1]:
            out.append(edit)
    return out


# What any rewriting of words needs, one part for each: a bracketed sign; a bare "dot"; a bare "at" whose host has plain
# dots only; two spelled digits; letters that a pattern without case takes for others. It may hold where no rule does,
# never the other way round; read on the lower-case text, where the first letters alone decide fast.
_HINT = re.compile(rf"[\[({{<]\s?(?:at|@|dot|\.)\s?[\])}}>]|dot\s|at\s+[a-z0-9-]{{1,63}}\.[a-z0-9-]|{_DIGIT_WORD}[\s-]+(?:{_DIGIT_WORD}|dot|point)|[ı\u0307]")


def find(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, plain) in code points, by kind as in ``KINDS``, then start; a null text has none.

    All plain matches stay; a disguised one is added where it is not a plain one of its kind or inside one, and overlaps
    no earlier disguised one of its kind. One that is disguised in part so stands beside its plain fragment.
    """
    if not text:
        return []
    plain = find_plain(text)
    found = [(*x, True) for x in plain]
    glyphs = Rewritten(text, edits) if (edits := _glyph_edits(text)) else None
    clear = glyphs.text if glyphs else text
    words = Rewritten(clear, edits) if _HINT.search(clear.lower()) and (edits := _word_edits(clear)) else None
    if glyphs or words:
        taken: dict[str, tuple[list[int], list[int]]] = {kind: ([], []) for kind in KINDS}
        for kind, start, end in plain:
            taken[kind][0].append(start)
            taken[kind][1].append(end)
        last = dict.fromkeys(KINDS, 0)
        for kind, start, end in find_plain((words or glyphs).text):
            for step in (words, glyphs):
                start, end = step.source(start, end) if step else (start, end)
            starts, ends = taken[kind]
            before = bisect_right(starts, start)
            if (before and ends[before - 1] >= end) or start < last[kind]:
                continue
            last[kind] = end
            found.append((kind, start, end, False))
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1]))


def redact_text(text: str | None) -> str | None:
    """The text with every span, plain or disguised, replaced by its kind in brackets; overlapping spans become one."""
    out, last = [], 0
    for kind, start, end, _ in sorted(find(text), key=lambda x: (x[1], -x[2])):
        if start >= last:
            out += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, end)
    return text if not out else "".join([*out, text[last:]])


SPANS = "array<struct<kind:string,start:long,end:long,plain:boolean>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_())]))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans array of (kind, start, end, plain)) of every whole text.

    A null or empty text has an empty list; a null id stays null; repeated rows are read each; further columns are
    ignored; an empty table gives an empty table.
    """
    rows = docs.select(id_col, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [[dict(zip(("kind", "start", "end", "plain"), x, strict=True)) for x in find(text.as_py())] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], [id_col, "spans"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, spans {SPANS}")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` redacted; all other columns, nulls and empty texts stay as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = list(batch.columns)
            columns[at] = pa.array([redact_text(text.as_py()) for text in columns[at]], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
