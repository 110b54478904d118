"""Several values packed in one field: one value per row, with its place and what was wrong with it.

A parsing expression grammar, tried in this order at each place (the first alternative that matches wins, and a failed one gives
back what it read):

    list    <-  ws open items close end / items end          the brackets must enclose the whole list
    items   <-  item (sep item)*
    item    <-  quoted &(sep / end) / bare / nothing
    quoted  <-  ws open-quote (doubled-quote / any but the closing quote)* close-quote ws
    bare    <-  (bracketed / inner-quoted / any but sep)*
    bracketed <- open (bracketed / any but close)* close

A quoted value whose quote never closes, or that text follows, is read again as a bare one (flag ``quote``); an opening bracket that
never closes is text (flag ``bracket``). The separators are ``; | , 、 ，``, line breaks and tabs, arrows (``-> => →``), and ``/``,
``>`` or a dash between spaces; inside a term (A/B, Front-end) those are text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.functions.columns import pick

QUOTES = {'"': '"', "'": "'", "“": "”", "”": "”", "„": "”", "«": "»", "‘": "’", "`": "`", "「": "」", "『": "』", "＂": "＂"}
BRACKETS = {"[": "]", "(": ")", "{": "}", "（": "）", "【": "】", "［": "］", "｛": "｝"}
_SEP = re.compile(r"[;；|｜,，、\n\r\t\x0b\x0c\u2028\u2029؛،]|->|=>|[→⇒➔➜⟶]|(?<=\s)(?:[/>–—-]|>>)(?=\s)")
_TRIM = re.compile(r"^[\s\ufeff\u200b\u200c\u200d\u2060]+|[\s\ufeff\u200b\u200c\u200d\u2060]+$")
_SPACES = " \u00a0\u2003\u2009\u202f\u3000\ufeff\u200b"


def _trim(s: str) -> str:
    return _TRIM.sub("", s)


class _Parser:
    """One field. Brackets are matched once, from the right, so nothing is read more than a few times however deep or broken it is."""

    def __init__(self, text: str) -> None:
        self.s = text
        self.close = self._pairs(text)

    @staticmethod
    def _pairs(s: str) -> dict[int, int]:
        """For each opening bracket that closes, the place of its partner; quotes are no concern here."""
        stack: list[int] = []
        of_kind: dict[str, list[int]] = {c: [] for c in BRACKETS.values()}  # the open ones, by what closes them
        out: dict[int, int] = {}
        for i, c in enumerate(s):
            if c in BRACKETS:
                stack.append(i)
                of_kind[BRACKETS[c]].append(i)
            elif c in of_kind and of_kind[c]:
                partner = of_kind[c][-1]
                out[partner] = i
                while stack and stack[-1] >= partner:  # what opened inside and is still open never closes
                    of_kind[BRACKETS[s[stack.pop()]]].pop()
        return out

    def quoted(self, i: int, end: int) -> tuple[str, int] | None:
        """The quoted value that begins at i, if it closes and only space lies between it and a separator or the end."""
        s, q = self.s, QUOTES[self.s[i]]
        j = i + 1
        while True:
            j = s.find(q, j, end)
            if j < 0:
                return None
            if q == self.s[i] and s[j + 1 : j + 2] == q and j + 1 < end and s[j + 2 : j + 3] not in (q,) and not self._at_end(j + 1, end):
                j += 2
                continue
            k = self._skip(j + 1, end)
            if k >= end or _SEP.match(s, k) or _SEP.match(s, j + 1):
                return s[i + 1 : j].replace(q + q, q) if q == self.s[i] else s[i + 1 : j], k
            if q != self.s[i] or q not in "'’`":
                return None
            j += 1

    def _at_end(self, j: int, end: int) -> bool:
        k = self._skip(j, end)
        return k >= end or bool(_SEP.match(self.s, k))

    def _skip(self, i: int, end: int) -> int:
        while i < end and self.s[i] in _SPACES:
            i += 1
        return i

    def bare(self, i: int, end: int) -> tuple[str, int, str]:
        s, start, flag = self.s, i, ""
        while i < end:
            c = s[i]
            if c in BRACKETS:
                j = self.close.get(i, -1)
                if 0 <= j < end:
                    i = j + 1
                    continue
                flag = "bracket"
            elif c in QUOTES and i > start and not s[i - 1].isalnum():
                got = s.find(QUOTES[c], i + 1, end)
                if got > 0 and not (c in "'’`" and got + 1 < end and s[got + 1].isalnum()) and self._inner(s[i + 1 : got]):
                    i = got + 1
                    continue
                flag = flag or "quote"
            elif _SEP.match(s, i):
                break
            i += 1
        return s[start:i], i, flag

    @staticmethod
    def _inner(text: str) -> bool:
        """A quotation inside a bare value: text, within one line."""
        return "\n" not in text and bool(text)

    def items(self, i: int, end: int) -> Iterator[tuple[str, str]]:
        s = self.s
        while i <= end:
            k = self._skip(i, end)
            got, flag = None, ""
            if k < end and s[k] in QUOTES and not _SEP.match(s, k):
                got = self.quoted(k, end)
                flag = "" if got else "quote"
            if got:
                value, i = got
                value = _trim(value)
            else:
                value, i, why = self.bare(k, end)
                value, flag = _unquoted(_trim(value)), flag or why
            if value:
                yield value, flag
            if i >= end:
                return
            m = _SEP.match(s, i)
            i = m.end() if m else i + 1


_STRAY = "".join(set(QUOTES) | set(QUOTES.values()))


def _unquoted(v: str) -> str:
    """A bare value without the stray quote of a quotation that never closed, at its start or end."""
    if v[:1] in QUOTES and v.count(v[0]) + v.count(QUOTES[v[0]]) * (QUOTES[v[0]] != v[0]) == 1:
        v = v[1:]
    if v[-1:] and v[-1] in _STRAY and sum(v.count(o) + v.count(c) * (o != c) for o, c in QUOTES.items() if c == v[-1]) == 1 and v[-1] not in "'’`":
        v = v[:-1]
    return _trim(v)


def parse(text: str | None) -> list[tuple[str, str]]:
    """(value, flag) of each value in a packed field, in order; flag is '' or quote or bracket."""
    if not text:
        return []
    s = _trim(text)
    p = _Parser(s)
    i, end = 0, len(s)
    while i < end and s[i] in BRACKETS:
        j, last = p.close.get(i, -1), end
        while last > i and (s[last - 1] in _SPACES or s[last - 1] in ";,；，、|\n\t"):
            last -= 1
        if j != last - 1:
            break
        i, end = p._skip(i + 1, j), j
    return list(p.items(i, end))


def unpack(df: DataFrame, fields: list[str], id_col: str = "row_id", id_type: str = "long") -> DataFrame:
    """(row_id, field_name, item_no, item_text, flag): one row per value of the packed fields.

    item_no counts from 1 within each field of each row; empty places are no values and aren't counted; repeated values stay. Null,
    blank and separator-only fields give no rows. Rows are independent, so there is no shuffle; equal rows each give their values.
    """
    t = pick(df, [id_col, *fields])
    schema = pa.schema([("row_id", pa.int64() if id_type == "long" else pa.string()), ("field_name", pa.string()), ("item_no", pa.int32()), ("item_text", pa.string()), ("flag", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            out: list[list] = [[], [], [], [], []]
            for k, name in enumerate(fields, 1):
                for rid, text in zip(ids, b.column(k).to_pylist()):
                    for n, (value, flag) in enumerate(parse(text), 1):
                        for col, x in zip(out, (rid, name, n, value, flag)):
                            col.append(x)
                    if len(out[0]) > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                        out = [[], [], [], [], []]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return t.mapInArrow(run, f"row_id {id_type}, field_name string, item_no int, item_text string, flag string")
