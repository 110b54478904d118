"""Canonical text: what stays of a string when formatting is taken away. Plain Python, used inside Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from typing import Any

#: Signs that look like punctuation or symbols but carry meaning (C, C++ and C# are three things).
KEPT_SIGNS = "+#"


class _Strip(dict[int, Any]):
    """str.translate table, filled as code points turn up: drops separators, punctuation, symbols and invisible characters."""

    def __missing__(self, cp: int) -> Any:
        c = chr(cp)
        drop = c not in KEPT_SIGNS and (unicodedata.category(c)[0] in "PSZC" or _invisible(cp))
        self[cp] = None if drop else cp
        return self[cp]


class _Space(dict[int, Any]):
    """As _Strip, but separators, punctuation and symbols become a space; invisible characters vanish."""

    def __missing__(self, cp: int) -> Any:
        c = chr(cp)
        kind = unicodedata.category(c)[0]
        if _invisible(cp) or (kind == "C" and c not in "\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85"):
            self[cp] = None
        elif c not in KEPT_SIGNS and kind in "PSZC":
            self[cp] = " "
        else:
            self[cp] = cp
        return self[cp]


def _invisible(cp: int) -> bool:
    """Letters and marks that show nothing: joiners, fillers, variation selectors."""
    return cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x2800, 0x3164, 0xFFA0) or 0xFE00 <= cp <= 0xFE0F or 0x180B <= cp <= 0x180F or 0xE0100 <= cp <= 0xE01EF


_STRIP, _SPACE = _Strip(), _Space()
#: The table by which words are split.
SPACED = _SPACE


def even(text: str) -> str:
    """One Unicode form and one letter case: NFKC, case folding, NFKC again."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", (text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text)).casefold())


def canon(text: str | None) -> str:
    """The text without case, white space, punctuation (but + and #) and invisible characters; '' for null. Accents stay."""
    if not text:
        return ""
    if text.isascii():
        return text.lower().translate(_STRIP)
    # signs go before the forms are evened: a spacing accent would otherwise become one of the letter before it
    bare = text.translate(_STRIP)
    if unicodedata.is_normalized("NFKC", bare):  # evening then only folds case, which makes no signs
        return even(bare)
    return unicodedata.normalize("NFKC", even(bare).translate(_STRIP))


def words(text: str | None) -> list[str]:
    """The words of a text in one Unicode form and case, split at white space, punctuation and symbols (but + and #)."""
    if not text:
        return []
    if text.isascii():
        return text.lower().translate(_SPACE).split()
    spaced = text.translate(_SPACE)
    if unicodedata.is_normalized("NFKC", spaced):
        return even(spaced).split()
    return even(spaced).translate(_SPACE).split()


def _combining_class() -> str:
    """A pattern of all combining characters, by Unicode's own data."""
    at = [cp for cp in range(0x300, 0x1E94B) if unicodedata.combining(chr(cp))]
    starts = [cp for cp, before in zip(at, [0, *at]) if before != cp - 1]
    ends = [cp for cp, after in zip(at, [*at[1:], 0]) if after != cp + 1]
    return "[" + "".join(f"{chr(x)}-{chr(y)}" for x, y in zip(starts, ends)) + "]+"


_COMBINING = re.compile(_combining_class())
_FOLDED: dict[str, str] = {}


def fold(text: str) -> str:
    """Without accents: base letters only, đ as d."""
    if text.isascii():
        return text
    got = _FOLDED.get(text)
    if got is None:
        got = _COMBINING.sub("", unicodedata.normalize("NFD", text.replace("đ", "d").replace("Đ", "D")))
        if len(text) < 40 and len(_FOLDED) < 200_000:
            _FOLDED[text] = got
    return got
