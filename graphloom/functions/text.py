"""Column expressions for text that behave as Python's str methods do; all stay inside Catalyst."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """str.strip(): all Unicode white space at both ends."""
    return F.regexp_replace(_c(x), r"(?U)^[\s\u001c-\u001f]+|[\s\u001c-\u001f]+$", "")


def squeeze(x: Column | str) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(_c(x), r"(?U)[\s\u001c-\u001f]+", " ")


def normal_name(x: Column | str) -> Column:
    """strip, then upper case, then single spaces: the key under which names are looked up."""
    return squeeze(F.upper(strip(x)))


def has(x: Column | str) -> Column:
    """Neither null nor empty (a Python truth value)."""
    return F.coalesce(_c(x) != "", F.lit(False))


def contains_ci(x: Column | str, part: Column) -> Column:
    """lower(x) CONTAINS lower(part); null if either is null, true for an empty part."""
    return F.contains(F.lower(_c(x)), F.lower(part))


def split_list(x: Column | str, sep: str = ";") -> Column:
    """Parts of a packed list: split, strip, drop empty ones. [] for null."""
    parts = F.transform(F.split(F.coalesce(_c(x), F.lit("")), sep), lambda p: strip(p))
    return F.filter(parts, lambda p: p != "")


def same_name(a: Column, b: Column) -> Column:
    """Fuzzy name equality: stripped and lower-cased, equal or either contains the other. An empty string matches anything."""
    p, q = F.lower(strip(a)), F.lower(strip(b))
    return (p == q) | F.contains(p, q) | F.contains(q, p)


def _bare_letters() -> tuple[str, str]:
    """Small accented Latin letters and the letters below their accents, by Unicode decomposition."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xDF, 0x1F00))]
    pairs = [(c, b) for c, b in pairs if c != b and b.isascii() and b.islower()] + [("đ", "d")]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _BARE = _bare_letters()
#: Academic titles before a name, with or without a stop.
_TITLE = r"^(?:(?:pgs|gs|ths|ts)\.?\s+|(?:pgs|gs|ths|ts)\.\s*)+"


def slug(x: Column | str) -> Column:
    """A key made of a name: small letters without accents and titles, everything else as single underscores."""
    low = F.regexp_replace(strip(F.lower(_c(x))), _TITLE, "")
    plain = F.regexp_replace(F.translate(low, _ACCENTED, _BARE), r"\p{M}+", "")
    return F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def ordered_distinct(*arrays: Column) -> Column:
    """Distinct elements in the order first seen."""
    return F.array_distinct(F.concat(*arrays))


def joined(arr: Column | str, sep: str = "|") -> Column:
    return F.array_join(_c(arr), sep)
