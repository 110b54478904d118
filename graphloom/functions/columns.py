"""Picking columns by exact name, whatever else a table carries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pick(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Only the named columns, in that order.

    An exact match wins over one that differs in case, and the first of equal names wins, so extra columns with clashing names
    (``ID`` beside ``id``, or two columns called ``id``) never make a reference ambiguous. A missing name raises ``KeyError``.
    """
    names = list(names)
    have = df.columns
    lower = [c.lower() for c in have]
    at = []
    for n in names:
        if n in have:
            at.append(have.index(n))
        elif n.lower() in lower:
            at.append(lower.index(n.lower()))
        else:
            raise KeyError(f"column {n!r} is missing; there are {have}")
    plain = df.toDF(*[f"_c{i}" for i in range(len(have))])
    return plain.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(at, names)])


def null_safe(c: Column | str) -> Column:
    """The string, or an empty one for null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
