"""Best representative of each duplicate group.

Two ways to choose the surviving value of a field:

* ``survivors`` takes each field from the most trusted, then latest record (the rule the p4_found query has to follow);
* ``consensus`` votes: the values of a group are aligned token by token (progressive alignment), each column of the alignment
  elects its heaviest token, and the existing value closest to the elected sequence survives.

Trust and recency can't be told from text, so the vote can't give the first result; both are offered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.canon import canon, words
from graphloom.functions.columns import pick
from graphloom.session import cut

# Fillers that say nothing, canonically written (no case, space or punctuation).
FILLERS = ["tbd", "tba", "đangcậpnhật", "chưacậpnhật", "cậpnhậtsau", "chưacó", "chưacómã", "khôngcó", "khôngrõ", "chưarõ", "trống", "na", "nil", "null", "none", "nan", "unknown", "undefined", "empty", "blank", "missing", "notavailable", "notapplicable"]

_CANON_FIELDS = "rid long, code string, name_vi string, name_en string, source string, at timestamp, code_raw string, vi_ok boolean, en_ok boolean"


def _keys(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Canonical code and name of each record, and which of its names are usable."""
    fillers = frozenset(FILLERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            code = [canon(x) for x in c["code"].to_pylist()]
            vi = [canon(x) for x in c["vi"].to_pylist()]
            en = [canon(x) for x in c["en"].to_pylist()]
            real = [x if len(x) == 7 and x.isascii() and x.isdigit() else None for x in code]
            arrays = [c["rid"], pa.array(real, pa.string()), pa.array(["" if x in fillers else x for x in vi], pa.string()), pa.array(en, pa.string()), c["source"], c["at"], c["code"], pa.array([bool(x) and x not in fillers for x in vi]), pa.array([bool(x) and x not in fillers for x in en])]
            yield pa.RecordBatch.from_arrays(arrays, names=["rid", "code", "name_vi", "name_en", "source", "at", "code_raw", "vi_ok", "en_ok"])

    t = pick(df, list(cols.values())).toDF(*cols.keys())
    t = t.select(F.col("rid").cast("long"), "code", "vi", "en", "source", F.col("at").cast("timestamp"))
    return t.mapInArrow(run, _CANON_FIELDS)


def group_majors(majors: DataFrame) -> DataFrame:
    """Each record with its group: (rid, grp, ...).

    Records whose codes are equal apart from formatting (seven digits) share a group. A record without a real code joins the major
    whose name equals its own; of several majors with that name, the smallest code. Records whose name no coded record bears are
    grouped by name; without a name too, each is alone.
    """
    k = _keys(majors, {"rid": "record_id", "code": "major_code", "vi": "major_name_vi", "en": "major_name_en", "source": "source_name", "at": "extracted_at"})
    coded = k.filter(F.col("code").isNotNull())
    names = coded.filter("vi_ok").groupBy("name_vi").agg(F.min("code").alias("by_name"))
    free = k.filter(F.col("code").isNull()).join(names, "name_vi", "left")
    alone = F.concat(F.lit("r"), F.coalesce(F.col("rid"), F.monotonically_increasing_id()).cast("string"))
    own = F.coalesce(F.concat(F.lit("c"), "by_name"), F.when(F.col("vi_ok"), F.concat(F.lit("n"), "name_vi")), alone)
    return coded.withColumn("grp", F.concat(F.lit("c"), "code")).unionByName(free.withColumn("grp", own).drop("by_name"))


def survivors(majors: DataFrame, trust: DataFrame) -> DataFrame:
    """(group_id, code_from, name_vi_from, name_en_from), one row per group of at least two records; not the consensus, see the module's text.

    Of the records with a usable value the one of best trust_rank (unlisted and null sources last, alike), then latest extracted_at
    (null last), then smallest record_id supplies a field; 0 if none has one. One hash aggregation with partial sums before the
    shuffle, so the size of a group doesn't matter. ``trust`` is a fixed small table; it is joined by Spark's own choice, which
    broadcasts it only under autoBroadcastJoinThreshold. Repeated sources in it count with their best rank. Empty tables give no rows.
    """
    ranks = pick(trust, ["source_name", "trust_rank"]).toDF("source", "rank").filter(F.col("source").isNotNull()).groupBy("source").agg(F.min("rank").alias("rank"))
    g = group_majors(majors).select("rid", "grp", "source", "at", "code_raw", "vi_ok", "en_ok").join(ranks, "source", "left")
    last = F.lit(2**62)
    order = F.struct(F.coalesce(F.col("rank").cast("long"), last).alias("a"), F.coalesce(-F.unix_micros("at"), last).alias("b"), F.col("rid").alias("c"))

    def best(ok: Column) -> Column:
        return F.coalesce(F.min(F.when(ok, order))["c"], F.lit(0).cast("long"))

    code_ok = F.col("code_raw").rlike(r"\A[0-9]{7}\z")
    agg = g.groupBy("grp").agg(F.min("rid").alias("group_id"), F.count(F.lit(1)).alias("n"), best(code_ok).alias("code_from"), best(F.col("vi_ok")).alias("name_vi_from"), best(F.col("en_ok")).alias("name_en_from"))
    return agg.filter("n >= 2").select("group_id", "code_from", "name_vi_from", "name_en_from")


# --- consensus by progressive alignment ---------------------------------------------------------------------------------------

#: Token sequences aligned at a time; larger groups are aligned in several blocks whose profiles are aligned in turn.
BLOCK = 64
#: Profiles aligned at a time, level by level, until a group has one.
FAN = 16
GAP = ""

Profile = list[dict[str, float]]


def _shares(p: Profile) -> list[dict[str, float]]:
    """Each column's tokens with their share of the column's weight; gaps agree with nothing."""
    return [{t: w / total for t, w in c.items() if t != GAP} if (total := sum(c.values())) else {} for c in p]


def _agreement(a: list[dict[str, float]], b: list[dict[str, float]]) -> list[list[float]]:
    """How well each two columns agree: the share of weight on common tokens."""
    single = [next(iter(c)) if len(c) == 1 and next(iter(c.values())) == 1.0 else None for c in b]
    return [[x.get(t, 0.0) if t is not None else sum(min(w, y[k]) for k, w in x.items() if k in y) for t, y in zip(single, b)] for x in a]


def align(p: Profile, q: Profile) -> Profile:
    """Needleman-Wunsch over two profiles: agreeing columns are merged, the others take a gap of the other side's weight."""
    if not p or not q:
        return p or q
    n, m, gap = len(p), len(q), -0.5
    agree = _agreement(_shares(p), _shares(q))
    best = [gap * j for j in range(m + 1)]
    back = [[2] * (m + 1)]
    for i in range(1, n + 1):
        row, step, own = [gap * i], [1], agree[i - 1]
        for j in range(1, m + 1):
            both, up, left = best[j - 1] + (2 * own[j - 1] - 0.9), best[j] + gap, row[j - 1] + gap
            k = 0 if both >= up and both >= left else 1 if up >= left else 2
            row.append((both, up, left)[k])
            step.append(k)
        best = row
        back.append(step)
    wp, wq = sum(p[0].values()), sum(q[0].values())
    out: Profile = []
    i, j = n, m
    while i or j:
        k = back[i][j] if i and j else (1 if i else 2)
        a = p[i - 1] if k in (0, 1) else {GAP: wp}
        b = q[j - 1] if k in (0, 2) else {GAP: wq}
        column = dict(a)
        for t, w in b.items():
            column[t] = column.get(t, 0.0) + w
        out.append(column)
        i -= k in (0, 1)
        j -= k in (0, 2)
    return out[::-1]


def elect(p: Profile) -> list[str]:
    """The heaviest token of each column (ties: the smaller token); columns where the gap wins say nothing."""
    tokens = [min(c, key=lambda t: (-c[t], t)) for c in p]
    return [t for t in tokens if t != GAP]


def distance(a: list[str], b: list[str]) -> int:
    """Edit distance over tokens."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def _profile(values: list[tuple[str, float]]) -> Profile:
    """Progressive alignment of token sequences (joined by spaces), heaviest first, so the common wording is the guide for the rare ones."""
    p: Profile = []
    for tokens, w in sorted(values, key=lambda v: (-v[1], v[0])):
        p = align(p, [{t: w} for t in tokens.split(" ") if t])
    return p


_PROFILE = "array<map<string,double>>"


def consensus(values: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(grp, field, value, votes): of each group and field the existing value closest to the consensus of its tokens.

    ``values`` has (grp, field, value, weight), one row per record and field; null, blank and punctuation-only values don't vote.
    Equal values, and then values of equal tokens, are summed before they are aligned, so a group of a million copies is a few distinct
    sequences. These are dealt into blocks of about ``block``; each is aligned by itself, and the profiles of a group's blocks (a few
    columns each) are aligned ``fan`` at a time, level by level, until one is left. Blocks, not groups, are spread over the cores. Ties go to the
    heavier value, then to the smaller text. Groups without a usable value give no row.
    """
    @F.pandas_udf("string")
    def tokens_of(text: pd.Series) -> pd.Series:
        return text.map(lambda t: " ".join(words(t)))

    summed = values.filter(F.col("value").isNotNull() & F.col("value").rlike(r"[\p{L}\p{N}]")).groupBy("grp", "field", "value").agg(F.sum("weight").alias("w"))
    v = cut(summed.withColumn("tokens", tokens_of("value")))
    sequences = cut(v.groupBy("grp", "field", "tokens").agg(F.sum("w").alias("w")))
    sizes = sequences.groupBy("grp", "field").agg(F.count(F.lit(1)).alias("n"))
    dealt = sequences.join(sizes, ["grp", "field"]).withColumn("block", F.pmod(F.xxhash64("tokens"), F.ceil(F.col("n") / block).cast("long"))).drop("n")
    # few bytes, but much work: the number of partitions is given, so that they aren't put together
    spread = lambda df: df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "grp", "field", "block")

    def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = _profile(list(zip(pdf["tokens"], pdf["w"])))
        return pd.DataFrame({"grp": [key[0]], "field": [key[1]], "block": [key[2]], "profile": [p]})

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [[dict(c) for c in p] for _, p in sorted(zip(pdf["part"], pdf["profile"]))]
        p = parts[0]
        for q in parts[1:]:
            p = align(p, q)
        return pd.DataFrame({"grp": [key[0]], "field": [key[1]], "block": [key[2]], "profile": [p]})

    @F.pandas_udf("array<string>")
    def elected_of(profiles: pd.Series) -> pd.Series:
        return pd.Series([elect([dict(c) for c in p]) for p in profiles])

    shape = f"grp string, field string, block long, profile {_PROFILE}"
    profiles = spread(dealt).groupBy("grp", "field", "block").applyInPandas(first, shape)
    blocks = -(-(sizes.agg(F.max("n").alias("m")).first().m or 0) // block)
    while blocks > 1:
        up = profiles.withColumn("part", F.col("block")).withColumn("block", F.floor(F.col("block") / fan))
        profiles = spread(up).groupBy("grp", "field", "block").applyInPandas(merge, shape)
        blocks = -(-blocks // fan)
    elected = profiles.select("grp", "field", elected_of("profile").alias("elected"))

    @F.pandas_udf("int")
    def away(text: pd.Series, target: pd.Series) -> pd.Series:
        return pd.Series([distance(t.split(" ") if t else [], list(e)) for t, e in zip(text, target)])

    scored = v.join(elected, ["grp", "field"]).withColumn("d", away("tokens", "elected"))
    pickd = F.min(F.struct("d", (-F.col("w")).alias("w"), "value"))
    return scored.groupBy("grp", "field").agg(pickd.alias("b"), F.sum("w").alias("votes")).select("grp", "field", F.col("b.value").alias("value"), "votes")


def major_consensus(majors: DataFrame) -> DataFrame:
    """(group_id, field, value, votes) over the groups of at least two major records, by vote; one vote per record."""
    g = group_majors(majors).select("rid", "grp")
    ids = g.groupBy("grp").agg(F.min("rid").alias("group_id"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    m = pick(majors, ["record_id", "major_code", "major_name_vi", "major_name_en"]).withColumn("record_id", F.col("record_id").cast("long"))
    wide = g.join(ids.select("grp"), "grp", "left_semi").join(m, g.rid == m.record_id).select("grp", "major_code", "major_name_vi", "major_name_en")
    long = wide.select("grp", F.expr("stack(3, 'major_code', major_code, 'major_name_vi', major_name_vi, 'major_name_en', major_name_en) as (field, value)"))
    return consensus(long.withColumn("weight", F.lit(1.0))).join(ids.select("grp", "group_id"), "grp").select("group_id", "field", "value", "votes")
