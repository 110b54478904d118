"""Rows that fail to parse: load what is well formed, and say of the rest what is wrong.

Strict load plus anti-join. Raw records keep their offset (``raw_id``). A record is loaded only if it conforms to one strict pattern
(twelve comma-separated fields, each bare or wholly quoted); the loaded offsets are subtracted from the raw ones, and only the
remainder is diagnosed. Everything is JVM-side: the patterns use possessive quantifiers only, so they run in linear time, without
backtracking and without recursion, on records of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.columns import pick
from graphloom.session import cut

# The columns of a ground-truth file and the kinds of query.
COLUMNS = [
    "id", "query", "query_type", "ground_truth_answer", "gold_entities", "relevant_node_ids",
    "gold_path", "gold_hop_count", "expected_communities", "source_document", "annotator", "notes",
]
QUERY_TYPES = ["single_hop", "multi_hop", "global"]

#: A quoted field (inside it a quote is doubled) and a bare one (does not begin with a quote).
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_BARE = r'(?!")[^,]*+'
_FIELD = f"(?:{_QUOTED}|{_BARE})"
_NEXT = f"(?:,{_FIELD})"
#: White space as Python's str.strip sees it, and the byte-order mark.
_WS = r"[\p{Z}\s\u001c-\u001f\u0085\u200b\ufeff]"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{_WS}++|{_WS}++$", "")


def _unquote(c: Column) -> Column:
    """The text of a field: freed of its quotes, doubled quotes halved."""
    return F.when(c.startswith('"') & c.endswith('"') & (F.length(c) >= 2), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)


def _record(c: Column) -> Column:
    """A record without the one carriage return (and line feed) that may end it."""
    return F.regexp_replace(c, r"\r?\n?\z", "")


def _first(c: Column) -> Column:
    """The first field, as far as it can be read, cleaned of byte-order mark, marks of required columns and space."""
    head = _trim(_unquote(_trim(F.regexp_extract(c, rf"\A[\ufeff\s]*+({_QUOTED}|[^,]*+)", 1))))
    return F.lower(F.regexp_replace(head, r"^(?:x|v)\s++", ""))


def not_a_record(c: Column) -> Column:
    """Header, comment, example and blank lines: neither loaded nor rejected."""
    nothing = rf'(?:"{_WS}*+"|(?:{_WS}|[;|])*+)'  # a field of nothing but space and separators, or an empty quoted one
    blank = c.rlike(rf"\A{nothing}(?:,{nothing})*+\z")
    # the first field is named once, inside the lambda, so that it is read once
    mark = F.exists(F.array(_first(c)), lambda f: f.startswith("#") | f.startswith("vd") | (f == "id"))
    return c.isNull() | blank | mark


def _fields(c: Column) -> Column:
    """The fields of a record whose form is sound, in order: a comma is put before the first, so each match begins with one."""
    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), c), F.lit(f",({_FIELD})"), F.lit(1)), lambda f: _unquote(f))


def _sound_form(c: Column) -> Column:
    """No quoted field is left open and no text follows a closing quote; any number of fields."""
    return c.rlike(rf"\A{_FIELD}{_NEXT}*+\z")


def _value_fault(f: Column) -> Column:
    """The first value that is wrong in a record of twelve fields; null if none is."""
    hops = _trim(f[7])
    return (
        F.when(~F.lower(_trim(f[2])).isin(QUERY_TYPES), F.lit("query_type"))
        .when((hops != "") & ~hops.rlike(r"\A[0-9]++\z"), F.lit("gold_hop_count"))
        .when(_trim(f[3]) == "", F.lit("ground_truth_answer"))
    )


def _conforming(t: Column) -> Column:
    """[the fields] of a record that loads, else []."""
    sound = t.rlike(rf"\A{_FIELD}{_NEXT}{{{len(COLUMNS) - 1}}}+\z") & ~not_a_record(t)
    return F.filter(F.array(F.when(sound, _fields(t))), lambda x: x.isNotNull() & _value_fault(x).isNull())


def load_rows(raw: DataFrame, id_col: str = "raw_id", text_col: str = "raw_text") -> DataFrame:
    """The strict load: one row per conforming record, with its offset and the twelve columns as strings.

    ``id_col`` is kept as it is. Header, comment, example and blank lines, null texts and faulty records are not loaded. An empty
    table gives an empty result; repeated records are all loaded; extra columns of ``raw`` are ignored.
    """
    t = pick(raw, [id_col, text_col]).toDF("raw_id", "t").withColumn("t", _record(F.col("t")))
    # split once: a filter on a column would be pushed down with the splitting repeated in it
    f = t.select("raw_id", F.explode(_conforming(F.col("t"))).alias("f"))
    return f.select("raw_id", *[F.col("f")[i].alias(c) for i, c in enumerate(COLUMNS)])


def reject_rows(raw: DataFrame, id_col: str = "raw_id", text_col: str = "raw_text") -> DataFrame:
    """(raw_id, reason), one row per record that is not loaded.

    reason is the first that applies of quoting, column_count, query_type, gold_hop_count, ground_truth_answer. Lines that are no
    records (header, comment, example, blank, null text) are not rejected. A null offset can't be subtracted, so such a record is
    diagnosed like the remainder and left out if nothing is wrong with it. Of records that share an offset, which must be unique,
    none is rejected if one of them loads.

    The load is tried once; what is kept of it in the shared checkpoint folder are the offsets, and the text only of what didn't load.
    So the anti-join moves no text of a loaded record.
    """
    t = pick(raw, [id_col, text_col]).toDF("raw_id", "t").withColumn("r", _record(F.col("t")))
    tried = t.select("raw_id", "t", F.explode(F.array(F.size(_conforming(F.col("r"))) > 0)).alias("ok"))
    kept = cut(tried.select("raw_id", "ok", F.when(~F.col("ok"), F.col("t")).alias("t")))
    rest = kept.join(kept.filter("ok").select("raw_id"), "raw_id", "left_anti").filter("t is not null")
    return diagnose(rest.select("raw_id", "t"))


def diagnose(rest: DataFrame) -> DataFrame:
    """(raw_id, reason) of the records (raw_id, t) that have a fault."""
    t = rest.withColumn("t", _record(F.col("t"))).filter(~not_a_record(F.col("t")))
    split = F.when(_sound_form(F.col("t")), _fields(F.col("t")))
    reason = lambda f: F.when(f.isNull(), F.lit("quoting")).when(F.size(f) != len(COLUMNS), F.lit("column_count")).otherwise(_value_fault(f))
    return t.select("raw_id", F.explode(F.array_compact(F.transform(F.array(split), reason))).alias("reason"))
