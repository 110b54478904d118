import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from graphloom.operators.reject_rows import COLUMNS, QUERY_TYPES, load_rows, reject_rows

GOOD = "r1,q,single_hop,answer,a; b,SKILL:a,a,0,,,,"


def brute(text):
    """Fields of a record by a plain state machine, None if the quoting is broken."""
    text = text[:-1] if text.endswith("\n") else text
    text = text[:-1] if text.endswith("\r") else text
    out, i = [], 0
    while True:
        if text[i : i + 1] == '"':
            j, buf = i + 1, ""
            while True:
                k = text.find('"', j)
                if k < 0:
                    return None
                buf += text[j:k]
                if text[k + 1 : k + 2] == '"':
                    buf, j = buf + '"', k + 2
                else:
                    break
            out.append(buf)
            i = k + 1
            if i < len(text) and text[i] != ",":
                return None
        else:
            k = text.find(",", i)
            k = len(text) if k < 0 else k
            out.append(text[i:k])
            i = k
        if i >= len(text):
            return out
        i += 1


def brute_reason(text):
    f = brute(text)
    if f is None:
        return "quoting"
    if len(f) != len(COLUMNS):
        return "column_count"
    if f[2].strip().lower() not in QUERY_TYPES:
        return "query_type"
    if f[7].strip() and not (f[7].strip().isascii() and f[7].strip().isdigit()):
        return "gold_hop_count"
    return None if f[3].strip() else "ground_truth_answer"


CASES = {
    GOOD: None,
    GOOD + "\r": None,
    GOOD.replace("answer", '"a ""b"", c\nd"'): None,
    GOOD.replace("answer", 'say "hi" now'): None,
    GOOD.replace("answer", '"open'): "quoting",
    GOOD.replace("answer", '"a" b'): "quoting",
    GOOD.replace("answer", r'"a \"b\" c"'): "quoting",
    GOOD + ",": "column_count",
    "r1,q": "column_count",
    GOOD.replace("single_hop", " Single_Hop "): None,
    GOOD.replace("single_hop", "hop"): "query_type",
    GOOD.replace(",0,", ",two,"): "gold_hop_count",
    GOOD.replace(",0,", ", 12 ,"): None,
    GOOD.replace(",answer,", ",\xa0 ,"): "ground_truth_answer",
    GOOD.replace("single_hop", "hop").replace(",0,", ",x,"): "query_type",
}
NO_RECORDS = ["﻿x id,x query", "id,query,query_type", '"x id","x query"', "# a comment", '# "open', "VD: r1,a", "vd1,x", ",,,,", "", "  \t", ";;", None]


def test_reasons(spark):
    texts = [*CASES, *NO_RECORDS]
    raw = spark.createDataFrame(list(enumerate(texts)), "raw_id long, raw_text string")
    got = {r.raw_id: r.reason for r in reject_rows(raw).collect()}
    assert got == {i: CASES[t] for i, t in enumerate(texts) if t is not None and CASES.get(t)}
    loaded = {r.raw_id: r for r in load_rows(raw).collect()}
    assert set(loaded) == {i for i, t in enumerate(texts) if t in CASES and CASES[t] is None}
    assert loaded[2].ground_truth_answer == 'a "b", c\nd'


def test_odd_tables(spark):
    raw = spark.createDataFrame([(None, "x,y"), (1, GOOD), (1, GOOD), (None, GOOD), (5, '"' * 100_001)], "raw_id long, raw_text string").selectExpr("*", "1 as RAW_ID2", "'z' as reason", "'t' as t")
    assert sorted((r.raw_id or -1, r.reason) for r in reject_rows(raw).collect()) == [(-1, "column_count"), (5, "quoting")]
    assert load_rows(raw).count() == 3
    empty = raw.limit(0)
    assert reject_rows(empty).count() == load_rows(empty).count() == 0


def test_very_long_records(spark):
    long = GOOD.replace("answer", '"' + 'a""b, \n' * 200_000 + '"')
    raw = spark.createDataFrame([(1, long), (2, "x," * 300_000)], "raw_id long, raw_text string")
    assert [tuple(r) for r in reject_rows(raw).collect()] == [(2, "column_count")]
    assert len(load_rows(raw).first().ground_truth_answer) == 6 * 200_000


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='ab",\n\r 1', min_size=1, max_size=12), min_size=30, max_size=60))
def test_against_brute_force(spark, parts):
    texts = [GOOD.replace("answer", p) for p in parts] + [GOOD.replace(",0,", f",{p},") for p in parts] + [GOOD + p for p in parts]
    raw = spark.createDataFrame(list(enumerate(texts)), "raw_id long, raw_text string")
    got = {r.raw_id: r.reason for r in reject_rows(raw).collect()}
    assert got == {i: r for i, t in enumerate(texts) if (r := brute_reason(t))}


@pytest.mark.parametrize("table", ["csv_raw"])
def test_whole_table(spark, data, table):
    raw = spark.read.parquet(f"{data}/{table}.parquet")
    assert load_rows(raw).count() + reject_rows(raw).count() <= raw.count()
