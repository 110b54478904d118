import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.operators.packed_values import parse, unpack

CASES = {
    "A; B;C": ["A", "B", "C"],
    "A | B、C；D": ["A", "B", "C", "D"],
    "A,B\tC\nD": ["A", "B", "C", "D"],
    "A -> B→C => D": ["A", "B", "C", "D"],
    "A / B": ["A", "B"],
    "TCP/IP; UI/UX": ["TCP/IP", "UI/UX"],
    "AT&T-kiểu mạng; Front-end": ["AT&T-kiểu mạng", "Front-end"],
    '"a; b"; «c, d»; “e | f”': ["a; b", "c, d", "e | f"],
    "'x; y'; z": ["x; y", "z"],
    '["a", "b, c"]': ["a", "b, c"],
    "[a;b]": ["a", "b"],
    "(a|b；c)": ["a", "b", "c"],
    "{a\tb}": ["a", "b"],
    "Lỗ hổng (PyTorch, cảng); B": ["Lỗ hổng (PyTorch, cảng)", "B"],
    ";a;;b; ": ["a", "b"],
    ";": [],
    "  ": [],
    "a; a": ["a", "a"],
    "C++; C#": ["C++", "C#"],
    '"a ""b"" c"; d': ['a "b" c', "d"],
    "d'accord; l'eau": ["d'accord", "l'eau"],
    "(a) b; c": ["(a) b", "c"],
    "3.5G; R&D": ["3.5G", "R&D"],
}


@pytest.mark.parametrize("text", CASES)
def test_values(text):
    assert [v for v, _ in parse(text)] == CASES[text]


def test_malformed_quotes_and_brackets_are_flagged():
    assert parse('"a; b') == [("a", "quote"), ("b", "")]
    assert parse('"a" b; c') == [('"a" b', "quote"), ("c", "")]
    assert parse("a (b; c") == [("a (b", "bracket"), ("c", "")]
    assert parse(None) == parse("") == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcđ /x", min_size=1).map(lambda s: " ".join(s.replace("/", "").split())).filter(bool), max_size=8), st.sampled_from(["; ", ";", "|", " | ", "\n", "、", " / ", " -> "]))
def test_round_trip(values, sep):
    assert [v for v, _ in parse(sep.join(values))] == values
    assert [v for v, _ in parse("[" + ", ".join(f'"{v}"' for v in values) + "]")] == values


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a\"'[](){}«»;,| \n", max_size=60))
def test_never_fails_and_never_gives_blank_values(text):
    assert all(v.strip() for v, _ in parse(text))


def test_long_fields_take_linear_time():
    assert len(parse("a; " * 200_000)) == 200_000
    assert parse("(" * 100_000 + "a")[0][1] == "bracket"
    assert parse('"' * 50_001)


def test_table(spark):
    df = spark.createDataFrame([(1, "a; b", None), (2, None, ""), (None, "c", "d"), (1, "a; b", None)], "row_id long, f string, g string").selectExpr("*", "0 as item_no", "1 as FLAG")
    got = sorted((r.row_id or 0, r.field_name, r.item_no, r.item_text) for r in unpack(df, ["f", "g"]).collect())
    assert got == [(0, "f", 1, "c"), (0, "g", 1, "d"), (1, "f", 1, "a"), (1, "f", 1, "a"), (1, "f", 2, "b"), (1, "f", 2, "b")]
    assert unpack(df.limit(0), ["f"]).count() == 0


def test_brackets_enclose_however_many_stay_open_inside():
    for n in (3, 8, 40):
        got = parse("[a; " + "( " * n + "b; c]")
        assert got[0][0] == "a" and got[-1][0] == "c" and len(got) == 3
