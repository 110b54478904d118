import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.functions.canon import canon, fold, words
from graphloom.functions.columns import pick


def test_canon_takes_formatting_away_and_keeps_accents_and_signs():
    same = ["Bảo vệ C++", "BẢO_VỆ  (C++)", "﻿bảo​ vệ – c++.", "Bảo vệ c++", "▪ Bảo-vệ ＣC++"[0:8] + " C++"]
    assert len({canon(x) for x in same}) == 1
    assert canon("Bao ve C++") != canon("Bảo vệ C++") != canon("Bảo vệ C#")
    assert canon(None) == canon("  ") == canon("...") == canon("“—”") == ""


def test_words_and_fold():
    assert words("Front-end, C# và «Data»") == ["front", "end", "c#", "và", "data"]
    assert fold("đường Đỗ ệ") == "duong Do e"


def test_pick_prefers_the_exact_name_and_survives_clashes(spark):
    df = spark.createDataFrame([(1, 2, 3)], "ID int, id int, x int")
    assert pick(df, ["id"]).collect()[0].id == 2
    twice = df.select(F.col("x").alias("k"), (F.col("x") + 1).alias("k"))
    assert pick(twice, ["k"]).collect()[0].k == 3
    with pytest.raises(KeyError):
        pick(df, ["none"])


def test_text_columns_follow_python(spark):
    df = spark.createDataFrame([("  a\xa0b \n",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(text.strip("s")).collect()] == ["a\xa0b", None, ""]
    assert [r[0] for r in df.select(text.normal_name("s")).collect()] == ["A B", None, ""]
    assert [r[0] for r in spark.sql("select 'a; b ;;c' s union all select null").select(text.split_list("s")).collect()] == [["a", "b", "c"], []]


def test_fuzzy_names_empty_matches_anything(spark):
    df = spark.createDataFrame([("Abc", "ab"), ("x", ""), ("x", "y")], "a string, b string")
    assert [r[0] for r in df.select(text.same_name(F.col("a"), F.col("b"))).collect()] == [True, True, False]


def test_rows_helper(spark):
    assert rows(spark.range(2)) == [(0,), (1,)]


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=30) | st.text(alphabet="aÀđĐ İẞǰﬁ…½①．，！\u0301\u0307\u200b\ufeffﾞ゛´¨+#_-", max_size=12))
def test_canonical_text_by_its_definition(text):
    import unicodedata

    from graphloom.functions import canon as C

    nfkc = lambda t: unicodedata.normalize("NFKC", t)
    even = lambda t: nfkc(nfkc(t).casefold())
    assert C.even(text) == even(text)
    assert C.canon(text) == nfkc(even(text.translate(C._STRIP)).translate(C._STRIP))
    assert C.fold(text) == (text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text.replace("đ", "d").replace("Đ", "D")) if not unicodedata.combining(c)))
    assert C.words(text) == even(text.translate(C._SPACE)).translate(C._SPACE).split()
