import random

from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.functions.canon import canon
from graphloom.llm import exact_copies as X
from graphloom.llm import survivors as S

SKILL = "record_id long, skill_key string, skill_name string, skill_type string"


def test_copies_differ_in_formatting_only(spark):
    df = spark.createDataFrame(
        [(5, "a_b", "Bảo vệ C++", "hard"), (3, "A-B", "BẢO_VỆ  (c++)", "Hard "), (4, "a b", "Bảo vệ C#", "hard"), (1, "a b", "Bao ve C++", "hard"), (9, None, " ", "..."), (8, "", None, "﻿"), (7, "x", "ö", None), (6, "x", "ö", "")],
        SKILL,
    )
    got = rows(X.collapse_tables([(df, "SKILL", ["skill_key", "skill_name", "skill_type"])]))
    assert got == [("SKILL", 1, 1), ("SKILL", 3, 2), ("SKILL", 4, 1), ("SKILL", 6, 2), ("SKILL", 8, 2)]
    assert rows(X.collapse_tables([(df, "SKILL", ["skill_key", "skill_name", "skill_type"])], min_copies=2)) == [("SKILL", 3, 2), ("SKILL", 6, 2), ("SKILL", 8, 2)]


def test_field_borders_count(spark):
    df = spark.createDataFrame([(1, "ab", "c", ""), (2, "a", "bc", "")], SKILL)
    assert len(rows(X.collapse_tables([(df, "S", ["skill_key", "skill_name"])]))) == 2


def test_hot_group_over_many_partitions_is_one_row(spark):
    rng = random.Random(1)
    data = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(50)}", None, None) for i in range(1, 3001)]
    df = spark.createDataFrame(data, SKILL).repartition(12)
    got = {r[1]: r[2] for r in rows(X.collapse_tables([(df, "S", ["skill_key"])]))}
    want = {}
    for i, k, *_ in data:
        low, n = want.get(k, (i, 0))
        want[k] = (min(low, i), n + 1)
    assert got == dict(want.values())


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a", None, None), (2, "A", None, None), (2, "a", None, None)], SKILL).selectExpr("*", "1 as key", "2 as N", "3 as RID", "'x' as Skill_Key2")
    assert rows(X.collapse_tables([(df, "S", ["skill_key"])])) == [("S", 2, 3)]
    assert rows(X.collapse_tables([(df.limit(0), "S", ["skill_key"])])) == []
    long = spark.createDataFrame([(1, "a " * 300_000, None, None), (2, "A." * 300_000, None, None)], SKILL)
    assert rows(X.collapse_tables([(long, "S", ["skill_key"])])) == [("S", 1, 2)]


MAJOR = "record_id long, major_code string, major_name_vi string, major_name_en string, source_name string, extracted_at timestamp"
TRUST = [("best", 1), ("good", 2)]


def majors(spark, data):
    from datetime import datetime

    return spark.createDataFrame([(i, c, v, e, s, datetime(2025, 1, d) if d else None) for i, c, v, e, s, d in data], MAJOR)


def test_survivors_by_trust_then_date_then_id(spark):
    m = majors(
        spark,
        [
            (10, "7480201", "N/A", "Law", "good", 5), (11, "748.0201", "Luật", None, "best", 1), (12, " 7480201", "Luật", "law", "best", 3), (13, "7480201", "LUẬT!", "law", None, None), (14, "7480201", "Luật", "-", "odd", 9), (15, "7480201", "Luật", "LAW", "odd", 9),
            (20, None, "luật", None, "best", 9), (21, "chưa có mã", "“Luật”", "", "good", 1), (30, "7000001", "Riêng", "Own", "best", 1), (40, None, None, None, None, None), (41, None, "?", None, None, None), (50, "x", "Mới", None, "best", 2), (51, None, "mới ", None, None, 3),
        ],
    )
    t = spark.createDataFrame([*TRUST, ("best", 5), (None, 0)], "source_name string, trust_rank int")
    assert rows(S.survivors(m, t)) == [(10, 10, 20, 12), (50, 0, 50, 0)]
    assert rows(S.survivors(m.limit(0), t)) == [] and S.survivors(m, t.limit(0)).count() == 2


def test_consensus_votes_token_by_token(spark):
    v = spark.createDataFrame(
        [("g", "n", "Luật kinh tế", 1.0), ("g", "n", "Luật kinh tế", 1.0), ("g", "n", "Luật kinh té", 1.0), ("g", "n", "Luật học kinh tế", 1.0), ("g", "n", None, 9.0), ("g", "n", "--", 9.0), ("h", "n", "x", 1.0), ("e", "n", None, 1.0)],
        "grp string, field string, value string, weight double",
    )
    assert rows(S.consensus(v)) == [("g", "n", "Luật kinh tế", 4.0), ("h", "n", "x", 1.0)]
    assert rows(S.consensus(v, block=1)) == rows(S.consensus(v, block=1, fan=2)) == rows(S.consensus(v))  # groups in several blocks, several levels
    assert S.consensus(v.limit(0)).count() == 0


def test_consensus_over_majors(spark):
    m = majors(spark, [(1, "7480201", "Luật học", None, None, 1), (2, "7480201", "Luật hoc", "Law", None, 1), (3, "7480201", "Luật học", "Law", None, 1)])
    got = {(r.field, r.value) for r in S.major_consensus(m).collect()}
    assert got == {("major_code", "7480201"), ("major_name_vi", "Luật học"), ("major_name_en", "Law")}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=5), min_size=1, max_size=4))
def test_alignment_keeps_all_weight(values):
    p = []
    kept = [v for v in values if v]
    for v in kept:
        p = S.align(p, [{t: 1.0} for t in v])
    assert all(abs(sum(c.values()) - len(kept)) < 1e-9 for c in p)
    assert sum(w for c in p for t, w in c.items() if t) == sum(map(len, kept))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40))
def test_canon_is_stable(text):
    assert canon(canon(text)) == canon(text)


def test_survivor_groups_against_brute_force(spark, data):
    m = spark.read.parquet(f"{data}/major.parquet")
    t = spark.read.parquet(f"{data}/source_trust.parquet")
    rank = {r.source_name: r.trust_rank for r in t.collect()}
    recs = m.collect()
    code = lambda r: canon(r.major_code) if len(canon(r.major_code)) == 7 and canon(r.major_code).isdigit() else None
    usable = lambda x: bool(canon(x)) and canon(x) not in S.FILLERS
    by_name = {}
    for r in recs:
        if code(r) and usable(r.major_name_vi):
            by_name[canon(r.major_name_vi)] = min(code(r), by_name.get(canon(r.major_name_vi), "9" * 8))
    groups = {}
    for r in recs:
        groups.setdefault(code(r) or by_name.get(canon(r.major_name_vi)) or r.record_id, []).append(r)
    order = lambda r: (rank.get(r.source_name, 10**9), -(r.extracted_at.timestamp() if r.extracted_at else -1e18), r.record_id)
    best = lambda rs: min(rs, key=order).record_id if rs else 0
    import re

    want = sorted(
        (min(r.record_id for r in g), best([r for r in g if re.fullmatch(r"[0-9]{7}", r.major_code or "")]), best([r for r in g if usable(r.major_name_vi)]), best([r for r in g if usable(r.major_name_en)]))
        for g in groups.values() if len(g) > 1
    )
    assert sorted(map(tuple, S.survivors(m, t).collect())) == want
