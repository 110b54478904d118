from collections import defaultdict
from itertools import combinations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from graphloom.llm import name_variants as V
from graphloom.llm.components import connected_components
from graphloom.llm.name_forms import code, jaro_winkler, osa, person_tokens, skill_tokens, untyped

PEOPLE = {
    "N.T.Đ. Thạo": "~n ~t ~d thao", "NTĐ Thạo": "~n ~t ~d thao", "ChửPhương Quế": "chu phuong que", "Cô Mai Quỳnh Thông": "mai quynh thong", "ThS. Lê Văn An (TS)": "le van an", "Ddawngj Kieens": "dang kien", "Nghie6m Ye6n1": "nghiem yen",
    "Ben I. Rubygatecki": "benjamin ~i rubygatecki", "Sương, Mai Thông": "suong mai thong", "TRỊNH CÔNG HÀ": "trinh cong ha", "": "", None: "", "(GV)": "",
}


@pytest.mark.parametrize("name", PEOPLE)
def test_person_tokens(name):
    assert " ".join(person_tokens(name)) == PEOPLE[name]


def test_skill_tokens():
    tools = frozenset(["c", "c++", "c#", "excel", "kubernetes"])
    cases = {
        "B.vệ cơ sở với Excel": ("~b ve co so", "excel"), "kỹ năng xây dựng dân dụng (C sharp)": ("xay dung dan dung", "c#"), "Excel - Bảo vệ cơ sở": ("bao ve co so", "excel"), "C.hóa dữ liệu lớn": ("~c hoa du lieu lon", ""),
        "Bảo vệ CSDL bằng K8s": ("bao ve co so du lieu", "kubernetes"), "Bảo vệ cơ sở": ("bao ve co so", ""), "BA3O VE6 so61 bag C++": ("bao ve so", "c++"),
    }
    for text, want in cases.items():
        tokens, tool = skill_tokens(text, tools, {"csdl": "co so du lieu"})
        assert (" ".join(tokens), tool) == want
    assert skill_tokens(None, tools, {}) == ([], "")


def test_distances():
    assert osa("kohng", "khong") == 1 and osa("abc", "abc") == 0 and osa("a", "abcd") == 3
    assert jaro_winkler("khong", "kohng") > 0.9 and jaro_winkler("ab", "xy") == 0 and jaro_winkler("", "a") == 0
    assert code("kohng") == code("khong") and code("lan") != code("minh") and untyped("docker") == "docker"


TEACHER = "record_id long, name string, teacher_key string, email string, title string"


def classes(df, col):
    out = defaultdict(set)
    for r in df.collect():
        out[r[col]].add(r.record_id)
    return sorted(map(sorted, out.values()))


def test_people(spark):
    t = spark.createDataFrame(
        [
            (1, "Hồ Như Quế Tuyền Pha", None, None, None), (2, "Hồ Nhuw Quế Tuyền Pha", None, " PHA@x ", None), (3, "Pha, Hồ Như Quế Tuyền", None, None, ""), (4, "Hồ Nhu Quế Tuyuền Pha", None, "pha@x", None), (5, "Hồ Như Pha", "", None, None),
            (6, "Lê An Bình", None, "a@x", "TS"), (7, "Lê An Bình", None, "b@x", "ThS"), (8, "Le An Binh", None, None, "ThS"), (9, None, None, None, None), (10, " ", "", None, None), (11, "X. Pha", "ho_nhu_que_tuyen_pha", None, None),
            (12, "Benjamin Ivor Rubygatecki", None, None, None), (13, "B.I. Rubygatecki", None, None, None), (14, "Ben Rubygatekci", None, None, None),
        ],
        TEACHER,
    )
    assert classes(V.link_people(t), "person") == [[1, 2, 3, 4, 5, 11], [6], [7, 8], [9], [10], [12, 13, 14]]
    assert V.link_people(t.limit(0)).count() == 0
    assert V.link_people(t.selectExpr("*", "1 as person", "2 as NAME2", "3 as cluster")).count() == 14


def test_people_with_different_middle_names_stay_apart(spark):
    middle = ["Văn", "Thị", "Hồng", "Minh", "Quang"]
    t = spark.createDataFrame([(i * 10 + j, f"Lê {a} {b} An", None, None, None) for i, a in enumerate(middle) for j, b in enumerate(middle) if i <= j], TEACHER)
    assert len(classes(V.link_people(t), "person")) == 15  # reordered parts are one name, so each two are taken once


def test_skills(spark):
    names = ["Bảo vệ địa chất thủy văn khai khoáng bằng Rust", "bảo vệ ĐỊA chất thủy văn khai khoáng bằng rust", "Bảo vệ ĐCTV khai khoáng dùng Rust", "Rust - Bảo vệ địa chất thủy văn khai khoáng", "B.vệ địa chất thủy văn khai khoáng với Rust", "Bao ve dia chat thuy vna khai khoang bang Rust", "khai khoáng - Bảo vệ địa chất thủy văn qua Rust"]
    other = ["Bảo vệ địa chất thủy văn khai khoáng", "Bảo vệ địa chất thủy văn khai khoáng bằng C", "Bảo vệ địa chất thủy văn khai khoáng bằng C#", "Bảo vệ địa chất thủy văn nhà trẻ bằng Rust", "Kiểm thử địa chất thủy văn khai khoáng bằng Rust", None, None]
    more = [f"{v} dữ liệu lớn {x} bằng {t}" for v in ("Kiểm thử", "Kiểm toán", "Bảo vệ") for x in ("nhà trẻ", "khai khoáng") for t in ("Rust", "C", "C#")]
    data = list(enumerate([*names, *other, *more]))
    k = spark.createDataFrame(data, "record_id long, skill_name string")
    alias = spark.createDataFrame([("x", None, "tool"), (None, "y", "tool")], "alias string, full_form string, kind string")
    got = classes(V.link_skills(k, alias), "skill")
    assert list(range(7)) in got and len(got) == 1 + len(other) + len(more)
    pairs = V.pairs_of(V.link_skills(k, alias), "skill", "written")
    assert (0, 1) not in rows(pairs) and len(rows(pairs)) == 7 * 6 // 2 - 1
    assert V.link_skills(k.limit(0), alias).count() == 0


def test_components_against_union_find(spark):
    import random

    rng = random.Random(5)
    edges = [(f"n{a:03}", f"n{b:03}") for a, b in ((rng.randrange(200), rng.randrange(200)) for _ in range(130))] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    names = sorted({x for e in edges for x in e} | {"alone"})
    parent = {x: x for x in names}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    got = connected_components(spark.createDataFrame([(x,) for x in names], "form string"), spark.createDataFrame(edges, "a string, b string"))
    assert {r.form: r.cluster for r in got.collect()} == {x: find(x) for x in names}


def test_emails_are_never_joined(spark, data):
    t = spark.read.parquet(f"{data}/teacher.parquet")
    mail = {r.record_id: "".join(r.email.split()).lower() for r in t.collect() if r.email and r.email.strip()}
    person = {r.record_id: r.person for r in V.link_people(t).collect()}
    assert len(person) == t.count()
    for a, b in combinations(mail, 2):
        assert (person[a] == person[b]) == (mail[a] == mail[b])


def test_copies_of_a_misspelt_record_dont_undo_its_link(spark):
    usual = [(i, "Lê Quốc Lan Phương", "le_quoc_lan_phuong", None, None) for i in range(8)]
    more = [(20 + 10 * i + j, f"{a} {b} {c}", None, None, None) for i, b in enumerate(("Lan", "Lam")) for j, (a, c) in enumerate((("Trần", "Kiên"), ("Hồ", "Quế"), ("Mai", "Thông")))]
    slip = [(100, "Lê Quốc Lam Phương", "le_quoc_lam_phuong", None, None)]
    again = [(101 + i, *slip[0][1:]) for i in range(3)]
    for extra in ([], again):
        got = classes(V.link_people(spark.createDataFrame(usual + more + slip + extra, TEACHER)), "person")
        assert [*range(8), 100, *(r[0] for r in extra)] in got and len(got) == 7
    names = ["Bảo vệ cơ sở dữ liệu lan", "BAO VE co so du lieu lan", "Bảo vệ co sở dữ liệu lan", "Bảo ve cơ sở dữ liệu lan", "Bao vệ cơ sở dữ liệu lan"] * 2
    rest = [f"{v} nhà trẻ {w}" for w in ("lan", "lam") for v in ("Kiểm thử", "Biên soạn", "Quản trị", "Đàm phán")]
    alias = spark.createDataFrame([], "alias string, full_form string, kind string")
    for n in (1, 6):
        k = spark.createDataFrame(list(enumerate(names + rest + ["Bảo vệ cơ sở dữ liệu lam"] * n)), "record_id long, skill_name string")
        skill = {r.record_id: r.skill for r in V.link_skills(k, alias).collect()}
        assert all(skill[0] == skill[len(names + rest) + i] for i in range(n))


def test_pairs_are_decided_by_jaro_winkler():
    known = {"bao", "ve", "du", "lieu", "lon", "kiem", "thu", "toan"}
    judge = lambda a, b, na=1, nb=9, persons=False: V.alike(a.split(), [t in known for t in a.split()], na, b.split(), [t in known for t in b.split()], nb, persons)
    assert judge("bao ve du lieu lno", "bao ve du lieu lon") and judge("bao ve dl lon", "bao ve du lieu lon") and judge("~b ve du lieu lon", "bao ve du lieu lon")
    assert jaro_winkler("xyz", "lon") < V.LEAST_JW and not judge("bao ve du lieu xyz", "bao ve du lieu lon")
    assert not judge("kiem thu du lieu lon", "kiem toan du lieu lon")  # both well known
    for a, b in combinations(["bao ve du lieu lno", "bao ve du lieu lon", "kiem thu du lieu lon", "bao vee du lieu lon"], 2):
        assert judge(a, b, 2, 2) == judge(b, a, 2, 2)


def test_keys_of_long_forms_follow_the_same_rule():
    for n in (5, 8, 15, 40):
        name = [f"t{chr(97 + i % 26)}{'bcdghk'[i % 6]}" for i in range(n)]
        slip = [*name[:2], name[2] + "x", *name[3:]]
        for persons in (True, False):
            assert set(V.keys_of(name, persons)) & set(V.keys_of(slip, persons))
            assert len(V.keys_of(name, persons)) <= 8 * n + n * n  # of words that may all be acronyms
        assert set(V.short_keys_of(name)) >= set(V.short_lookups_of(name[:-1])) and set(V.short_keys_of(name)) >= set(V.short_lookups_of(name[:3]))
        assert set(V.short_keys_of(name)) >= set(V.short_lookups_of([*(f"~{t[0]}" for t in name[:-1]), name[-1]]))


def test_names_that_share_common_parts_make_no_block():
    first, middle = ["nguyen", "tran"], ["van", "thi"]
    ends = [a + b + c for a in ("b", "ch", "d", "h", "kh", "l", "m", "ng", "ph", "q", "s", "t", "v", "x") for b in ("a", "e", "i", "o", "u") for c in ("", "c", "m", "n", "ng", "t")]
    names = [f"{f} {m} {e}" for f in first for m in middle for e in ends]
    blocks = defaultdict(int)
    for n in names:
        for k in V.keys_of(n.split(), True):
            blocks[k] += 1
    assert len(names) == 1680 and max(blocks.values()) <= 30  # 420 names share their first two parts


def test_aliases_beyond_the_bound_are_refused_and_within_it_all_count(spark, monkeypatch):
    k = spark.createDataFrame([(1, "Bảo vệ cơ sở bằng Rust"), (2, "Bảo vệ cơ sở bằng Zz9")], "record_id long, skill_name string")
    alias = spark.createDataFrame([(f"zz{i}", "Rust" if i == 9 else f"Tool{i}", "tool") for i in range(12)], "alias string, full_form string, kind string")
    monkeypatch.setattr(V, "MOST_ALIASES", 12)
    assert V.link_skills(k, alias).count() == 2
    monkeypatch.setattr(V, "MOST_ALIASES", 11)
    with pytest.raises(ValueError):
        V.link_skills(k, alias)


def test_components_that_are_not_done_raise(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    nodes = spark.range(301).toDF("form")
    with pytest.raises(RuntimeError):
        connected_components(nodes, edges, most_rounds=2)
    assert connected_components(nodes, edges).filter("cluster <> 0").count() == 0


def test_classes_of_skills(spark, data):
    from graphloom.llm import queries as Q

    got = Q.p2_skills(spark, data)
    assert got.columns == ["record_id", "class_id", "records", "spellings"] and got.count() == spark.read.parquet(f"{data}/skill.parquet").count()
    assert got.filter("class_id > record_id or records < spellings").count() == 0


def slipped(name, rng):
    """A name as a careless hand types it: one slip in a word, perhaps without accents, in other case, or with its halves swapped."""
    from graphloom.functions.canon import fold

    ws = name.split()
    i = rng.choice([k for k, w in enumerate(ws) if len(w) > 1 and w.isalpha()])
    w, j = ws[i], rng.randrange(len(ws[i]) - 1)
    ws[i] = rng.choice([w[:j] + w[j + 1] + w[j] + w[j + 2 :], w[:j] + w[j + 1 :], w[: j + 1] + w[j:], w[: j + 1] + rng.choice("abcdghiklmnoprstuvxy") + w[j + 2 :]])
    out = " ".join(ws)
    return rng.choice([out, fold(out), out.upper(), out.lower().replace(" ", "_")])


def test_recall_of_planted_slips_of_skills_and_of_persons_without_emails(spark):
    import random

    d = "/root/testdata/sf0.01"
    rng = random.Random(11)
    skills = spark.read.parquet(f"{d}/skill.parquet").select("record_id", "skill_name")
    alias = spark.read.parquet(f"{d}/alias_ref.parquet")
    usual = {r.skill: (r.skill_name, r.record_id) for r in V.link_skills(skills, alias).join(skills, "record_id").groupBy("skill", "skill_name").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("record_id")).orderBy("n", "record_id").collect()}
    names = sorted((n, i) for n, i in usual.values() if n and len(n.split()) >= 6 and n.isprintable() and any(c in n for c in "ệấộểơư"))
    planted = [(10**6 + k, slipped(n, rng), i) for k, (n, i) in enumerate(names)]
    both = skills.union(spark.createDataFrame([p[:2] for p in planted], "record_id long, skill_name string"))
    got = {r.record_id: r.skill for r in V.link_skills(both, alias).collect()}
    recall = sum(got[k] == got[i] for k, _, i in planted) / len(planted)
    wrong = sum(got[k] != got[i] and any(got[k] == got[j] for _, _, j in planted if j != i) for k, _, i in planted) / len(planted)
    assert len(planted) >= 60 and recall >= 0.9 and wrong <= 0.02, (len(planted), recall, wrong)

    t = spark.read.parquet(f"{d}/teacher.parquet")
    mail = {r.record_id: "".join(r.email.split()).lower() for r in t.collect() if r.email and r.email.strip()}
    person = {r.record_id: r.person for r in V.link_people(t.withColumn("email", F.lit(None).cast("string"))).collect()}
    same = [(a, b) for a, b in combinations(mail, 2) if mail[a] == mail[b]]
    linked = [(a, b) for a, b in combinations(mail, 2) if person[a] == person[b]]
    right = sum(mail[a] == mail[b] for a, b in linked)
    assert right / len(same) >= 0.9 and right / len(linked) >= 0.9, (right, len(same), len(linked))
