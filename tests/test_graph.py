import itertools

from conftest import rows
from pyspark.sql import functions as F

from graphloom.functions.text import joined
from graphloom.operators import aggregate, community, containing, context, match, providers, repair, route, traverse, upsert
from graphloom.sources import fixture_graph


def graph(spark, node_rows, edge_rows):
    n = spark.createDataFrame([(f"{label}:{name}", label, name, code) for label, name, code in node_rows], "node_id string, label string, name string, code string")
    e = spark.createDataFrame([(f"e{i}", a, b, t, None, None, None) for i, (a, b, t) in enumerate(edge_rows)], "edge_id string, src string, dst string, rel_type string, semester int, required_type string, required_level string")
    return n, e


def test_fixture_counts(spark, data):
    n, e = fixture_graph.nodes(spark, data), fixture_graph.edges(spark, data)
    assert {r.label: r["count"] for r in n.groupBy("label").count().collect()} == {"MAJOR": 25, "SUBJECT": 200, "SKILL": 31, "CAREER": 25, "TEACHER": 10}
    assert {r.rel_type: r["count"] for r in e.groupBy("rel_type").count().collect()} == {"OFFERS": 190, "TEACH": 37, "PROVIDES": 70, "REQUIRES": 17, "LEADS_TO": 29}
    assert e.select("edge_id").distinct().count() == e.count()


def test_trails_of_a_triangle_with_a_tail(spark):
    n, e = graph(spark, [("SKILL", x, None) for x in "abcd"], [("SKILL:a", "SKILL:b", "R"), ("SKILL:b", "SKILL:c", "R"), ("SKILL:c", "SKILL:a", "R"), ("SKILL:a", "SKILL:d", "R")])
    t = traverse.trails(n, e, spark.createDataFrame([("a",)], "name string"), 3, limit=None)
    assert {r.hops: r["count"] for r in t.groupBy("hops").count().collect()} == {1: 3, 2: 2, 3: 2}
    two = traverse.trails(n, e, spark.createDataFrame([("a",)], "name string"), 3, limit=2)
    assert two.count() == 2 and {r.hops for r in two.collect()} == {1}
    assert traverse.trails(n, e, spark.createDataFrame([], "name string"), 2).count() == 0


def test_trail_scope_holds_for_the_end_only(spark):
    n, e = graph(spark, [("MAJOR", "m", "1"), ("SUBJECT", "s", "2"), ("SKILL", "k", None)], [("MAJOR:m", "SUBJECT:s", "OFFERS"), ("SUBJECT:s", "SKILL:k", "PROVIDES")])
    t = traverse.trails(n, e, spark.createDataFrame([("m",)], "name string"), 2, ["SKILL"])
    assert [(r.name, r.hops, r.node_names) for r in t.collect()] == [("k", 2, ["m", "s", "k"])]


def test_path_depth(spark):
    _, e = graph(spark, [], [("a", "b", "R"), ("b", "c", "R"), ("x", "y", "R")])
    p = spark.createDataFrame([(1, "a", "c"), (2, "c", "a"), (3, "a", "a"), (4, "a", "y"), (5, "a", "nowhere")], "pair_id int, a string, b string")
    assert rows(traverse.path_depth(e, p)) == [(1, 2), (2, 2), (3, 0), (4, None), (5, None)]


def test_templates_match_code_only_where_they_may(spark):
    n, e = graph(spark, [("MAJOR", "Law", "7"), ("CAREER", "Judge", None), ("SKILL", "Logic", None)], [("MAJOR:Law", "CAREER:Judge", "LEADS_TO"), ("CAREER:Judge", "SKILL:Logic", "REQUIRES")])
    kw = spark.createDataFrame([("7", 0), ("", 1), ("LA", 2)], "kw string, kw_pos int")
    assert rows(match.match(n, e, kw, "MAJOR", "CAREER").select("kw", "name", joined("node_names"))) == [("", "Judge", "Law|Judge"), ("7", "Judge", "Law|Judge"), ("LA", "Judge", "Law|Judge")]
    assert match.match(n, e, spark.createDataFrame([("7", 0)], "kw string, kw_pos int"), "CAREER", "SKILL").count() == 0
    back = match.match(n, e, spark.createDataFrame([("jud", 0)], "kw string, kw_pos int"), "CAREER", "MAJOR")
    assert back.first().node_names == ["Law", "Judge"]


def test_parallel_edges_repeat_rows_and_count_once(spark):
    n, e = graph(spark, [("MAJOR", "m", "1"), ("SUBJECT", "s", "2")], [("MAJOR:m", "SUBJECT:s", "OFFERS")] * 2)
    kw = spark.createDataFrame([("m", 0)], "kw string, kw_pos int")
    assert match.match(n, e, kw, "MAJOR", "SUBJECT").count() == 2
    assert aggregate.top_by_count(n, e, "OFFERS", "MAJOR", "src", 10).first().n == 1


def test_relaxed_intersection_only_if_the_strict_one_is_empty(spark):
    majors = [("MAJOR", f"m{i}", str(i)) for i in range(5)]
    n, e = graph(spark, [*majors, ("SUBJECT", "s", "s")], [(f"MAJOR:m{i}", "SUBJECT:s", "OFFERS") for i in range(4)])
    assert rows(aggregate.subjects_all_or_most(n, e)) == [("s", "s", 4)]
    n, e = graph(spark, [*majors, ("SUBJECT", "s", "s"), ("SUBJECT", "t", "t")], [(f"MAJOR:m{i}", f"SUBJECT:{x}", "OFFERS") for i in range(5) for x in "st" if x == "s" or i])
    assert rows(aggregate.subjects_all_or_most(n, e)) == [("s", "s", 5)]


def test_context_keeps_fewest_hops_and_first_place(spark):
    df = spark.createDataFrame([(1, "A", "x", 0), (2, "A", "x", 2), (3, "B", "y", 1), (4, "A", "x", 1), (5, "B", None, 1)], "seq int, label string, name string, hops int")
    got = {(r.label, r.name): (r.hops, r.first_seq) for r in context.ranked(df).collect()}
    assert got == {("A", "x"): (1, 1), ("B", "y"): (1, 3), ("B", None): (1, 5)}
    assert context.ranked(df, ["X"]).count() == 2
    assert context.ranked(df, [""]).count() == 0


def test_records_number_nodes_and_keep_nulls(spark):
    q = spark.createDataFrame([("q1", "?", None), ("q2", "?", None)], "query_id string, query string, generated_answer string")
    n = spark.createDataFrame([("q1", 2, "b", "SKILL", None, 1), ("q1", 1, "a", "MAJOR", "7", 0)], "query_id string, position int, name string, label string, code string, hops int")
    p = spark.createDataFrame([("q1", i, "a", "b", "R", 1) for i in range(30)], "query_id string, seq int, `from` string, `to` string, relation string, hop int")
    r = {x.query_id: x for x in context.records(q, n, p).collect()}
    assert [x.node_id for x in r["q1"].retrieved_nodes] == ["node001", "node002"] and len(r["q1"].traversal_path) == 20
    assert '"code":null' in r["q1"].retrieved_nodes[1].content and r["q2"].retrieved_nodes == []
    said = providers.answer(context.prompt(context.records(q, n, p)), lambda a, b: a + str(len(b) > 10))
    assert {x.generated_answer for x in said.collect()} == {"?True"}


def test_routes(spark):
    df = spark.createDataFrame(
        [(["ngành 7480201 nào"], ["SKILL"], "CAREER"), (["phân tích dữ liệu"], ["MAJOR", "SKILL"], "SUBJECT"), (["sql"], ["SKILL"], "SUBJECT"), ([], ["TEACHER", "MAJOR"], "CAREER"), (None, None, None), (["x"], ["MAJOR"], "MAJOR"), (["a74802011"], [], "MAJOR")],
        "k array<string>, m array<string>, a string",
    )
    got = [r[0] for r in df.select(route.community(F.col("k"), F.col("m"), F.col("a"))).collect()]
    assert got == ["L3_MAJOR_CENTRIC", "L3_SKILL_CENTRIC", "L2_CAREER_ALIGNMENT", "L2_CAREER_ALIGNMENT", "L1_GLOBAL", "L1_GLOBAL", "L1_GLOBAL"]


def test_aggregation_patterns(spark):
    qs = {
        "Môn nào chung giữa CNTT và Kế toán?": "subject_intersection_two",
        "Môn học nào có ở tất cả các ngành?": "subject_intersection_all",
        "NGÀNH nào có nhiều môn học nhất?": "major_most_subjects",
        "Nghề nào cần nhiều kỹ năng nhất?": "career_most_skills",
        "Môn nào phổ biến nhất?": "subject_most_majors",
        "Kỹ năng nào có nhiều môn dạy?": "skill_most_subjects",
        "Có bao nhiêu giảng viên?": "count_entities",
        "Thầy A dạy gì?": None,
    }
    df = spark.createDataFrame(list(enumerate(qs)), "i int, q string").orderBy("i")
    assert [r[0] for r in df.select(aggregate.detect_aggregation(F.col("q"))).collect()] == list(qs.values())


def test_abbreviations_short_ones_in_capitals_only(spark):
    df = spark.createDataFrame([("DA học gì",), ("da học gì",), ("cntt và CNTT",), ("XDA, ADA",), (None,)], "q string")
    assert [r[0] for r in df.select(joined(route.found_abbreviations(F.col("q")))).collect()] == ["da", "", "cntt", "", ""]  # null has none
    assert df.limit(1).select(route.expanded(F.col("q"))).first()[0] == "DA học gì  [GHI CHÚ: DA = data analyst / phân tích dữ liệu]"


def test_upserts(spark):
    df = spark.createDataFrame([(1, "s", "x", "e"), (2, "s", "y", ""), (3, "", "z", "z")], "seq int, k string, a string, b string")
    assert rows(upsert.last_wins(df, "k", ["a", "b"])) == [("s", "y", "")]
    assert rows(upsert.last_nonempty_wins(df, "k", ["a", "b"])) == [("s", "y", "e")]
    e = spark.createDataFrame([(1, "a", "b", None), (2, "a", "b", "x"), (3, "c", "d", "x"), (4, "c", "d", ""), (5, "c", "d", "y"), (6, "c", "d", "x"), (7, None, "d", "x")], "seq int, s string, t string, p string")
    assert rows(upsert.merge_edges(e, ["s", "t"], ["p"])) == [("a", "b", "x"), ("a", "b", None), ("c", "d", "x"), ("c", "d", "y")]


def test_merging_majors_moves_every_edge_and_never_merges_one_with_itself(spark):
    n, e = graph(spark, [("MAJOR", "Law", "Law"), ("MAJOR", "123", "123"), ("CAREER", "c", None)], [("MAJOR:Law", "CAREER:c", "LEADS_TO"), ("CAREER:c", "MAJOR:Law", "MENTIONED_IN")])
    good = spark.createDataFrame([("MAJOR:7", "MAJOR", "law", "7"), ("MAJOR:8", "MAJOR", "Law", "8")], n.schema)
    kept, moved = repair.merge_majors(n.union(good), e)
    assert "MAJOR:Law" not in {r.node_id for r in kept.collect()} and kept.count() == 4
    assert {(r.src, r.dst) for r in moved.collect()} == {("MAJOR:7", "CAREER:c"), ("MAJOR:8", "CAREER:c"), ("CAREER:c", "MAJOR:7"), ("CAREER:c", "MAJOR:8")}
    only_other_case = n.union(good.filter("node_id = 'MAJOR:7'"))
    assert repair.merge_majors(only_other_case, e)[0].count() == 4  # no name is borne twice in the same case
    assert repair.merge_majors(only_other_case, e, gate=False)[0].count() == 3


def test_louvain_is_a_partition_no_worse_than_singletons_and_repeats_itself(spark, data):
    n, e = fixture_graph.nodes(spark, data), fixture_graph.edges(spark, data)
    a, b = (community.louvain(n, e, "L2_CAREER_ALIGNMENT") for _ in range(2))
    assert rows(a) == rows(b)
    ids = n.filter(F.col("label").isin("SKILL", "CAREER", "SUBJECT"))
    assert a.count() == ids.count() == a.select("node_id").distinct().count()
    g = community.projection(n, e, "L2_CAREER_ALIGNMENT")
    single = ids.select("node_id", F.col("node_id").alias("community"))
    assert community.modularity(g, a) > max(0.2, community.modularity(g, single))
    assert community.louvain(n, e, "L3_SKILL_CENTRIC").groupBy("community").count().filter("count > 1").count() == 0


def test_louvain_finds_two_cliques(spark):
    names = [("SKILL", f"k{i}", None) for i in range(8)]
    links = [(f"SKILL:k{i}", f"SKILL:k{j}", "PROVIDES") for base in (0, 4) for i in range(base, base + 4) for j in range(i + 1, base + 4)] + [("SKILL:k0", "SKILL:k4", "PROVIDES")]
    n, e = graph(spark, names, links)
    groups = {}
    for r in community.louvain(n, e, "L2_CAREER_ALIGNMENT").collect():
        groups.setdefault(r.community, set()).add(r.node_id[-1])
    assert sorted(map(sorted, groups.values())) == [list("0123"), list("4567")]


def test_pagerank_adds_up_to_one(spark):
    n, e = graph(spark, [("SKILL", x, None) for x in "abc"], [("SKILL:a", "SKILL:b", "R"), ("SKILL:a", "SKILL:b", "R"), ("SKILL:b", "SKILL:c", "R")])
    r = {x.node_id: x["rank"] for x in community.pagerank(n, e).collect()}
    assert abs(sum(r.values()) - 1) < 1e-9 and r["SKILL:c"] > r["SKILL:b"] > r["SKILL:a"]


def test_ask_questions_walks_three_hops(spark, data):
    from graphloom.operators.ask import ask
    from graphloom.plans import graph_queries

    got = {r.query_id: r.n_nodes for r in graph_queries.queries()["ask_questions"](spark, data).collect()}
    asked = [("a4", "Ngành 7480007 có những môn nào?"), ("a5", "Ngành 7480003 dẫn tới nghề nào?")]
    n, e = fixture_graph.nodes(spark, data), fixture_graph.edges(spark, data)
    q = spark.createDataFrame(asked, "query_id string, query string")
    two, three = ({r.query_id: len(r.retrieved_nodes) for r in ask(n, e, q, max_hops=h).collect()} for h in (2, 3))
    assert two != three and {k: got[k] for k in three} == three


def test_questions_read_the_graph_once(spark):
    from graphloom.operators.ask import ask

    n, e = graph(spark, [("MAJOR", "law", "7480007"), ("SUBJECT", "s", "S1"), ("CAREER", "c", None)], [("MAJOR:law", "SUBJECT:s", "OFFERS"), ("MAJOR:law", "CAREER:c", "LEADS_TO")])
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    q = spark.createDataFrame([("a2", "Ngành nào có nhiều môn học nhất?"), ("a3", "Có bao nhiêu nghề?"), ("a4", "Ngành 7480007 có những môn nào?"), ("a5", "Ngành 7480007 dẫn tới nghề nào?")], "query_id string, query string")
    got = {r.query_id: [x.entities[0] for x in r.retrieved_nodes] for r in ask(n.mapInArrow(counted, n.schema), e.mapInArrow(counted, e.schema), q).collect()}
    assert seen.value == 5
    assert got["a2"] == ["law"] and got["a3"] == ["CAREER"] and got["a4"][0] == "s" and got["a5"][0] == "c"


def test_the_context_has_sixty_steps_the_rule_negation_and_community_and_the_record_twenty(spark):
    q = spark.createDataFrame([("q1", "?", None, "say why", ["x", "y"], "L2_ACADEMIC"), ("q2", "?", None, None, [], None)], "query_id string, query string, generated_answer string, answer_rule string, negated array<string>, community string")
    n = spark.createDataFrame([("q1", 1, "a", "MAJOR", "7", 0)], "query_id string, position int, name string, label string, code string, hops int")
    p = spark.createDataFrame([("q1", i, f"n{i:02}", "b", "R", 1) for i in range(70)], "query_id string, seq int, `from` string, `to` string, relation string, hop int")
    r = {x.query_id: x for x in context.prompt(context.records(q, n, p)).collect()}
    assert len(r["q1"].traversal_path) == 20 and r["q1"].context.count('"hop":1') == 60 and '"n59"' in r["q1"].context and '"n60"' not in r["q1"].context
    assert "say why" in r["q1"].context and "x; y" in r["q1"].context and "level 2: MAJOR, SUBJECT, TEACHER" in r["q1"].context and "no data" not in r["q1"].context
    assert "no data" in r["q2"].context and "level 1" in r["q2"].context and "rejects" not in r["q2"].context


def brute_trails(nodes, edges, seeds, hops, labels, limit):
    name = {i: (n, label, code) for i, label, n, code in nodes}
    out = {}
    for s in seeds:
        front = [(i, (), (), (s,)) for i, v in name.items() if v[0] == s]
        seen = set()
        for h in range(1, hops + 1):
            step = []
            for at, used, kinds, path in front:
                for e, a, b, t in edges:
                    for x, y in {(a, b), (b, a)}:
                        if x == at and e not in used:
                            step.append((y, (*used, e), (*kinds, t), (*path, name[y][0])))
            seen |= {(h, "|".join(p), "|".join(k), *name[y][:2], name[y][2] or "") for y, _, k, p in step if not labels or name[y][1] in labels}
            front = step
        out[s] = sorted(seen)[:limit]
    return out


def test_limited_trails_against_brute_force(spark):
    import random

    rng = random.Random(3)
    for round_ in range(4):
        n = [("SKILL" if i % 3 else "MAJOR", f"n{i}" if i % 5 else "same", str(i) if i % 3 == 0 else None) for i in range(14)]
        ids = [f"i{i}" for i in range(14)]
        nodes = [(i, *x) for i, x in zip(ids, n)]
        edges = [(f"e{k}", ids[0] if k % 3 == 0 else rng.choice(ids), rng.choice(ids), rng.choice("RS")) for k in range(34)]
        nd = spark.createDataFrame(nodes, "node_id string, label string, name string, code string")
        ed = spark.createDataFrame(edges, "edge_id string, src string, dst string, rel_type string")
        seeds = ["same", "n1", "n7"]
        start = spark.createDataFrame([(x,) for x in seeds], "name string")
        for labels, limit in ((None, 7), (["MAJOR"], 7), (["MAJOR"], 300)):
            got = {}
            for r in traverse.trails(nd, ed, start, 3, labels, limit).collect():
                got.setdefault(r.seed, []).append((r.hops, "|".join(r.node_names), "|".join(r.rel_types), r.name, r.label, r.code or ""))
            assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in brute_trails(nodes, edges, seeds, 3, labels, limit).items() if v}


def broadcast(df):
    """The parts of the plan that are broadcast, as text."""
    lines, out = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    for i, line in enumerate(lines):
        if line.lstrip(" :+-*").startswith("BroadcastExchange"):
            out.append("\n".join(itertools.takewhile(lambda x: depth(x) > depth(line), lines[i + 1 :])))
    return out


def stored_graph(spark, path):
    n, e = graph(spark, [("SUBJECT", f"deep blue {i}", f"P{i}") for i in range(9)] + [("SKILL", "k", None), ("TEACHER", "t", None)], [(f"SUBJECT:deep blue {i}", "SKILL:k", "PROVIDES") for i in range(9)] + [("TEACHER:t", f"SUBJECT:deep blue {i}", "TEACH") for i in range(9)])
    for name, df in (("n", n), ("e", e)):
        df.write.parquet(f"{path}/{name}")
    return spark.read.parquet(f"{path}/n"), spark.read.parquet(f"{path}/e")


def test_grams_of_names_are_never_broadcast(spark, tmp_path, monkeypatch):
    n, e = stored_graph(spark, tmp_path)
    kw = spark.createDataFrame([("BLUE", 0), ("7", 1), ("no", 2)], "kw string, kw_pos int")
    want = sorted([("BLUE", f"k|deep blue {i}") for i in range(9)] + [("7", "k|deep blue 7")])
    for sent in (1_000_000, 0):
        monkeypatch.setattr(containing, "SENT", sent, raising=False)
        found = match.match(n, e, kw, "SUBJECT", "SKILL")
        assert not any("explode" in x for x in broadcast(found))
        assert sorted((r.kw, "|".join(reversed(r.node_names))) for r in found.collect()) == want


def test_nodes_matched_by_code_are_never_broadcast(spark, tmp_path, monkeypatch):
    n, e = stored_graph(spark, tmp_path)
    kw = spark.createDataFrame([("P3", 0), ("blue 4", 1), (None, 2)], "kw string, kw_pos int")
    for sent in (1_000_000, 0):
        monkeypatch.setattr(containing, "SENT", sent, raising=False)
        assert not any("FileScan" in x for x in broadcast(containing.named(n, kw)))
        found = match.match(n, e, kw, "SUBJECT", "TEACHER")
        assert rows(found.select("kw", "name", "node_names")) == [("P3", "t", ["t", "deep blue 3"]), ("blue 4", "t", ["t", "deep blue 4"])]


def test_path_depth_is_searched_to_the_end(spark):
    n, e = graph(spark, [("SKILL", f"k{i}", None) for i in range(30)], [(f"SKILL:k{i}", f"SKILL:k{i + 1}", "R") for i in range(26)])
    pairs = spark.createDataFrame([("far", "SKILL:k0", "SKILL:k26"), ("none", "SKILL:k0", "SKILL:k28"), ("self", "SKILL:k29", "SKILL:k29"), ("gone", "x", "SKILL:k0")], "pair_id string, a string, b string")
    assert {r.pair_id: r.depth for r in traverse.path_depth(e, pairs, nodes=n).collect()} == {"far": 26, "none": None, "self": 0, "gone": None}
    assert {r.pair_id: r.depth for r in traverse.path_depth(e, pairs, most=20).collect()} == {"far": None, "none": None, "self": None, "gone": None}


def test_communities_are_built_once(spark):
    n, e = graph(spark, [("MAJOR", "m", "7"), ("SUBJECT", "s", "s"), ("SKILL", "k", None), ("TEACHER", "t", None), ("CAREER", "c", None)], [("MAJOR:m", "SUBJECT:s", "OFFERS"), ("SUBJECT:s", "SKILL:k", "PROVIDES"), ("TEACHER:t", "SUBJECT:s", "TEACH"), ("CAREER:c", "SKILL:k", "REQUIRES")])
    built = community.build(n, e).cache()
    got = {r.node_id: (r.community_L1, r.community_L2, r.community_L3) for r in built.collect()}
    assert set(v[0] for v in got.values()) == {"0"} and got["MAJOR:m"][2] is None and got["MAJOR:m"][1] is not None
    assert got["SUBJECT:s"][1] == got["SKILL:k"][1] == got["CAREER:c"][1]  # the later definition's
    assert community.build(built, e, detect=False) is built
    assert {r.node_id: r.community_L2 for r in community.build(built, e, detect=False, rebuild=True).collect()}["TEACHER:t"] == "0"
    assert rows(community.scope(n, e, "L3_MAJOR_CENTRIC", major_code="7").select("node_id")) == [("SUBJECT:s",)] and community.scope(n, e, "L2_ACADEMIC").count() == 3
