import json

from conftest import rows
from pyspark.sql import functions as F

from graphloom.operators import containing, dataset, evaluate, ingest, load, mapping, providers
from graphloom.sources import readers, sinks
from graphloom.streaming.documents import document_stream, event_counts, load_stream, stream_graph

NODE = "doc_id string, doctype string, file_name string, pos int, type string, key string, name string"
REL = "doc_id string, rel_id int, rel_type string, from_major_code string, from_subject_code string, from_career_key string, from_teacher_key string, to_subject_code string, to_skill_key string, to_career_key string"


def doc(spark, nodes, rels):
    n = spark.createDataFrame([("CUR-1", "curriculum", "f", i, *x) for i, x in enumerate(nodes)], NODE)
    fields = REL.split(", ")
    names = [f.split()[0] for f in fields][3:]
    r = spark.createDataFrame([("CUR-1", i, t, *[kw.get(c) for c in names]) for i, (t, kw) in enumerate(rels)], REL)
    return n, r


def test_every_fault_is_reported_once(spark):
    n, r = doc(
        spark,
        [("MAJOR", "m", "Law"), ("SUBJECT", "s", "Logic"), ("SKILL", "k", "x"), ("CAREER", "", "Judge"), ("TEACHER", "t", None), (None, "q", "q")],
        [("major_offers_subject", {"from_major_code": "m", "to_subject_code": "s"}), ("major_offers_subject", {"from_major_code": "z", "to_subject_code": None}), ("teacher_instructs_subject", {"from_teacher_key": "t", "to_subject_code": "s"}), ("odd", {}), (None, {})],
    )
    got = sorted((x.error, x.detail) for x in ingest.validate(n, r).collect())
    assert got == [
        ("bad_rel_type", ""), ("bad_rel_type", "odd"), ("bad_type", ""), ("bad_type", "SKILL"), ("missing_endpoint", "major_offers_subject:from_major_code:z"), ("missing_endpoint", "major_offers_subject:to_subject_code:"), ("missing_key", "CAREER"), ("missing_name", "TEACHER"),
    ]
    assert rows(ingest.repair_nodes(n).select("type")) == [("MAJOR",), ("SUBJECT",)]
    assert rows(ingest.repair_rels(n, r).select("rel_id")) == [(0,)]  # the teacher has no name
    shared = spark.createDataFrame([("SUBJECT", "s")], "label string, key string")
    assert rows(ingest.repair_rels(n, r, shared).select("rel_id")) == [(0,)]


def test_status_and_schema(spark):
    n, r = doc(spark, [("MAJOR", "m", "Law"), ("TEACHER", "t", "T")], [])
    docs = spark.createDataFrame([("CUR-1",), ("CUR-2",), ("CUR-3",)], "doc_id string")
    done = docs.filter("doc_id = 'CUR-3'")
    assert rows(ingest.status(docs, n, done)) == [("CUR-1", "ok"), ("CUR-2", "error"), ("CUR-3", "skip")]
    assert rows(ingest.status_counts(ingest.status(docs, n, done))) == [("curriculum", 1, 1, 1), ("total", 1, 1, 1)]
    assert ingest.detect_schema(n, r).first().schema == "syllabus"
    kept, _ = ingest.compatible(n, r)
    assert [x.type for x in kept.collect()] == ["TEACHER"]


def test_codes_of_names(spark):
    m = spark.createDataFrame([("1", " Luật  học ", "b", 0), ("2", "luật học", "a", 0), ("3", "Kinh tế số", "a", 1), ("4", "Kinh tế xanh", "a", 2), ("", "x", "a", 3)], "major_code string, major_name_vi string, file_name string, pos int")
    index, conflicts = mapping.major_index(m)
    assert rows(index) == [("KINH TẾ SỐ", "3"), ("KINH TẾ XANH", "4"), ("LUẬT HỌC", "2")]
    assert rows(conflicts) == [("LUẬT HỌC", 2)]
    names = spark.createDataFrame([("NGÀNH LUẬT HỌC",), ("KINH TẾ",), ("XANH",), ("Ậ",), ("ZZ",)], "norm string")
    assert rows(mapping.partial_match(names, index)) == [("NGÀNH LUẬT HỌC", "2"), ("XANH", "4"), ("Ậ", "2")]
    lists = spark.createDataFrame([("c", ["Luật học", "luật HỌC", "xanh", "Ngành Kinh tế xanh", "KINH TẾ", None])], "owner string, names array<string>")
    codes, lost = mapping.map_codes(lists, index)
    assert codes.first().codes == ["2", "4"]
    assert sorted(x.pos for x in lost.collect()) == [3, 4, 5]


def test_metrics_by_hand(spark):
    s = spark.createDataFrame(
        [(1, "q1", "t", ["a", "b"], [], ["a", "b"], ["L2_X"]), (2, "q2", "t", [], [], [], []), (3, "q3", "u", ["a"], ["n"], ["a"], ["L1"])],
        "row_id int, id string, query_type string, gold_entities array<string>, relevant_node_ids array<string>, gold_path array<string>, expected_communities array<string>",
    )
    node = "array<struct<node_id:string,content:string,entities:array<string>>>"
    r = spark.createDataFrame(
        [("q1", "about l2 x", [("1", '{"name": "zz"}', []), ("2", "{}", ["A"]), ("3", "{}", ["a", "B"]), ("4", "no json", [])], [("a", "", "R", 1)])],
        f"query_id string, generated_answer string, retrieved_nodes {node}, traversal_path array<struct<from_node:string,to_node:string,relation:string,hop:int>>",
    )
    m = {x.row_id: x for x in evaluate.evaluate(s, r, 5).collect()}
    assert (m[1].precision, m[1].recall, m[1].f1, m[1].mrr, m[1].entity_coverage, m[1].path_relevance, m[1].comprehensiveness) == (0.2, 0.5, 0.2857, 0.5, 1.0, 0.5, 1.0)
    assert (m[2].precision, m[2].recall, m[2].mrr, m[2].entity_coverage, m[2].path_relevance, m[2].comprehensiveness, m[2].missing) == (1.0, 1.0, 0.0, 1.0, None, None, True)
    assert (m[3].precision, m[3].mrr, m[3].entity_coverage, m[3].path_relevance) == (0.0, 0.0, 0.0, 0.0)
    up = {(x.scope, x.query_type): x for x in evaluate.rollup(evaluate.evaluate(s, r, 5)).collect()}
    assert up["overall", None].sample_count == 3 and up["by_type", "t"].path_relevance == 0.5
    assert evaluate.report(evaluate.evaluate(s, r, 5), "d", 5, "now").first().missing_results == 2


def test_an_empty_name_matches_anything(spark):
    s = spark.createDataFrame([(1, "q1", "t", ["a"])], "row_id int, id string, query_type string, gold_entities array<string>").selectExpr("*", "array() as relevant_node_ids", "array() as gold_path", "array() as expected_communities")
    r = spark.createDataFrame([("q1", "", [("1", "{}", [])], None)], "query_id string, generated_answer string, retrieved_nodes array<struct<node_id:string,content:string,entities:array<string>>>, traversal_path array<struct<from_node:string,to_node:string,relation:string,hop:int>>")
    x = evaluate.evaluate(s, r, 5).first()
    assert (x.mrr, x.entity_coverage) == (1.0, 0.0)


def test_dataset_rules(spark):
    cols = "row_id int, id string, query string, query_type string, ground_truth_answer string, gold_entities string, relevant_node_ids string, gold_path string, gold_hop_count string, expected_communities string, source_document string, annotator string, notes string"
    df = spark.createDataFrame(
        [(1, " ", "q", "GLOBAL", "a", "x; y;", "n", "", "", "", None, None, None), (2, "q9", "q", "single_hop", "a", "x", "n", "a;b;c", "", "c", None, None, None), (3, "q9", "", "hop", "a", "x", "n", "a", "2x", "", None, None, None), (4, "# c", *[None] * 11), (5, "VD: 1", *[None] * 11), (6, "", *[None] * 11), (7, "", "q", "multi_hop", "a", "x", "n", "a", "7", "", None, None, None)],
        cols,
    )
    s = {x.row_id: x for x in dataset.convert(df).collect()}
    assert set(s) == {1, 2, 3, 7}
    assert s[1].gold_entities == ["x", "y"] and s[1].gold_hop_count == 0 and s[1].errors == ["global without expected_communities"]
    assert s[2].gold_hop_count == 2 and s[2].errors == []
    assert s[3].gold_hop_count == 0 and s[3].errors == ["missing query", "bad query_type", "bad gold_hop_count"]
    ids = {x.row_id: (x.id, x.duplicate) for x in dataset.number_blank_ids(dataset.convert(df)).collect()}
    assert ids == {1: ("q001", False), 2: ("q9", True), 3: ("q9", True), 7: ("q002", False)}
    assert dataset.missing_columns(["x id", "\U0001f7e1 x query", "v notes"]) == ["gold_entities", "ground_truth_answer", "query_type", "relevant_node_ids"]


def test_files_in_and_out(spark, tmp_path):
    docs = tmp_path / "in" / "curriculum"
    docs.mkdir(parents=True)
    (docs / "cur_1.json").write_text(json.dumps({"nodes": [{"type": "MAJOR", "major_code": "7", "major_name_vi": "Luật"}], "relationships": []}), encoding="utf8")
    (docs / "cur_2.json").write_text("{ broken", encoding="utf8")
    (docs / "note.txt").write_text("no document")
    read = readers.json_documents(spark, str(tmp_path / "in")).cache()
    good, bad = ingest.quarantine(read)
    assert rows(good.select("doc_id", "folder")) == [("CUR-cur_1", "curriculum")] and bad.count() == 1
    assert readers.pending(good, good).count() == 0
    out = str(tmp_path / "out")
    sinks.documents(good.select("doc_id", F.lit("curriculum").alias("doctype"), "nodes"), out)
    assert spark.read.json(out).first().doctype == "curriculum"

    stream = document_stream(spark, str(tmp_path / "in"))
    load_stream(stream, str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s" / "nodes")).select("key").first().key == "7"
    load_stream(document_stream(spark, str(tmp_path / "in")), str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s" / "nodes")).count() == 1  # nothing is loaded twice
    nodes, edges = stream_graph(spark, str(tmp_path / "s"))
    assert rows(nodes.select("node_id", "name")) == [("MAJOR:7", "Luật")] and edges.count() == 0
    assert [r.nodes_ok for r in spark.read.parquet(str(tmp_path / "s" / "totals")).collect()] == [1]


def test_ground_truth_file_with_preamble(spark, tmp_path):
    text = '﻿Title, of the sheet\n\n x id,x query,x query_type,x ground_truth_answer,x gold_entities,x relevant_node_ids,v gold_path,v gold_hop_count,v expected_communities,v source_document,v annotator,v notes\nVD: 1,a,b,c,d,e,f,g,h,i,j,k\nr1,q,single_hop,"two\nlines, ""quoted""",a,b,,0,,,,\nr2,q,hop,a,a,b,,0,,,,\n# end\n'
    (tmp_path / "g.csv").write_text(text, encoding="utf8")
    good, bad = readers.ground_truth(spark, str(tmp_path))
    assert [(x.id, x.ground_truth_answer) for x in good.collect()] == [("r1", 'two\nlines, "quoted"')]
    assert [x.reason for x in bad.collect()] == ["query_type"]


def test_samples_results_and_plain_graph(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"query_id": "q1", "query": "x", "gold_entities": ["a"]}]))
    (tmp_path / "b.json").write_text(json.dumps({"samples": [{"id": "q2"}]}))
    assert rows(readers.samples(spark, f"{tmp_path}/a.json").select("id")) == [("q1",)]
    assert rows(readers.samples(spark, f"{tmp_path}/b.json").select("id")) == [("q2",)]
    (tmp_path / "r").mkdir()
    for name, text in (("1_result.json", "old"), ("2_result.json", "new"), ("3.json", "other")):
        (tmp_path / "r" / name).write_text(json.dumps({"query_id": "q", "generated_answer": text}))
    assert [x.generated_answer for x in readers.results(spark, str(tmp_path / "r")).collect()] == ["new"]
    (tmp_path / "g.json").write_text(json.dumps({"nodes": ["a", {"id": "z"}], "edges": [{"source": "a", "target": "b", "type": "R"}, {"from": "b", "to": "c"}]}))
    nodes, edges = readers.plain_graph(spark, f"{tmp_path}/g.json")
    assert rows(edges) == [("a", "b", "R"), ("b", "c", None)] and rows(nodes) == [("a",), ("b",), ("c",), ("z",)]


def test_event_windows(spark):
    df = spark.sql("select timestamp'2026-01-01 00:01:00' as ts union all select timestamp'2026-01-01 00:02:00' union all select timestamp'2026-01-01 00:07:00'")
    assert [r.n for r in event_counts(df, "ts").orderBy("start").collect()] == [2, 1]


def test_the_record_below_the_header_may_be_an_example(spark, tmp_path):
    head = "id,query,query_type,ground_truth_answer,gold_entities,relevant_node_ids,gold_path,gold_hop_count,expected_communities,source_document,annotator,notes\n"
    for name, ids in (("a.csv", ["q001", "q002"]), ("b.csv", ["q7", "q001"])):
        (tmp_path / name).write_text(head + "".join(f"{i},q,single_hop,a,a,b,,0,,,,\n" for i in ids), encoding="utf8")
    good, bad = readers.ground_truth(spark, str(tmp_path))
    assert sorted(x.id for x in good.collect()) == ["q001", "q002", "q7"] and bad.count() == 0  # a q001 elsewhere is a row


def documents(spark):
    from graphloom.model import KG_DOCUMENT

    def one(doc_id, kind, nodes, rels):
        return (doc_id, kind, doc_id + ".json", [{f.name: n.get(f.name) for f in KG_DOCUMENT["nodes"].dataType.elementType.fields} for n in nodes], [{f.name: r.get(f.name) for f in KG_DOCUMENT["relationships"].dataType.elementType.fields} for r in rels])

    rel = lambda t, **kw: {"rel_type": t, **kw}
    docs = [
        one("CUR-1", "curriculum", [{"type": "MAJOR", "major_code": " 7 ", "major_name_vi": "Luật", "major_name_en": "Law"}, {"type": "SUBJECT", "subject_code": "s", "subject_name_vi": "Logic"}, {"type": "MAJOR"}], [rel("major_offers_subject", from_major_code="7", to_subject_code="s", semester="2"), rel("OFFERS", from_major_code="7", to_subject_code="s", semester="x"), rel("odd"), rel("LEADS_TO", from_major_code="7", to_career_key="gone")]),
        one("SYL-1", "syllabus", [{"type": "SUBJECT", "subject_code": "s", "subject_name_vi": ""}, {"type": "TEACHER", "name": "An", "teacher_key": "an", "email": "a@x"}, {"type": "TEACHER", "name": "An", "email": ""}, {"type": "TEACHER", "name": "An B", "teacher_key": "an"}, {"type": "SKILL", "skill_name": "đọc", "skill_key": "doc"}], [rel("TEACHER_INSTRUCTS_SUBJECT", from_teacher_key="an", to_subject_code="s")] * 2 + [rel("subject_provides_skill", from_subject_code="s", to_skill_key="doc")]),
        one("CAR-1", "career_description", [{"type": "CAREER", "career_name_en": "Judge", "career_key": "j"}, {"type": "SKILL", "skill_name": "đọc", "skill_key": "doc"}], [rel("career_requires_skill", from_career_key="j", to_skill_key="doc"), rel("career_requires_skill", from_career_key="j", to_skill_key="doc", required_level="high")]),
        ("CUR-2", "curriculum", "CUR-2.json", None, None),
    ]
    from pyspark.sql import types as T

    return spark.createDataFrame(docs, T.StructType([*[T.StructField(c, T.StringType()) for c in ("doc_id", "doctype", "file_name")], *KG_DOCUMENT.fields]))


def test_documents_become_a_graph(spark):
    nodes, edges, totals = load.load(documents(spark))
    n = {r.node_id: r for r in nodes.collect()}
    assert set(n) == {"MAJOR:7", "SUBJECT:s", "TEACHER:An", "TEACHER:An B", "SKILL:đọc", "CAREER:Judge"}
    assert n["SUBJECT:s"].name == "" and n["TEACHER:An"].email == "a@x" and n["CAREER:Judge"].name == "Judge"  # the last record of a subject, the last that says something of others
    got = {(r.src, r.dst, r.rel_type, r.semester, r.required_level) for r in edges.collect()}
    assert got == {
        ("MAJOR:7", "SUBJECT:s", "OFFERS", 2, None), ("TEACHER:An", "SUBJECT:s", "TEACH", None, None), ("TEACHER:An B", "SUBJECT:s", "TEACH", None, None),
        ("SUBJECT:s", "SKILL:đọc", "PROVIDES", None, None), ("CAREER:Judge", "SKILL:đọc", "REQUIRES", None, None), ("CAREER:Judge", "SKILL:đọc", "REQUIRES", None, "high"),
    }
    assert {r.doc_id: tuple(r)[1:] for r in totals.collect()} == {"CUR-1": (2, 1, 3, 1), "SYL-1": (5, 0, 3, 0), "CAR-1": (2, 0, 2, 0)}
    nodes, edges, _ = load.load(documents(spark), compat=True)
    assert "SKILL:đọc" in {r.node_id for r in nodes.collect()} and {r.rel_type for r in edges.collect()} == {"OFFERS", "REQUIRES"}  # by the exact spelling only
    empty = load.load(documents(spark).limit(0))
    assert [df.count() for df in empty] == [0, 0, 0]


def test_sinks_write_what_readers_read(spark, tmp_path):
    nodes, edges, _ = load.load(documents(spark))
    sinks.graph(nodes, edges, f"{tmp_path}/g")
    assert spark.read.parquet(f"{tmp_path}/g/nodes").filter("label = 'TEACHER'").count() == 2 and spark.read.parquet(f"{tmp_path}/g/edges").count() == edges.count()
    s = spark.createDataFrame([("q1", ["e"]), ("q2", [])], "id string, errors array<string>")
    assert [r.id for r in sinks.dataset(s, f"{tmp_path}/d").collect()] == ["q1"] and spark.read.json(f"{tmp_path}/d").count() == 2
    assert sinks.dataset(s, f"{tmp_path}/none", validate_only=True).count() == 1 and not (tmp_path / "none").exists()
    r = spark.createDataFrame([("q1", "a"), ("q2", None)], "query_id string, generated_answer string")
    sinks.results(r, f"{tmp_path}/r")
    sinks.results(r, f"{tmp_path}/p", per_query=True)
    assert "generated_answer" in spark.read.json(f"{tmp_path}/r").columns and (tmp_path / "p" / "query_id=q1").exists()
    m = spark.createDataFrame([(1, "q1", "t", False, *[0.5] * 7)], "row_id int, id string, query_type string, missing boolean, " + ", ".join(f"{x} double" for x in evaluate.METRICS))
    sinks.report(evaluate.report(m, "d", 5), m, f"{tmp_path}/rep")
    got = spark.read.json(f"{tmp_path}/rep/report").first()
    assert got.config.dataset == "d" and len(got.config.timestamp) == 19 and spark.read.json(f"{tmp_path}/rep/per_sample").count() == 1


def test_retries():
    waits, left = [], [providers.RateLimited(), providers.ServiceError(), None]

    def call():
        e = left.pop(0)
        if e:
            raise e
        return "ok"

    assert providers.patiently(call, sleep=waits.append) == "ok" and waits == [4.0, 4.0]
    left[:], waits[:] = [ValueError(), ValueError(), None], []
    assert providers.patiently(call, sleep=waits.append) == "ok" and waits == []
    left[:] = [providers.ServiceError()] * 3
    for kind in (providers.ServiceError, providers.RateLimited, ValueError):
        left[:] = [kind()] * 3
        try:
            providers.patiently(call, sleep=waits.append)
            raise AssertionError
        except kind:
            pass


def test_extraction_and_intents_from_a_provider(spark):
    d = spark.createDataFrame([("CUR-1", "curriculum", "good"), ("CUR-2", "curriculum", "bad")], "doc_id string, doctype string, text string")
    reply = lambda kind, text: '{"nodes": [{"type": "MAJOR", "major_code": "7"}]}' if text == "good" else "no json"
    got = {r.doc_id: r for r in providers.extract(d, reply).collect()}
    assert got["CUR-1"].nodes[0].major_code == "7" and got["CUR-2"].nodes is None and got["CUR-2"].failure == "JSONDecodeError"
    q = spark.createDataFrame([("q1", "x")], "query_id string, query string")
    i = providers.read_intents(q, lambda question: '{"keywords": ["a"]}').first().intent
    assert i.keywords == ["a"] and i.asked_label == "UNKNOWN" and i.negated_keywords == [] and i.is_comparison is False


def test_containing_equals_nested_loops(spark):
    import itertools

    texts = ["", "a", "ab", "abc", "xabcx", "abcabc", "ngành luật", "luật", None]
    words = ["", "a", "bc", "abc", "luật", "zzz", "ngành l", None]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    w = spark.createDataFrame([(j, x) for j, x in enumerate(words)], "j int, w string")
    want = sorted((i, j) for (i, x), (j, y) in itertools.product(enumerate(texts), enumerate(words)) if x is not None and y is not None and y in x)
    for counted in (False, True):
        assert rows(containing.containing(t, "t", w, "w", counted).select("i", "j")) == want
        assert "NestedLoop" not in containing.containing(t, "t", w, "w", counted)._jdf.queryExecution().toString()


def test_numbers_of_blank_rows_that_share_an_id(spark):
    s = spark.createDataFrame([(1, ""), (1, ""), (2, "a")], "row_id int, id string")
    assert rows(dataset.number_blank_ids(s).select("row_id", "id", "duplicate")) == [(1, "q001", False), (1, "q002", False), (2, "a", False)]
