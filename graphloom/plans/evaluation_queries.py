"""Ground truth, retrieval metrics, routing of questions and communities, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import joined
from graphloom.model import ABBREVIATIONS, AGGREGATIONS, CONSTRAINTS, DEFAULT_CONSTRAINT, ROUTES, THRESHOLDS
from graphloom.operators import aggregate, community, dataset, evaluate, route, traverse
from graphloom.sources import fixture_graph
from graphloom.sources.domain import table

Q: dict = {}
S: dict[str, str] = {}
K = 5


def _add(name: str, f, sql: str | None = None) -> None:
    f.__name__ = name
    Q[name] = f
    if sql:
        S[name] = sql


_WS = r"[\s\p{Z}\x1c-\x1f\x85]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _list(c: str) -> str:
    return f"[{_strip('y')} for y in string_split(coalesce({c}, ''), ';') if {_strip('y')} <> '']"


# --- ground truth
def _samples(s: SparkSession, d: str) -> DataFrame:
    return dataset.convert(table(s, d, "csv_to_dataset").drop("loaded_at"))


_C = ["id", "query", "query_type", "ground_truth_answer", "gold_entities", "relevant_node_ids", "gold_path", "expected_communities"]
_SA = f"""raw AS (SELECT row_id, gold_hop_count AS h, {', '.join(f"{_strip(f'coalesce({c}, chr(32))')} AS {c}" for c in _C)} FROM csv_to_dataset),
sa AS (SELECT row_id, id, query, lower(query_type) AS query_type, query_type = '' AS no_type, ground_truth_answer, gold_entities AS ge, relevant_node_ids AS rn, {_list('gold_entities')} AS gold_entities, {_list('relevant_node_ids')} AS relevant_node_ids, {_list('gold_path')} AS gold_path, {_list('expected_communities')} AS expected_communities, h
  FROM raw WHERE NOT (id LIKE '#%' OR id = 'id' OR lower(id) LIKE 'vd%'))"""
_add(
    "dataset_parse_lists", lambda s, d: _samples(s, d).select("row_id", "gold_hop_count", *[joined(c).alias(c) for c in dataset.LISTS]),
    f"WITH {_SA} SELECT row_id, CASE WHEN h IS NOT NULL THEN h ELSE greatest(len(gold_path) - 1, 0) END AS gold_hop_count, {', '.join(f'''array_to_string({c}, '|') AS {c}''' for c in dataset.LISTS)} FROM sa",
)
_add(
    "dataset_validate", lambda s, d: _samples(s, d).select("row_id", F.explode("errors").alias("error")),
    f"""WITH {_SA} SELECT row_id, error FROM (SELECT row_id, unnest([CASE WHEN query = '' THEN 'missing query' END, CASE WHEN no_type THEN 'missing query_type' END, CASE WHEN ground_truth_answer = '' THEN 'missing ground_truth_answer' END,
  CASE WHEN ge = '' THEN 'missing gold_entities' END, CASE WHEN rn = '' THEN 'missing relevant_node_ids' END, CASE WHEN query_type NOT IN ('single_hop', 'multi_hop', 'global') THEN 'bad query_type' END,
  CASE WHEN query_type = 'global' AND len(expected_communities) = 0 THEN 'global without expected_communities' END, CASE WHEN query_type IN ('single_hop', 'multi_hop') AND len(gold_path) = 0 THEN 'hop without gold_path' END]) AS error FROM sa) WHERE error IS NOT NULL""",
)
_add("dataset_type_counts", lambda s, d: dataset.type_counts(_samples(s, d)), f"WITH {_SA} SELECT query_type, count(*) AS n FROM sa GROUP BY query_type")
_NUM = f"{_SA}, nu AS (SELECT * EXCLUDE (id), CASE WHEN id = '' THEN printf('q%03d', row_number() OVER (PARTITION BY id = '' ORDER BY row_id)) ELSE id END AS id FROM sa)"
_add("dataset_ids", lambda s, d: dataset.number_blank_ids(_samples(s, d)).select("row_id", "id", "duplicate"), f"WITH {_NUM} SELECT row_id, id, count(*) OVER (PARTITION BY id) > 1 AS duplicate FROM nu")


# --- metrics
def _metrics(s: SparkSession, d: str) -> DataFrame:
    latest = evaluate.latest_results(table(s, d, "results"))
    return evaluate.evaluate(dataset.number_blank_ids(_samples(s, d)), latest, K)


def _same(a: str, b: str) -> str:
    p, q = f"lower({_strip(a)})", f"lower({_strip(b)})"
    return f"(contains({p}, {q}) OR contains({q}, {p}))"


_EV = f"""{_NUM}, re AS (SELECT query_id, arg_max(struct_pack(a := generated_answer, n := retrieved_nodes, p := traversal_path), result_id) AS r FROM results WHERE query_id <> '' GROUP BY query_id),
ev AS (SELECT row_id, id, query_type, r IS NULL AS missing, gold_entities, gold_path, expected_communities, CASE WHEN len(relevant_node_ids) > 0 THEN relevant_node_ids ELSE gold_entities END AS rel, r.a AS answer,
  [coalesce(n.entities[1], json_extract_string(n.content, '$.name'), '') for n in coalesce(r.n, [])] AS names,
  [CASE WHEN len(n.entities) > 0 THEN n.entities ELSE [coalesce(json_extract_string(n.content, '$.name'), '')] END for n in coalesce(r.n, [])] AS by_node,
  flatten([[x.from_node, x.to_node] for x in coalesce(r.p, [])]) AS way FROM nu LEFT JOIN re ON nu.id = re.query_id),
fl AS (SELECT *, [x for x in flatten(by_node) if coalesce(x, '') <> ''] AS flat, [x for x in way if coalesce(x, '') <> ''] AS onway, len([x for x in names[1:{K}] if list_contains(rel, x)])::DOUBLE AS tp, len(list_distinct(rel)) AS nrel, least(len(names), {K}) AS ntop,
  list_position([len([1 for x in ns if len([1 for g in rel if {_same('x', 'g')}]) > 0]) > 0 for ns in by_node], true) AS rank FROM ev),
me AS (SELECT row_id, id, query_type, missing, CASE WHEN ntop = 0 AND nrel = 0 THEN 1.0 WHEN ntop = 0 OR nrel = 0 THEN 0.0 ELSE round(tp / {K}, 4) END AS precision,
  CASE WHEN ntop = 0 AND nrel = 0 THEN 1.0 WHEN ntop = 0 OR nrel = 0 THEN 0.0 ELSE round(tp / nrel, 4) END AS recall,
  CASE WHEN ntop = 0 AND nrel = 0 THEN 1.0 WHEN ntop = 0 OR nrel = 0 OR tp = 0 THEN 0.0 ELSE round(2 * (tp / {K}) * (tp / nrel) / (tp / {K} + tp / nrel), 4) END AS f1,
  CASE WHEN coalesce(rank, 0) > 0 THEN round(1.0 / rank, 4) ELSE 0.0 END AS mrr,
  CASE WHEN len(gold_entities) = 0 THEN 1.0 ELSE round(len([1 for g in gold_entities if len([1 for x in flat if {_same('g', 'x')}]) > 0]) / len(gold_entities), 4) END AS entity_coverage,
  CASE WHEN len(gold_path) = 0 THEN NULL WHEN len(onway) = 0 THEN 0.0 ELSE round(len([1 for g in gold_path if len([1 for x in onway if {_same('g', 'x')}]) > 0]) / len(gold_path), 4) END AS path_relevance,
  CASE WHEN len(expected_communities) = 0 THEN NULL ELSE round(len([1 for c in expected_communities if contains(lower(coalesce(answer, '')), lower(replace(c, '_', ' ')))]) / len(expected_communities), 4) END AS comprehensiveness FROM fl)"""
for _name, _cols in (("eval_prf", ["precision", "recall", "f1"]), ("eval_mrr", ["mrr"]), ("eval_coverage", ["entity_coverage"]), ("eval_path_relevance", ["path_relevance"]), ("eval_comprehensiveness", ["comprehensiveness"])):
    _add(_name, lambda s, d, c=_cols: _metrics(s, d).select("row_id", *c), f"WITH {_EV} SELECT row_id, {', '.join(_cols)} FROM me")
_add(
    "eval_coverage_lists", lambda s, d: evaluate.coverage_lists(dataset.number_blank_ids(_samples(s, d)), evaluate.latest_results(table(s, d, "results"))).select("row_id", joined("covered").alias("covered"), joined("missing").alias("missing"), F.col("threshold_ok").cast("int").alias("threshold_ok")),
    f"""WITH {_EV}, cl AS (SELECT row_id, gold_entities, [g for g in gold_entities if len([1 for x in flat if {_same('g', 'x')}]) > 0] AS covered, [g for g in gold_entities if len([1 for x in flat if {_same('g', 'x')}]) = 0] AS missing FROM fl)
SELECT row_id, array_to_string(covered, '|') AS covered, array_to_string(missing, '|') AS missing, CASE WHEN len(gold_entities) > 0 THEN (len(covered) / len(gold_entities) >= 0.8)::INT END AS threshold_ok FROM cl""",
)
_add("eval_missing", lambda s, d: evaluate.missing(_metrics(s, d)), f"WITH {_EV} SELECT row_id, id FROM me WHERE missing")
_RO = f"""{_EV}, ro AS (SELECT CASE WHEN grouping(query_type) = 1 THEN 'overall' ELSE 'by_type' END AS scope, query_type, count(*) AS sample_count, {', '.join(f'round(avg({m}), 4) AS {m}' for m in THRESHOLDS)} FROM me GROUP BY ROLLUP (query_type))"""
_add("eval_rollup", lambda s, d: evaluate.rollup(_metrics(s, d)), f"WITH {_RO} SELECT * FROM ro")
_PF = f"{_RO}, pf AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS score, {t} AS threshold, CASE WHEN {m} IS NULL THEN 'N/A' WHEN {m} >= {t} THEN 'PASS' ELSE 'FAIL' END AS verdict FROM ro WHERE scope = 'overall'" for m, t in THRESHOLDS.items()) + ")"
_add("eval_pass_fail", lambda s, d: evaluate.pass_fail(evaluate.rollup(_metrics(s, d))), f"WITH {_PF} SELECT metric, score, threshold::DOUBLE AS threshold, verdict FROM pf")
_add("eval_radar", lambda s, d: evaluate.radar(evaluate.rollup(_metrics(s, d))), f"WITH {_PF} SELECT metric, score, threshold::DOUBLE AS threshold FROM pf WHERE metric NOT IN ('precision', 'recall') AND score IS NOT NULL")
_add("eval_bars", lambda s, d: evaluate.bars(evaluate.rollup(_metrics(s, d))), f"WITH {_RO}, f4 AS (SELECT * FROM ro WHERE scope = 'by_type' ORDER BY query_type LIMIT 4) " + " UNION ALL ".join(f"SELECT query_type, '{m}' AS metric, coalesce({m}, 0.0) AS score FROM f4" for m in THRESHOLDS))
_add("eval_scatter", lambda s, d: evaluate.scatter(_metrics(s, d)), f"WITH {_EV} SELECT row_id, id, query_type, recall, precision FROM me")
_add("eval_summary_table", lambda s, d: evaluate.summary_table(evaluate.rollup(_metrics(s, d))), f"WITH {_PF} SELECT metric, printf('%.3f', score) AS score, threshold::DOUBLE AS threshold, verdict FROM pf WHERE score IS NOT NULL")


def _depth(s: SparkSession, d: str) -> DataFrame:
    """Depth between every major and every skill of the fixture graph."""
    nodes, edges = fixture_graph.nodes(s, d), fixture_graph.edges(s, d)
    a = nodes.filter("label = 'MAJOR'").select(F.col("node_id").alias("a"), F.lit(1).alias("one"))
    b = nodes.filter("label = 'SKILL'").select(F.col("node_id").alias("b"), F.lit(1).alias("one"))
    pairs = a.join(b, "one").select(F.concat_ws(">", "a", "b").alias("pair_id"), "a", "b")
    return traverse.path_depth(edges, pairs, nodes=nodes)


_add(
    "eval_path_depth", _depth,
    f"""WITH RECURSIVE {fixture_graph.SQL}, bw AS (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
walk AS (SELECT node_id AS s, node_id AS v, 0 AS d FROM nodes WHERE label = 'MAJOR' UNION SELECT s, b, d + 1 FROM walk JOIN bw ON v = a WHERE d < 12),
dist AS (SELECT s, v, min(d) AS depth FROM walk GROUP BY s, v)
SELECT m.node_id || '>' || k.node_id AS pair_id, depth FROM nodes m JOIN nodes k ON m.label = 'MAJOR' AND k.label = 'SKILL' LEFT JOIN dist ON s = m.node_id AND v = k.node_id""",
)


# --- routing
def _results(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "results").select("result_id", "query", "keywords", "intent")


def _map_sql(t: dict) -> str:
    return "map {" + ", ".join(f"'{a}|{b}': '{v}'" for (a, b), v in t.items()) + "}"


def _look_sql(t: dict) -> str:
    return f"[x for x in [{_map_sql(t)}[m || '|' || asked] for m in labels] if x IS NOT NULL][1]"


_IN = "q AS (SELECT result_id, coalesce(intent.keywords, []) AS kws, coalesce(intent.mentioned_labels, []) AS labels, coalesce(intent.asked_label, 'UNKNOWN') AS asked, coalesce(intent.is_comparison, false) AS comp FROM results)"
_add(
    "route_questions", lambda s, d: _results(s, d).select("result_id", route.community(F.col("intent.keywords"), F.col("intent.mentioned_labels"), F.col("intent.asked_label")).alias("community")),
    rf"""WITH {_IN} SELECT result_id, CASE WHEN len([1 for k in kws if regexp_matches(k, '(^|[^\p{{L}}\p{{N}}_])[0-9]{{7}}($|[^\p{{L}}\p{{N}}_])')]) > 0 THEN 'L3_MAJOR_CENTRIC'
 WHEN asked IN ('CAREER', 'SUBJECT') AND list_contains(labels, 'SKILL') AND len([1 for k in kws if regexp_matches({_strip('k')}, '{_WS}')]) > 0 THEN 'L3_SKILL_CENTRIC'
 ELSE coalesce({_look_sql(ROUTES)}, 'L1_GLOBAL') END AS community FROM q""",
)
_add(
    "answer_constraint", lambda s, d: _results(s, d).select("result_id", route.constraint(F.col("intent.mentioned_labels"), F.col("intent.asked_label"), F.col("intent.is_comparison")).alias("answer_rule")),
    f"WITH {_IN} SELECT result_id, CASE WHEN comp AND list_contains(labels, 'MAJOR') THEN '{CONSTRAINTS['MAJOR', 'MAJOR']}' ELSE coalesce({_look_sql(CONSTRAINTS)}, '{DEFAULT_CONSTRAINT}') END AS answer_rule FROM q",
)
_AGG = "CASE " + " ".join(f"WHEN regexp_matches(query, '(?i){p}') THEN '{n}'" for n, p in AGGREGATIONS) + " END"
_add("detect_aggregation", lambda s, d: _results(s, d).select("result_id", aggregate.detect_aggregation(F.col("query")).alias("aggregation")), f"SELECT result_id, {_AGG} AS aggregation FROM results")
_add(
    "aggregation_meta", lambda s, d: _results(s, d).select("result_id", aggregate.detect_aggregation(F.col("query")).alias("a")).select("result_id", aggregate.asked_label(F.col("a")).alias("asked_label"), aggregate.meta_text(F.col("a"), F.lit(7)).alias("meta")),
    f"SELECT result_id, CASE WHEN a LIKE '%subject%' THEN 'SUBJECT' WHEN a LIKE '%major%' THEN 'MAJOR' WHEN a LIKE '%career%' THEN 'CAREER' WHEN a LIKE '%skill%' THEN 'SKILL' ELSE 'UNKNOWN' END AS asked_label, CASE a WHEN 'major_most_subjects' THEN '7 môn học' WHEN 'career_most_skills' THEN '7 kỹ năng' WHEN 'subject_most_majors' THEN '7 ngành' WHEN 'subject_intersection_two' THEN '7 ngành' WHEN 'skill_most_subjects' THEN '7 môn học' ELSE '' END AS meta FROM (SELECT result_id, {_AGG} AS a FROM results)",
)
_B = r"[^\p{L}\p{N}_]"
_FOUND = "[x for x in [" + ", ".join(f"CASE WHEN regexp_matches(t, '{'' if len(a) <= 3 else '(?i)'}(^|{_B}){a.upper() if len(a) <= 3 else a}($|{_B})') THEN '{a}' END" for a in ABBREVIATIONS) + "] if x IS NOT NULL]"
_FULL = "map {" + ", ".join(f"'{a}': '{'|'.join(v)}'" for a, v in ABBREVIATIONS.items()) + "}"


def _questions(s: SparkSession, d: str) -> DataFrame:
    """Questions and, as further ones, the texts of documents: these have more short forms."""
    r = table(s, d, "results").select(F.concat(F.lit("r"), F.col("result_id").cast("string")).alias("k"), F.col("query").alias("t"))
    return r.union(table(s, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")), "text"))


_add(
    "expand_abbrev", lambda s, d: _questions(s, d).select("k", joined(route.found_abbreviations(F.col("t"))).alias("found"), joined(route.expansions(F.col("t"))).alias("expansions")).filter("found <> ''"),
    f"WITH t AS (SELECT 'r' || result_id AS k, query AS t FROM results UNION ALL SELECT 'd' || doc_id, text FROM documents), f AS (SELECT k, {_FOUND} AS f FROM t) SELECT k, array_to_string(f, '|') AS found, array_to_string([{_FULL}[x] for x in f], '|') AS expansions FROM f WHERE len(f) > 0",
)
_add("keywords_merged", lambda s, d: _results(s, d).select("result_id", joined(route.all_keywords(F.col("keywords"), F.col("query"))).alias("keywords")),
     f"WITH f AS (SELECT result_id, coalesce(keywords, []) AS own, query AS t FROM results), g AS (SELECT result_id, own, {_FOUND} AS f FROM f), h AS (SELECT result_id, list_concat(own, flatten([string_split({_FULL}[x], '|') for x in f])) AS k FROM g) SELECT result_id, coalesce(array_to_string([x for x, i in k if list_position(k, x) = i], '|'), '') AS keywords FROM h")

# --- communities
_G = lambda s, d: fixture_graph.nodes(s, d)
_add("community_l1", lambda s, d: community.level_one(_G(s, d)), f"WITH {fixture_graph.SQL} SELECT node_id, 0 AS community FROM nodes")
_add("community_rule_l2", lambda s, d: community.by_rule(_G(s, d), 2), f"WITH {fixture_graph.SQL} SELECT node_id, CASE label WHEN 'TEACHER' THEN 0 WHEN 'MAJOR' THEN 2 WHEN 'SKILL' THEN 0 WHEN 'CAREER' THEN 1 WHEN 'SUBJECT' THEN 2 END AS community FROM nodes")
_add("community_rule_l3", lambda s, d: community.by_rule(_G(s, d), 3), f"WITH {fixture_graph.SQL} SELECT node_id, CASE label WHEN 'TEACHER' THEN 1 WHEN 'SKILL' THEN 2 WHEN 'SUBJECT' THEN 0 WHEN 'CAREER' THEN 1 END AS community FROM nodes")
_L3 = lambda s, d, **kw: community.scope(_G(s, d), fixture_graph.edges(s, d), **kw).select("node_id", "label")
_add("scope_major", lambda s, d: _L3(s, d, community="L3_MAJOR_CENTRIC", major_code="7480007"), f"WITH {fixture_graph.SQL} SELECT node_id, label FROM nodes n WHERE label IN ('SUBJECT', 'TEACHER', 'SKILL') AND EXISTS (FROM edges e JOIN nodes m ON e.src = m.node_id WHERE e.dst = n.node_id AND e.rel_type = 'OFFERS' AND m.label = 'MAJOR' AND m.code = '7480007')")
_add("scope_skill", lambda s, d: _L3(s, d, community="L3_SKILL_CENTRIC", skill_name="Brand#11"), f"WITH {fixture_graph.SQL} SELECT node_id, label FROM nodes n WHERE label IN ('SUBJECT', 'CAREER') AND EXISTS (FROM edges e JOIN nodes k ON e.dst = k.node_id WHERE e.src = n.node_id AND e.rel_type IN ('PROVIDES', 'REQUIRES') AND k.label = 'SKILL' AND k.name = 'Brand#11')")
_add("community_build", lambda s, d: community.build(_G(s, d), fixture_graph.edges(s, d), detect=False).select("node_id", "community_L1", "community_L2", "community_L3"), f"WITH {fixture_graph.SQL} SELECT node_id, '0' AS community_L1, CASE label WHEN 'TEACHER' THEN '0' WHEN 'MAJOR' THEN '2' WHEN 'SKILL' THEN '0' WHEN 'CAREER' THEN '1' WHEN 'SUBJECT' THEN '2' END AS community_L2, CASE label WHEN 'TEACHER' THEN '1' WHEN 'SKILL' THEN '2' WHEN 'SUBJECT' THEN '0' WHEN 'CAREER' THEN '1' END AS community_L3 FROM nodes")
_add("community_written", lambda s, d: community.written(community.by_rule(_G(s, d), 3)), f"WITH {fixture_graph.SQL} SELECT count(*) AS nodes_written FROM nodes WHERE label <> 'MAJOR'")
_add("louvain_l2", lambda s, d: community.louvain(_G(s, d), fixture_graph.edges(s, d), "L2_CAREER_ALIGNMENT"))
_PR = ", ".join(
    f"r{i} AS (SELECT n.node_id, {0.15} / (SELECT count(*) FROM nodes) + 0.85 * (coalesce(g.x, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE node_id NOT IN (SELECT src FROM li)) / (SELECT count(*) FROM nodes)) AS rank FROM nodes n LEFT JOIN (SELECT dst, sum(rank / o) AS x FROM li JOIN r{i - 1} ON src = node_id GROUP BY dst) g ON n.node_id = g.dst)"
    for i in range(1, 11)
)
_add("pagerank", lambda s, d: community.pagerank(_G(s, d), fixture_graph.edges(s, d)).select("node_id", F.round("rank", 6).alias("rank")), f"WITH {fixture_graph.SQL}, e2 AS (SELECT DISTINCT src, dst FROM edges), li AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS o FROM e2), r0 AS (SELECT node_id, 1.0 / (SELECT count(*) FROM nodes) AS rank FROM nodes), {_PR} SELECT node_id, round(rank, 6) AS rank FROM r10")


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return S
