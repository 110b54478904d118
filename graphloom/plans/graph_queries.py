"""Queries over the fixture graph: aggregations, patterns, seeds, trails, bridges, context; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import joined
from graphloom.model import TEMPLATES
from graphloom.operators import aggregate, context, match, traverse
from graphloom.session import cut
from graphloom.sources import fixture_graph as G

# Keywords that occur in the fixture's names, by start label; '' is in every name.
KEYWORDS = {"MAJOR": ["nation_1", "7480007"], "SUBJECT": ["P000003", "blue"], "SKILL": ["brand#1", "small"], "CAREER": ["building", "urgent"], "TEACHER": ["00001", "supplier#00000002"]}
SEED_KEYWORDS = ["nation_2", "brand#7", "building 1"]


def _kw(spark: SparkSession, words: list[str]) -> DataFrame:
    return spark.createDataFrame([(w, i) for i, w in enumerate(words)], "kw string, kw_pos int")


def _kw_sql(words: list[str]) -> str:
    return "(VALUES " + ", ".join(f"('{w}', {i})" for i, w in enumerate(words)) + ") AS k(kw, kw_pos)"


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return G.nodes(spark, d), G.edges(spark, d)


def _sql(body: str, ctes: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{G.SQL}{', ' + ctes if ctes else ''} {body}"


Q: dict = {}
S: dict[str, str] = {}


def _add(name: str, f, sql: str | None = None) -> None:
    f.__name__ = name
    Q[name] = f
    if sql:
        S[name] = sql


# --- aggregations
_OFF = "(SELECT DISTINCT src, dst FROM edges WHERE rel_type = 'OFFERS')"
_add("agg_subject_in_all_majors", lambda s, d: aggregate.subjects_in_all_majors(*_graph(s, d)), _sql(f"SELECT n.name, n.code, count(*) AS n FROM {_OFF} e JOIN nodes n ON e.dst = n.node_id GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM nodes WHERE label = 'MAJOR')"))
_add("agg_subject_in_80pct", lambda s, d: aggregate.subjects_in_all_majors(*_graph(s, d), share=0.8, k=30), _sql(f"SELECT name, code, n FROM (SELECT n.name, n.code, n.node_id, count(*) AS n FROM {_OFF} e JOIN nodes n ON e.dst = n.node_id GROUP BY ALL) WHERE n >= trunc((SELECT count(*) FROM nodes WHERE label = 'MAJOR') * 0.8) ORDER BY n DESC, name, node_id LIMIT 30"))
_add("agg_subject_all_or_most", lambda s, d: aggregate.subjects_all_or_most(*_graph(s, d)), S["agg_subject_in_all_majors"])
_WITHOUT = "(SELECT DISTINCT src, dst FROM edges WHERE rel_type = 'OFFERS' AND dst NOT IN ('SUBJECT:P000000', 'SUBJECT:P000001', 'SUBJECT:P000002'))"


def _no_core(s: SparkSession, d: str) -> DataFrame:
    """Without the subjects that all majors share, so that most have to do."""
    nodes, edges = _graph(s, d)
    return aggregate.subjects_all_or_most(nodes, edges.filter(~F.col("dst").isin("SUBJECT:P000000", "SUBJECT:P000001", "SUBJECT:P000002")))


_add("agg_subject_most_only", _no_core, _sql(f"SELECT name, code, n FROM (SELECT n.name, n.code, n.node_id, count(*) AS n FROM {_WITHOUT} e JOIN nodes n ON e.dst = n.node_id GROUP BY ALL) WHERE n >= trunc((SELECT count(*) FROM nodes WHERE label = 'MAJOR') * 0.8) ORDER BY n DESC, name, node_id LIMIT 30"))
_add("agg_subject_shared_two", lambda s, d: aggregate.subjects_shared(*_graph(s, d)), _sql(f"SELECT name, code, majors, n FROM (SELECT n.name, n.code, n.node_id, count(*) AS n, string_agg(lower(m.name), '|' ORDER BY lower(m.name)) AS majors FROM {_OFF} e JOIN nodes n ON e.dst = n.node_id JOIN nodes m ON e.src = m.node_id GROUP BY n.name, n.code, n.node_id) WHERE n >= 2 ORDER BY n DESC, name, node_id LIMIT 50"))
for _name, _rel, _label, _side, _k in (("agg_major_most_subjects", "OFFERS", "MAJOR", "src", 10), ("agg_career_most_skills", "REQUIRES", "CAREER", "src", 10), ("agg_subject_most_majors", "OFFERS", "SUBJECT", "dst", 15), ("agg_skill_most_subjects", "PROVIDES", "SKILL", "dst", 15)):
    _other = "dst" if _side == "src" else "src"
    _add(_name, lambda s, d, a=(_rel, _label, _side, _k): aggregate.top_by_count(*_graph(s, d), *a), _sql(f"SELECT name, code, n FROM (SELECT n.name, n.code, n.node_id, count(DISTINCT e.{_other}) AS n FROM edges e JOIN nodes n ON e.{_side} = n.node_id WHERE e.rel_type = '{_rel}' AND n.label = '{_label}' GROUP BY n.name, n.code, n.node_id) ORDER BY n DESC, name, node_id LIMIT {_k}"))


def _asked(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/results.parquet").select(F.col("result_id").alias("question_id"), "query")


_add(
    "agg_count_entities", lambda s, d: aggregate.count_entities(G.nodes(s, d), _asked(s, d)),
    _sql("SELECT result_id AS question_id, q.label, coalesce(c.n, 0) AS n FROM (SELECT result_id, CASE WHEN query IS NULL THEN 'SUBJECT' WHEN contains(lower(query), 'ngành') THEN 'MAJOR' WHEN contains(lower(query), 'nghề') THEN 'CAREER' WHEN contains(lower(query), 'kỹ năng') OR contains(lower(query), 'skill') THEN 'SKILL' WHEN contains(lower(query), 'giảng viên') THEN 'TEACHER' ELSE 'SUBJECT' END AS label FROM results) q LEFT JOIN (SELECT label, count(*) AS n FROM nodes GROUP BY label) c ON q.label = c.label"),
)


# --- patterns
def _match(s: SparkSession, d: str, start: str, asked: str) -> DataFrame:
    rows = match.match(*_graph(s, d), _kw(s, KEYWORDS[start]), start, asked)
    return rows.select("kw", "name", "label", "code", joined("rel_types").alias("rel_types"), joined("node_names").alias("node_names"), "hops")


def match_sql(start: str, asked: str, words: list[str], limit: int = match.PER_KEYWORD) -> str:
    steps, by_code, begins = TEMPLATES[start, asked]
    joins, names, kinds = [], ["s.name"], []
    at = "s.node_id"
    for i, (kind, way) in enumerate(steps):
        a, b = ("src", "dst") if way == ">" else ("dst", "src")
        joins.append(f"JOIN edges e{i} ON e{i}.{a} = {at} AND e{i}.rel_type = '{kind}' JOIN nodes n{i} ON n{i}.node_id = e{i}.{b}")
        at, _ = f"n{i}.node_id", names.append(f"n{i}.name")
        kinds.append(kind)
    end = f"n{len(steps) - 1}"
    if begins == "end":
        names, kinds = names[::-1], kinds[::-1]
    code = f"{end}.code" if asked in ("MAJOR", "SUBJECT") else "NULL"
    own = "OR s.code = kw" if by_code else ""
    return (
        f"SELECT kw, name, label, code, rel_types, node_names, hops FROM (SELECT kw, {end}.name, {end}.label, {code} AS code, '{'|'.join(kinds)}' AS rel_types, concat_ws('|', {', '.join(names)}) AS node_names, {len(steps)} AS hops, "
        f"row_number() OVER (PARTITION BY kw ORDER BY {end}.name, {end}.node_id, concat_ws('|', {', '.join(names)})) AS rn FROM {_kw_sql(words)} JOIN nodes s ON s.label = '{start}' AND (contains(lower(s.name), lower(kw)) {own}) "
        f"{' '.join(joins)} WHERE {end}.label = '{asked}') WHERE rn <= {limit}"
    )


for _s, _a in TEMPLATES:
    _add(f"match_{_s.lower()}_{_a.lower()}", lambda s, d, a=(_s, _a): _match(s, d, *a), _sql(match_sql(_s, _a, KEYWORDS[_s])))


def _path_steps(s: SparkSession, d: str) -> DataFrame:
    rows = match.match(*_graph(s, d), _kw(s, KEYWORDS["SKILL"]), "SKILL", "MAJOR")
    return match.path_steps(rows, ["kw"])


_ps = match_sql("SKILL", "MAJOR", KEYWORDS["SKILL"])
_add("path_steps", _path_steps, _sql(f"SELECT kw, split_part(node_names, '|', i) AS from_node, split_part(node_names, '|', i + 1) AS to_node, split_part(rel_types, '|', i) AS relation, i AS hop FROM ({_ps}), (VALUES (1), (2)) AS t(i)"))

# --- seeds and trails
_SEEDS = f"""deg AS (SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id, edge_id FROM edges UNION SELECT dst, edge_id FROM edges) GROUP BY node_id),
seed AS (SELECT * FROM (SELECT kw, kw_pos, n.node_id, n.name, n.label, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY kw ORDER BY coalesce(degree, 0) DESC, n.name, n.node_id) AS rank
  FROM {_kw_sql(SEED_KEYWORDS)} JOIN nodes n ON contains(lower(n.name), lower(kw)) OR n.code = kw LEFT JOIN deg ON n.node_id = deg.node_id) WHERE rank <= 3)"""
_add("seeds_top3", lambda s, d: traverse.seeds(*_graph(s, d), _kw(s, SEED_KEYWORDS)).select("kw", "rank", "name", "label", "degree"), _sql("SELECT kw, rank, name, label, degree FROM seed", _SEEDS))


def trails_sql(max_hops: int, limit: int, labels: list[str] | None = None) -> str:
    scope = f"WHERE label IN ({', '.join(repr(x) for x in labels)})" if labels else ""
    return f"""{_SEEDS},
both_ways AS (SELECT edge_id, rel_type, src AS at, dst AS next FROM edges UNION ALL SELECT edge_id, rel_type, dst, src FROM edges WHERE src <> dst),
walk AS (SELECT s.name AS seed, n.node_id AS at, []::BIGINT[] AS used, []::VARCHAR[] AS kinds, [s.name] AS names, 0 AS hops FROM (SELECT DISTINCT name FROM seed) s JOIN nodes n ON n.name = s.name
  UNION ALL SELECT w.seed, b.next, list_append(w.used, b.edge_id), list_append(w.kinds, b.rel_type), list_append(w.names, n.name), w.hops + 1 FROM walk w JOIN both_ways b ON b.at = w.at JOIN nodes n ON n.node_id = b.next
  WHERE w.hops < {max_hops} AND NOT list_contains(w.used, b.edge_id)),
rows AS (SELECT DISTINCT seed, n.name, n.label, n.code, array_to_string(kinds, '|') AS rel_types, array_to_string(names, '|') AS node_names, hops FROM walk JOIN nodes n ON n.node_id = walk.at WHERE hops > 0),
trail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hops, node_names, rel_types, name, label, coalesce(code, '')) AS rn FROM rows {scope}) WHERE rn <= {limit})"""


def _trails(s: SparkSession, d: str, labels: list[str] | None = None, hops: int = 3) -> DataFrame:
    nodes, edges = map(cut, _graph(s, d))  # read for the seeds and for the trails
    first = traverse.distinct_seeds(traverse.seeds(nodes, edges, _kw(s, SEED_KEYWORDS)))
    return traverse.trails(nodes, edges, first, hops, labels)


def _flat(df: DataFrame) -> DataFrame:
    return df.select("seed", "name", "label", "code", joined("rel_types").alias("rel_types"), joined("node_names").alias("node_names"), "hops")


_cols = "SELECT seed, name, label, code, rel_types, node_names, hops FROM trail"
_add("traverse_3hop", lambda s, d: _flat(_trails(s, d)), _sql(_cols, trails_sql(3, 60), True))
_add("traverse_scoped", lambda s, d: _flat(_trails(s, d, ["SKILL", "CAREER", "SUBJECT"])), _sql(_cols, trails_sql(3, 60, ["SKILL", "CAREER", "SUBJECT"]), True))


# --- bridges
def _bridge(s: SparkSession, d: str, cluster: str, asked: str, label: str) -> DataFrame:
    nodes, edges = _graph(s, d)
    return traverse.bridge(nodes, edges, nodes.filter(F.col("label") == label).filter(F.contains(F.lower("name"), F.lit("1"))), cluster, asked)


_add("bridge_major_career", lambda s, d: _bridge(s, d, "L2_ACADEMIC", "CAREER", "MAJOR"), _sql("SELECT m.name AS start, '' AS via, c.name, 'CAREER' AS label, c.code FROM edges e JOIN nodes m ON e.src = m.node_id JOIN nodes c ON e.dst = c.node_id WHERE e.rel_type = 'LEADS_TO' AND contains(m.name, '1')"))
_add("bridge_career_subject", lambda s, d: _bridge(s, d, "L2_CAREER_ALIGNMENT", "SUBJECT", "CAREER"), _sql("SELECT c.name AS start, k.name AS via, b.name, 'SUBJECT' AS label, b.code FROM edges e JOIN edges f ON e.dst = f.dst AND f.rel_type = 'PROVIDES' JOIN nodes c ON e.src = c.node_id JOIN nodes k ON e.dst = k.node_id JOIN nodes b ON f.src = b.node_id WHERE e.rel_type = 'REQUIRES' AND contains(c.name, '1')"))


# --- ranked context
def _context(s: SparkSession, d: str, negated: list[str] | None) -> DataFrame:
    nodes, edges = _graph(s, d)
    first = match.match(nodes, edges, _kw(s, ["nation_1"]), "MAJOR", "SUBJECT").select(F.lit(1).alias("phase"), F.lit("").alias("seed"), "name", "label", "code", "hops", joined("node_names").alias("path"), joined("rel_types").alias("rels"))
    second = _trails(s, d, hops=2).select(F.lit(2).alias("phase"), "seed", "name", "label", "code", "hops", joined("node_names").alias("path"), joined("rel_types").alias("rels"))
    rows = first.unionByName(second).withColumn("seq", F.struct("phase", "seed", "hops", "path", "rels"))
    return context.ranked(rows, negated).select("label", "name", "code", "hops")


_ctx = (
    trails_sql(2, 60)
    + f""", ctx AS (SELECT 1 AS phase, '' AS seed, name, label, code, hops, node_names AS path, rel_types AS rels FROM ({match_sql("MAJOR", "SUBJECT", ["nation_1"])})
  UNION ALL SELECT 2, seed, name, label, code, hops, node_names, rel_types FROM trail),
best AS (SELECT *, row_number() OVER (PARTITION BY label, name ORDER BY CASE WHEN hops = 0 THEN 99 ELSE hops END, phase, seed, hops, path, rels) AS rn FROM ctx)"""
)
_add("context_dedup", lambda s, d: _context(s, d, None), _sql("SELECT label, name, code, hops FROM best WHERE rn = 1", _ctx, True))
_add("context_negation", lambda s, d: _context(s, d, ["BLUE", "nation_1"]), _sql("SELECT label, name, code, hops FROM best WHERE rn = 1 AND NOT contains(lower(name), 'blue') AND NOT contains(lower(name), 'nation_1')", _ctx, True))


# --- whole questions
def _ask(s: SparkSession, d: str) -> DataFrame:
    """Every distinct question of the results table against the fixture graph, and some that name what the graph has."""
    from graphloom.operators.ask import ask

    own = [("a1", "Môn nào chung cho tất cả ngành?"), ("a2", "Ngành nào có nhiều môn học nhất?"), ("a3", "Có bao nhiêu nghề?"), ("a4", "Ngành 7480007 có những môn nào?"), ("a5", "Ngành 7480003 dẫn tới nghề nào?")]
    asked = s.read.parquet(f"{d}/results.parquet").filter("query is not null").groupBy("query").agg(F.min("result_id").alias("i")).select(F.concat(F.lit("r"), F.col("i").cast("string")).alias("query_id"), "query")
    nodes, edges = _graph(s, d)
    out = ask(nodes, edges, asked.union(s.createDataFrame(own, "query_id string, query string")))
    return out.select("query_id", "community", "algorithm", F.size("retrieved_nodes").alias("n_nodes"), F.size("traversal_path").alias("n_steps"))


_add("ask_questions", _ask)


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return S
