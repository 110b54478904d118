"""Validation, repair, mapping and upserts over the domain tables; repair of duplicate majors on planted ones; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import joined, slug
from graphloom.model import NODES_BY_DOCTYPE, REL_TYPES
from graphloom.operators import ingest, journal, load, mapping, repair, upsert
from graphloom.sources import domain, fixture_graph

Q: dict = {}
S: dict[str, str] = {}


def _add(name: str, f, sql: str | None = None) -> None:
    f.__name__ = name
    Q[name] = f
    if sql:
        S[name] = sql


_OK = "(" + " OR ".join(f"(doctype = '{d}' AND type IN ({', '.join(map(repr, k))}))" for d, k in NODES_BY_DOCTYPE.items()) + ")"
_ENDS = " UNION ALL ".join(
    f"SELECT doc_id, rel_id, rel_type, '{col}' AS col, '{label}' AS label, {col} AS key FROM relationships WHERE rel_type = '{kind}'" for kind, (_, la, ca, lb, cb) in REL_TYPES.items() for label, col in ((la, ca), (lb, cb))
)
_D = domain.SQL + f", en AS ({_ENDS})"


def _parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return domain.doc_nodes(s, d), domain.doc_rels(s, d), domain.catalogue(s, d)


def _errors(s: SparkSession, d: str) -> DataFrame:
    return ingest.validate(*_parts(s, d)).groupBy("doc_id", "error", "detail").agg(F.count(F.lit(1)).alias("n"))


_add(
    "validate_errors", _errors,
    f"""WITH {_D}, k AS (SELECT DISTINCT doc_id, type AS label, key FROM dn WHERE key <> ''), wn AS (SELECT DISTINCT doc_id FROM dn),
er AS (SELECT doc_id, 'bad_type' AS error, type AS detail FROM dn WHERE NOT {_OK} OR doctype IS NULL
 UNION ALL SELECT doc_id, 'missing_key', type FROM dn WHERE {_OK} AND coalesce(key, '') = '' UNION ALL SELECT doc_id, 'missing_name', type FROM dn WHERE {_OK} AND coalesce(name, '') = ''
 UNION ALL SELECT doc_id, 'bad_rel_type', coalesce(rel_type, '') FROM relationships WHERE doc_id IN (FROM wn) AND (rel_type IS NULL OR rel_type NOT IN ({', '.join(map(repr, REL_TYPES))}))
 UNION ALL SELECT doc_id, 'missing_endpoint', rel_type || ':' || col || ':' || coalesce(key, '') FROM en WHERE doc_id IN (FROM wn) AND NOT EXISTS (FROM k WHERE k.doc_id = en.doc_id AND k.label = en.label AND k.key = en.key)
   AND NOT (label = 'SUBJECT' AND coalesce(key, '') IN (SELECT subject_code FROM subject))
 UNION ALL SELECT DISTINCT doc_id, 'no_nodes', '' FROM relationships WHERE doc_id NOT IN (FROM wn))
SELECT doc_id, error, detail, count(*) AS n FROM er GROUP BY ALL""",
)
_add("fix_nodes", lambda s, d: ingest.repair_nodes(domain.doc_nodes(s, d)).select("doc_id", "type", "key", "name", "pos"), f"WITH {_D} SELECT doc_id, type, key, name, pos FROM dn WHERE {_OK} AND key <> '' AND name <> ''")
_FIX = f"""clean AS (SELECT DISTINCT doc_id, type AS label, key FROM dn WHERE {_OK} AND key <> '' AND name <> ''),
fixed AS (SELECT rel_id FROM en WHERE EXISTS (FROM clean c WHERE c.doc_id = en.doc_id AND c.label = en.label AND c.key = en.key) OR (label = 'SUBJECT' AND key IN (SELECT subject_code FROM subject)) GROUP BY rel_id HAVING count(*) = 2)"""
_add("fix_rels", lambda s, d: ingest.repair_rels(*_parts(s, d)).select("rel_id", "doc_id", "rel_type"), f"WITH {_D}, {_FIX} SELECT rel_id, doc_id, rel_type FROM relationships WHERE rel_id IN (FROM fixed)")


def _all_docs(s: SparkSession, d: str) -> DataFrame:
    return domain.doc_nodes(s, d).select("doc_id").union(domain.doc_rels(s, d).select("doc_id"))


_ST = f"st AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM dn WHERE {_OK} AND key <> '' AND name <> '') THEN 'ok' ELSE 'error' END AS status FROM (SELECT doc_id FROM dn UNION SELECT doc_id FROM relationships))"
_add("doc_status", lambda s, d: ingest.status(_all_docs(s, d), domain.doc_nodes(s, d)), f"WITH {_D}, {_ST} SELECT doc_id, status FROM st")
_add(
    # documents with teachers are taken to have been done before
    "doc_status_counts", lambda s, d: ingest.status_counts(ingest.status(_all_docs(s, d), domain.doc_nodes(s, d), domain.table(s, d, "teacher").select("doc_id"))),
    f"WITH {_D}, {_ST}, sk AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM teacher) THEN 'skip' ELSE status END AS status FROM st) SELECT coalesce(t, 'total') AS doctype, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'skip') AS skip, count(*) FILTER (status = 'error') AS error FROM (SELECT *, coalesce({domain._T}, 'other') AS t FROM sk) GROUP BY ROLLUP (t)",
)
_add(
    "detect_schema", lambda s, d: ingest.detect_schema(domain.doc_nodes(s, d), domain.doc_rels(s, d)),
    f"""WITH {_D}, x AS (SELECT doc_id, type AS k FROM dn UNION ALL SELECT doc_id, rel_type FROM relationships)
SELECT doc_id, CASE WHEN bool_or(k IN ('CAREER', 'career_requires_skill')) THEN 'career' WHEN bool_or(k IN ('TEACHER', 'teacher_instructs_subject')) THEN 'syllabus' WHEN bool_or(k IN ('MAJOR', 'major_offers_subject')) THEN 'curriculum' ELSE 'unknown' END AS schema FROM x GROUP BY doc_id""",
)


def _journal(s: SparkSession, d: str) -> DataFrame:
    """How many records each step of ingestion leaves, by kind."""
    n, r, c = _parts(s, d)
    nodes = journal.counted({"nodes read": n, "nodes clean": ingest.repair_nodes(n)}, F.col("type"))
    return nodes.unionByName(journal.counted({"relationships read": r, "relationships clean": ingest.repair_rels(n, r, c)}, F.col("rel_type")))


_add(
    "step_counts", _journal,
    f"""WITH {_D}, {_FIX} SELECT 'nodes read' AS step, coalesce(type, '') AS detail, count(*) AS n FROM dn GROUP BY ALL UNION ALL SELECT 'nodes clean', type, count(*) FROM dn WHERE {_OK} AND key <> '' AND name <> '' GROUP BY ALL
 UNION ALL SELECT 'relationships read', coalesce(rel_type, ''), count(*) FROM relationships GROUP BY ALL UNION ALL SELECT 'relationships clean', rel_type, count(*) FROM relationships WHERE rel_id IN (FROM fixed) GROUP BY ALL""",
)


# --- names to codes
def _index(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = domain.table(s, d, "major").filter(F.col("major_code").rlike("^[0-9]{7}$"))
    return mapping.major_index(m)


_WS = r"[\s\p{Z}\x1c-\x1f\x85]"


def _norm(c: str) -> str:
    return rf"regexp_replace(upper(regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')), '{_WS}+', ' ', 'g')"


_IX = f"""m AS (SELECT {_norm('major_name_vi')} AS norm, major_code, file_name, pos FROM major WHERE regexp_full_match(major_code, '[0-9]{{7}}') AND major_name_vi <> ''),
ix AS (SELECT norm, arg_min(major_code, (file_name, pos, major_code)) AS code FROM m WHERE norm <> '' GROUP BY norm)"""
_add("major_index", lambda s, d: _index(s, d)[0], f"WITH {_IX} SELECT norm, code FROM ix")
_add("major_index_conflicts", lambda s, d: _index(s, d)[1], f"WITH {_IX} SELECT norm, count(DISTINCT major_code) AS codes FROM m WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT major_code) > 1")


def _typed_names(s: SparkSession, d: str) -> DataFrame:
    """Names that stand where a code should."""
    from graphloom.functions.text import normal_name

    return domain.table(s, d, "major").filter("not major_code rlike '[0-9]'").select(normal_name("major_code").alias("norm"))


_PM = "pm AS (SELECT a.norm, min(ix.code) AS code FROM (SELECT DISTINCT norm FROM names WHERE norm <> '') a JOIN ix ON contains(a.norm, ix.norm) OR contains(ix.norm, a.norm) GROUP BY a.norm HAVING count(DISTINCT ix.code) = 1)"
_add("partial_match", lambda s, d: mapping.partial_match(_typed_names(s, d), _index(s, d)[0]), f"WITH {_IX}, names AS (SELECT {_norm('major_code')} AS norm FROM major WHERE NOT regexp_matches(major_code, '[0-9]')), {_PM} SELECT norm, code FROM pm")


def _lists(s: SparkSession, d: str) -> DataFrame:
    """The names of majors each document lists, in order."""
    m = domain.table(s, d, "major").filter("major_name_vi is not null")
    return m.groupBy(F.col("doc_id").alias("owner")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "record_id", "major_name_vi"))), lambda x: x["major_name_vi"]).alias("names"))


def _mapped(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mapping.map_codes(_lists(s, d), _index(s, d)[0])


_MAP = f"""{_IX}, l AS (SELECT doc_id AS owner, row_number() OVER (PARTITION BY doc_id ORDER BY pos, record_id) - 1 AS pos_, major_name_vi AS name, {_norm('major_name_vi')} AS norm FROM major WHERE major_name_vi IS NOT NULL),
names AS (SELECT l.norm FROM l LEFT JOIN ix ON l.norm = ix.norm WHERE ix.norm IS NULL), {_PM},
f AS (SELECT l.*, ix.code AS exact, CASE WHEN ix.code IS NULL THEN pm.code END AS partial, coalesce(ix.code, pm.code) AS code FROM l LEFT JOIN ix ON l.norm = ix.norm LEFT JOIN pm ON l.norm = pm.norm),
fi AS (SELECT owner, code, min(pos_) AS first FROM f WHERE code IS NOT NULL GROUP BY owner, code)"""
_add("map_codes", lambda s, d: _mapped(s, d)[0].select("owner", joined("codes").alias("codes")), f"WITH {_MAP} SELECT owner, string_agg(code, '|' ORDER BY first, code) AS codes FROM fi GROUP BY owner")
_add("map_codes_unmatched", lambda s, d: _mapped(s, d)[1], f"WITH {_MAP} SELECT f.owner, f.pos_ AS pos, f.name FROM f LEFT JOIN fi ON f.owner = fi.owner AND f.code = fi.code WHERE f.code IS NULL OR (f.partial IS NOT NULL AND fi.first < f.pos_)")


def _summary(s: SparkSession, d: str) -> DataFrame:
    lists = _lists(s, d)
    return mapping.mapping_summary(lists, *mapping.map_codes(lists, _index(s, d)[0]))


_add("map_codes_summary", _summary, f"WITH {_MAP} SELECT (SELECT count(DISTINCT owner) FROM l) AS files, (SELECT count(*) FROM fi) AS mapped, (SELECT count(*) FROM f LEFT JOIN fi ON f.owner = fi.owner AND f.code = fi.code WHERE f.code IS NULL OR (f.partial IS NOT NULL AND fi.first < f.pos_)) AS unmatched")

# --- keys of names
_add("slug_names", lambda s, d: domain.table(s, d, "teacher").select("record_id", slug("name").alias("slug")), rf"""SELECT record_id, regexp_replace(regexp_replace(regexp_replace(strip_accents(replace(regexp_replace(regexp_replace(lower(name), '^{_WS}+|{_WS}+$', '', 'g'), '^((pgs|gs|ths|ts)\.?\s+|(pgs|gs|ths|ts)\.\s*)+', ''), 'đ', 'd')), '\p{{M}}+', '', 'g'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM teacher""")

# --- upserts
_RANK = "CASE WHEN starts_with(doc_id, 'CUR-') THEN 0 WHEN starts_with(doc_id, 'CAR-') THEN 1 WHEN starts_with(doc_id, 'SYL-') THEN 2 ELSE 3 END"


def _seq(df: DataFrame, *rest: str) -> DataFrame:
    return df.withColumn("seq", upsert.ingest_seq(ingest.doctype_of(F.col("doc_id")), *rest))


_add(
    "upsert_last_wins", lambda s, d: upsert.last_wins(_seq(domain.table(s, d, "major"), "file_name", "pos", "record_id"), "major_code", ["major_name_vi", "major_name_en"]),
    f"SELECT major_code, major_name_vi, major_name_en FROM (SELECT *, row_number() OVER (PARTITION BY major_code ORDER BY {_RANK} DESC, file_name DESC, pos DESC, record_id DESC) AS rn FROM major WHERE major_code <> '') WHERE rn = 1",
)
_NE = "arg_max({0}, (" + _RANK + ", file_name, pos, record_id)) FILTER ({0} <> '') AS {0}"
_add("upsert_nonempty", lambda s, d: upsert.last_nonempty_wins(_seq(domain.table(s, d, "teacher"), "file_name", "pos", "record_id"), "name", ["email", "title", "teacher_key"]), "SELECT name, " + ", ".join(_NE.format(c) for c in ("email", "title", "teacher_key")) + " FROM teacher WHERE name <> '' GROUP BY name")
_add(
    "edge_merge_props", lambda s, d: upsert.merge_edges(_seq(domain.table(s, d, "relationships").filter("rel_type = 'career_requires_skill'"), "rel_id"), ["from_career_key", "to_skill_key"], ["required_level"]),
    f"""WITH e AS (SELECT from_career_key, to_skill_key, nullif(required_level, '') AS required_level, min(({_RANK}, rel_id)) AS first FROM relationships WHERE rel_type = 'career_requires_skill' AND from_career_key IS NOT NULL AND to_skill_key IS NOT NULL GROUP BY ALL),
r AS (SELECT from_career_key a, to_skill_key b, min(first) AS rich FROM e WHERE required_level IS NOT NULL GROUP BY ALL)
SELECT from_career_key, to_skill_key, required_level FROM e LEFT JOIN r ON a = from_career_key AND b = to_skill_key WHERE required_level IS NOT NULL OR rich IS NULL OR first < rich""",
)


for _t, _k, _v in (("skill", "skill_name", ["skill_key", "skill_type"]), ("career", "career_name_vi", ["career_key", "career_name_en", "field_name"])):
    _add(f"upsert_{_t}", lambda s, d, a=(_t, _k, _v): upsert.last_nonempty_wins(_seq(domain.table(s, d, a[0]), "file_name", "pos", "record_id"), a[1], a[2]), f"SELECT {_k}, " + ", ".join(_NE.format(c) for c in _v) + f" FROM {_t} WHERE {_k} <> '' GROUP BY {_k}")


# --- the whole load: documents to nodes, edges and totals
def _node_records(s: SparkSession, d: str) -> DataFrame:
    """Node records of the four tables, and of the catalogue of subjects (as a document that comes first)."""
    parts = [_seq(domain.table(s, d, t).withColumn("type", F.lit(label)), "file_name", "pos", "record_id").drop("extracted_at", "ingested_at", "file_name", "pos", "record_id", "doctype", "node_json", "source_name") for label, (t, _, _) in domain.NODE_TABLES.items()]
    none = F.struct(F.lit(-1).alias("folder"), F.lit(None).cast("string").alias("file_name"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("long").alias("record_id"))
    catalogue = domain.table(s, d, "subject").select(F.lit("catalogue").alias("doc_id"), F.lit("SUBJECT").alias("type"), "subject_code", "subject_name_vi", "subject_name_en", none.alias("seq"))
    return load.node_records(load.union_tables([*parts, catalogue]))


def _rel_records(s: SparkSession, d: str) -> DataFrame:
    return load.rel_records(_seq(domain.table(s, d, "relationships"), "rel_id"))


def _load_edges(s: SparkSession, d: str) -> DataFrame:
    return load.load_edges(_rel_records(s, d), load.load_nodes(_node_records(s, d))).drop("edge_id")


def _tr(c: str) -> str:
    return rf"coalesce(regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g'), '')"


_LN = f"""nr AS (SELECT doc_id, 'MAJOR' AS label, {_tr('major_code')} AS key, {_tr('major_code')} AS ek, {_tr('major_name_vi')} AS name, {_tr('major_name_en')} AS name_en, {_tr('major_code')} AS code, '' AS email, '' AS title, '' AS skill_type, '' AS field_name, ({_RANK}, file_name, pos, record_id) AS seq FROM major
 UNION ALL SELECT doc_id, 'SKILL', {_tr('skill_name')}, {_tr('skill_key')}, {_tr('skill_name')}, '', '', '', '', {_tr('skill_type')}, '', ({_RANK}, file_name, pos, record_id) FROM skill
 UNION ALL SELECT doc_id, 'CAREER', coalesce(nullif({_tr('career_name_vi')}, ''), {_tr('career_name_en')}), {_tr('career_key')}, coalesce(nullif({_tr('career_name_vi')}, ''), {_tr('career_name_en')}), {_tr('career_name_en')}, '', '', '', '', {_tr('field_name')}, ({_RANK}, file_name, pos, record_id) FROM career
 UNION ALL SELECT doc_id, 'TEACHER', {_tr('name')}, {_tr('teacher_key')}, {_tr('name')}, '', '', {_tr('email')}, {_tr('title')}, '', '', ({_RANK}, file_name, pos, record_id) FROM teacher
 UNION ALL SELECT 'catalogue', 'SUBJECT', {_tr('subject_code')}, {_tr('subject_code')}, {_tr('subject_name_vi')}, {_tr('subject_name_en')}, {_tr('subject_code')}, '', '', '', '', (-1, '', 0, 0) FROM subject),
ln AS (SELECT label || ':' || key AS node_id, label, arg_max(ek, seq) FILTER (ek <> '') AS entity_key, CASE WHEN label IN ('MAJOR', 'SUBJECT') THEN arg_max(name, seq) ELSE key END AS name,
  CASE WHEN label IN ('MAJOR', 'SUBJECT') THEN arg_max(name_en, seq) WHEN label = 'CAREER' THEN arg_max(name_en, seq) FILTER (name_en <> '') END AS name_en, CASE WHEN label IN ('MAJOR', 'SUBJECT') THEN key END AS code,
  arg_max(email, seq) FILTER (email <> '') AS email, arg_max(title, seq) FILTER (title <> '') AS title, arg_max(skill_type, seq) FILTER (skill_type <> '') AS skill_type, arg_max(field_name, seq) FILTER (field_name <> '') AS field_name FROM nr WHERE key <> '' GROUP BY label, key)"""
_KINDS = [(kind, *v) for kind, v in REL_TYPES.items()]
_CASE = lambda i: "CASE rel_type " + " ".join(f"WHEN '{k[0]}' THEN {k[i] if i in (3, 5) else repr(k[i])}" for k in _KINDS) + " END"
_LE = f"""rr AS (SELECT doc_id, {_CASE(1)} AS kind, {_CASE(2)} AS fl, {_tr(_CASE(3))} AS fk, {_CASE(4)} AS tl, {_tr(_CASE(5))} AS tk, CASE WHEN rel_type = 'major_offers_subject' AND regexp_full_match({_tr('semester')}, '[+-]?[0-9]+') THEN try_cast({_tr('semester')} AS INT) END AS semester,
  CASE WHEN rel_type = 'major_offers_subject' THEN nullif({_tr('required_type')}, '') END AS required_type, CASE WHEN rel_type = 'career_requires_skill' THEN nullif({_tr('required_level')}, '') END AS required_level, ({_RANK}, rel_id) AS seq FROM relationships),
le AS (SELECT a.node_id AS src, b.node_id AS dst, kind AS rel_type, semester, required_type, required_level, min(seq) AS first FROM rr JOIN ln a ON a.label = fl AND a.entity_key = fk JOIN ln b ON b.label = tl AND b.entity_key = tk WHERE fk <> '' AND tk <> '' GROUP BY ALL),
ri AS (SELECT src, dst, rel_type, min(first) AS rich FROM le WHERE semester IS NOT NULL OR required_type IS NOT NULL OR required_level IS NOT NULL GROUP BY ALL)"""
_add("load_nodes", lambda s, d: load.load_nodes(_node_records(s, d)), f"WITH {_LN} SELECT * FROM ln")
_add(
    "load_edges", _load_edges,
    f"WITH {_LN}, {_LE} SELECT le.src, le.dst, le.rel_type, semester, required_type, required_level FROM le LEFT JOIN ri ON le.src = ri.src AND le.dst = ri.dst AND le.rel_type = ri.rel_type WHERE semester IS NOT NULL OR required_type IS NOT NULL OR required_level IS NOT NULL OR rich IS NULL OR first < rich",
)
_add(
    "load_totals", lambda s, d: load.totals(_node_records(s, d), _rel_records(s, d)),
    f"""WITH {_LN}, {_LE} SELECT doc_id, sum(a)::BIGINT AS nodes_ok, sum(b)::BIGINT AS nodes_failed, sum(c)::BIGINT AS rels_ok, sum(d)::BIGINT AS rels_failed FROM (SELECT doc_id, (key <> '')::INT AS a, (key = '')::INT AS b, 0 AS c, 0 AS d FROM nr
 UNION ALL SELECT doc_id, 0, 0, (kind IS NOT NULL AND fk <> '' AND tk <> '')::INT, (kind IS NULL OR fk = '' OR tk = '')::INT FROM rr) GROUP BY doc_id""",
)


# --- duplicate majors, planted into the fixture graph
def planted(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The fixture graph with, for every fifth nation, a major whose code is its name, one in other case, and one each without and with a bad code."""
    nodes, edges = fixture_graph.nodes(s, d), fixture_graph.edges(s, d)
    n = s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name").filter("n_nationkey % 5 = 0")
    dup = n.select(F.explode(F.array("n_name", F.lower("n_name"))).alias("name")).select(F.concat(F.lit("MAJOR:"), "name").alias("node_id"), F.lit("MAJOR").alias("label"), "name", F.col("name").alias("code"))
    odd = s.createDataFrame([("MAJOR:none", "MAJOR", "NATION_1", None), ("MAJOR:X1", "MAJOR", "Odd", "X1")], "node_id string, label string, name string, code string")
    lonely = s.createDataFrame([("CAREER:lonely", "CAREER", "lonely", None), ("CAREER:by name", "CAREER", "by name", None)], "node_id string, label string, name string, code string")
    more = n.select(F.concat(F.lit("MAJOR:"), "n_name").alias("src"), F.explode(F.array(F.lit("SUBJECT:P000010"), F.lit("SUBJECT:P000000"))).alias("dst")).select("src", "dst", F.lit("OFFERS").alias("rel_type"), F.lit(9).alias("semester"))
    lead = n.select(F.concat(F.lit("MAJOR:"), "n_name").alias("src"), F.lit("CAREER:by name").alias("dst"), F.lit("LEADS_TO").alias("rel_type"), F.lit(None).cast("int").alias("semester"))
    null = F.lit(None).cast("string")
    extra = more.unionByName(lead).withColumn("required_type", null).withColumn("required_level", null).withColumn("edge_id", F.md5(F.concat_ws("|", "src", "dst", "rel_type")))
    return nodes.unionByName(dup).unionByName(odd).unionByName(lonely), edges.unionByName(extra.select(*edges.columns))


PLANTED_SQL = (
    fixture_graph.SQL
    + """, np AS (SELECT * FROM nation WHERE n_nationkey % 5 = 0),
pn AS (SELECT node_id, label, name, code FROM nodes UNION ALL SELECT 'MAJOR:' || x, 'MAJOR', x, x FROM (SELECT n_name AS x FROM np UNION ALL SELECT lower(n_name) FROM np)
 UNION ALL VALUES ('MAJOR:none', 'MAJOR', 'NATION_1', NULL), ('MAJOR:X1', 'MAJOR', 'Odd', 'X1'), ('CAREER:lonely', 'CAREER', 'lonely', NULL), ('CAREER:by name', 'CAREER', 'by name', NULL)),
pe AS (SELECT src, dst, rel_type, semester, required_type, required_level FROM edges UNION ALL SELECT 'MAJOR:' || n_name, x, 'OFFERS', 9, NULL, NULL FROM np, (VALUES ('SUBJECT:P000010'), ('SUBJECT:P000000')) t(x)
 UNION ALL SELECT 'MAJOR:' || n_name, 'CAREER:by name', 'LEADS_TO', NULL, NULL, NULL FROM np),
pairs AS (SELECT b.node_id AS bad, g.node_id AS good FROM pn b JOIN pn g ON lower(b.name) = lower(g.name) AND b.node_id <> g.node_id WHERE b.label = 'MAJOR' AND g.label = 'MAJOR' AND b.code = b.name AND regexp_full_match(g.code, '[0-9]+'))"""
)
_p = lambda body: f"WITH {PLANTED_SQL} {body}"
_add("repair_status", lambda s, d: repair.code_status(planted(s, d)[0]), _p("SELECT node_id, name, code, CASE WHEN coalesce(code, '') = '' THEN 'NO CODE' WHEN regexp_full_match(code, '[0-9]+') THEN 'VALID_CODE' WHEN code = name THEN 'CODE_IS_NAME' ELSE 'OTHER' END AS status FROM pn WHERE label = 'MAJOR'"))
_add("repair_dup_names", lambda s, d: repair.duplicate_names(planted(s, d)[0]), _p("SELECT name, count(*) AS n FROM pn WHERE label = 'MAJOR' GROUP BY name HAVING count(*) > 1"))
_add("repair_pairs", lambda s, d: repair.duplicate_pairs(planted(s, d)[0]), _p("SELECT bad, good FROM pairs"))
_add("repair_nodes_kept", lambda s, d: repair.merge_majors(*planted(s, d))[0].select("node_id", "label", "name", "code"), _p("SELECT node_id, label, name, code FROM pn WHERE node_id NOT IN (SELECT bad FROM pairs)"))
_add("repair_edges_moved", lambda s, d: repair.merge_majors(*planted(s, d))[1], _p("SELECT DISTINCT coalesce(a.good, src) AS src, coalesce(b.good, dst) AS dst, rel_type, semester, required_type, required_level FROM pe LEFT JOIN pairs a ON src = a.bad LEFT JOIN pairs b ON dst = b.bad"))
_add("repair_verify", lambda s, d: repair.verify_counts(*planted(s, d)), _p("SELECT name, code, (SELECT count(DISTINCT dst) FROM pe WHERE src = node_id AND rel_type = 'LEADS_TO') AS careers, (SELECT count(DISTINCT dst) FROM pe WHERE src = node_id AND rel_type = 'OFFERS') AS subjects FROM pn WHERE label = 'MAJOR'"))
_add("rel_direction", lambda s, d: repair.career_direction(*planted(s, d)), _p("SELECT 'MAJOR_TO_CAREER' AS direction, 'LEADS_TO' AS rel_type, count(*) AS n FROM pe WHERE rel_type = 'LEADS_TO'"))


def _backwards(s: SparkSession, d: str) -> DataFrame:
    """The same where careers point at majors, by two types."""
    nodes, edges = planted(s, d)
    back = F.when(F.length("dst") % 2 == 0, "COMES_FROM").otherwise("TAUGHT_IN")
    return repair.career_direction(nodes, edges.filter("rel_type = 'LEADS_TO'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), back.alias("rel_type")))


_add("rel_direction_back", _backwards, _p("SELECT 'CAREER_TO_MAJOR' AS direction, CASE WHEN length(dst) % 2 = 0 THEN 'COMES_FROM' ELSE 'TAUGHT_IN' END AS rel_type, count(*) AS n FROM pe WHERE rel_type = 'LEADS_TO' GROUP BY ALL ORDER BY n DESC, rel_type LIMIT 1"))


def _usable(s: SparkSession, d: str) -> DataFrame:
    """Per career the codes of its majors that say something and aren't their names."""
    nodes, edges = planted(s, d)
    m = nodes.filter("label = 'MAJOR'").select(F.col("node_id").alias("src"), "name", "code")
    by = edges.filter("rel_type = 'LEADS_TO'").select("src", "dst").distinct().join(m, "src").groupBy("dst").agg(F.array_sort(F.collect_list(F.struct("name", "code"))).alias("m"))
    return by.select(F.col("dst").alias("career"), F.array_join(F.transform(repair.usable_codes(F.col("m")), lambda x: x["code"]), "|").alias("codes"))


_add("career_usable_codes", _usable, _p("SELECT dst AS career, coalesce(string_agg(code, '|' ORDER BY name, code) FILTER (code <> '' AND code <> coalesce(name, '')), '') AS codes FROM (SELECT DISTINCT src, dst FROM pe WHERE rel_type = 'LEADS_TO') JOIN pn ON src = node_id WHERE label = 'MAJOR' GROUP BY dst"))


def _unresolved(s: SparkSession, d: str) -> DataFrame:
    """Also with a career that only a major of unknown code and name leads to."""
    nodes, edges = planted(s, d)
    return repair.unresolved_majors(nodes, edges.unionByName(s.createDataFrame([("x1", "MAJOR:X1", "CAREER:lonely", "LEADS_TO", None, None, None)], edges.schema)))


_add("career_unresolved", _unresolved, _p("").rstrip() + """, l2 AS (SELECT src, dst FROM pe WHERE rel_type = 'LEADS_TO' UNION SELECT 'MAJOR:X1', 'CAREER:lonely'), j AS (SELECT dst, m.name, m.code, coalesce(regexp_full_match(m.code, '[0-9]+'), false) AS ok FROM l2 JOIN pn m ON src = m.node_id AND m.label = 'MAJOR')
SELECT c.name AS career, j.name AS major, j.code FROM j JOIN pn c ON j.dst = c.node_id AND c.label = 'CAREER' WHERE NOT ok AND dst NOT IN (SELECT dst FROM j WHERE ok) AND lower(j.name) NOT IN (SELECT lower(name) FROM pn WHERE label = 'MAJOR' AND regexp_full_match(code, '[0-9]+'))""")
_CC = """li AS (SELECT DISTINCT e.dst AS node_id, m.code, lower(m.name) AS k FROM pe e JOIN pn m ON e.src = m.node_id AND m.label = 'MAJOR' WHERE e.rel_type = 'LEADS_TO'),
di AS (SELECT node_id, string_agg(DISTINCT code, '|' ORDER BY code) AS codes FROM li WHERE regexp_full_match(code, '[0-9]+') GROUP BY node_id),
na AS (SELECT li.node_id, string_agg(DISTINCT g.code, '|' ORDER BY g.code) AS codes FROM li JOIN pn g ON g.label = 'MAJOR' AND lower(g.name) = li.k AND regexp_full_match(g.code, '[0-9]+') WHERE NOT coalesce(regexp_full_match(li.code, '[0-9]+'), false) GROUP BY li.node_id),
cc AS (SELECT c.node_id, c.name, coalesce(di.codes, na.codes, '') AS codes, di.codes IS NULL AND na.codes IS NOT NULL AS by_name FROM pn c LEFT JOIN di ON c.node_id = di.node_id LEFT JOIN na ON c.node_id = na.node_id WHERE c.label = 'CAREER')"""
_add("career_major_codes", lambda s, d: repair.career_codes(*planted(s, d)).select("node_id", "name", joined("codes").alias("codes"), "by_name"), _p("").rstrip() + f", {_CC} SELECT * FROM cc")
_add("career_code_totals", lambda s, d: repair.code_totals(repair.career_codes(*planted(s, d))), _p("").rstrip() + f", {_CC} SELECT count(*) AS careers, sum(CASE WHEN codes = '' THEN 0 ELSE len(string_split(codes, '|')) END)::BIGINT AS codes, count(*) FILTER (codes = '') AS empty FROM cc")


def queries() -> dict:
    return Q


def oracle_sql() -> dict[str, str]:
    return S
