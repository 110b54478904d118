"""From documents of extracted nodes and relationships to a property graph, end to end: one table of nodes, one of edges, totals per document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import has, strip
from graphloom.model import NODE_KEY, NODE_STRUCT, REL_ALIASES, REL_TYPES
from graphloom.operators import ingest
from graphloom.operators.upsert import ingest_seq, merge_edges, resolve

#: What identifies a node of each label, and which fields of a record give its properties.
IDENTITY = {
    "MAJOR": (["major_code"], {"name": "major_name_vi", "name_en": "major_name_en", "code": "major_code"}),
    "SUBJECT": (["subject_code"], {"name": "subject_name_vi", "name_en": "subject_name_en", "code": "subject_code"}),
    "SKILL": (["skill_name"], {"name": "skill_name", "skill_type": "skill_type"}),
    "CAREER": (["career_name_vi", "career_name_en"], {"name": "career_name_vi", "name_en": "career_name_en", "field_name": "field_name"}),
    "TEACHER": (["name"], {"name": "name", "email": "email", "title": "title"}),
}
#: Labels whose names are those of the last record, empty or not; elsewhere an empty value never replaces one that says something.
LAST_WINS = ["MAJOR", "SUBJECT"]
PROPS = ["name", "name_en", "code", "email", "title", "skill_type", "field_name"]
EDGE_PROPS = ["semester", "required_type", "required_level"]


def _text(df: DataFrame, field: str) -> Column:
    return strip(F.coalesce(F.col(field), F.lit(""))) if field in df.columns else F.lit("")


def node_records(nodes: DataFrame) -> DataFrame:
    """(doc_id, label, key, entity_key, properties..., seq) of node records (doc_id, type, the fields of a node, seq).

    key identifies the node ('' if the record lacks it); entity_key is what relationships call it. Values are stripped; a table may
    lack fields of other labels. Records of unknown types are left out.
    """
    by_label = lambda get: F.coalesce(*[F.when(F.col("type") == label, get(label)) for label in IDENTITY], F.lit(""))
    key = by_label(lambda label: F.coalesce(*[F.nullif(_text(nodes, f), F.lit("")) for f in IDENTITY[label][0]], F.lit("")))
    props = {p: by_label(lambda label, p=p: _text(nodes, IDENTITY[label][1][p]) if p in IDENTITY[label][1] else F.lit("")) for p in PROPS}
    out = nodes.filter(F.col("type").isin(list(IDENTITY))).select("doc_id", F.col("type").alias("label"), key.alias("key"), by_label(lambda label: _text(nodes, NODE_KEY[label])).alias("entity_key"), *[e.alias(p) for p, e in props.items()], "seq")
    return out.withColumn("name", F.when(F.col("label") == "CAREER", F.col("key")).otherwise(F.col("name")))


def load_nodes(records: DataFrame) -> DataFrame:
    """(node_id, label, entity_key, properties...): one node per label and key, as a series of upserts in the order of seq would leave it.

    One aggregation with partial sums, so a node with a third of all records is no hot spot. Records without a key load nothing.
    A property that no record has is null ('' where the last record of a major or subject says so).
    """

    def last(p: str) -> Column:
        ok = F.col("label").isin(LAST_WINS) | has(p) if p != "entity_key" else has(p)
        return F.max_by(F.when(ok, F.col(p)), F.when(ok, F.col("seq"))).alias(p)

    one = records.filter(has("key")).groupBy("label", "key").agg(*[last(p) for p in ("entity_key", *PROPS)])
    own = {p: [label for label, (_, props) in IDENTITY.items() if p in props] for p in PROPS}
    return one.select(F.concat_ws(":", "label", "key").alias("node_id"), "label", "entity_key", *[F.when(F.col("label").isin(own[p]), F.col(p)).alias(p) for p in PROPS])


def rel_records(rels: DataFrame) -> DataFrame:
    """(doc_id, rel_type, from_label, from_key, to_label, to_key, semester, required_type, required_level, seq): relationships in one shape.

    Every known spelling of a type is taken; of an unknown type, or without an end, from_key and to_key are ''. A semester that is no
    number is null.
    """
    canonical = F.create_map(*[F.lit(x) for kv in REL_ALIASES.items() for x in kv])
    r = rels.withColumn("canonical", F.try_element_at(canonical, F.col("rel_type")))
    pick = lambda i: F.coalesce(*[F.when(F.col("canonical") == t[0], _text(rels, t[i])) for t in REL_TYPES.values()], F.lit(""))
    label = lambda i: F.coalesce(*[F.when(F.col("canonical") == t[0], F.lit(t[i])) for t in REL_TYPES.values()])
    offers, requires = F.col("canonical") == "OFFERS", F.col("canonical") == "REQUIRES"
    return r.select(
        "doc_id", F.col("canonical").alias("rel_type"), label(1).alias("from_label"), pick(2).alias("from_key"), label(3).alias("to_label"), pick(4).alias("to_key"),
        F.when(offers & _text(rels, "semester").rlike(r"^[+-]?[0-9]+$"), _text(rels, "semester").try_cast("int").cast("string")).alias("semester"),
        F.when(offers, F.nullif(_text(rels, "required_type"), F.lit(""))).alias("required_type"), F.when(requires, F.nullif(_text(rels, "required_level"), F.lit(""))).alias("required_level"), "seq",
    )


def load_edges(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, src, dst, rel_type, semester, required_type, required_level) of relationship records whose both ends are ``nodes``.

    Repeated relationships are merged before the ends are looked up, so a hot end costs as many rows as it has different edges. A key
    that several nodes share leads to each of them. Edges with different properties are parallel; see upsert.merge_edges.
    """
    ends = ["rel_type", "from_label", "from_key", "to_label", "to_key"]
    once = records.filter(has("rel_type") & has("from_key") & has("to_key")).groupBy(*ends, *EDGE_PROPS).agg(F.min("seq").alias("seq"))
    both = resolve(resolve(once, nodes, "from_label", "from_key", "src"), nodes, "to_label", "to_key", "dst")
    e = merge_edges(both, ["src", "dst", "rel_type"], EDGE_PROPS)
    digest = F.md5(F.concat_ws("\x1f", "src", "dst", "rel_type", *[F.coalesce(p, F.lit("\x00")) for p in EDGE_PROPS]))
    return e.select(digest.alias("edge_id"), "src", "dst", "rel_type", F.col("semester").cast("int").alias("semester"), "required_type", "required_level")


def totals(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """(doc_id, nodes_ok, nodes_failed, rels_ok, rels_failed): records of each document that have what loading needs, and those that lack it."""
    ok = has("key")
    n = nodes.select("doc_id", ok.cast("int").alias("a"), (~ok).cast("int").alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d"))
    ok = has("rel_type") & has("from_key") & has("to_key")
    r = rels.select("doc_id", F.lit(0).alias("a"), F.lit(0).alias("b"), ok.cast("int").alias("c"), (~ok).cast("int").alias("d"))
    return n.unionByName(r).groupBy("doc_id").agg(*[F.sum(x).alias(y) for x, y in zip("abcd", ("nodes_ok", "nodes_failed", "rels_ok", "rels_failed"))])


def document_records(n: DataFrame, r: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node records, relationship records) of ingest.explode_documents' tables; records arrive by kind of document, file name and place."""
    kind = docs.select("doc_id", F.col("doctype").alias("_kind"), F.col("file_name").alias("_file")).distinct()
    fields = [f.name for f in NODE_STRUCT.fields if f.name != "type"]
    n = n.select("doc_id", "type", *[F.col(f"n.{f}").alias(f) for f in fields], ingest_seq(F.col("doctype"), "file_name", "pos").alias("seq"))
    r = r.join(kind, "doc_id").withColumn("seq", ingest_seq(F.col("_kind"), F.col("_file").alias("file_name"), "rel_id")).drop("_kind", "_file")
    return node_records(n), rel_records(r)


def load(docs: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, totals) of documents (doc_id, doctype, file_name, nodes, relationships); unreadable ones are to be put aside before.

    With ``compat`` only the kinds that each document's schema loads count. A document of null arrays loads nothing; an empty table
    gives empty results.
    """
    n, r = ingest.explode_documents(docs)
    if compat:
        n, r = ingest.compatible(n, r)
    nr, rr = document_records(n, r, docs)
    nodes = load_nodes(nr)
    return nodes, load_edges(rr, nodes), totals(nr, rr)


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """Node records of several tables, each with its own fields."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
