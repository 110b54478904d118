"""Validating, repairing and classifying documents of extracted nodes and relationships.

Works on two long tables: nodes (doc_id, doctype, file_name, pos, type, key, name) and rels (doc_id, rel_id, rel_type, endpoint
columns). Rules are joins and filters; a faulty row never ends a run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import has
from graphloom.model import DOC_PREFIX, KG_DOCUMENT, NODE_KEY, NODE_NAME, NODES_BY_DOCTYPE, REL_TYPES


def doc_id(folder: Column, file_name: Column) -> Column:
    """CUR-/CAR-/SYL-/DOC- and the file's stem."""
    m = F.create_map(*[F.lit(x) for k, v in DOC_PREFIX.items() for x in (k, v)])
    return F.concat(F.coalesce(F.try_element_at(m, folder), F.lit("DOC")), F.lit("-"), F.regexp_replace(F.regexp_extract(file_name, r"([^/]*)$", 1), r"\.[^.]*$", ""))


def doctype_of(doc: Column) -> Column:
    """The kind of document by the prefix of its id."""
    out = F.lit(None).cast("string")
    for kind, prefix in DOC_PREFIX.items():
        out = F.when(doc.startswith(f"{prefix}-"), kind).otherwise(out)
    return out


def explode_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, rels) of documents (doc_id, doctype, file_name, nodes, relationships)."""
    n = docs.select("doc_id", "doctype", "file_name", F.posexplode_outer("nodes").alias("pos", "n")).filter("n is not null")
    key = F.coalesce(*[F.when(F.col("n.type") == t, F.col(f"n.{k}")) for t, k in NODE_KEY.items()])
    name = F.coalesce(*[F.when(F.col("n.type") == t, F.col(f"n.{k}")) for t, k in NODE_NAME.items()])
    nodes = n.select("doc_id", "doctype", "file_name", "pos", F.col("n.type").alias("type"), key.alias("key"), name.alias("name"), "n")
    rels = docs.select("doc_id", F.posexplode_outer("relationships").alias("rel_id", "r")).filter("r is not null").select("doc_id", "rel_id", "r.*")
    return nodes, rels


def allowed(doctype: Column, kind: Column) -> Column:
    out = F.lit(False)
    for d, kinds in NODES_BY_DOCTYPE.items():
        out = out | ((doctype == d) & kind.isin(kinds))
    return F.coalesce(out, F.lit(False))


def endpoints(rels: DataFrame) -> DataFrame:
    """(doc_id, rel_id, rel_type, side, column, label, key): both ends of each relationship of a known type."""
    parts = []
    for kind, (_, la, ca, lb, cb) in REL_TYPES.items():
        r = rels.filter(F.col("rel_type") == kind)
        both = F.array(*[F.struct(F.lit(side).alias("side"), F.lit(col).alias("column"), F.lit(label).alias("label"), F.col(col).alias("key")) for side, label, col in (("from", la, ca), ("to", lb, cb))])
        parts.append(r.select("doc_id", "rel_id", "rel_type", F.explode(both).alias("e")))
    return reduce(DataFrame.unionByName, parts).select("doc_id", "rel_id", "rel_type", "e.*")


def validate(nodes: DataFrame, rels: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """(doc_id, error, detail), one row per fault.

    bad_type, missing_key, missing_name of nodes; bad_rel_type and missing_endpoint of relationships. Endpoints are looked up among
    all nodes of the document, valid or not, and among ``shared`` (label, key), nodes that every document may refer to. Documents
    without nodes have the single fault no_nodes.
    """
    ok = allowed(F.col("doctype"), F.col("type"))
    n1 = nodes.filter(~ok).select("doc_id", F.lit("bad_type").alias("error"), F.coalesce("type", F.lit("")).alias("detail"))
    typed = nodes.filter(ok)
    n2 = typed.filter(~has("key")).select("doc_id", F.lit("missing_key").alias("error"), F.col("type").alias("detail"))
    n3 = typed.filter(~has("name")).select("doc_id", F.lit("missing_name").alias("error"), F.col("type").alias("detail"))
    with_nodes = nodes.select("doc_id").distinct()
    held = rels.join(with_nodes, "doc_id", "left_semi")
    r1 = held.filter(~F.coalesce(F.col("rel_type").isin(list(REL_TYPES)), F.lit(False))).select("doc_id", F.lit("bad_rel_type").alias("error"), F.coalesce("rel_type", F.lit("")).alias("detail"))
    keys = nodes.filter(has("key")).select("doc_id", F.col("type").alias("label"), "key").distinct()
    ends = endpoints(held)
    lost = ends.join(keys, ["doc_id", "label", "key"], "left_anti")
    if shared is not None:
        lost = lost.join(shared.select("label", "key").distinct(), ["label", "key"], "left_anti")
    r2 = lost.select("doc_id", F.lit("missing_endpoint").alias("error"), F.concat_ws(":", "rel_type", "column", F.coalesce("key", F.lit(""))).alias("detail"))
    none = rels.select("doc_id").distinct().join(with_nodes, "doc_id", "left_anti").select("doc_id", F.lit("no_nodes").alias("error"), F.lit("").alias("detail"))
    return reduce(DataFrame.unionByName, [n1, n2, n3, r1, r2, none])


def repair_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of an allowed type with a key and a name."""
    return nodes.filter(allowed(F.col("doctype"), F.col("type")) & has("key") & has("name"))


def repair_rels(nodes: DataFrame, rels: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """Relationships of a known type both of whose ends are clean nodes of the same document (or shared ones)."""
    clean = repair_nodes(nodes).select("doc_id", F.col("type").alias("label"), "key").distinct()
    ends = endpoints(rels)
    good = ends.join(clean, ["doc_id", "label", "key"], "left_semi")
    if shared is not None:
        # an end is good in one way only, so nothing is counted twice
        rest = ends.join(clean, ["doc_id", "label", "key"], "left_anti").join(shared.select("label", "key").distinct(), ["label", "key"], "left_semi")
        good = good.unionByName(rest.select(*good.columns))
    both = good.groupBy("doc_id", "rel_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 2")
    return rels.join(both.select("doc_id", "rel_id"), ["doc_id", "rel_id"], "left_semi")


def status(docs: DataFrame, nodes: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(doc_id, status): skip if the document was done before, error if it has no clean node, else ok."""
    clean = repair_nodes(nodes).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    out = docs.select("doc_id").distinct().join(clean, "doc_id", "left")
    skip = F.lit(False)
    if done is not None:
        out = out.join(done.select("doc_id").distinct().withColumn("done", F.lit(True)), "doc_id", "left")
        skip = F.coalesce("done", F.lit(False))
    return out.select("doc_id", F.when(skip, "skip").when(F.coalesce("n", F.lit(0)) > 0, "ok").otherwise("error").alias("status"))


def status_counts(statuses: DataFrame) -> DataFrame:
    """(doctype, ok, skip, error), the total as doctype 'total'."""
    s = statuses.withColumn("doctype", F.coalesce(doctype_of(F.col("doc_id")), F.lit("other")))
    n = [F.count(F.when(F.col("status") == x, 1)).alias(x) for x in ("ok", "skip", "error")]
    return s.rollup("doctype").agg(*n).withColumn("doctype", F.coalesce("doctype", F.lit("total")))


def detect_schema(nodes: DataFrame, rels: DataFrame) -> DataFrame:
    """(doc_id, schema) from what a document holds: career before syllabus before curriculum, else unknown."""
    n = nodes.groupBy("doc_id").agg(*[F.bool_or(F.coalesce(F.col("type") == t, F.lit(False))).alias(t) for t in ("CAREER", "TEACHER", "MAJOR")])
    r = rels.groupBy("doc_id").agg(*[F.bool_or(F.coalesce(F.col("rel_type") == t, F.lit(False))).alias(t) for t in ("career_requires_skill", "teacher_instructs_subject", "major_offers_subject")])
    j = n.join(r, "doc_id", "full")
    any_of = lambda a, b: F.coalesce(F.col(a), F.lit(False)) | F.coalesce(F.col(b), F.lit(False))
    return j.select("doc_id", F.when(any_of("CAREER", "career_requires_skill"), "career").when(any_of("TEACHER", "teacher_instructs_subject"), "syllabus").when(any_of("MAJOR", "major_offers_subject"), "curriculum").otherwise("unknown").alias("schema"))


# What each schema loads in compatible mode; everything else is dropped.
LOADED = {
    "curriculum": (["MAJOR", "SUBJECT"], ["major_offers_subject"]),
    "syllabus": (["SUBJECT", "TEACHER"], ["teacher_instructs_subject"]),
    "career": (["CAREER", "SKILL"], ["career_requires_skill"]),
}


def compatible(nodes: DataFrame, rels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Only the node and relationship kinds that each document's schema loads."""
    schema = detect_schema(nodes, rels)
    keep = lambda i, c: F.coalesce(*[F.when(F.col("schema") == s, F.col(c).isin(v[i])) for s, v in LOADED.items()], F.lit(False))
    return tuple(df.join(schema, "doc_id").filter(keep(i, c)).drop("schema") for i, (df, c) in enumerate(((nodes, "type"), (rels, "rel_type"))))


def quarantine(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable, broken) of documents read with a _corrupt_record column."""
    if "_corrupt_record" not in docs.columns:
        return docs, docs.limit(0)
    return docs.filter("_corrupt_record is null").drop("_corrupt_record"), docs.filter("_corrupt_record is not null")


DOCUMENT = KG_DOCUMENT
