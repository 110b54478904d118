"""Finding and merging duplicate majors, and the codes that careers derive from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.aggregate import most_frequent

VALID = r"^[0-9]+$"


def _valid(c: str) -> Column:
    return F.coalesce(F.col(c).rlike(VALID), F.lit(False))


def code_status(nodes: DataFrame) -> DataFrame:
    """(node_id, name, code, status) of majors: NO CODE, VALID_CODE, CODE_IS_NAME or OTHER, the first that applies."""
    status = F.when(F.col("code").isNull() | (F.col("code") == ""), "NO CODE").when(_valid("code"), "VALID_CODE").when(F.col("code") == F.col("name"), "CODE_IS_NAME").otherwise("OTHER")
    return nodes.filter("label = 'MAJOR'").select("node_id", "name", "code", status.alias("status"))


def usable_codes(majors: Column) -> Column:
    """Of an array of (name, code) structs those whose code says something and isn't the name: what a client may show, valid or not."""
    return F.filter(majors, lambda m: F.coalesce((m["code"] != "") & (m["code"] != F.coalesce(m["name"], F.lit(""))), F.lit(False)))


def duplicate_names(nodes: DataFrame) -> DataFrame:
    """(name, n): major names borne by more than one node, case-sensitive."""
    return nodes.filter("label = 'MAJOR'").groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def duplicate_pairs(nodes: DataFrame) -> DataFrame:
    """(bad, good): a major whose code is its name, and each major with a valid code of the same name, case aside; never itself."""
    m = nodes.filter("label = 'MAJOR'")
    good = m.filter(_valid("code")).select(F.col("node_id").alias("good"), F.lower("name").alias("k"))
    bad = m.filter(F.col("code") == F.col("name")).select(F.col("node_id").alias("bad"), F.lower("name").alias("k"))
    return bad.join(good, "k").filter("bad <> good").select("bad", "good")


def merge_majors(nodes: DataFrame, edges: DataFrame, gate: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with the edges of duplicate majors moved to their twins, properties kept, and the duplicates gone.

    Edges of every type move, inbound ones too; equal edges become one. With the gate, nothing happens unless some name is borne twice
    in the same case (checked in the plan, without collecting anything).
    """
    pairs = duplicate_pairs(nodes)
    if gate:
        pairs = pairs.filter(duplicate_names(nodes).agg(F.count(F.lit(1)).alias("c")).scalar() > 0)
    moved = edges
    for end in ("src", "dst"):
        moved = moved.join(pairs.withColumnRenamed("bad", end), end, "left").withColumn(end, F.coalesce("good", end)).drop("good")
    props = [c for c in edges.columns if c != "edge_id"]
    gone = pairs.select(F.col("bad").alias("node_id")).distinct()
    return nodes.join(gone, "node_id", "left_anti"), moved.select(*props).distinct()


def verify_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, code, careers, subjects) of every major; each branch is aggregated before it is joined."""
    n = lambda kind, a: edges.filter(F.col("rel_type") == kind).groupBy(F.col("src").alias("node_id")).agg(F.count_distinct("dst").alias(a))
    m = nodes.filter("label = 'MAJOR'").join(n("LEADS_TO", "careers"), "node_id", "left").join(n("OFFERS", "subjects"), "node_id", "left")
    return m.select("name", "code", F.coalesce("careers", F.lit(0)).alias("careers"), F.coalesce("subjects", F.lit(0)).alias("subjects"))


def career_direction(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(direction, rel_type, n): major to career if LEADS_TO edges do so, else the most frequent type from career to major."""
    kinds = nodes.select("node_id", "label")
    e = edges.join(kinds.toDF("src", "a"), "src").join(kinds.toDF("dst", "b"), "dst")
    there = e.filter("rel_type = 'LEADS_TO' and a = 'MAJOR' and b = 'CAREER'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("MAJOR_TO_CAREER").alias("direction"), F.lit("LEADS_TO").alias("rel_type"), "n").filter("n > 0")
    back = most_frequent(e.filter("a = 'CAREER' and b = 'MAJOR'"), "rel_type").select(F.lit("CAREER_TO_MAJOR").alias("direction"), "rel_type", "n")
    return there.unionByName(back).orderBy(F.desc("direction")).limit(1)


def career_codes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, name, codes): the valid codes of the majors that lead to each career, in order; [] if there is none.

    A career without codes gets, as a fallback, those of majors with a valid code that bear the name of a major that leads to it.
    """
    majors = nodes.filter("label = 'MAJOR'").select(F.col("node_id").alias("src"), "code", F.lower("name").alias("k"))
    links = edges.filter("rel_type = 'LEADS_TO'").select("src", F.col("dst").alias("node_id")).distinct().join(majors, "src")
    direct = links.filter(_valid("code")).groupBy("node_id").agg(F.array_sort(F.collect_set("code")).alias("direct"))
    good = majors.filter(_valid("code")).select("k", F.col("code").alias("good"))
    named = links.filter(~_valid("code")).select("node_id", "k").distinct().join(good, "k").groupBy("node_id").agg(F.array_sort(F.collect_set("good")).alias("named"))
    c = nodes.filter("label = 'CAREER'").join(direct, "node_id", "left").join(named, "node_id", "left")
    return c.select("node_id", "name", F.coalesce("direct", "named", F.expr("cast(array() as array<string>)")).alias("codes"), (F.col("direct").isNull() & F.col("named").isNotNull()).alias("by_name"))


def unresolved_majors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(career, major, code): of careers to which no major with a valid code leads, the majors that lead there and for whose name no valid code is known."""
    majors = nodes.filter("label = 'MAJOR'").select(F.col("node_id").alias("src"), F.col("name").alias("major"), "code", F.lower("name").alias("k"))
    links = edges.filter("rel_type = 'LEADS_TO'").select("src", F.col("dst").alias("node_id")).distinct().join(majors, "src")
    direct = links.filter(_valid("code")).select("node_id").distinct()
    known = majors.filter(_valid("code")).select("k").distinct()
    lost = links.filter(~_valid("code")).join(direct, "node_id", "left_anti").join(known, "k", "left_anti")
    return lost.join(nodes.filter("label = 'CAREER'").select("node_id", F.col("name").alias("career")), "node_id").select("career", "major", "code")


def code_totals(careers: DataFrame) -> DataFrame:
    """One row: careers, codes in all, careers without one."""
    return careers.agg(F.count(F.lit(1)).alias("careers"), F.coalesce(F.sum(F.size("codes")), F.lit(0)).alias("codes"), F.coalesce(F.sum((F.size("codes") == 0).cast("int")), F.lit(0)).alias("empty"))
