"""Aggregate questions over a graph (nodes, edges), and how a question is recognised as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.model import AGGREGATIONS


def _ends(nodes: DataFrame, edges: DataFrame, rel_type: str) -> DataFrame:
    """Distinct (src, dst) of a relationship type: parallel edges count once, and the pairs are pre-aggregated before any join."""
    return edges.filter(F.col("rel_type") == rel_type).select("src", "dst").distinct()


def _named(nodes: DataFrame, label: str, id_col: str, name: str) -> DataFrame:
    return nodes.filter(F.col("label") == label).select(F.col("node_id").alias(id_col), F.col("name").alias(name), "code")


def top_by_count(nodes: DataFrame, edges: DataFrame, rel_type: str, label: str, side: str, k: int | None) -> DataFrame:
    """(name, code, n): nodes of a label by the number of distinct neighbours over one relationship type; side is the label's end."""
    other = "dst" if side == "src" else "src"
    n = edges.filter(F.col("rel_type") == rel_type).groupBy(side).agg(F.count_distinct(other).alias("n"))
    rows = n.join(_named(nodes, label, side, "name"), side).orderBy(F.desc("n"), "name", side)
    return (rows.limit(k) if k else rows).select("name", "code", "n")


def subjects_in_all_majors(nodes: DataFrame, edges: DataFrame, share: float = 1.0, k: int | None = None) -> DataFrame:
    """(name, code, n): subjects offered by at least int(total * share) majors; exactly all of them for share 1."""
    total = nodes.filter("label = 'MAJOR'").agg(F.count_distinct("node_id").alias("total"))
    n = _ends(nodes, edges, "OFFERS").groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    need = total.scalar() if share == 1.0 else (total.scalar() * share).cast("int")
    hit = n.filter(F.col("n") == need if share == 1.0 else F.col("n") >= need)
    rows = hit.join(_named(nodes, "SUBJECT", "dst", "name"), "dst")
    return (rows.orderBy(F.desc("n"), "name", "dst").limit(k) if k else rows).select("name", "code", "n")


def subjects_all_or_most(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Subjects in all majors; only if there are none, those in four fifths (30 at most)."""
    every = subjects_in_all_majors(nodes, edges)
    found = every.agg(F.count(F.lit(1)).alias("c"))
    return every.unionByName(subjects_in_all_majors(nodes, edges, 0.8, 30).filter(found.scalar() == 0))


def subjects_shared(nodes: DataFrame, edges: DataFrame, k: int = 50) -> DataFrame:
    """(name, code, majors, n): subjects of at least two majors with the lower-case names of these."""
    pairs = _ends(nodes, edges, "OFFERS").join(_named(nodes, "MAJOR", "src", "major").drop("code"), "src")
    n = pairs.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(F.lower("major"))), "|").alias("majors")).filter("n >= 2")
    return n.join(_named(nodes, "SUBJECT", "dst", "name"), "dst").orderBy(F.desc("n"), "name", "dst").limit(k).select("name", "code", "majors", "n")


def asked_entity(question: Column) -> Column:
    """The label a counting question asks for."""
    q = F.lower(question)
    has = lambda *xs: F.greatest(*[F.contains(q, F.lit(x)) for x in xs]) if len(xs) > 1 else F.contains(q, F.lit(xs[0]))
    return F.when(has("ngành"), "MAJOR").when(has("nghề"), "CAREER").when(has("kỹ năng", "skill"), "SKILL").when(has("giảng viên"), "TEACHER").otherwise("SUBJECT")


def count_entities(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, label, n) for (question_id, query) rows."""
    n = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return questions.select("question_id", asked_entity(F.col("query")).alias("label")).join(n, "label", "left").select("question_id", "label", F.coalesce("n", F.lit(0)).alias("n"))


def detect_aggregation(question: Column) -> Column:
    """The first aggregation whose pattern is found in the question, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(AGGREGATIONS):
        out = F.when(question.rlike(f"(?iuU){pattern}"), name).otherwise(out)
    return out


def asked_label(agg: Column) -> Column:
    """The label an aggregation reports about, by the words in its name."""
    return (
        F.when(F.contains(agg, F.lit("subject")), "SUBJECT").when(F.contains(agg, F.lit("major")), "MAJOR").when(F.contains(agg, F.lit("career")), "CAREER").when(F.contains(agg, F.lit("skill")), "SKILL").otherwise("UNKNOWN")
    )


def meta_text(agg: Column, n: Column) -> Column:
    """What an aggregation's count counts, in words."""
    unit = F.when(agg == "major_most_subjects", "môn học").when(agg == "career_most_skills", "kỹ năng").when(agg.isin("subject_most_majors", "subject_intersection_two"), "ngành").when(agg == "skill_most_subjects", "môn học")
    return F.when(unit.isNotNull(), F.concat_ws(" ", n.cast("string"), unit)).otherwise(F.lit(""))


def most_frequent(rows: DataFrame, by: str, *keys: str) -> DataFrame:
    """The most frequent value of ``by``; ties by value."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(1)


def first_of(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key; the rank limit is pushed below the shuffle by Spark (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")
