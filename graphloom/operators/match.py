"""Typed one- and two-hop patterns, started from keywords: a list of steps becomes a chain of equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import TEMPLATES
from graphloom.operators.aggregate import first_of
from graphloom.operators.containing import named

#: Rows reported per keyword.
PER_KEYWORD = 50


def starts(nodes: DataFrame, keywords: DataFrame, label: str, by_code: bool, size: tuple[bool, bool] | None = None) -> DataFrame:
    """(kw, kw_pos, node_id, name): nodes of a label whose name contains a keyword (any case; an empty one is in every name), or whose code is it."""
    return named(nodes.filter(F.col("label") == label), keywords, by_code, size).select("kw", "kw_pos", "node_id", "name")


def match(nodes: DataFrame, edges: DataFrame, keywords: DataFrame, start: str, asked: str, limit: int | None = PER_KEYWORD, size: tuple[bool, bool] | None = None) -> DataFrame:
    """(kw, kw_pos, name, label, code, node_id, rel_types, node_names, hops), one row per chain of edges (bags: parallel edges repeat).

    ``keywords``: (kw, kw_pos). Per keyword the first ``limit`` rows by name, node_id, path. Labels without a pattern raise KeyError.
    ``size``: of the keywords, as in ``named``.
    """
    steps, by_code, begins = TEMPLATES[start, asked]
    rows = starts(nodes, keywords, start, by_code, size).select("kw", "kw_pos", F.col("node_id").alias("at"), F.array("name").alias("names"))
    names = nodes.select(F.col("node_id").alias("at"), F.col("name").alias("n_name"), F.col("label").alias("n_label"), F.col("code").alias("n_code"))
    for i, (kind, way) in enumerate(steps):
        e = edges.filter(F.col("rel_type") == kind)
        e = e.select(F.col("src").alias("at"), F.col("dst").alias("next")) if way == ">" else e.select(F.col("dst").alias("at"), F.col("src").alias("next"))
        rows = rows.join(e, "at").select("kw", "kw_pos", F.col("next").alias("at"), "names")
        rows = rows.join(names, "at").withColumn("names", F.concat("names", F.array("n_name")))
        rows = rows if i == len(steps) - 1 else rows.drop("n_name", "n_label", "n_code")
    kinds = [k for k, _ in steps]
    path = F.col("names") if begins == "start" else F.reverse("names")
    kinds = kinds if begins == "start" else kinds[::-1]
    code = F.col("n_code") if asked in ("MAJOR", "SUBJECT") else F.lit(None).cast("string")
    out = rows.filter(F.col("n_label") == asked).select("kw", "kw_pos", F.col("n_name").alias("name"), F.col("n_label").alias("label"), code.alias("code"), F.col("at").alias("node_id"), F.array(*map(F.lit, kinds)).alias("rel_types"), path.alias("node_names"), F.lit(len(steps)).alias("hops"))
    return first_of(out, ["kw", "kw_pos"], ["name", "node_id", F.array_join("node_names", "|")], limit) if limit else out


def path_steps(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., from_node, to_node, relation, hop) of each step of (node_names, rel_types), in path order; a missing name is ''."""
    step = rows.select(*keep, "node_names", F.posexplode("rel_types").alias("i", "relation"))
    at = lambda i: F.coalesce(F.get("node_names", i), F.lit(""))
    return step.select(*keep, at(F.col("i")).alias("from_node"), at(F.col("i") + 1).alias("to_node"), "relation", (F.col("i") + 1).alias("hop"))
