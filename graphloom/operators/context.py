"""Ranking and assembling what was retrieved into the context of an answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.model import COMMUNITIES
from graphloom.operators.aggregate import first_of

#: Path steps that the model sees, and that the record keeps.
CONTEXT_PATHS, RECORD_PATHS = 60, 20


def ranked(rows: DataFrame, negated: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys..., label, name, ..., position): one row per (label, name) with the fewest hops (0 counts as 99; ties by seq), in order of first appearance.

    ``rows`` needs label, name, hops, seq (what orders the list the rows stand for); ``keys`` separates questions. Rows whose name
    contains a negated keyword (any case; an empty one is in every name) are dropped.
    """
    keys = keys or []
    part = [*keys, "label", "name"]
    hops = F.coalesce(F.nullif("hops", F.lit(0)), F.lit(99))
    best = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*part).orderBy(hops, "seq"))).withColumn("first_seq", F.min("seq").over(Window.partitionBy(*part)))
    out = best.filter("_rn = 1").drop("_rn")
    for word in negated or []:
        out = out.filter(~F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit(word.lower())))
    return out


def negation_filter(rows: DataFrame, negated: str) -> DataFrame:
    """The same for a column of negated keywords per row."""
    name = F.lower(F.coalesce("name", F.lit("")))
    return rows.filter(~F.exists(F.coalesce(F.col(negated), F.array().cast("array<string>")), lambda x: F.contains(name, F.lower(x))))


def records(questions: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Result records: questions with retrieved_nodes, traversal_path and context_paths.

    ``nodes``: (query_id, position, name, label, code, hops); ``paths``: (query_id, seq, from, to, relation, hop). Nodes are numbered
    node001, ... in order; content is JSON with nulls kept; the first 20 path steps are recorded as traversal_path, the first 60 are for
    the model's context. Questions without nodes have empty lists.
    """
    content = F.to_json(F.struct("name", "label", "code", "hops"), {"ignoreNullFields": "false"})
    numbered = nodes.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy("position")))
    entry = F.struct("i", F.format_string("node%03d", "i").alias("node_id"), content.alias("content"), F.array("name").alias("entities"))
    by_node = numbered.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(x["node_id"].alias("node_id"), x["content"].alias("content"), x["entities"].alias("entities"))).alias("retrieved_nodes"))
    step = F.struct("seq", F.col("from"), F.col("to"), "relation", "hop")
    first = first_of(paths, ["query_id"], ["seq"], CONTEXT_PATHS)
    by_path = first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(step)), lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"), x["relation"].alias("relation"), x["hop"].alias("hop"))).alias("context_paths"))
    out = questions.join(by_node, "query_id", "left").join(by_path, "query_id", "left")
    empty_nodes = F.expr("cast(array() as array<struct<node_id:string,content:string,entities:array<string>>>)")
    empty_path = F.expr("cast(array() as array<struct<from:string,to:string,relation:string,hop:int>>)")
    out = out.withColumn("retrieved_nodes", F.coalesce("retrieved_nodes", empty_nodes)).withColumn("context_paths", F.coalesce("context_paths", empty_path))
    return out.withColumn("traversal_path", F.slice("context_paths", 1, RECORD_PATHS))


def prompt(records_df: DataFrame) -> DataFrame:
    """records_df with context, all that an answer may rest on.

    The JSON of the nodes and of the first 60 path steps; then, as far as records_df has these columns, what the answer is held to
    (answer_rule), what the asker doesn't want (negated), and the community that answers; and a hint if nothing was found.
    """
    body = F.to_json(F.struct(F.col("retrieved_nodes").alias("ranked_results"), F.col("context_paths").alias("traversal_paths")), {"ignoreNullFields": "false"})
    none = F.when(F.size("retrieved_nodes") == 0, "\n[no data was found in the graph: say so politely, add nothing]").otherwise("")
    parts = [body, none]
    if "answer_rule" in records_df.columns:
        parts.append(F.concat(F.lit("\n[rule] "), F.coalesce("answer_rule", F.lit(""))))
    if "negated" in records_df.columns:
        parts.append(F.when(F.size("negated") > 0, F.concat(F.lit("\n[leave out, the asker rejects] "), F.array_join("negated", "; "))).otherwise(""))
    if "community" in records_df.columns:
        about = F.create_map(*[F.lit(x) for c, (level, labels, kinds) in COMMUNITIES.items() for x in (c, f"level {level}: {', '.join(labels)} by {', '.join(kinds)}")])
        parts.append(F.concat(F.lit("\n[community] "), F.coalesce(F.try_element_at(about, F.col("community")), F.try_element_at(about, F.lit("L1_GLOBAL")))))
    return records_df.withColumn("context", F.concat(*parts))
