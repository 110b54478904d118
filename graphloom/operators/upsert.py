"""Merging repeated node and edge records: what an ordered series of upserts would leave, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import has
from graphloom.model import FOLDER_ORDER


def ingest_seq(folder: Column, *rest: str) -> Column:
    """The order in which records arrive: folder, then file name, then position."""
    rank = F.coalesce(*[F.when(folder == f, F.lit(i)) for i, f in enumerate(FOLDER_ORDER)], F.lit(len(FOLDER_ORDER)))
    return F.struct(rank.alias("folder"), *rest)


def last_wins(records: DataFrame, key: str, values: list[str], seq: str = "seq") -> DataFrame:
    """One row per non-empty key with the values of its last record, empty and null ones too."""
    last = F.max_by(F.struct(*values), seq)
    return records.filter(has(key)).groupBy(key).agg(last.alias("v")).select(key, *[F.col(f"v.{c}").alias(c) for c in values])


def last_nonempty_wins(records: DataFrame, key: str, values: list[str], seq: str = "seq") -> DataFrame:
    """One row per non-empty key; each value is the last non-empty one."""
    last = [F.max_by(F.when(has(c), F.col(c)), F.when(has(c), F.col(seq))).alias(c) for c in values]
    return records.filter(has(key)).groupBy(key).agg(*last)


def merge_edges(rels: DataFrame, ends: list[str], props: list[str], seq: str = "seq") -> DataFrame:
    """Edges as merges leave them: different properties are parallel edges, equal ones are one.

    An edge without any property is only made if it comes before all edges with properties between the same ends of that type.
    """
    bare = F.lit(True)
    for p in props:
        bare = bare & ~has(p)
    e = rels.filter(~F.exists(F.array(*ends), lambda x: x.isNull())).withColumn("bare", bare)
    clean = [F.when(has(p), F.col(p)).alias(p) for p in props]
    one = e.select(*ends, *clean, "bare", seq).groupBy(*ends, *props, "bare").agg(F.min(seq).alias("first"))
    rich = one.filter("not bare").groupBy(*ends).agg(F.min("first").alias("rich"))
    kept = one.join(rich, ends, "left").filter(~F.col("bare") | F.col("rich").isNull() | (F.col("first") < F.col("rich")))
    return kept.select(*ends, *props)


def resolve(rels: DataFrame, nodes: DataFrame, label: str, key: str, out: str) -> DataFrame:
    """rels with the node id of the end that the columns ``label`` and ``key`` name; keys shared by several nodes fan out, unknown ones drop out."""
    ids = nodes.filter(has("entity_key")).select(F.col("label").alias(label), F.col("entity_key").alias(key), F.col("node_id").alias(out))
    return rels.join(ids, [label, key])
