"""Ground-truth rows: skipping, converting, checking, numbering."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import split_list, strip
from graphloom.operators.reject_rows import COLUMNS, QUERY_TYPES

REQUIRED, OPTIONAL = COLUMNS[:6], COLUMNS[6:]
LISTS = ["gold_entities", "relevant_node_ids", "gold_path", "expected_communities"]


def clean_name(name: str) -> str:
    """A header's name without outer space, leading coloured circles, and the x or v that marks required and optional columns."""
    return re.sub(r"^[xv]\s+", "", name.strip().lstrip("\U0001f7e1\U0001f7e2 ").strip()).strip()


def missing_columns(columns: list[str]) -> list[str]:
    """Required columns that a file lacks."""
    have = {clean_name(c) for c in columns}
    return sorted(set(REQUIRED) - have)


def is_skipped(df: DataFrame) -> Column:
    """Blank, comment, header and example rows."""
    i = strip(F.coalesce("id", F.lit("")))
    blank = strip(F.concat_ws("", *[F.col(c).cast("string") for c in COLUMNS if c in df.columns])) == ""
    return blank | i.startswith("#") | (i == "id") | F.lower(i).startswith("vd")


def is_example(row_no: Column) -> Column:
    """The first data row, if its id is an example's."""
    i = F.lower(strip(F.coalesce("id", F.lit(""))))
    return (row_no == 1) & (i.startswith("vd") | F.contains(i, F.lit("q001")) | F.contains(i, F.lit("q002")))


def convert(rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Samples: stripped fields, lower-case type, lists, hop count, and errors (an array of texts; the row is kept all the same).

    A missing hop count is the gold path's length less one, 0 without a path; one that is no integer is 0 with an error.
    """
    r = rows.filter(~is_skipped(rows))
    text = {c: strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in COLUMNS if c in rows.columns}
    s = r.select(F.col(row_id), *[e.alias(c) for c, e in text.items()])
    kind = F.lower("query_type")
    lists = {c: split_list(c) for c in LISTS}
    hop = F.expr("try_cast(gold_hop_count as int)")
    lacking = [F.when(F.col(c) == "", F.lit(f"missing {c}")) for c in REQUIRED if c != "id"]
    s = s.withColumn("kind", kind).withColumn("p", lists["gold_path"]).withColumn("x", lists["expected_communities"])
    errors = F.array_compact(
        F.array(
            *lacking,
            F.when(~F.col("kind").isin(QUERY_TYPES), F.lit("bad query_type")),
            F.when((F.col("gold_hop_count") != "") & hop.isNull(), F.lit("bad gold_hop_count")),
            F.when((F.col("kind") == "global") & (F.size("x") == 0), F.lit("global without expected_communities")),
            F.when(F.col("kind").isin("single_hop", "multi_hop") & (F.size("p") == 0), F.lit("hop without gold_path")),
        )
    )
    hops = F.when(F.col("gold_hop_count") != "", F.coalesce(hop, F.lit(0))).otherwise(F.greatest(F.size("p") - 1, F.lit(0)))
    return s.select(row_id, "id", "query", F.col("kind").alias("query_type"), "ground_truth_answer", lists["gold_entities"].alias("gold_entities"), lists["relevant_node_ids"].alias("relevant_node_ids"), F.col("p").alias("gold_path"), hops.alias("gold_hop_count"), F.col("x").alias("expected_communities"), errors.alias("errors"))


def number_blank_ids(samples: DataFrame, row_id: str = "row_id") -> DataFrame:
    """samples with blank ids as q001, q002, ... in row order, and duplicate (whether another row has the same id).

    Numbers follow from a two-level prefix sum: rows are ranged by row order, partitions counted, and each counts on from the ones
    before, so no single task sees all blank rows. Rows that share a row_id are numbered one by one.
    """
    from graphloom.session import cut

    blank = samples.filter("id = ''")
    placed = cut(blank.repartitionByRange(row_id).sortWithinPartitions(row_id).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))  # one row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    auto = placed.join(F.broadcast(offsets), "part").withColumn("id", F.format_string("q%03d", F.col("before") + F.col("at") - F.col("first") + 1))
    numbered = samples.filter("id <> ''").unionByName(auto.select(*samples.columns))
    repeated = numbered.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit(True).alias("duplicate"))
    return numbered.join(repeated, "id", "left").withColumn("duplicate", F.coalesce("duplicate", F.lit(False)))


def type_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("query_type").agg(F.count(F.lit(1)).alias("n")).orderBy("query_type")
