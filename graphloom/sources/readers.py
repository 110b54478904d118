"""Readers: documents of extracted nodes, ground-truth files, results, graphs. Schemas are fixed; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.model import KG_DOCUMENT, PLAIN_GRAPH, RESULT
from graphloom.operators.dataset import clean_name, is_example
from graphloom.operators.ingest import doc_id
from graphloom.operators.reject_rows import COLUMNS, load_rows, reject_rows


def json_documents(spark: SparkSession, path: str, schema: T.StructType = KG_DOCUMENT) -> DataFrame:
    """Every .json below ``path``, one document per file: (doc_id, folder, file_name, fields..., _corrupt_record).

    Unreadable files stay as rows with _corrupt_record set, for quarantine; other extensions are not listed.
    """
    kept = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    df = spark.read.schema(kept).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    name, where = F.col("_metadata.file_name"), F.col("_metadata.file_path")
    folder = F.regexp_extract(where, r"([^/]+)/[^/]+$", 1)
    return df.select(doc_id(folder, name).alias("doc_id"), folder.alias("folder"), name.alias("file_name"), "*")


def pending(docs: DataFrame, done: DataFrame) -> DataFrame:
    """Documents that have no output yet."""
    return docs.join(done.select("doc_id").distinct(), "doc_id", "left_anti")


_HEAD = r'(?i)\A\s*"?(?:x\s+)?id"?\s*,'


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, raw_id, raw_text): the records of ground-truth files after their header line, wherever that is; a record may hold line breaks.

    Each file is read whole and cut at line breaks outside quotes. Everything before the first line that begins with ``id,`` (or ``x id,``) is
    preamble. A byte-order mark is dropped. raw_id is the record's number in its file.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.regexp_replace("value", r"\A﻿", "").alias("t"))
    body = F.regexp_replace("t", r"(?is)\A.*?(?:^|(?<=\n))(?=\s*\"?(?:x\s+)?id\"?\s*,)", "")
    lines = files.select("file_name", F.posexplode(F.regexp_extract_all(body, F.lit(r'((?:[^"\n]++|"[^"]*+(?:"|\z))++)(?:\n|\z)'), F.lit(1))).alias("raw_id", "raw_text"))
    return lines.filter(F.col("raw_id") > 0).withColumn("raw_id", F.col("raw_id").cast("long"))


def ground_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of ground-truth CSV files: twelve columns as strings, and (raw_id, reason) of records that don't conform.

    The record right below the header is passed over if its id is an example's.
    """
    raw = csv_records(spark, path).withColumn("id", F.regexp_extract("raw_text", r'\A\s*"?([^,"]*)', 1))
    keyed = raw.filter(~is_example(F.col("raw_id"))).drop("id").withColumn("key", F.xxhash64("file_name", "raw_id"))
    return load_rows(keyed, "key").withColumnRenamed("raw_id", "row_id"), reject_rows(keyed, "key")


def header(columns: list[str]) -> list[str]:
    return [clean_name(c) for c in columns]


SAMPLE = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("id", "query_id", "query", "query_type", "ground_truth_answer")],
        *[T.StructField(c, T.ArrayType(T.StringType())) for c in ("gold_entities", "relevant_node_ids", "gold_path", "expected_communities")],
        T.StructField("gold_hop_count", T.IntegerType()),
    ]
)


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Dataset files: a list of samples, or an object whose ``samples`` is one; query_id stands in for a missing id."""
    wrapped = T.StructType([*SAMPLE.fields, T.StructField("samples", T.ArrayType(SAMPLE))])
    df = spark.read.schema(wrapped).option("multiLine", True).json(path)
    flat = df.select(F.explode(F.coalesce("samples", F.array(F.struct(*[F.col(f.name) for f in SAMPLE.fields])))).alias("s")).select("s.*")
    return flat.withColumn("id", F.coalesce("id", "query_id")).drop("query_id")


def results(spark: SparkSession, path: str) -> DataFrame:
    """Result files *_result.json, one per query_id: of several the last by file name."""
    df = spark.read.schema(RESULT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_result.json").json(path)
    df = df.select("*", F.col("_metadata.file_name").alias("file_name"))
    cols = [f.name for f in RESULT.fields if f.name != "query_id"]
    return df.groupBy("query_id").agg(F.max_by(F.struct(*cols), "file_name").alias("r")).select("query_id", "r.*")


def plain_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((node_id), (src, dst, rel_type)) of a graph file; a node is its id or an object with one, edges may say source or from, target or to, relation or type.

    Ends of edges are nodes, too, whether listed or not.
    """
    df = spark.read.schema(PLAIN_GRAPH).option("multiLine", True).json(path)
    e = df.select(F.explode("edges").alias("e"))
    get = lambda *ks: F.coalesce(*[F.col("e")[k] for k in ks])
    edges = e.select(get("source", "from").alias("src"), get("target", "to").alias("dst"), get("relation", "type").alias("rel_type")).filter("src is not null and dst is not null")
    listed = df.select(F.explode("nodes").alias("n")).select(F.when(F.col("n").startswith("{"), F.coalesce(F.get_json_object("n", "$.id"), F.lit(""))).otherwise(F.col("n")).alias("node_id"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id"))
    return listed.union(ends).filter("node_id is not null").distinct(), edges


__all__ = ["COLUMNS", "csv_records", "ground_truth", "json_documents", "pending", "plain_graph", "results", "samples"]
