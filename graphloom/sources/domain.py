"""The domain tables as nodes and relationships of documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.ingest import doctype_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Key and name column of each node table.
NODE_TABLES = {"MAJOR": ("major", "major_code", "major_name_vi"), "SKILL": ("skill", "skill_key", "skill_name"), "CAREER": ("career", "career_key", "career_name_vi"), "TEACHER": ("teacher", "teacher_key", "name")}


def doc_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, doctype, file_name, pos, type, key, name) of all node records."""
    parts = [table(spark, sf_dir, t).select("doc_id", "file_name", "pos", F.lit(label).alias("type"), F.col(k).alias("key"), F.col(n).alias("name")) for label, (t, k, n) in NODE_TABLES.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("doctype", doctype_of(F.col("doc_id")))


def doc_rels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "relationships").drop("extracted_at", "ingested_at")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, key) of the subjects, which every document may refer to."""
    return table(spark, sf_dir, "subject").select(F.lit("SUBJECT").alias("label"), F.col("subject_code").alias("key"))


_T = "CASE WHEN starts_with(doc_id, 'CUR-') THEN 'curriculum' WHEN starts_with(doc_id, 'CAR-') THEN 'career_description' WHEN starts_with(doc_id, 'SYL-') THEN 'syllabus' END"
SQL = "dn AS (SELECT *, " + _T + " AS doctype FROM (" + " UNION ALL ".join(f"SELECT doc_id, file_name, pos, '{label}' AS type, {k} AS key, {n} AS name FROM {t}" for label, (t, k, n) in NODE_TABLES.items()) + "))"
