"""Data preparation queries of the core: rejected rows and packed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators.packed_values import unpack
from graphloom.operators.reject_rows import COLUMNS, load_rows, reject_rows

# The packed list fields.
PACKED = ["gold_entities", "relevant_node_ids", "gold_path", "expected_communities"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_rows(spark.read.parquet(f"{sf_dir}/csv_raw.parquet"))


def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that load, with their twelve columns."""
    return load_rows(spark.read.parquet(f"{sf_dir}/csv_raw.parquet"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack(spark.read.parquet(f"{sf_dir}/csv_to_dataset.parquet"), PACKED).drop("flag")


def p6_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values whose quotes or brackets are malformed, with the flag."""
    return unpack(spark.read.parquet(f"{sf_dir}/csv_to_dataset.parquet"), PACKED).filter("flag <> ''")


_FIELD = r'(?:"[^"]*(?:""[^"]*)*"|[^,"][^,]*|)'



def _trim(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\p{{Z}}\x{{FEFF}}\x{{200B}}]+|[\s\p{{Z}}\x{{FEFF}}\x{{200B}}]+$', '', 'g')"


_P5_CTES = rf"""
WITH t AS (SELECT raw_id, regexp_replace(raw_text, '\r?\n?$', '') AS t FROM csv_raw WHERE raw_text IS NOT NULL),
h AS (SELECT *, lower(regexp_replace(trim(regexp_extract(t, '^[\x{{FEFF}}\s]*("(?:[^"]|"")*"|[^,]*)', 1), E' \t\n\r"'), '^[xv]\s+', '')) AS first FROM t),
r AS (SELECT *, regexp_full_match(t, '(?s){_FIELD}(,{_FIELD})*') AS sound FROM h
      WHERE regexp_replace(t, '[\s,;|"]', '', 'g') <> '' AND first NOT LIKE '#%' AND first NOT LIKE 'vd%' AND first <> 'id'),
f AS (SELECT *, [CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END for x in regexp_extract_all(',' || t, '(?s),({_FIELD})', 1)] AS f FROM r),
d AS (SELECT raw_id, CASE WHEN NOT sound THEN 'quoting' WHEN len(f) <> 12 THEN 'column_count'
  WHEN lower({_trim('f[3]')}) NOT IN ('single_hop', 'multi_hop', 'global') THEN 'query_type'
  WHEN {_trim('f[8]')} <> '' AND NOT regexp_full_match({_trim('f[8]')}, '[0-9]+') THEN 'gold_hop_count'
  WHEN {_trim('f[4]')} = '' THEN 'ground_truth_answer' END AS reason, f FROM f)"""
P5_SQL = _P5_CTES + " SELECT raw_id, reason FROM d WHERE reason IS NOT NULL"
P5_LOADED_SQL = _P5_CTES + " SELECT raw_id, " + ", ".join(f"f[{i}] AS {c}" for i, c in enumerate(COLUMNS, 1)) + " FROM d WHERE reason IS NULL"


def queries() -> dict:
    return {f.__name__: f for f in (p5_found, p5_loaded, p6_found, p6_flags)}


def oracle_sql() -> dict[str, str]:
    return {"p5_found": P5_SQL, "p5_loaded": P5_LOADED_SQL}
