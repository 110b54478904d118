"""Writers: documents, graph tables, datasets, results, reports. All are plain Spark writes, partitioned where reads prune."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def documents(df: DataFrame, path: str) -> None:
    """Extracted documents as JSON, nulls kept, by kind."""
    df.write.mode("overwrite").option("ignoreNullFields", False).partitionBy("doctype").json(path)


def graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes by label and edges by type, so a scan of one label or type reads only that."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("rel_type").parquet(f"{path}/edges")


def dataset(samples: DataFrame, path: str, validate_only: bool = False) -> DataFrame:
    """Samples as JSON lines; with ``validate_only`` nothing is written. Returns the rows that have errors."""
    if not validate_only:
        samples.drop("errors").write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return samples.filter(F.size("errors") > 0)


def results(records: DataFrame, path: str, per_query: bool = False) -> None:
    """Result records as JSON; by query only on request, as a directory per query doesn't scale."""
    w = records.write.mode("overwrite").option("ignoreNullFields", False)
    (w.partitionBy("query_id") if per_query else w).json(path)


def report(row: DataFrame, per_sample: DataFrame, path: str) -> None:
    """The report's single row and its samples."""
    row.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/report")
    per_sample.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/per_sample")
