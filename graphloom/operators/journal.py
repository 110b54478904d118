"""What steps of a run did, as rows instead of log lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(steps: dict[str, DataFrame], by: Column | None = None) -> DataFrame:
    """(step, detail, n): the rows of each step's result, by a column of detail if given; one pass over each, no row is collected."""
    detail = F.lit("") if by is None else F.coalesce(by.cast("string"), F.lit(""))
    return reduce(DataFrame.unionByName, [df.groupBy(detail.alias("detail")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(step).alias("step"), "detail", "n") for step, df in steps.items()])


def append(entries: DataFrame, path: str) -> None:
    """Entries added to a journal (parquet), each with the time at which it was written."""
    entries.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
