"""Resolving names of majors to codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import has, normal_name
from graphloom.operators.containing import containing


def major_index(majors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, conflicts): normalized name -> the code seen first by (file_name, pos, code); and names with several codes.

    ``majors``: (major_code, major_name_vi, file_name, pos). Rows without code or name are passed over.
    """
    m = majors.filter(has("major_code") & has("major_name_vi")).select(normal_name("major_name_vi").alias("norm"), "major_code", "file_name", "pos").filter("norm <> ''")
    first = F.min(F.struct("file_name", "pos", "major_code"))["major_code"]
    index = m.groupBy("norm").agg(first.alias("code"))
    conflicts = m.groupBy("norm").agg(F.count_distinct("major_code").alias("codes")).filter("codes > 1")
    return index, conflicts


def partial_match(names: DataFrame, index: DataFrame) -> DataFrame:
    """(norm, code): names that contain, or are contained in, indexed names of exactly one distinct code.

    Both directions are equi-joins on the rarest gram of the contained name, followed by the test itself; so an opening that all
    names share is no hot key. No row is left out.
    """
    a = names.select("norm").filter("norm <> ''").distinct()
    b = index.select(F.col("norm").alias("other"), "code")
    inside = containing(b, "other", a, "norm", counted=True)
    around = containing(a, "norm", b, "other", counted=True)
    hits = inside.select("norm", "code").union(around.select("norm", "code"))
    return hits.groupBy("norm").agg(F.count_distinct("code").alias("n"), F.min("code").alias("code")).filter("n = 1").select("norm", "code")


def map_codes(lists: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(codes, unmatched) for (owner, names): codes in order of first appearance, and names that got none.

    A name is looked up exactly, else by partial match. An exact repeat of a code is dropped silently; a partial hit whose code an
    earlier name already gave is reported unmatched.
    """
    each = lists.select("owner", F.posexplode("names").alias("pos", "name")).withColumn("norm", normal_name("name"))
    exact = each.join(index.select("norm", F.col("code").alias("exact")), "norm", "left")
    partial = partial_match(exact.filter("exact is null").select("norm"), index).toDF("norm", "partial")
    found = exact.join(partial, "norm", "left").withColumn("partial", F.when(F.col("exact").isNull(), F.col("partial"))).withColumn("code", F.coalesce("exact", "partial"))
    first = found.filter("code is not null").groupBy("owner", "code").agg(F.min("pos").alias("first"))
    codes = first.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "code"))), lambda x: x["code"]).alias("codes"))
    late = found.join(first, ["owner", "code"], "left").filter(F.col("code").isNull() | (F.col("partial").isNotNull() & (F.col("first") < F.col("pos"))))
    return codes, late.select("owner", "pos", "name")


def mapping_summary(lists: DataFrame, codes: DataFrame, unmatched: DataFrame) -> DataFrame:
    """One row: files, codes mapped, names unmatched."""
    one = lambda df, e, n: df.agg(F.coalesce(e, F.lit(0)).cast("long").alias(n))
    rows = [one(lists, F.count_distinct("owner"), "files"), one(codes, F.sum(F.size("codes")), "mapped"), one(unmatched, F.count(F.lit(1)), "unmatched")]
    return rows[0].join(rows[1]).join(rows[2])  # three single rows
