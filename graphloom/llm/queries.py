"""The queries of the nine problems that belong to this subpackage: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import answer_pairs, exact_copies, mixture, name_variants, spam_pages, survivors, tokens

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The content fields of each table.
CONTENT = {"MAJOR": ("major", ["major_code", "major_name_vi", "major_name_en"]), "SKILL": ("skill", ["skill_key", "skill_name", "skill_type"]), "CAREER": ("career", ["career_key", "career_name_vi", "career_name_en", "field_name"])}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies.collapse_tables([(_t(spark, sf_dir, table), kind, fields) for kind, (table, fields) in CONTENT.items()], min_copies=2)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    people, skills = name_variants.link_people_and_skills(_t(spark, sf_dir, "teacher"), _t(spark, sf_dir, "skill"), _t(spark, sf_dir, "alias_ref"))
    # of persons every pair counts, so no two records are written alike
    p = people.select(F.lit("TEACHER").alias("node_type"), "record_id", F.col("person").alias("class"), F.col("record_id").cast("string").alias("written"))
    k = skills.select(F.lit("SKILL").alias("node_type"), "record_id", F.col("skill").alias("class"), "written")
    return name_variants.pairs_of(p.unionByName(k), ["node_type", "class"], differ="written")


def p2_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per teacher record: its class and the number of records that share it."""
    people = name_variants.link_people(_t(spark, sf_dir, "teacher"))
    sizes = people.groupBy("person").agg(F.count(F.lit(1)).alias("records"), F.min("record_id").alias("class_id"))
    return people.join(sizes, "person").select("record_id", "class_id", "records")


def p2_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per skill record: its class, the number of records that share it, and of spellings."""
    skills = name_variants.link_skills(_t(spark, sf_dir, "skill"), _t(spark, sf_dir, "alias_ref"))
    sizes = skills.groupBy("skill").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("written").alias("spellings"), F.min("record_id").alias("class_id"))
    return skills.join(sizes, "skill").select("record_id", "class_id", "records", "spellings")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_pairs.first_defect(_defects(spark, sf_dir))


def p3_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every triggered defect type of every pair that has one."""
    return _defects(spark, sf_dir).select("table_name", "row_key", F.explode("defects").alias("defect"))


def _defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_pairs.defects(
        [
            (_t(spark, sf_dir, "results"), "results", "result_id", "query", "generated_answer"),
            (_t(spark, sf_dir, "csv_to_dataset"), "csv_to_dataset", "row_id", "query", "ground_truth_answer"),
        ]
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(_t(spark, sf_dir, "major"), _t(spark, sf_dir, "source_trust"))


def p4_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survivors by vote: of each group and field the existing value closest to the consensus of its tokens."""
    return survivors.major_consensus(_t(spark, sf_dir, "major"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(_t(spark, sf_dir, "documents"), *tokens.public_vocabulary())


def p7_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, and whether decoding its ids gives the text back."""
    return tokens.round_trips(_t(spark, sf_dir, "documents"), *tokens.public_vocabulary())


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture, one row per use of a document."""
    return mixture.mix_sources(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "mix_targets"), *tokens.public_vocabulary()).copies


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached, one row per target source."""
    return mixture.mix_sources(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "mix_targets"), *tokens.public_vocabulary()).shares


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages.spam_pages(_t(spark, sf_dir, "documents")).filter("spam").select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and distance of every document."""
    return spam_pages.spam_pages(_t(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_people, p2_skills, p3_found, p3_defects, p4_found, p4_consensus, p7_ids, p7_lengths, p8_mix, p8_shares, p9_found, p9_scores)}
