"""Retrieval metrics of results against ground truth, their roll-up and report tables. One projection per sample, one pass for all groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import same_name, strip
from graphloom.model import THRESHOLDS

METRICS = list(THRESHOLDS)
_ARR = "cast(array() as array<string>)"


def latest_results(results: DataFrame, order: str = "result_id") -> DataFrame:
    """One result per query_id: the last by ``order`` (later files replace earlier ones). Null and empty ids are passed over."""
    cols = [c for c in results.columns if c != "query_id"]
    r = results.filter("query_id is not null and query_id <> ''")
    return r.groupBy("query_id").agg(F.max_by(F.struct(*cols), order).alias("r")).select("query_id", "r.*")


def retrieved_names(nodes: Column) -> Column:
    """Of each retrieved node its first entity, else the name in its content, else ''."""
    return F.transform(F.coalesce(nodes, F.expr("cast(array() as array<struct<node_id:string,content:string,entities:array<string>>>)")), lambda n: F.coalesce(F.get(n["entities"], 0), F.get_json_object(n["content"], "$.name"), F.lit("")))


def all_names(nodes: Column) -> Column:
    """Of each retrieved node all its entities, else the name in its content ('' if that has none, nothing if it isn't JSON)."""
    return F.transform(
        F.coalesce(nodes, F.expr("cast(array() as array<struct<node_id:string,content:string,entities:array<string>>>)")),
        lambda n: F.when(F.coalesce(F.size(n["entities"]), F.lit(0)) > 0, n["entities"]).otherwise(F.array_compact(F.array(F.when(F.get_json_object(n["content"], "$").isNotNull(), F.coalesce(F.get_json_object(n["content"], "$.name"), F.lit("")))))),
    )


def _none(a: Column) -> Column:
    return F.size(a) == 0


def precision_recall_f1(retrieved: Column, relevant: Column, k: int) -> Column:
    """struct(precision, recall, f1): of the first k; hits are counted with repeats, precision is over k, rounded to 4 places."""
    top = F.slice(retrieved, 1, k)
    wanted = F.array_distinct(relevant)
    tp = F.size(F.filter(top, lambda x: F.array_contains(wanted, x))).cast("double")
    p, r = tp / F.lit(float(k)), tp / F.size(wanted)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    full = F.struct(F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f1, 4).alias("f1"))
    flat = lambda v: F.struct(*[F.lit(v).alias(x) for x in ("precision", "recall", "f1")])
    return F.when(_none(top) & _none(wanted), flat(1.0)).when(_none(top) | _none(wanted), flat(0.0)).otherwise(full)


def mrr(names_by_node: Column, relevant: Column) -> Column:
    """1 over the rank of the first node with a matching name; 0 without one."""
    hit = F.transform(names_by_node, lambda ns: F.exists(ns, lambda n: F.exists(relevant, lambda g: same_name(n, g))))
    rank = F.array_position(hit, True)
    return F.when(rank > 0, F.round(1.0 / F.nullif(rank, F.lit(0)), 4)).otherwise(F.lit(0.0))


def entity_coverage(gold: Column, names_by_node: Column) -> Column:
    """Share of gold entities that some retrieved name matches; 1 if there are none to find."""
    flat = F.filter(F.flatten(names_by_node), lambda n: F.coalesce(n, F.lit("")) != "")
    hit = F.size(F.filter(gold, lambda g: F.exists(flat, lambda n: same_name(g, n))))
    return F.when(_none(gold), F.lit(1.0)).otherwise(F.round(hit / F.nullif(F.size(gold), F.lit(0)), 4))


def entity_lists(gold: Column, names_by_node: Column) -> Column:
    """struct(covered, missing, threshold_ok): gold entities that some retrieved name matches and the others; whether the unrounded share reaches its target."""
    flat = F.filter(F.flatten(names_by_node), lambda n: F.coalesce(n, F.lit("")) != "")
    found = lambda g: F.exists(flat, lambda n: same_name(g, n))
    covered = F.filter(gold, found)
    ok = F.when(_none(gold), F.lit(None).cast("boolean")).otherwise(F.size(covered) / F.nullif(F.size(gold), F.lit(0)) >= THRESHOLDS["entity_coverage"])
    return F.struct(covered.alias("covered"), F.filter(gold, lambda g: ~found(g)).alias("missing"), ok.alias("threshold_ok"))


def coverage_lists(samples: DataFrame, results: DataFrame) -> DataFrame:
    """(row_id, covered, missing, threshold_ok) of each sample; one without a result covers nothing."""
    j = samples.join(results.select("query_id", "retrieved_nodes"), F.col("id") == F.col("query_id"), "left")
    return j.select("row_id", entity_lists(F.coalesce("gold_entities", F.expr(_ARR)), all_names(F.col("retrieved_nodes"))).alias("e")).select("row_id", "e.*")


def path_relevance(path: Column, gold: Column) -> Column:
    """Share of the gold path's nodes on the traversed path; null without a gold path, 0 without a traversed one."""
    steps = F.coalesce(path, F.expr("cast(array() as array<struct<from_node:string,to_node:string,relation:string,hop:int>>)"))
    on = F.filter(F.flatten(F.transform(steps, lambda s: F.array(s["from_node"], s["to_node"]))), lambda n: F.coalesce(n, F.lit("")) != "")
    hit = F.size(F.filter(gold, lambda g: F.exists(on, lambda n: same_name(g, n))))
    return F.when(_none(gold), F.lit(None).cast("double")).when(_none(on), F.lit(0.0)).otherwise(F.round(hit / F.nullif(F.size(gold), F.lit(0)), 4))


def comprehensiveness(answer: Column, expected: Column) -> Column:
    """Share of expected communities, underscores as spaces, whose name is in the answer; null if none is expected."""
    said = F.lower(F.coalesce(answer, F.lit("")))
    hit = F.size(F.filter(expected, lambda c: F.contains(said, F.lower(F.replace(c, F.lit("_"), F.lit(" "))))))
    return F.when(_none(expected), F.lit(None).cast("double")).otherwise(F.round(hit / F.nullif(F.size(expected), F.lit(0)), 4))


def evaluate(samples: DataFrame, results: DataFrame, k: int = 5) -> DataFrame:
    """One row per sample with all metrics; a sample without a result is scored as an empty one and marked missing.

    ``samples``: (row_id, id, query_type, gold_entities, relevant_node_ids, gold_path, expected_communities as arrays); ``results``: one
    row per query_id. Precision and recall compare names by equality; the relevant names are relevant_node_ids, else gold_entities.
    """
    r = results.select("query_id", "generated_answer", "retrieved_nodes", "traversal_path", F.lit(True).alias("found"))
    j = samples.join(r, F.col("id") == F.col("query_id"), "left")
    for c in ("gold_entities", "relevant_node_ids", "gold_path", "expected_communities"):
        j = j.withColumn(c, F.coalesce(c, F.expr(_ARR)))
    relevant = F.when(F.size("relevant_node_ids") > 0, F.col("relevant_node_ids")).otherwise(F.col("gold_entities"))
    j = j.withColumn("relevant", relevant).withColumn("names", retrieved_names(F.col("retrieved_nodes"))).withColumn("by_node", all_names(F.col("retrieved_nodes")))
    j = j.withColumn("prf", precision_recall_f1(F.col("names"), F.col("relevant"), k))
    return j.select(
        "row_id", "id", "query_type", F.col("found").isNull().alias("missing"), "prf.precision", "prf.recall", "prf.f1", mrr(F.col("by_node"), F.col("relevant")).alias("mrr"),
        entity_coverage(F.col("gold_entities"), F.col("by_node")).alias("entity_coverage"), path_relevance(F.col("traversal_path"), F.col("gold_path")).alias("path_relevance"),
        comprehensiveness(F.col("generated_answer"), F.col("expected_communities")).alias("comprehensiveness"),
    )


def rollup(metrics: DataFrame) -> DataFrame:
    """(scope, query_type, sample_count, mean of each metric): one overall row and one per type, in one pass; means of nulls only are null."""
    means = [F.round(F.avg(m), 4).alias(m) for m in METRICS]
    g = metrics.rollup("query_type").agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("sample_count"), *means)
    return g.select(F.when(F.col("gid") == 1, "overall").otherwise("by_type").alias("scope"), "query_type", "sample_count", *METRICS)


def pass_fail(rolled: DataFrame) -> DataFrame:
    """(metric, score, threshold, verdict) of the overall row: PASS, FAIL, or N/A without a score."""
    pairs = ", ".join(f"'{m}', {m}, {t}D" for m, t in THRESHOLDS.items())
    long = rolled.filter("scope = 'overall'").select(F.expr(f"stack({len(THRESHOLDS)}, {pairs}) as (metric, score, threshold)"))
    return long.withColumn("verdict", F.when(F.col("score").isNull(), "N/A").when(F.col("score") >= F.col("threshold"), "PASS").otherwise("FAIL"))


def radar(rolled: DataFrame) -> DataFrame:
    """(metric, score, threshold) of the five metrics a radar shows, without those that have no score."""
    return pass_fail(rolled).filter(F.col("metric").isin("f1", "mrr", "entity_coverage", "path_relevance", "comprehensiveness") & F.col("score").isNotNull()).drop("verdict")


def bars(rolled: DataFrame, most_types: int = 4) -> DataFrame:
    """(query_type, metric, score) for grouped bars: the first four types, missing scores as 0."""
    pairs = ", ".join(f"'{m}', coalesce({m}, 0.0D)" for m in METRICS)
    first = rolled.filter("scope = 'by_type' and query_type is not null").orderBy("query_type").limit(most_types)
    return first.select("query_type", F.expr(f"stack({len(METRICS)}, {pairs}) as (metric, score)"))


def scatter(metrics: DataFrame) -> DataFrame:
    return metrics.select("row_id", "id", "query_type", "recall", "precision")


def summary_table(rolled: DataFrame) -> DataFrame:
    """(metric, score as text, threshold, verdict), metrics without a score omitted."""
    return pass_fail(rolled).filter("score is not null").withColumn("score", F.format_string("%.3f", "score"))


def missing(metrics: DataFrame) -> DataFrame:
    return metrics.filter("missing").select("row_id", "id")


def report(metrics: DataFrame, dataset: str, k: int, run_at: str | None = None) -> DataFrame:
    """One nested row: config, aggregate, missing ids. Per-sample rows stay a table of their own: they may be many. run_at is now, in ISO form, if not given."""
    r = rollup(metrics)
    row = F.struct("query_type", "sample_count", *METRICS)
    agg = r.agg(F.first(F.when(F.col("scope") == "overall", row), ignorenulls=True).alias("overall"), F.array_sort(F.collect_list(F.when(F.col("scope") == "by_type", row))).alias("by_query_type"))
    n = metrics.agg(F.count(F.when(F.col("missing"), 1)).alias("missing_results"))
    config = F.struct(F.lit(dataset).alias("dataset"), F.lit(k).alias("k"), (F.lit(run_at) if run_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"))
    return agg.join(n).select(config.alias("config"), F.struct("overall", "by_query_type").alias("aggregate"), "missing_results")  # two single rows


__all__ = ["evaluate", "rollup", "pass_fail", "strip"]
