"""Answering questions in batch: all questions at once, from text to result records."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import COMMUNITIES, TEMPLATES
from graphloom.operators import aggregate, context, match, providers, route, traverse
from graphloom.operators.containing import sized
from graphloom.session import cut

_PATH = "path_names array<string>, path_kinds array<string>"


def plan_questions(questions: DataFrame, intents: DataFrame | None = None) -> DataFrame:
    """(query_id, query, aggregation, keywords, mentioned, asked, negated, comparison, community, answer_rule).

    ``questions``: (query_id, query); ``intents``: (query_id, intent) from an outside reader, else the built-in lexicon is used.
    """
    q = questions.select("query_id", "query").withColumn("aggregation", aggregate.detect_aggregation(F.col("query")))
    q = q.withColumn("intent", route.lexicon_intent(F.col("query"))) if intents is None else q.join(intents.select("query_id", "intent"), "query_id", "left")
    i = lambda f: F.col(f"intent.{f}")
    q = q.select("query_id", "query", "aggregation", route.all_keywords(i("keywords"), F.col("query")).alias("keywords"), F.coalesce(i("mentioned_labels"), F.expr("cast(array() as array<string>)")).alias("mentioned"), F.coalesce(i("asked_label"), F.lit("UNKNOWN")).alias("asked"), F.coalesce(i("negated_keywords"), F.expr("cast(array() as array<string>)")).alias("negated"), F.coalesce(i("is_comparison"), F.lit(False)).alias("comparison"))
    return q.withColumn("community", route.community(F.col("keywords"), F.col("mentioned"), F.col("asked"))).withColumn("answer_rule", route.constraint(F.col("mentioned"), F.col("asked"), F.col("comparison")))


def _aggregated(nodes: DataFrame, edges: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows of the aggregation each question asks for; an aggregation that no question asks for isn't planned."""
    tables = {
        "subject_intersection_all": ("SUBJECT", lambda: aggregate.subjects_all_or_most(nodes, edges)),
        "subject_intersection_two": ("SUBJECT", lambda: aggregate.subjects_shared(nodes, edges)),
        "major_most_subjects": ("MAJOR", lambda: aggregate.top_by_count(nodes, edges, "OFFERS", "MAJOR", "src", 10)),
        "career_most_skills": ("CAREER", lambda: aggregate.top_by_count(nodes, edges, "REQUIRES", "CAREER", "src", 10)),
        "subject_most_majors": ("SUBJECT", lambda: aggregate.top_by_count(nodes, edges, "OFFERS", "SUBJECT", "dst", 15)),
        "skill_most_subjects": ("SKILL", lambda: aggregate.top_by_count(nodes, edges, "PROVIDES", "SKILL", "dst", 15)),
    }
    counted = aggregate.count_entities(nodes, plans.filter("aggregation = 'count_entities'").select(F.col("query_id").alias("question_id"), "query"))
    rows = counted.select(F.col("question_id").alias("query_id"), F.col("label").alias("name"), "label", F.lit(None).cast("string").alias("code"), F.col("n").cast("long").alias("n"))
    asked = {r.aggregation for r in plans.select("aggregation").distinct().collect()}  # at most as many as there are aggregations
    parts = [cut(t()).select(F.lit(a).alias("aggregation"), "name", F.lit(label).alias("label"), "code", F.col("n").cast("long").alias("n")) for a, (label, t) in tables.items() if a in asked]
    if parts:
        hit = plans.filter("aggregation is not null").select("query_id", "aggregation").join(reduce(DataFrame.unionByName, parts), "aggregation")
        rows = rows.unionByName(hit.select(*rows.columns))
    none = F.expr("cast(array() as array<string>)")
    return rows.select("query_id", F.struct(F.lit(0).alias("phase"), (-F.col("n")).alias("a"), F.col("name").alias("b"), F.lit("").alias("c")).alias("seq"), "name", "label", "code", F.lit(0).alias("hops"), none.alias("node_names"), none.alias("rel_types"))


def _matched(nodes: DataFrame, edges: DataFrame, kw: DataFrame, size: tuple[bool, bool]) -> DataFrame:
    """Phase 1: the pattern of (first mentioned, asked) for each keyword; questions share the work for equal keywords."""
    wanted = [(r.first, r.asked) for r in kw.select("first", "asked").distinct().collect()]  # at most labels x labels
    parts = []
    for start, asked in wanted:
        if (start, asked) in TEMPLATES:
            mine = kw.filter((F.col("first") == start) & (F.col("asked") == asked))
            words = mine.select("kw").distinct().withColumn("kw_pos", F.lit(0))
            rows = match.match(nodes, edges, words, start, asked, size=size).drop("kw_pos").withColumnRenamed("node_id", "at")
            parts.append(cut(mine.select("query_id", "kw", "kw_pos").join(rows, "kw")))
    if not parts:
        return None
    rows = reduce(DataFrame.unionByName, parts)
    seq = F.struct(F.lit(1).alias("phase"), F.col("kw_pos").cast("long").alias("a"), F.col("name").alias("b"), F.concat_ws("|", "at", F.array_join("node_names", "|")).alias("c"))
    return rows.select("query_id", seq.alias("seq"), "name", "label", "code", "hops", "node_names", "rel_types")


def _walked(nodes: DataFrame, edges: DataFrame, kw: DataFrame, size: tuple[bool, bool], max_hops: int) -> DataFrame:
    """Phase 2: trails from the best connected nodes of each keyword; the end's label must belong to the question's community."""
    words = kw.select("kw").distinct().withColumn("kw_pos", F.lit(0))
    found = traverse.seeds(nodes, edges, words, size=size).select("kw", F.col("rank").alias("kw_rank"), F.col("name").alias("seed"))
    mine = kw.select("query_id", "kw", "kw_pos", "community").join(found, "kw")
    mine = cut(aggregate.first_of(mine, ["query_id", "seed"], ["kw_pos", "kw_rank"], 1))
    parts = []
    for (c,) in mine.select("community").distinct().collect():  # at most as many as there are communities
        own = mine.filter(F.col("community") == c)
        rows = traverse.trails(nodes, edges, own.select(F.col("seed").alias("name")).distinct(), max_hops, COMMUNITIES[c][1])
        parts.append(cut(own.select("query_id", "seed", "kw_pos", "kw_rank").join(rows, "seed")))
    if not parts:
        return None
    rows = reduce(DataFrame.unionByName, parts)
    order = F.col("kw_pos").cast("long") * 1000 + F.col("kw_rank")
    seq = F.struct(F.lit(2).alias("phase"), order.alias("a"), F.concat_ws("|", "seed", F.lpad(F.col("hops").cast("string"), 3, "0")).alias("b"), F.concat_ws("|", F.array_join("node_names", "|"), F.array_join("rel_types", "|")).alias("c"))
    return rows.select("query_id", seq.alias("seq"), "name", "label", "code", "hops", "node_names", "rel_types")


def _bridged(nodes: DataFrame, edges: DataFrame, plans: DataFrame, so_far: DataFrame) -> DataFrame | None:
    """Phase 3: from the first 20 names found so far over the bridge of (community, asked)."""
    wanted = {(r.community, r.asked) for r in plans.select("community", "asked").distinct().collect()}  # at most communities x labels
    parts = []
    for cluster, asked in (("L2_ACADEMIC", "CAREER"), ("L2_CAREER_ALIGNMENT", "SUBJECT")):
        if (cluster, asked) not in wanted:
            continue
        mine = plans.filter((F.col("community") == cluster) & (F.col("asked") == asked)).select("query_id")
        first = so_far.join(mine, "query_id", "left_semi").groupBy("query_id", "name").agg(F.min("seq").alias("seq"))
        names = aggregate.first_of(first, ["query_id"], ["seq"], 20).select("query_id", F.col("name").alias("start"))
        rows = traverse.bridge(nodes, edges, names.select(F.col("start").alias("name")), cluster, asked)
        parts.append(names.join(rows, "start"))
    if not parts:
        return None
    rows = reduce(DataFrame.unionByName, parts)
    way = F.when(F.col("via") == "", F.array("start", "name")).otherwise(F.array("start", "via", "name"))
    kinds = F.when(F.col("via") == "", F.array(F.lit("LEADS_TO"))).otherwise(F.array(F.lit("REQUIRES"), F.lit("PROVIDES")))
    seq = F.struct(F.lit(3).alias("phase"), F.lit(0).cast("long").alias("a"), F.col("name").alias("b"), F.concat_ws("|", "start", "via").alias("c"))
    return rows.select("query_id", seq.alias("seq"), "name", "label", "code", F.size(kinds).alias("hops"), way.alias("node_names"), kinds.alias("rel_types"))


def retrieve(nodes: DataFrame, edges: DataFrame, plans: DataFrame, max_hops: int = 3) -> DataFrame:
    """All rows of all phases: (query_id, seq, name, label, code, hops, node_names, rel_types).

    The graph is read once and every phase is written to the shared checkpoint folder as soon as it is found: planned together, the
    phases hold more of the driver's memory than all their rows.
    """
    nodes = cut(nodes.select("node_id", "label", "name", "code"))
    edges = cut(edges.select("edge_id", "src", "dst", "rel_type"))
    asked = plans.filter("aggregation is null")
    kw = cut(asked.select("query_id", "asked", "community", F.get("mentioned", 0).alias("first"), F.posexplode("keywords").alias("kw_pos", "kw")))
    size = sized(kw.select("kw", F.lit(0).alias("kw_pos")).distinct())
    parts = [p for p in (_matched(nodes, edges, kw, size), _walked(nodes, edges, kw, size, max_hops)) if p is not None]
    none = _aggregated(nodes, edges, plans)
    if not parts:
        return none
    two = reduce(DataFrame.unionByName, parts)
    # what a checkpoint is known to hold trips the optimizer inside a union, so its columns are made anew
    fresh = two.withColumn("seq", F.struct(*[F.col(f"seq.{f}").alias(f) for f in ("phase", "a", "b", "c")])).withColumn("query_id", F.concat("query_id", F.lit("")))
    more = _bridged(nodes, edges, asked, two)
    return reduce(DataFrame.unionByName, [none, fresh, *([] if more is None else [more])])


def ask(nodes: DataFrame, edges: DataFrame, questions: DataFrame, intents: DataFrame | None = None, provider: Callable[[str, str], str] | None = None, max_hops: int = 3) -> DataFrame:
    """Result records for (query_id, query): retrieved nodes ranked and without repeats or negated names, the first path steps, the community.

    Questions recognised as aggregations get its rows and no paths. Without a provider generated_answer is null. Questions with no
    keyword or no hit have empty lists; an empty table gives no rows.
    """
    plans = cut(plan_questions(questions, intents))
    rows = cut(retrieve(nodes, edges, plans, max_hops))
    best = context.ranked(rows, keys=["query_id"]).join(plans.select("query_id", "negated"), "query_id")
    best = context.negation_filter(best, "negated")
    found = best.select("query_id", F.col("first_seq").alias("position"), "name", "label", "code", "hops")
    steps = match.path_steps(rows.filter("size(rel_types) > 0"), ["query_id", "seq"])
    paths = steps.select("query_id", F.struct("seq", "hop").alias("seq"), F.col("from_node").alias("from"), F.col("to_node").alias("to"), "relation", "hop")
    base = plans.select("query_id", "query", F.lit(None).cast("string").alias("generated_answer"), "keywords", "negated", "community", "answer_rule", F.coalesce("aggregation", F.lit("traversal")).alias("algorithm"))
    out = context.records(base, found, paths)
    out = providers.answer(context.prompt(out), provider).drop("context") if provider else out
    return out.drop("context_paths", "negated")
