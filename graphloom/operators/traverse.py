"""Seeds, bounded trails, bridges, shortest paths."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.aggregate import first_of
from graphloom.operators.containing import named
from graphloom.session import cut


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, degree): edges at a node, any type, both ways; a loop counts once."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def seeds(nodes: DataFrame, edges: DataFrame, keywords: DataFrame, k: int = 3, size: tuple[bool, bool] | None = None) -> DataFrame:
    """(kw, kw_pos, rank, node_id, name, label, degree): per keyword the k best connected nodes whose name contains it or whose code it is."""
    found = named(nodes, keywords, size=size).join(degrees(edges), "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    top = first_of(found, ["kw", "kw_pos"], [F.desc("degree"), "name", "node_id"], k)
    rank = F.row_number().over(Window.partitionBy("kw", "kw_pos").orderBy(F.desc("degree"), "name", "node_id"))
    return top.select("kw", "kw_pos", rank.alias("rank"), "node_id", "name", "label", "degree")


def distinct_seeds(seed_rows: DataFrame) -> DataFrame:
    """One row per seed name: its first appearance by keyword and rank."""
    return first_of(seed_rows, ["name"], ["kw_pos", "rank"], 1)


def trails(nodes: DataFrame, edges: DataFrame, start: DataFrame, max_hops: int = 3, labels: list[str] | None = None, limit: int | None = 60) -> DataFrame:
    """(seed, name, label, code, node_id, rel_types, node_names, hops): distinct trails from every node with a seed's name.

    ``start`` has (name). Edges are walked both ways and never twice in one trail; nodes may repeat. Only the last node has to have
    one of ``labels``; the way there is free. With a limit, each seed keeps its first rows by hops, then path, and a hub costs no more
    than it can give: each node's kinds of neighbours (name, type, label, code) are ranked once, and the last step of a seed joins only
    the first of them. A step is a seed's last one if it is the last of all, or if it is sure to fill the limit; only the other seeds,
    which have fewer rows than the limit by then, are followed with their whole frontier, which is written to the shared checkpoint
    folder at each hop.
    """
    names = nodes.select(F.col("node_id").alias("next"), F.col("name").alias("n_name"), F.col("label").alias("n_label"), F.col("code").alias("n_code"))
    way = lambda a, b: edges.select("edge_id", "rel_type", F.col(a).alias("at"), F.col(b).alias("next"))
    both = way("src", "dst").union(way("dst", "src").filter("at <> next"))
    both = cut(both.join(names, "next"))  # read at every hop
    ends = both.filter(F.col("n_label").isin(labels)) if labels else both
    code = F.coalesce("n_code", F.lit(""))
    front = start.select(F.col("name").alias("seed")).distinct().join(nodes.select(F.col("name").alias("seed"), F.col("node_id").alias("at")), "seed")
    front = front.select("seed", "at", F.array().cast("array<string>").alias("used"), F.array().cast("array<string>").alias("rel_types"), F.array("seed").alias("node_names"))
    front = cut(front)  # read several times at every hop
    found: list[DataFrame] = []
    have: DataFrame | None = None  # rows found so far by seed

    def rows_of(step: DataFrame, hop: int, node_id: str) -> DataFrame:
        row = step.select("seed", F.col("n_name").alias("name"), F.col("n_label").alias("label"), F.col("n_code").alias("code"), F.col(node_id).alias("node_id"), F.concat("rel_types", F.array("rel_type")).alias("rel_types"), F.concat("node_names", F.array("n_name")).alias("node_names"), F.lit(hop).alias("hops"))
        return row.groupBy("seed", "name", "label", "code", "rel_types", "node_names", "hops").agg(F.min("node_id").alias("node_id")).select(*row.columns)

    def nearest(front: DataFrame, hop: int) -> DataFrame:
        """The first kinds of neighbours of the nodes that the frontier has reached, with some edges of each."""
        kind = ["at", "n_name", "rel_type", "n_label", "n_code"]
        own = ends.join(front.select("at").distinct(), "at", "left_semi")
        # a trail has walked fewer edges than hops, so of so many of a kind one is left, and so many kinds more are enough
        few = first_of(own, kind, ["edge_id"], hop).groupBy(*kind).agg(F.collect_list("edge_id").alias("edges"), F.min("next").alias("node_id"))
        return cut(first_of(few, ["at"], ["n_name", "rel_type", "n_label", code], limit + hop))

    def last_step(front: DataFrame, near: DataFrame, kinds: DataFrame, hop: int) -> DataFrame:
        """The rows of a last hop, as far as they can be among the first ``limit``."""
        prefix = F.concat(F.array_join("node_names", "|"), F.lit("|"))
        f = front.join(kinds, "at").withColumn("prefix", prefix).withColumn("plain", F.size(F.split("prefix", r"\|")) == F.size("node_names") + 1)
        # prefixes that surely go on, in the order of paths: beyond the first ``limit`` of them nothing can be among the first rows
        sure = f.filter(F.col("plain") & (F.col("kinds") >= hop)).select("seed", "prefix").distinct()
        stop = first_of(sure, ["seed"], ["prefix"], limit).groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.max("prefix").alias("stop")).filter(F.col("n") == limit).select("seed", "stop")
        f = f.join(stop, "seed", "left").filter(F.col("stop").isNull() | ~F.col("plain") | (F.col("prefix") <= F.col("stop")))
        return rows_of(f.join(near, "at").filter(F.exists("edges", lambda e: ~F.array_contains("used", e))), hop, "node_id")

    for hop in range(1, max_hops + 1):
        if limit:
            near = nearest(front, hop)
            kinds = near.groupBy("at").agg(F.count(F.lit(1)).alias("kinds"))
            if hop == max_hops:
                found.append(last_step(front, near, kinds, hop))
                break
            each = front.join(kinds, "at").groupBy("seed", "node_names", "rel_types").agg(F.max(F.col("kinds") - (hop - 1)).alias("n")).filter("n > 0")
            given = [each.select("seed", "n"), *([] if have is None else [have])]
            filled = reduce(DataFrame.unionByName, given).groupBy("seed").agg(F.sum("n").alias("n")).filter(F.col("n") >= limit).select("seed", F.lit(True).alias("filled"))
            front = cut(front.join(filled, "seed", "left"))
            found.append(last_step(front.filter("filled"), near, kinds, hop))
            front = front.filter("filled is null").drop("filled")
            if front.isEmpty():
                break
        step = front.join(both, "at").filter(~F.array_contains("used", F.col("edge_id")))
        step = cut(step.select("seed", "next", F.concat("used", F.array("edge_id")).alias("used"), "rel_types", "node_names", "rel_type", "n_name", "n_label", "n_code"))
        found.append(rows_of(step.filter(F.col("n_label").isin(labels)) if labels else step, hop, "next"))
        front = step.select("seed", F.col("next").alias("at"), "used", F.concat("rel_types", F.array("rel_type")).alias("rel_types"), F.concat("node_names", F.array("n_name")).alias("node_names"))
        if limit:
            have = cut(reduce(DataFrame.unionByName, found).groupBy("seed").agg(F.count(F.lit(1)).alias("n")))
            front = front.join(have.filter(F.col("n") >= limit).select("seed"), "seed", "left_anti")
    every = reduce(DataFrame.unionByName, found)
    order = ["hops", F.array_join("node_names", "|"), F.array_join("rel_types", "|"), "name", "label", F.coalesce("code", F.lit(""))]
    return first_of(every, ["seed"], order, limit) if limit else every


def bridge(nodes: DataFrame, edges: DataFrame, names: DataFrame, cluster: str, asked: str) -> DataFrame:
    """(start, via, name, label, code): from one cluster to the other, without a limit.

    L2_ACADEMIC and CAREER: majors of these names and where they lead. L2_CAREER_ALIGNMENT and SUBJECT: careers of these names, the
    skills they require, and the subjects that provide them. Anything else has no bridge and gives no rows.
    """
    n = lambda label, a: nodes.filter(F.col("label") == label).select(F.col("node_id").alias(a), F.col("name").alias(f"{a}_name"), F.col("code").alias(f"{a}_code"))
    named = names.select(F.col("name").alias("s_name")).distinct()
    if (cluster, asked) == ("L2_ACADEMIC", "CAREER"):
        s = n("MAJOR", "s").join(named, "s_name", "left_semi")
        e = edges.filter("rel_type = 'LEADS_TO'").select(F.col("src").alias("s"), F.col("dst").alias("t"))
        return s.join(e, "s").join(n("CAREER", "t"), "t").select(F.col("s_name").alias("start"), F.lit("").alias("via"), F.col("t_name").alias("name"), F.lit("CAREER").alias("label"), F.col("t_code").alias("code"))
    if (cluster, asked) == ("L2_CAREER_ALIGNMENT", "SUBJECT"):
        s = n("CAREER", "s").join(named, "s_name", "left_semi")
        e1 = edges.filter("rel_type = 'REQUIRES'").select(F.col("src").alias("s"), F.col("dst").alias("v"))
        e2 = edges.filter("rel_type = 'PROVIDES'").select(F.col("src").alias("t"), F.col("dst").alias("v"))
        rows = s.join(e1, "s").join(e2, "v").join(n("SKILL", "v"), "v").join(n("SUBJECT", "t"), "t")
        return rows.select(F.col("s_name").alias("start"), F.col("v_name").alias("via"), F.col("t_name").alias("name"), F.lit("SUBJECT").alias("label"), F.col("t_code").alias("code"))
    return nodes.limit(0).select(F.col("name").alias("start"), F.col("name").alias("via"), "name", "label", "code")


def path_depth(edges: DataFrame, pairs: DataFrame, most: int | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(pair_id, depth): hops of the shortest undirected path for (pair_id, a, b); null if there is none or an end is unknown.

    ``nodes`` (node_id) makes nodes without edges known. With ``most``, only paths of so many hops count; without it the search ends
    when every pair is settled or nothing new is reached. Breadth first from all sources at once, from each source's side only; a visited set per source (anti-join) keeps the frontier small.
    """
    both = cut(edges.select(F.col("src").alias("at"), F.col("dst").alias("next")).union(edges.select(F.col("dst").alias("at"), F.col("src").alias("next"))).distinct())  # read at every hop
    known = both.select("at") if nodes is None else both.select("at").union(nodes.select("node_id"))
    known = known.distinct()
    live = pairs.join(known.withColumnRenamed("at", "a"), "a", "left_semi").join(known.withColumnRenamed("at", "b"), "b", "left_semi").select("pair_id", "a", "b")
    seen = cut(live.select(F.col("a").alias("source"), F.col("a").alias("at")).distinct().withColumn("depth", F.lit(0)))
    front, open_pairs, done = seen, live, []
    for hop in count() if most is None else range(most + 1):
        hit = open_pairs.join(front.select(F.col("source").alias("a"), F.col("at").alias("b")), ["a", "b"], "left_semi").select("pair_id").withColumn("depth", F.lit(hop))
        hit = cut(hit)
        done.append(hit)
        open_pairs = open_pairs.join(hit.select("pair_id"), "pair_id", "left_anti")
        need = open_pairs.select(F.col("a").alias("source")).distinct()
        step = front.join(need, "source", "left_semi").join(both, "at").select("source", F.col("next").alias("at")).distinct()
        front = cut(step.join(seen.select("source", "at"), ["source", "at"], "left_anti").withColumn("depth", F.lit(hop + 1)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return pairs.select("pair_id").join(reduce(DataFrame.unionByName, done), "pair_id", "left")
