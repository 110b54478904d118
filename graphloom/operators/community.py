"""Communities at three levels: by rule, by weighted Louvain; PageRank."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import COMMUNITIES, REL_WEIGHTS, RULE_COMMUNITY
from graphloom.session import cut


def level_one(nodes: DataFrame) -> DataFrame:
    """(node_id, community): everything is community 0."""
    return nodes.filter(F.col("label").isin(COMMUNITIES["L1_GLOBAL"][1])).select("node_id", F.lit(0).alias("community"))


def by_rule(nodes: DataFrame, level: int) -> DataFrame:
    """(node_id, community): the number of the label; where two definitions of a level name a label, the later one."""
    defs = [RULE_COMMUNITY[c] for c, v in COMMUNITIES.items() if v[0] == level and c in RULE_COMMUNITY]
    table = reduce(lambda a, b: {**a, **b}, defs, {})
    number = F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in table.items()])
    return nodes.select("node_id", number.alias("community"))


def written(rows: DataFrame) -> DataFrame:
    """One row: how many nodes have a community."""
    return rows.agg(F.count("community").alias("nodes_written"))


def projection(nodes: DataFrame, edges: DataFrame, community: str) -> DataFrame:
    """(u, v, w), u < v: the undirected weighted graph of a definition; edges with an end outside its labels are left out, parallel ones added up."""
    _, labels, kinds = COMMUNITIES[community]
    ids = nodes.filter(F.col("label").isin(labels)).select("node_id")
    w = F.coalesce(*[F.when(F.col("rel_type") == k, F.lit(float(REL_WEIGHTS[k]))) for k in kinds])
    e = edges.filter(F.col("rel_type").isin(kinds) & (F.col("src") != F.col("dst"))).withColumn("w", w)
    e = e.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")
    return e.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.sum("w").alias("w"))


def scope(nodes: DataFrame, edges: DataFrame, community: str, major_code: str | None = None, skill_name: str | None = None) -> DataFrame:
    """Nodes of a definition's labels; at level three only those that the major of this code offers, or that provide or require the skill of this name."""
    level, labels, _ = COMMUNITIES[community]
    own = nodes.filter(F.col("label").isin(labels))
    if level != 3:
        return own
    if community == "L3_MAJOR_CENTRIC":
        at = nodes.filter((F.col("label") == "MAJOR") & (F.col("code") == major_code)).select(F.col("node_id").alias("src"))
        near = edges.filter("rel_type = 'OFFERS'").join(at, "src", "left_semi").select(F.col("dst").alias("node_id"))
    else:
        at = nodes.filter((F.col("label") == "SKILL") & (F.col("name") == skill_name)).select(F.col("node_id").alias("dst"))
        near = edges.filter("rel_type in ('PROVIDES', 'REQUIRES')").join(at, "dst", "left_semi").select(F.col("src").alias("node_id"))
    return own.join(near, "node_id", "left_semi")


def build(nodes: DataFrame, edges: DataFrame, detect: bool = True, rebuild: bool = False) -> DataFrame:
    """nodes with community_L1, community_L2 and community_L3 (as text), by Louvain or, without ``detect``, by rule.

    The five definitions are built in order; where two of one level share a label, the later one's value stays. Nothing is done if some
    node has a community_L2 already, unless ``rebuild``.
    """
    if "community_L2" in nodes.columns and not rebuild and not nodes.filter("community_L2 is not null").isEmpty():
        return nodes
    out = nodes.drop("community_L1", "community_L2", "community_L3").join(level_one(nodes).select("node_id", F.col("community").cast("string").alias("community_L1")), "node_id", "left")
    for level in (2, 3):
        name = f"community_L{level}"
        if detect:
            parts = [louvain(nodes, edges, c).toDF("node_id", f"_{i}") for i, c in enumerate(c for c, v in COMMUNITIES.items() if v[0] == level)]
            for p in parts:
                out = out.join(p, "node_id", "left")
            found = [f"_{i}" for i in range(len(parts))]
            out = out.withColumn(name, F.coalesce(*found[::-1])).drop(*found)
        else:
            out = out.join(by_rule(nodes, level).select("node_id", F.col("community").cast("string").alias(name)), "node_id", "left")
    return out


def modularity(graph: DataFrame, members: DataFrame, resolution: float = 1.0) -> float:
    """Newman's modularity of (node, community) over (u, v, w); 0 for a graph without edges."""
    both = graph.join(members.toDF("u", "cu"), "u").join(members.toDF("v", "cv"), "v")
    m = both.agg(F.sum("w").alias("m"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inner")).first()
    if not m.m:
        return 0.0
    ends = both.select(F.explode(F.array(F.struct(F.col("cu").alias("c"), "w"), F.struct(F.col("cv").alias("c"), "w"))).alias("e")).select("e.c", "e.w")
    squares = ends.groupBy("c").agg(F.sum("w").alias("t")).agg(F.sum(F.pow("t", F.lit(2.0))).alias("s")).first().s
    return m.inner / m.m - resolution * squares / (2 * m.m) ** 2


def louvain(nodes: DataFrame, edges: DataFrame, community: str, least_gain: float = 1e-6) -> DataFrame:
    """(node_id, community): weighted Louvain over a definition's projection (Blondel et al. 2008), communities named by their smallest member.

    Each round, the nodes of one hash class move at once to the neighbouring community of greatest gain (ties: smallest name); two
    classes take turns, which keeps neighbours from swapping for ever. Rounds end when both turns together gain less than ``least_gain``
    of modularity, which is at most 1, so they do end; then communities are contracted and the next level begins, until a level gains
    less. Everything is joins and aggregations; one number per round reaches the driver,
    and the assignment is written to the shared checkpoint folder each round. Nodes without edges are communities of their own.
    """
    ids = nodes.filter(F.col("label").isin(COMMUNITIES[community][1])).select("node_id").distinct()
    first = cut(projection(nodes, edges, community))
    graph, loops = first, None
    whole = cut(ids.select("node_id", F.col("node_id").alias("community")))
    total = first.agg(F.sum("w").alias("m")).first().m
    if not total:
        return whole
    best = modularity(first, whole)
    while True:
        both = graph.select(F.col("u").alias("a"), F.col("v").alias("b"), "w").union(graph.select("v", "u", "w"))
        own = both.select("a", "w") if loops is None else both.select("a", "w").union(loops.select("a", F.col("w") * 2))
        k = cut(own.groupBy("a").agg(F.sum("w").alias("k")))
        local = cut(k.select("a", F.col("a").alias("c")))
        score = best
        gained = {0: True, 1: True}
        for turn in count():
            sums = local.join(k, "a").groupBy("c").agg(F.sum("k").alias("t"))
            near = both.join(local.toDF("b", "cb"), "b").groupBy("a", "cb").agg(F.sum("w").alias("kin"))
            mine = local.toDF("a", "ca").join(k, "a")
            move = near.join(mine, "a").filter(F.pmod(F.xxhash64("a"), F.lit(2)) == turn % 2).join(sums.toDF("cb", "t"), "cb")
            rest = F.col("t") - F.when(F.col("ca") == F.col("cb"), F.col("k")).otherwise(0.0)
            gain = F.col("kin") / total - rest * F.col("k") / (2 * total * total)
            pick = move.groupBy("a").agg(F.min(F.struct((-F.round(gain, 12)).alias("g"), F.col("cb").alias("c"))).alias("p"), F.max(F.when(F.col("ca") == F.col("cb"), F.round(gain, 12))).alias("stay"))
            alone = F.coalesce("stay", F.lit(0.0))
            to = pick.filter(-F.col("p.g") > alone).select("a", F.col("p.c").alias("to"))
            tried = cut(local.join(to, "a", "left").select("a", F.coalesce("to", "c").alias("c")))
            joined = whole.join(tried.toDF("community", "c"), "community", "left").select("node_id", F.coalesce("c", "community").alias("community"))
            now = modularity(first, joined)
            gained[turn % 2] = now >= score + least_gain
            if now >= score:
                score, local = now, tried
            if not gained[0] and not gained[1]:
                break
        if score < best + least_gain:
            break
        best = score
        whole = cut(whole.join(local.toDF("community", "c"), "community", "left").select("node_id", F.coalesce("c", "community").alias("community")))
        e = graph.join(local.toDF("u", "cu"), "u").join(local.toDF("v", "cv"), "v")
        inner = e.filter("cu = cv").select(F.col("cu").alias("a"), "w")
        if loops is not None:
            inner = inner.union(loops.join(local, "a").select(F.col("c").alias("a"), "w"))
        loops = cut(inner.groupBy("a").agg(F.sum("w").alias("w")))
        graph = cut(e.filter("cu <> cv").groupBy(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).agg(F.sum("w").alias("w")))
        if graph.isEmpty():
            break
    low = whole.groupBy("community").agg(F.min("node_id").alias("low"))
    return whole.join(low, "community").select("node_id", F.col("low").alias("community"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node_id, rank) by power iteration over distinct directed edges; ranks add up to 1, what ends in sinks is shared out evenly.

    Shares are pre-aggregated by target before the shuffle, so a hub costs one partial sum per task. The ranks are written to the
    shared checkpoint folder every round, with each node's number of links, so sinks are known without a join.
    """
    n = nodes.select("node_id").distinct().count()
    if not n:
        return nodes.select("node_id", F.lit(0.0).alias("rank"))
    links = cut(edges.select("src", "dst").distinct())
    out = links.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("out"))
    rank = cut(nodes.select("node_id").distinct().join(out, "node_id", "left").select("node_id", F.coalesce("out", F.lit(0)).alias("out"), F.lit(1.0 / n).alias("rank")))
    for _ in range(rounds):
        shares = rank.filter("out > 0").select(F.col("node_id").alias("src"), (F.col("rank") / F.col("out")).alias("share"))
        given = links.join(shares, "src").groupBy(F.col("dst").alias("node_id")).agg(F.sum("share").alias("in"))
        lost = rank.filter("out = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        rank = rank.select("node_id", "out").join(given, "node_id", "left")
        rank = cut(rank.select("node_id", "out", (F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("in", F.lit(0.0)) + lost.scalar() / n)).alias("rank")))  # read three times in a round
    return rank.select("node_id", "rank")
