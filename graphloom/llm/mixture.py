"""Mixing sources to target weights by systematic sampling.

The total is the largest at which every source that has documents meets its (renormalised) target share without using a text more
often than its cap, or a given number of tokens. Each document then has an expected number of copies; these are summed up along
the documents of a source, one random offset is added, and a document is emitted once per integer boundary its interval crosses.
Documents are ordered by size first, so the drawn tokens follow the expected ones closely.

The prefix sum is taken in two levels: a range partitioning orders the documents, each partition is counted, and the counts (at most
one row per partition and source boundary) give each partition its offset. No window runs over a whole source, so a source that
holds a third of all rows is spread like any other.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.columns import pick
from graphloom.llm.tokens import count_tokens
from graphloom.session import cut

#: The targets are a setting, read on the driver; more rows than this are refused.
MOST_TARGETS = 10_000


@dataclass
class Mix:
    """copies: (doc_id, source, n_tokens, copy_no), one row per use of a document; shares: the report, one row per target source."""

    copies: DataFrame
    shares: DataFrame


def candidates(docs: DataFrame, targets: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, source, n_tokens): one document per distinct text of the target sources.

    Equal texts are one text, however many documents carry it: it stands with the source of smallest cap (then smallest doc_id), so no
    cap is exceeded by way of copies. Only ids, sizes and a SHA-256 of each text are shuffled. Texts without tokens, and documents of
    null or unlisted sources, can't contribute.
    """
    sized = count_tokens(pick(docs, ["doc_id", "source", "text"]).withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)), vocabulary, pattern, ["doc_id", "source", "sha"])
    t = pick(targets, ["source", "max_repeats"]).groupBy("source").agg(F.min("max_repeats").alias("cap"))
    own = sized.filter("n_tokens > 0").join(t, "source")
    best = F.min(F.struct("cap", "doc_id", "source", "n_tokens")).alias("b")
    return own.groupBy("sha").agg(best).select("b.doc_id", "b.source", "b.n_tokens")


def rates(totals: dict[str, int], targets: list[tuple[str, float, int]], total_tokens: float | None = None) -> dict[str, float]:
    """Expected copies of each document by source: the planned tokens of the source over the tokens it has, at most its cap."""
    live = [(s, w, cap) for s, w, cap in targets if totals.get(s, 0) > 0 and w > 0 and cap > 0]
    weight = sum(w for _, w, _ in live)
    if not live or weight <= 0:
        return {}
    most = min(cap * totals[s] * weight / w for s, w, cap in live)
    plan = most if total_tokens is None else total_tokens
    return {s: min(float(cap), plan * (w / weight) / totals[s]) for s, w, cap in live}


def mix_sources(docs: DataFrame, targets: DataFrame, vocabulary: str, pattern: str, total_tokens: float | None = None, seed: int = 20) -> Mix:
    """Draw a mixture; see the module's text.

    A source without usable documents is reported with nothing reached, and its share goes to the others in proportion. A source
    repeated in ``targets`` counts with the sum of its shares and its smallest cap; null sources, and shares or caps of 0 or less,
    draw nothing. With a total beyond what the caps allow, the capped sources fall short and the report says by how much. Empty
    documents or targets give an empty mixture. Without ``total_tokens`` the scarcest source sets the size of the whole mixture; the
    report marks it (at_cap).
    """
    spark = docs.sparkSession
    t = pick(targets, ["source", "target_share", "max_repeats"]).filter(F.col("source").isNotNull())
    t = t.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    want = [(r.source, float(r.target_share or 0), int(r.max_repeats or 0)) for r in t.limit(MOST_TARGETS + 1).collect()]
    if len(want) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} target sources")
    order = ["source", "n_tokens", F.xxhash64("doc_id", F.lit(seed)), "doc_id"]
    ranged = candidates(docs, t, vocabulary, pattern).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))

    parts = placed.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.sum("n_tokens").alias("tokens"))
    totals = {r.source: int(r.tokens) for r in parts.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}  # as many as targets at most
    rate = rates(totals, want, total_tokens)
    rng = random.Random(seed)
    draw = spark.createDataFrame([(s, rate.get(s, 0.0), rng.random()) for s, _, _ in sorted(want)], "source string, rate double, shift double")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition and source boundary, so its size is bounded by the number of partitions and targets
    offsets = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(draw, "source").select("source", "part", "first", "before", "rate", "shift")
    rank = F.col("before") + F.col("at") - F.col("first")
    # decimals: doubles would lose whole copies once rank times rate has no digits left behind the point
    rate_, shift = F.col("rate").cast("decimal(17,12)"), F.col("shift").cast("decimal(17,12)")
    at = lambda r: F.floor(shift + rate_ * r.cast("decimal(19,0)"))
    crossed = at(rank + 1) - at(rank)
    drawn = placed.join(F.broadcast(offsets), ["source", "part"]).withColumn("n_copies", crossed.cast("int")).filter("n_copies > 0")
    copies = drawn.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no"))

    has = parts.groupBy("source").agg(F.sum("n").alias("texts"), F.sum("tokens").alias("tokens"))
    used = drawn.groupBy("source").agg(F.sum("n_copies").alias("copies"), F.sum(F.col("n_copies") * F.col("n_tokens")).alias("tokens_used"), F.max("n_copies").alias("most_repeats"))
    every = Window.partitionBy()  # one row per target source
    scarce = draw.select("source", F.col("rate").alias("_rate"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    shares = t.join(has, "source", "left").join(used, "source", "left").select("source", "target_share", "max_repeats", zero("texts"), zero("tokens"), zero("copies"), zero("tokens_used"), zero("most_repeats"))
    # the sources that are used as often as they may be: without a total these set the size of the whole mixture
    shares = shares.join(scarce, "source").withColumn("at_cap", (F.col("_rate") > 0) & (F.col("_rate") >= F.col("max_repeats") - F.lit(1e-9))).drop("_rate")
    total = F.sum("tokens_used").over(every)
    shares = shares.withColumn("reached_share", F.when(total > 0, F.round(F.col("tokens_used") / total, 6)).otherwise(F.lit(0.0)))
    return Mix(copies, shares.withColumn("gap", F.round(F.col("reached_share") - F.col("target_share"), 6)))
