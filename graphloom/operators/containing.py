"""Texts that contain words, as equi-joins on grams instead of nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a gram.
GRAM = 3
#: Letters of all rows of words, as JSON, up to which every task gets all of them.
SENT = 8_000_000


def _parts(c: Column, n: int) -> Column:
    """The distinct parts of n letters of a text; [] for a shorter one."""
    if n == 0:
        return F.array(F.substring(c, 1, 0))
    at = F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1)))
    return F.filter(F.array_distinct(F.transform(at, lambda i: F.substring(c, i, F.lit(n)))), lambda p: F.length(p) == n)


def _joined(many: DataFrame, words: DataFrame, on: str | Column, sent: bool) -> DataFrame:
    """An inner join that never broadcasts ``many``, whatever Spark takes its size for: the words are sent, or both sides are merged."""
    return many.join(F.broadcast(words), on) if sent else many.hint("merge").join(words, on)


def measured(words: DataFrame, word: str) -> tuple[bool, bool]:
    """Whether words are few enough to be sent to every task, and whether any is shorter than a gram; one job over words."""
    n = words.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)), F.coalesce(F.min(F.length(word)) < GRAM, F.lit(False))).first()
    return n[0] <= SENT, n[1]


def containing(texts: DataFrame, text: str, words: DataFrame, word: str, counted: bool = False, size: tuple[bool, bool] | None = None) -> DataFrame:
    """texts joined with the words that the column ``text`` contains; both tables' columns, which must differ. Nulls match nothing, '' is in every text.

    A word of three letters or more meets the texts that have its first gram, or, if ``counted``, the one of its grams that fewest
    texts have, so that a common opening is no hot key; shorter words meet the texts that have them as a part of that length. Every
    match is found once. Spark takes the grams of a text for no more bytes than the text, and so might collect and broadcast those of
    a large table. Therefore few words are sent (then no gram travels), and more are merged; if ``counted``, the choice is Spark's.
    ``size``: what ``measured`` gave for words, if known.
    """
    t, w = F.col(text), F.col(word)
    sent, short_ones = (False, True) if counted else size or measured(words, word)
    meet = lambda own, mine: own.join(mine, "_g") if counted else _joined(own, mine, "_g", sent)
    long = words.filter(F.length(w) >= GRAM)
    own = texts.withColumn("_g", F.explode(_parts(t, GRAM)))
    if counted:
        grams = long.select(word, F.explode(_parts(w, GRAM)).alias("_g")).distinct()
        n = own.join(grams.select("_g").distinct(), "_g", "left_semi").groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
        best = grams.join(n, "_g").groupBy(word).agg(F.min(F.struct("_n", "_g")).alias("_b")).select(F.col(word).alias("_w"), F.col("_b._g").alias("_g"))
        long = long.join(best, w == F.col("_w")).drop("_w")
    else:
        long = long.withColumn("_g", F.substring(w, 1, GRAM))
    hits = meet(own, long).filter(F.contains(t, w)).drop("_g")
    if not short_ones:
        return hits
    few = texts.filter(t.isNotNull()).withColumn("_g", F.explode(F.concat(*[_parts(t, n) for n in range(GRAM)])))
    short = words.filter(F.length(w) < GRAM).withColumn("_g", w)
    return hits.unionByName(meet(few, short).drop("_g"))


def sized(keywords: DataFrame) -> tuple[bool, bool]:
    """What ``measured`` gives for keywords (kw, kw_pos) in lower case; it holds for a part of them too."""
    return measured(keywords.withColumn("_kw", F.lower("kw")), "_kw")


def named(nodes: DataFrame, keywords: DataFrame, by_code: bool = True, size: tuple[bool, bool] | None = None) -> DataFrame:
    """nodes joined with the keywords (kw, kw_pos) that their name contains, case aside, or that are their code; each pair once.

    ``size``: what ``sized`` gave for these keywords or more, if known.
    """
    n, k = nodes.withColumn("_name", F.lower("name")), keywords.withColumn("_kw", F.lower("kw"))
    size = size or sized(keywords)
    hits = containing(n, "_name", k, "_kw", size=size).drop("_name", "_kw")
    if not by_code:
        return hits
    codes = _joined(nodes, keywords, F.col("code") == F.col("kw"), size[0]).filter(~F.coalesce(F.contains(F.lower("name"), F.lower("kw")), F.lit(False)))
    return hits.unionByName(codes.select(*hits.columns))
