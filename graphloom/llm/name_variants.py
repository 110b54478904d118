"""Variant spellings of names typed by people: which written forms mean one entity.

Forms (distinct token lists) are blocked by phonetic codes of their sorted tokens: under all codes, and under the codes of all tokens
but one (or but neighbours that may be run together or shortened to an acronym) with what that token looks like with a letter left
out. So no block rests on common tokens alone, and its size depends on how many ways one name is typed, not on how many names there
are. Candidates are compared token by token: what isn't equal is paired off by Jaro-Winkler, which accepts or rejects it; initials,
acronyms and nicknames are spelled out first. Accepted pairs are clustered by connected components. A shorter form (initials, dropped
names) joins a cluster only if that is the only one it can stand for, which is counted by key, without meeting the others.

Which tokens are well known is counted over all forms: a slip is rare, a word that many forms share isn't one, however near it is to
another. So "kiểm thử" and "kiểm toán", or two middle names, stay apart. All counts are of distinct forms or spellings, so copies of
records change nothing.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.canon import canon, fold, words
from graphloom.functions.columns import pick
from graphloom.llm.components import connected_components
from graphloom.llm.name_forms import SYLLABLE, code, is_syllable, jaro_winkler, person_tokens, skill_tokens
from graphloom.session import cut

#: A token is well known from this share of all forms, and from this many.
KNOWN_SHARE, KNOWN_LEAST = 0.0015, 3
#: The least Jaro-Winkler similarity of a slip, and of parts that were run together or torn.
LEAST_JW, LEAST_JW_RUN = 0.7, 0.93
#: How many times rarer a form must be to be taken for a slip of another though all its tokens are well known. Copies don't count.
RARER = 4
#: A word that ends at least this share of the names with "bằng" is a tool, so there are 5,000 at most.
TOOL_SHARE = 0.0002
#: The table of aliases is a setting, read on the driver; more rows than this are refused.
MOST_ALIASES = 100_000
PERSON, SKILL = "P", "S"


def _foreign(t: str) -> bool:
    return len(t) > 5 and not is_syllable(t)


def _deletions(t: str) -> set[str]:
    """t, and t without one letter; two of long tokens, in which more goes wrong."""
    out = {t} | {t[:i] + t[i + 1 :] for i in range(len(t))}
    if len(t) > 7:
        out |= {t[:i] + t[i + 1 : j] + t[j + 1 :] for i, j in combinations(range(len(t)), 2)}
    return out


def keys_of(tokens: list[str], persons: bool) -> list[str]:
    """The block keys of a form, the same for forms of any length.

    0: the codes of all tokens. 1: those of all but one, and that one with a letter left out or not; or of all but two neighbours, and
    these run together. Skills, whose names are longer and may have several slips, initials and acronyms, instead have keys 1 only for
    slips in the first two letters, and 2: the first letters of all codes, and one token as it is. What may be an acronym gives keys 2
    also with its letters as those of words. So a skill's variants meet that agree in their first letters and one word.
    """
    n = len(tokens)
    if n < 2:
        return []
    codes = [code(t) for t in tokens]
    out = {"0" + " ".join(sorted(codes))}
    full = [t for t in tokens if t[0] != "~"]
    for i, t in enumerate(tokens):
        if t[0] != "~":
            rest = " ".join(sorted(codes[:i] + codes[i + 1 :]))
            out.update(f"1{rest}|{v}" for v in (_deletions(t) if persons else (t, t[1:], t[0] + t[2:])))
    for i in range(n - 1):
        if tokens[i][0] != "~" and tokens[i + 1][0] != "~":
            out.add(f"1{' '.join(sorted(codes[:i] + codes[i + 2 :]))}|{tokens[i]}{tokens[i + 1]}")
    if not persons:
        letters = [c[:1] for c in codes]
        spelled = ["".join(sorted(letters))]
        for i, t in enumerate(tokens):
            if 2 <= len(t) <= 5 and t[0] != "~" and not is_syllable(t):
                spelled.append("".join(sorted([*letters[:i], *(code(c) for c in t), *letters[i + 1 :]])))
        out.update(f"2{x}|{t}" for x in spelled for t in full)
    return sorted(out)


def alike(a: list[str], known_a: list[bool], na: int, b: list[str], known_b: list[bool], nb: int, persons: bool) -> bool:
    """Whether a and b are one name but for slips, acronyms and word order. Symmetric.

    known: which tokens are well known; n: how many records have the form, copies aside. Tokens that differ are paired off by
    Jaro-Winkler similarity, and each pair must reach LEAST_JW. A slip may happen to give a well-known token; that is believed of a
    form much rarer than the other, or of a long name of a person.
    """
    if (na, a) > (nb, b):  # the rarer one is looked at as the slip
        a, known_a, na, b, known_b, nb = b, known_b, nb, a, known_a, na
    left, right = Counter(a), Counter(b)
    both = left & right
    la, lb = list((left - both).elements()), list((right - both).elements())
    if not la and not lb or "".join(a) == "".join(b):
        return True
    shared = sum(v for t, v in both.items() if t[0] != "~")
    known = dict(zip(a, known_a)) | dict(zip(b, known_b))
    if not persons:
        short, rest, done = _expand(la, lb, b)
        if done:
            la, lb = short, rest
        else:
            short, rest, done = _expand(lb, la, a)
            lb, la = (short, rest) if done else (lb, la)
    if any(t[0] == "~" for t in la + lb):
        return False
    if not la and not lb:
        return True
    if len(la) != len(lb):  # run together or torn
        torn = shared >= 2 and abs(len(la) - len(lb)) == 1 and not all(known[t] for t in la) | all(known[t] for t in lb)
        return torn and jaro_winkler("".join(la), "".join(lb)) >= (1 if persons else LEAST_JW_RUN)
    foreign = persons and len(la) == 1 and shared >= 1 and len(la[0]) > 5
    if len(la) > (2 if persons else 3) or shared < (2 if len(la) == 1 else 3) and not foreign:
        return False
    much = na * RARER <= nb
    rarer = (shared >= 4 or (shared == 3 and (na == 1 or much))) if persons else shared >= 5 and much
    rest = list(lb)
    for t in la:
        near = [(jaro_winkler(t, o), o) for o in rest if rarer or not (known[t] and known[o])]
        if not near or max(near)[0] < LEAST_JW:
            return False
        rest.remove(max(near)[1])
    return True


def _expand(la: list[str], lb: list[str], b: list[str]) -> tuple[list[str], list[str], bool]:
    """Initials and acronyms of la against the words of lb they stand for; what is left of both."""
    rest = list(lb)
    out = []
    done = False
    for t in sorted(la, key=lambda x: x[0] == "~"):
        if t[0] != "~" and len(t) >= 2 and len(rest) >= len(t) and not is_syllable(t) and (run := _run(t, rest, b)):
            for w in run:
                rest.remove(w)
            done = True
        elif t[0] == "~" and (fit := [w for w in rest if w[0] == t[1]]):
            rest.remove(fit[0])
            done = True
        else:
            out.append(t)
    return out, rest, done


def _run(acronym: str, rest: list[str], b: list[str]) -> list[str]:
    """Consecutive words of b, all among rest, whose first letters spell the acronym."""
    for i in range(len(b) - len(acronym) + 1):
        run = b[i : i + len(acronym)]
        if "".join(w.lstrip("~")[:1] for w in run) == acronym and not Counter(run) - Counter(rest):
            return run
    return []


# --- short forms of persons' names

#: A short form keeps at most so many parts of a name, or all but so many.
FEW = 3


def _short_key(kept: list[str], initials: str) -> list[str]:
    """The keys of parts kept whole and initials: as they are (e), and with one foreign part with a letter left out or not (c)."""
    out = [f"e{' '.join(sorted(kept))}|{initials}"]
    for t in {t for t in kept if _foreign(t)}:
        others = " ".join(sorted((Counter(kept) - Counter([t])).elements()))
        out += [f"c{others}|{initials}|{v}" for v in {t} | {t[:i] + t[i + 1 :] for i in range(len(t))}]
    return out


def _says_enough(kept: list[str], initials: str) -> bool:
    return len(kept) >= 2 or bool(kept and initials) and (_foreign(kept[0]) or len(initials) >= 3)


def short_keys_of(tokens: list[str]) -> list[str]:
    """What a full name may be shortened to: some parts whole, and of the others none or, in order, all initials but at most one."""
    n = len(tokens)
    out: set[str] = set()
    for k in {*range(1, min(FEW, n - 1) + 1), *range(max(1, n - FEW), n)}:
        for at in combinations(range(n), k):
            kept = [tokens[i] for i in at]
            rest = "".join(tokens[i][0] for i in range(n) if i not in at)
            for initials in {"", rest, *(rest[:i] + rest[i + 1 :] for i in range(len(rest)))}:
                if _says_enough(kept, initials):
                    out.update(_short_key(kept, initials))
    return sorted(out)


def short_lookups_of(tokens: list[str]) -> list[str]:
    """Where a form looks for what it may be short for."""
    kept = [t for t in tokens if t[0] != "~"]
    initials = "".join(t[1] for t in tokens if t[0] == "~")
    return _short_key(kept, initials) if _says_enough(kept, initials) else []


def _spread(df: DataFrame) -> DataFrame:
    """A written table of few rows over all cores: small partitions are put together, but much is made of each row next."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _hash(key: str) -> int:
    return int.from_bytes(hashlib.blake2b(key.encode("utf8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _nodes(forms: DataFrame) -> DataFrame:
    """(id, kind, form, uses, known, rarest): the distinct forms, numbered, how many spellings each has, 1 or 0 for each token that is well known or not, and how many forms have its rarest token."""
    nodes = forms.filter("form <> ''").distinct().groupBy("kind", "form").agg(F.count(F.lit(1)).alias("uses"))
    each = nodes.select("kind", "form", F.posexplode(F.split("form", " ")).alias("at", "token"))
    total = nodes.groupBy("kind").agg(F.greatest(F.lit(float(KNOWN_LEAST)), F.lit(KNOWN_SHARE) * F.count(F.lit(1))).alias("total"))  # one row per kind
    counts = each.groupBy("kind", "token").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total), "kind")
    # what isn't built as a syllable has to be five times as common: names and terms are, slips aren't
    known = (F.col("n") >= F.col("total") * F.when(F.col("token").rlike(SYLLABLE), 1.0).otherwise(5.0)).cast("int").cast("string")
    marked = each.join(counts.select("kind", "token", "n", known.alias("known")), ["kind", "token"]).groupBy("kind", "form").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "known"))), lambda x: x["known"]), "").alias("known"), F.min("n").alias("rarest"))
    return cut(nodes.join(marked, ["kind", "form"]).withColumn("id", F.monotonically_increasing_id()))  # so the numbers stay


def link_forms(forms: DataFrame) -> DataFrame:
    """(id, kind, form, uses, known, rarest, cluster): every distinct form (its tokens joined by spaces); cluster is the smallest id of its cluster.

    ``forms``: (kind, form, written); kind is PERSON or SKILL, written is what tells records apart; equal rows count once, so copies
    of a record don't make its form commoner. No form is left out and no block is capped. Single tokens are linked only to equal ones.
    Only ids and hashes are blocked; equal hashes of different keys do no harm, as the comparison follows.
    """
    nodes = _nodes(forms)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, whole, at = [], [], []
            for i, (kind, form) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                keys = keys_of(form.split(" "), kind == PERSON)
                same = _hash(keys[0]) if keys else 0
                hs += [_hash(kind + k) for k in keys]
                whole += [None if k[0] == "0" else same for k in keys]  # equal codes meet once, under the key of all of them
                at += [i] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(whole, pa.int64()), b.column(0).take(pa.array(at, pa.int64()))], names=["h", "whole", "id"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = lambda k: [c == "1" for c in k]
        for b in batches:
            keep = [alike(x.split(" "), flags(kx), nx, y.split(" "), flags(ky), ny, p == PERSON) for p, x, nx, kx, y, ny, ky in zip(*(b.column(i).to_pylist() for i in range(2, 9)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ix = _spread(nodes).select("id", "kind", "form").mapInArrow(index, "h long, whole long, id long")
    # planned as a merge: what a few forms unfold to is estimated by their own size, and would be broadcast
    met = ix.toDF("h", "wa", "a").hint("merge").join(ix.toDF("h", "wb", "b"), "h").filter("a < b and (wa is null or wa <> wb)").select("a", "b").distinct()
    one = lambda x: nodes.select(F.col("id").alias(x), "kind", F.col("form").alias(f"f{x}"), F.col("uses").alias(f"n{x}"), F.col("known").alias(f"k{x}"))
    wide = met.join(one("a"), "a").join(one("b").drop("kind"), "b").select("a", "b", "kind", "fa", "na", "ka", "fb", "nb", "kb")
    edges = wide.mapInArrow(judge, "a long, b long")
    groups = connected_components(nodes.select(F.col("id").alias("form")), edges).toDF("id", "cluster")
    return cut(nodes.join(groups, "id"))


def join_short_forms(forms: DataFrame) -> DataFrame:
    """(form, cluster) of persons' ``forms`` (of link_forms): a cluster of short forms becomes part of the only cluster that it can stand for.

    Each cluster is represented by the form whose rarest token is commonest (a slip is rare; then most spellings, smallest). A form
    looks itself up under its own key, so a key has hardly more than one form that looks, however many names can be shortened to it;
    what they can stand for is counted, not compared with each other. Clusters that are short forms themselves don't stand for anything.
    """

    def keys(of, out: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [of(f.split(" ")) for f in b.column(1).to_pylist()]
                at = pa.array([i for i, ks in enumerate(found) for _ in ks], pa.int64())
                ks = [k for ks in found for k in ks]
                yield pa.RecordBatch.from_arrays([pa.array(map(_hash, ks), pa.int64()), pa.array([k[0] == "e" for k in ks], pa.bool_()), b.column(0).take(at)], names=["h", "exact", out])

        return run

    best = forms.filter(~F.contains("form", F.lit("~"))).groupBy("cluster").agg(F.min(F.struct((-F.col("rarest")).alias("rarest"), (-F.col("uses")).alias("uses"), "form")).alias("r")).select("cluster", F.col("r.form").alias("form"))
    index = best.repartition(forms.sparkSession.sparkContext.defaultParallelism, "cluster").mapInArrow(keys(short_keys_of, "full"), "h long, exact boolean, full long")
    looked = forms.select("cluster", "form").mapInArrow(keys(short_lookups_of, "cluster"), "h long, exact boolean, cluster long").select("h", "cluster").distinct()
    hits = cut(index.hint("merge").join(looked, "h").filter("full <> cluster").select("cluster", "exact", "full").distinct())
    full = hits.join(hits.select(F.col("cluster").alias("full")).distinct(), "full", "left_anti")
    at = lambda f: F.coalesce(f(F.when(F.col("exact"), F.col("full"))), f(F.when(~F.col("exact"), F.col("full"))))  # noqa: E731  names as they are come first
    only = full.groupBy("cluster").agg(at(F.min).alias("low"), at(F.max).alias("high")).filter("low = high").select("cluster", "low")
    return forms.join(only, "cluster", "left").select("form", F.coalesce("low", "cluster").alias("cluster"))


# --- records of persons


def _read_people(teachers: DataFrame) -> DataFrame:
    cols = ["record_id", "name", "teacher_key", "email", "title"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, names, keys, emails, titles = (b.column(i).to_pylist() for i in range(5))
            nf = [" ".join(person_tokens(n)) for n in names]
            kf = [" ".join(person_tokens((k or "").replace("_", " ").replace("-", " "), True)) for k in keys]
            mail = ["".join((e or "").split()).lower() or None for e in emails]
            accents = [" ".join(sorted(words(n))) for n in names]
            title = ["".join(fold(w) for w in words(t)) for t in titles]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.string()) for x in (nf, kf, mail, accents, title))], names=["record_id", "nf", "kf", "mail", "accents", "title"])

    t = pick(teachers, cols).withColumn("record_id", F.col("record_id").cast("long"))
    return cut(t.mapInArrow(read, "record_id long, nf string, kf string, mail string, accents string, title string").withColumn("row", F.monotonically_increasing_id()))


def _people_forms(rec: DataFrame) -> DataFrame:
    # a key that repeats the name isn't a second use of it
    return rec.select(F.lit(PERSON).alias("kind"), F.explode(F.array_distinct(F.array("nf", "kf"))).alias("form"), F.concat_ws("\x1f", "accents", "kf", F.coalesce("mail", F.lit(""))).alias("written"))


def _people(rec: DataFrame, clusters: DataFrame) -> DataFrame:
    parts = F.size(F.filter(F.split("form", " "), lambda x: ~x.startswith("~")))
    each = rec.select("row", F.posexplode(F.array("nf", "kf")).alias("at", "form")).filter("form <> ''").join(clusters, "form")
    # the fuller of name and key; of equally full ones the name
    chosen = each.groupBy("row").agg(F.min(F.struct((-parts).alias("parts"), "at", "cluster")).alias("c")).select("row", F.col("c.cluster").alias("cluster"))
    named = cut(rec.select("row", "record_id", "mail", "accents", "title").join(chosen, "row", "left"))
    known = named.filter("mail is not null and cluster is not null").groupBy("cluster", "mail").agg(F.count(F.lit(1)).alias("n"), F.collect_set("accents").alias("spelt"), F.collect_set("title").alias("titles"))
    lost = named.filter("mail is null and cluster is not null").join(known.withColumnRenamed("mail", "m"), "cluster")
    agree = F.array_contains("spelt", F.col("accents")).cast("int") + 2 * ((F.col("title") != "") & F.array_contains("titles", F.col("title"))).cast("int")
    best = lost.groupBy("row").agg(F.min(F.struct((-agree).alias("x"), (-F.col("n")).alias("y"), F.col("m").alias("m"))).alias("b")).select("row", F.col("b.m").alias("m"))
    out = named.join(best, "row", "left")
    mail = F.coalesce("mail", "m")
    person = F.when(mail.isNotNull(), F.concat(F.lit("@"), mail)).when(F.col("cluster").isNotNull(), F.concat(F.lit("n"), "cluster")).otherwise(F.concat(F.lit("r"), F.col("row").cast("string")))
    return out.select("record_id", person.alias("person"))


def link_people(teachers: DataFrame) -> DataFrame:
    """(record_id, person): every record with the class of its person.

    An email, spaces and case aside, belongs to one person, who has no other: records with one are settled by it. The others go by
    their name, or by their key if that is fuller: to the only person with that name; of several, to the one whose accents and title
    agree best (then the one with most records, then the smallest email). Without any usable name or email a record is alone.
    Null ids are kept. Repeated rows share a class. An empty table gives no rows.
    """
    rec = _read_people(teachers)
    return _people(rec, join_short_forms(link_forms(_people_forms(rec))))


# --- records of skills


def known_tools(names: DataFrame) -> frozenset[str]:
    """Tools: single words that end at least TOOL_SHARE of the distinct names that end with a word after "bằng" ("with")."""
    last = F.regexp_extract("name", r"(?iu)b(?:ằng|ang)[\s_]+\W*([a-z][a-z0-9+#]*)\W*$", 1)
    ends = names.select(F.lower("skill_name").alias("name")).distinct().select(last.alias("t")).filter("t <> ''").groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    # one row per ending word; the window only adds them up
    kept = ends.withColumn("all", F.sum("n").over(Window.partitionBy())).filter(F.col("n") >= TOOL_SHARE * F.col("all"))
    return frozenset(r.t for r in kept.select("t").collect())  # 1 / TOOL_SHARE rows at most


def _read_skills(skills: DataFrame, aliases: DataFrame) -> DataFrame:
    t = pick(skills, ["record_id", "skill_name"]).withColumn("record_id", F.col("record_id").cast("long"))
    table = pick(aliases, ["alias", "full_form", "kind"]).filter("alias is not null and full_form is not null").limit(MOST_ALIASES + 1).collect()
    if len(table) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} aliases")
    named = {" ".join(fold(w) for w in words(r.alias)): " ".join(fold(w) for w in words(r.full_form)) for r in table if r.kind == "tool"}
    phrases = {"".join(fold(w) for w in words(r.alias)): " ".join(fold(w) for w in words(r.full_form)) for r in table if r.kind == "phrase"}
    tools = known_tools(t) | frozenset(named.values())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms, tool, written = [], [], []
            for s in b.column(1).to_pylist():
                tokens, k = skill_tokens(s, tools, phrases)
                forms.append(" ".join(tokens))
                tool.append(k)
                written.append(canon(s))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.string()) for x in (forms, tool, written))], names=["record_id", "form", "tool", "written"])

    return cut(t.mapInArrow(read, "record_id long, form string, tool string, written string").withColumn("row", F.monotonically_increasing_id()))


def _skill_forms(rec: DataFrame) -> DataFrame:
    return rec.select(F.lit(SKILL).alias("kind"), "form", "written")


def _skills(rec: DataFrame, forms: DataFrame) -> DataFrame:
    clusters = forms.select("form", "cluster")
    own = F.concat(F.lit("r"), F.col("row").cast("string"))
    skill = F.when(F.col("cluster").isNotNull(), F.concat(F.lit("s"), F.col("cluster").cast("string"), F.lit(" | "), "tool")).when(F.col("tool") != "", F.concat(F.lit("t"), "tool")).otherwise(own)
    return rec.join(clusters, "form", "left").select("record_id", skill.alias("skill"), "written")


def link_skills(skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """(record_id, skill, written): every record with the class of its skill and its canonical spelling.

    A skill is what remains of the name without its tool, and the tool. Known short forms (``aliases``: alias, full_form, kind; more
    than MOST_ALIASES raise ValueError) and tools are spelled out, unknown acronyms are matched with the words they stand for. A record
    without a name is alone. Repeated rows share a class. An empty table gives no rows.
    """
    rec = _read_skills(skills, aliases)
    return _skills(rec, link_forms(_skill_forms(rec)))


def link_people_and_skills(teachers: DataFrame, skills: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """link_people and link_skills, with the forms of both blocked, compared and clustered in one pass."""
    people, named = _read_people(teachers), _read_skills(skills, aliases)
    forms = link_forms(_people_forms(people).unionByName(_skill_forms(named)))
    return _people(people, join_short_forms(forms.filter(F.col("kind") == PERSON))), _skills(named, forms.filter(F.col("kind") == SKILL))


def pairs_of(members: DataFrame, group: str | list[str], differ: str | None = None) -> DataFrame:
    """(groups..., id_a, id_b), id_a < id_b, of each two records of one class (with ``differ``: whose value of it differs). The result asks for every pair."""
    keys = [group] if isinstance(group, str) else group
    part = [k for k in keys if k != keys[-1]]
    m = cut(members.filter(F.col("record_id").isNotNull()).dropDuplicates([*part, "record_id"]))  # both sides read it
    extra = [differ] if differ else []
    a = m.select(*keys, F.col("record_id").alias("id_a"), *[F.col(c).alias("wa") for c in extra])
    b = m.select(*keys, F.col("record_id").alias("id_b"), *[F.col(c).alias("wb") for c in extra])
    on = a.join(b, keys).filter("id_a < id_b")
    return (on.filter("wa <> wb") if differ else on).select(*part, "id_a", "id_b")
