"""From a question to its community, constraint and keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.text import ordered_distinct
from graphloom.model import ABBREVIATIONS, CONSTRAINTS, DEFAULT_CONSTRAINT, ROUTES

_NO_STRINGS = "cast(array() as array<string>)"


def _strings(c: Column) -> Column:
    return F.coalesce(c, F.expr(_NO_STRINGS))


def _lookup(table: dict, mentioned: Column, asked: Column) -> Column:
    """The entry for (label, asked) of the first mentioned label that has one."""
    m = F.create_map(*[F.lit(x) for (a, b), v in table.items() for x in (f"{a}|{b}", v)])
    found = F.filter(F.transform(mentioned, lambda x: F.try_element_at(m, F.concat_ws("|", x, asked))), lambda v: v.isNotNull())
    return F.get(found, 0)


def community(keywords: Column, mentioned: Column, asked: Column) -> Column:
    """The community that answers: a seven-digit code among the keywords, a long skill, the table of labels, or everything."""
    kws, labels, a = _strings(keywords), _strings(mentioned), F.coalesce(asked, F.lit("UNKNOWN"))
    code = F.exists(kws, lambda k: F.coalesce(k.rlike(r"(?U)\b[0-9]{7}\b"), F.lit(False)))
    long_kw = F.exists(kws, lambda k: F.coalesce(F.size(F.split(F.regexp_replace(k, r"(?U)^\s+|\s+$", ""), r"(?U)\s+")) >= 2, F.lit(False)))
    skill = a.isin("CAREER", "SUBJECT") & F.array_contains(labels, "SKILL") & long_kw
    return F.when(code, "L3_MAJOR_CENTRIC").when(skill, "L3_SKILL_CENTRIC").otherwise(F.coalesce(_lookup(ROUTES, labels, a), F.lit("L1_GLOBAL")))


def constraint(mentioned: Column, asked: Column, comparison: Column) -> Column:
    """What the answer is held to."""
    labels, a = _strings(mentioned), F.coalesce(asked, F.lit("UNKNOWN"))
    both = F.coalesce(comparison, F.lit(False)) & F.array_contains(labels, "MAJOR")
    return F.when(both, CONSTRAINTS["MAJOR", "MAJOR"]).otherwise(F.coalesce(_lookup(CONSTRAINTS, labels, a), F.lit(DEFAULT_CONSTRAINT)))


#: Neither before nor after a short form may stand a letter, digit or underscore, or any character from À to ɏ.
_B = r"[\wÀ-ɏ]"


def found_abbreviations(question: Column) -> Column:
    """The short forms in a question, in the order of the table: up to three letters in capitals only, longer ones in any case."""
    tests = [F.when(question.rlike(rf"(?U)(?<!{_B}){a.upper()}(?!{_B})" if len(a) <= 3 else rf"(?iuU)(?<!{_B}){a}(?!{_B})"), F.lit(a)) for a in ABBREVIATIONS]
    return F.array_compact(F.array(*tests))


def expansions(question: Column) -> Column:
    """The full forms of the short forms in a question, in order."""
    m = F.create_map(*[x for a, full in ABBREVIATIONS.items() for x in (F.lit(a), F.array(*map(F.lit, full)))])
    return F.flatten(F.transform(found_abbreviations(question), lambda a: F.try_element_at(m, a)))


def expanded(question: Column) -> Column:
    """The question with a note that spells its short forms out."""
    m = F.create_map(*[x for a, full in ABBREVIATIONS.items() for x in (F.lit(a), F.lit(f"{a.upper()} = {' / '.join(full)}"))])
    hints = F.array_join(F.transform(found_abbreviations(question), lambda a: F.try_element_at(m, a)), "; ")
    return F.when(hints != "", F.concat(question, F.lit("  [GHI CHÚ: "), hints, F.lit("]"))).otherwise(question)


def all_keywords(given: Column, question: Column) -> Column:
    """Given keywords and those of the question's short forms, each once, in order."""
    return ordered_distinct(_strings(given), _strings(expansions(question)))


# Words that name a label, for the built-in intent of questions.
LABEL_WORDS = {"MAJOR": ["ngành", "major"], "SUBJECT": ["môn", "học phần", "course", "subject"], "SKILL": ["kỹ năng", "skill"], "CAREER": ["nghề", "career", "vị trí"], "TEACHER": ["giảng viên", "thầy", "cô ", "teach"]}


def lexicon_intent(question: Column) -> Column:
    """A deterministic intent from label words, codes and short forms, where no outside service reads the question."""
    q = F.lower(question)
    at = {label: F.array_min(F.array_compact(F.array(*[F.nullif(F.instr(q, w), F.lit(0)) for w in ws]))) for label, ws in LABEL_WORDS.items()}
    seen = F.array_sort(F.filter(F.array(*[F.struct(p.alias("at"), F.lit(label).alias("label")) for label, p in at.items()]), lambda s: s["at"].isNotNull()))
    labels = F.transform(seen, lambda s: s["label"])
    codes = F.regexp_extract_all(question, F.lit(r"\b([0-9]{7}|[A-Z]{4}[0-9]{4})\b"), F.lit(1))
    return F.struct(
        all_keywords(codes, question).alias("keywords"), labels.alias("mentioned_labels"), F.coalesce(F.try_element_at(labels, F.lit(-1)), F.lit("UNKNOWN")).alias("asked_label"),
        F.expr(_NO_STRINGS).alias("negated_keywords"), F.contains(q, F.lit("so sánh")).alias("is_comparison"),
    )
