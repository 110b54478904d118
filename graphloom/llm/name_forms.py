"""Written names as lists of plain tokens: what typing habits, titles, initials and short forms make of one name."""

from __future__ import annotations

import re
import unicodedata

from graphloom.functions.canon import even, fold, words

# The parts of a Vietnamese syllable, without tone marks.
_ONSET = "b|ch|c|d|gh|gi|g|h|kh|k|l|m|ngh|ng|nh|n|ph|qu|q|r|s|th|tr|t|v|x|"
_RIME = (
    "a|ac|ach|ai|am|an|ang|anh|ao|ap|at|au|ay|e|ec|ech|em|en|eng|enh|eo|ep|et|eu|i|ia|ich|iec|iem|ien|ieng|iep|iet|ieu|im|in|inh|ip|it|iu|o|oa|oac|oach|oai|oam|oan|oang|oanh|oat|oay|oc|oe|oen|oet|oi|om|on|ong|op|ot|"
    "u|ua|uan|uang|uat|uay|uc|ue|uech|uenh|ui|um|un|ung|uo|uoc|uoi|uom|uon|uong|uop|uot|uou|up|ut|uu|uy|uya|uych|uyen|uyet|uynh|uyt|uyu|y|yem|yen|yet|yeu|ynh|yt"
)
SYLLABLE = rf"^(?:{_ONSET})(?:{_RIME})$"
_SYLLABLE = re.compile(SYLLABLE)

# Academic and polite titles, as words without accents.
TITLES = frozenset("gs pgs ts ths dr prof professor mr mrs ms miss mx gv ncs ks cn bs phd msc thay".split())
#: Titles that are names, too: only with their accents, or before a short form.
SOFT_TITLES = frozenset("cô chị anh bà thầy".split())
# English short names.
NICKNAMES = {
    "alex": "alexander", "andy": "andrew", "tony": "anthony", "ben": "benjamin", "benny": "benjamin", "cathy": "catherine", "chuck": "charles", "charlie": "charles", "chris": "christopher", "kit": "christopher", "dan": "daniel", "danny": "daniel", "dave": "david",
    "dot": "dorothy", "dottie": "dorothy", "dolly": "dorothy", "ed": "edward", "eddie": "edward", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "lizzie": "elizabeth", "fred": "frederick", "freddie": "frederick", "gabby": "gabriella", "gabi": "gabriella", "ella": "gabriella",
    "hank": "henry", "harry": "henry", "bella": "isabella", "izzy": "isabella", "jim": "james", "jimmy": "james", "jen": "jennifer", "jenny": "jennifer", "jon": "jonathan", "jonny": "jonathan", "joe": "joseph", "josh": "joshua", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kay": "katherine",
    "larry": "lawrence", "len": "leonard", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "greta": "margaret", "matt": "matthew", "mike": "michael", "mick": "michael", "nat": "nathaniel", "nate": "nathaniel", "nick": "nicholas", "nicky": "nicholas", "ollie": "oliver", "pat": "patricia", "patty": "patricia", "tricia": "patricia", "trish": "patricia",
    "pete": "peter", "phil": "philip", "ray": "raymond", "becky": "rebecca", "rick": "richard", "dick": "richard", "rich": "richard", "bob": "robert", "rob": "robert", "bobby": "robert", "ron": "ronald", "sam": "samuel", "sammy": "samuel", "steve": "stephen", "sue": "susan", "ted": "theodore", "teddy": "theodore", "theo": "theodore",
    "tom": "thomas", "tommy": "thomas", "tim": "timothy", "vicky": "victoria", "vic": "victor", "walt": "walter", "bill": "william", "will": "william", "billy": "william", "liam": "william",
}
# Short forms of tools.
TOOL_ALIASES = {
    "js": "javascript", "java script": "javascript", "ts": "typescript", "type script": "typescript", "py": "python", "kt": "kotlin", "rs": "rust", "tf": "terraform", "pts": "photoshop", "ps": "photoshop", "cpp": "c++", "c plus plus": "c++", "cplusplus": "c++", "c cong cong": "c++",
    "csharp": "c#", "c sharp": "c#", "cs": "c#", "k8s": "kubernetes", "kube": "kubernetes", "psql": "postgresql", "postgres": "postgresql", "pg": "postgresql", "es": "elasticsearch", "elastic": "elasticsearch", "elastic search": "elasticsearch", "gql": "graphql", "graph ql": "graphql",
    "xls": "excel", "xlsx": "excel", "ms excel": "excel", "acad": "autocad", "auto cad": "autocad", "torch": "pytorch", "py torch": "pytorch", "mat lab": "matlab", "golang": "go", "hdfs": "hadoop",
}
CONNECTORS = frozenset(["bang", "voi", "qua", "dung"])


def is_syllable(w: str) -> bool:
    return bool(_SYLLABLE.match(w))


def untyped(w: str) -> str:
    """A plain token typed in an input method that was off: letters doubled or followed by w and tone letters (Telex), or digits (VNI)."""
    if is_syllable(w) or len(w) < 2:
        return w
    b = re.sub(r"(?<=[a-z])[0-9]+", "", w)
    if is_syllable(b):
        return b
    b = b.replace("dd", "d")
    for x in ("aa", "ee", "oo"):
        b = b.replace(x, x[0])
    b = re.sub(r"([aou])w", r"\1", b)
    b = "u" + b[1:] if b.startswith("w") else b
    for tail in (b, b[:-1] if b[-1:] in "sfrxjz" else b, re.sub(r"(?<=[aeiouy])[sfrxjw](?=[a-z]{0,3}$)", "", b, count=1)):
        if len(tail) > 1 and is_syllable(tail):
            return tail
    t = re.sub(r"w", "", b)
    for tail in (t, t[:-1] if t[-1:] in "sfrxjz" else t):
        if len(tail) > 1 and is_syllable(tail):
            return tail
    return w


def _uncamel(text: str) -> str:
    """A space where a small letter is followed by a capital inside a word."""
    out = []
    for i, c in enumerate(text):
        if i and c.isupper() and text[i - 1].islower():
            out.append(" ")
        out.append(c)
    return "".join(out)


def person_tokens(name: str | None, is_key: bool = False) -> list[str]:
    """The tokens of a person's name without accents and titles; '~x' is an initial. [] if nothing is left."""
    if not name:
        return []
    text = unicodedata.normalize("NFKC", name)
    text = re.sub(r"\(([^()]*)\)", lambda m: " " if all(fold(even(w)) in TITLES or w in SOFT_TITLES or fold(w) in ("co", "thay") for w in words(m[1])) else f" {m[1]} ", text)
    mixed = any(c.islower() for c in text)
    raw = [w for w in re.split(r"[\s,;/_|–—-]+", text) if w]
    if mixed and not is_key:
        raw = [x for w in raw for x in ([w] if fold(even(w)).strip(".()") in TITLES else _uncamel(w).split())]
    out: list[str] = []
    for w in raw:
        dotted = re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]?\.?", w)
        plain = [fold(even(x)) for x in re.findall(r"[^\W_]+", w)]
        joined = "".join(plain)
        if not joined or joined.isdigit():  # keys of names that occur again are numbered
            continue
        if joined in TITLES or (joined in ("gsts", "pgsts")) or (len(plain) > 1 and all(p in TITLES for p in plain)):
            continue
        if even(w).strip(".()") in SOFT_TITLES and not out and len(raw) > 1 and (w[:1].islower() or even(w).strip(".") in ("cô", "thầy", "chị")):
            continue
        if dotted or (len(joined) == 1 and len(raw) > 1):
            out += [f"~{c}" for c in joined]
        elif mixed and w.isupper() and 2 <= len(joined) <= 4 and len(raw) <= 3 and not is_key:
            out += [f"~{c}" for c in joined]
        elif len(plain) > 1:
            out += [f"~{p}" if len(p) == 1 else p for p in plain if p not in TITLES]
        else:
            out.append(joined)
    out = [w if w[0] == "~" else untyped(w) for w in out]
    if any(len(w) > 3 and w[0] != "~" and not is_syllable(w) for w in out):
        out = [NICKNAMES.get(w, w) for w in out]
    return out


_MARK = "zqz"


def skill_tokens(name: str | None, tools: frozenset[str], phrases: dict[str, str]) -> tuple[list[str], str]:
    """(the plain tokens of a skill without its tool, the tool or ''); '~x' is an initial that stands for a word."""
    if not name:
        return [], ""
    text = unicodedata.normalize("NFKC", name)
    # an initial with a stop that stands for a word ("B.vệ") is marked, so that it isn't taken for a word or a tool
    text = re.sub(r"(?<![^\W_])([^\W\d_])\.(?=[^\W\d_])", rf" {_MARK}\1 ", text)
    out = [f"~{f[len(_MARK) :]}" if f.startswith(_MARK) else f for f in (fold(w) for w in words(text))]
    titled = out[:2] == ["ky", "nang"] and len(out) > 4
    if titled:
        out = out[2:]
    tool = ""
    for k in (3, 2, 1):  # "... with <tool>", "skill ... (<tool>)"
        tool = _tool(" ".join(out[-k:]), tools) if len(out) > k else ""
        if tool:
            out = out[:-k]
            if not titled and len(out) > 2:
                last = untyped(out[-1])
                if last in CONNECTORS or _slip(last, "bang"):
                    out = out[:-1]
                elif last.endswith("bang") and len(last) > 5:  # run together with the word before
                    out = [*out[:-1], last[:-4]]
            break
    for k in (3, 2, 1):  # "<tool> - ..."
        if not tool and len(out) > k + 1:
            tool = _tool(" ".join(out[:k]), tools)
            out = out[k:] if tool else out
    spelled = [x for w in out for x in phrases.get(w, w).split()]
    return [w if w[0] == "~" else untyped(w) for w in spelled], tool


def _tool(phrase: str, tools: frozenset[str]) -> str:
    phrase = TOOL_ALIASES.get(phrase, phrase)
    return phrase if phrase in tools else ""


def _slip(a: str, b: str) -> bool:
    """b mistyped: one edit, or two if that makes no word."""
    return a != b and (osa(a, b, 1) <= 1 or (not is_syllable(a) and a[:1] == b[0] and osa(a, b, 2) <= 2))


def osa(a: str, b: str, most: int = 2) -> int:
    """Edits (a swap of neighbours is one) from a to b, or most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        before, row = row, new
    return min(row[-1], most + 1)


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity, prefix weight 0.1 over at most four letters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 1)  # at least one, so that a swap in a short word is seen
    hit = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not hit[j] and b[j] == x:
                hit[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, h in zip(b, hit) if h]
    swaps = sum(x != y for x, y in zip(left, right)) / 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


_CLASS = str.maketrans({"y": "i", "w": "u"})


def code(token: str) -> str:
    """Phonetic code: the first letter and the consonants that follow, in order of the alphabet, so that swaps, doublings and vowels don't matter."""
    t = token.lstrip("~").translate(_CLASS)
    rest = sorted({c for c in t[1:] if c.isalnum() and c not in "aeiou"})
    return t[:1] + "".join(rest)
