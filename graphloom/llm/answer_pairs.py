"""Broken prompt and response pairs: every defect type that ordered rules find.

empty           nothing that answers: null, blank, placeholders, bare labels and markup
copy            nothing beyond the question: repeated, quoted, wrapped in phrases that say so, retyped with slips
refusal         declines or says that it can't answer, in any language, and answers nothing
other_language  another language than the question's, by script, function words and syllables; names and terms don't count
truncated       breaks off: unclosed delimiters, dangling words, cut enumerations, prose without an end, and list items or
                openings whose endings differ from how the rest of the corpus ends them

The rules that look at one pair run in one pass over the texts. Two need the corpus: how complete list items end, and how often
answers with the same opening end with a stop. Both are counts over all pairs, joined back only to the pairs left undecided.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.canon import canon, even, fold, words
from graphloom.functions.columns import pick
from graphloom.llm.name_forms import is_syllable
from graphloom.session import cut

#: In the order in which a pair's one defect is chosen.
DEFECTS = ["empty", "copy", "refusal", "other_language", "truncated"]

# What stands where an answer should, canonically written; labels that may stand before one; phrases that echo a question.
PLACEHOLDERS = frozenset("null none nil na nan nul undefined tbd tba todo xxx empty blank unknown trống khôngcó chưacó khôngrõ chưarõ đangcậpnhật chưacậpnhật noanswer chưacócâutrảlời khôngcócâutrảlời".split())
LABELS = r"(?:đáp án|dap an|trả lời|tra loi|câu trả lời|cau tra loi|answer|response|réponse|reply|a|output|nội dung|noi dung|câu hỏi|cau hoi|question|bạn hỏi|ban hoi|hỏi|hoi|q|query)"
ECHO = frozenset(
    "cau hoi cua ban la do chinh dieu muon biet tra loi dap an noi dung ve so your question is that what you asked the answer to asking about are wanted know query response reply vay thi nay".split()
)

# Phrases of refusals, without accents, by what they say.
REFUSALS = [
    r"khong the (?:tra loi|dua ra|cung cap|ket luan|ho tro|giup|xac dinh|tim thay)", r"khong (?:duoc phep|dam|muon|nen) (?:tra loi|dua ra|ban|noi|chia se|tiet lo)",
    r"(?:xin phep|xin|da)? ?(?:khong|tu choi) tra loi", r"tu choi", r"khong tra loi duoc", r"khong ket luan duoc", r"khong (?:co|du|co du|tim thay|tim duoc|thay) (?:bat ky |mot )?(?:du )?(?:thong tin|du lieu|can cu|tai lieu|cau tra loi|ket qua)",
    r"khong co trong (?:tai lieu|ngu canh|du lieu|do thi)", r"khong nhac (?:toi|den)", r"khong de cap", r"chua the (?:tra loi|dua ra|ket luan|xac dinh)", r"chua (?:biet|co can cu|co du|co thong tin|co du lieu|tim thay)",
    r"chua duoc cung cap", r"nam ngoai (?:pham vi|kha nang|tham quyen)", r"ngoai pham vi", r"khong thuoc pham vi", r"khong ro ve", r"(?:toi|minh|em|chung toi) khong (?:biet|ro|chac)", r"khong lien quan nen",
    r"\b(?:can ?not|can ?t|can t|could not|couldn ?t|unable to|not able to|won ?t|will not) (?:help|assist|answer|provide|discuss|comment|respond|share|give|determine|find|comply|fulfil)", r"rather not (?:answer|say|discuss)", r"(?:decline|refuse) to",
    r"no answer (?:can|could) be given", r"(?:nothing|no (?:information|data|mention|record\w*|answer)) (?:about|on|for|regarding|of) (?:this|that|it)", r"(?:do|does|did) not (?:have|contain|include|mention|provide|know|cover) (?:\w+ )*?(?:data|information|answer|details|this|that|it)\b",
    r"don ?t (?:have|know) ", r"(?:outside|beyond) (?:what|my|the|our) ", r"not (?:allowed|permitted) to", r"no (?:information|data) (?:is )?(?:available|found|provided)", r"as an? (?:ai|assistant|language model) i",
    r"je ne (?:peux|sais|suis)|ne peux pas repondre|pas (?:d information|en mesure)|desole", r"no puedo (?:responder|ayudar|contestar)|no (?:tengo|hay|dispongo de) (?:suficiente )?(?:informacion|datos)|lo siento", r"kann (?:ich )?(?:diese|die|das|ihnen|dir)?.{0,30}nicht|keine (?:informationen|angaben|daten)|tut mir leid|wei(?:ss|ß) (?:ich |es |das |leider )*nicht",
    r"vet (?:jeg |jag |dessverre |tyvarr )*(?:ikke|inte)|kan (?:jeg |jag |dessverre |tyvarr )*(?:ikke|inte) svar|weet (?:ik )?(?:het )?(?:helaas )?niet|kan (?:ik )?.{0,20}niet beantwoorden|nie (?:wiem|moge odpowiedziec)|tidak (?:tahu|bisa menjawab|dapat menjawab)",
    r"申し訳|お答えでき|回答でき|分かりません|わかりません|情報がありません|無法回答|无法回答|抱歉|不能回答|没有(?:相关)?信息|죄송|답변(?:할 수|드릴 수) 없|알 수 없", r"не могу|извините|нет (?:информации|данных)|nao posso|desculpe|non posso|mi dispiace",
]
_REFUSAL = re.compile("|".join(REFUSALS))
#: In Thai, whose vowels are marks that folding takes away.
_THAI_REFUSAL = re.compile("ขออภัย|ไม่สามารถตอบ|ไม่ทราบ|ไม่มีข้อมูล")
#: After these the sentence answers after all.
_TURN = re.compile(r"\b(?:nhung|tuy nhien|tuy vay|song le|but|however|mais|pero|aber|mas)\b")
#: Sentences that go with a refusal and say nothing more.
_POLITE = re.compile(
    r"^(?:xin loi|rat tiec|tiec la|thanh that|da|thua|vui long|ban (?:thu|vui|co the thu|thong cam)|mong|please|sorry|i apologi[sz]e|i m sorry|regrettably|unfortunately|hay|rat mong|lien he|cam on|thank)"
)

# Words after which an answer can't end, in Vietnamese, English and French.
DANGLING = [
    "và", "với", "của", "vì", "là", "như là", "nên", "hoặc", "hay", "để", "cho", "tại", "tại các", "trong", "trong đó", "trong đó có", "gồm", "bao gồm", "gồm có", "ngoài ra", "ngoài ra còn", "đồng thời", "bên cạnh đó", "bên cạnh đó các", "tuy nhiên", "thứ hai",
    "thứ nhất", "thứ ba", "cho phép", "được dùng để", "dùng để", "các", "những", "một", "bởi", "từ", "do", "khi", "nếu", "mà", "thì", "xem thêm", "mã", "ví dụ", "chẳng hạn", "cụ thể là", "về",
    "and", "or", "of", "of the", "the", "a", "an", "to", "in", "on", "with", "for", "by", "because", "which", "which is", "that", "is", "are", "including", "such as", "for example", "however", "moreover", "also", "see", "in addition", "secondly", "but", "as", "at", "from",
    "et", "de", "le", "la", "les", "des", "du", "un", "une", "pour", "avec", "dans",
]
_DANGLING = frozenset(DANGLING) | frozenset(fold(x) for x in DANGLING if " " in x or fold(x) in ("va", "voi", "cua", "gom", "hoac", "trong", "nhung", "cac"))

_END = re.compile(r"[.!?。！？][\"”»’')\]）」』*_~]*$")
_ELLIPSIS = re.compile(r"(?:\.\.\.|…)[\"”»’')\]]*$")
_ETC = re.compile(r"(?:v\.\s*v\.?|v\.v|vân vân|etc)\.*\s*…?$", re.I)
_STUB = re.compile(r"(?:^|\n)\s*(?:\d{1,3}[.)]|[-*•–▪])\s*$")
_INNER_STOP = re.compile(r"[^\W\d_)\]\"”»%+#]{2,}[)\]\"”»]?[.!?。]\s+\S|[\d#+%)\"”»][.!?]\s+[^\W\d_a-z]")
_ITEM = re.compile(r"\s*[;；]\s*|\s*\n\s*(?:[-*•–▪]|\d{1,3}[.)])?\s*|,\s+|\s*[|、]\s*")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|&nbsp;")
_PROMISE = re.compile(r"(\d{1,3})\s+(?:\w+\s){0,2}?\w+\s*:\s*(.+)$", re.S)
_ECHOED = re.compile(r"^(?:về câu hỏi|ve cau hoi|regarding(?: the question)?|về|as to)\s*[\"“«](.{3,}?)[\"”»]\s*:\s*", re.I | re.S)
_ANSWER_IS = re.compile(r"^(.{3,}?)[?？]?\s*(?:câu trả lời là|cau tra loi la|the answer is|answer|trả lời)\s*:\s*", re.I | re.S)
_LABEL = re.compile(rf"^\s*(?:\*\*|#+\s*)?{LABELS}(?:\s+(?:của bạn|cua ban))?(?:\s+(?:là|la|is))?\s*[:：]\s*(?:\*\*)?\s*", re.I)

_VIET = re.compile(r"[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹĩũ]")
# Common words of languages in Latin script, whatever is spoken of; of the last four only what is no Vietnamese syllable.
COMMON = {
    "en": frozenset("the of and to is are was were be with on that this by as from it or not have has their which who what when they yes but most more each first does how where for in using usually together".split()),
    "fr": frozenset("le la les des du et un une est sont dans pour par avec que qui au aux ce cette se il plus sur plusieurs pas elle".split()),
    "de": frozenset("der die das und ist sind wird mit einer ein eine im für von zu den dem auf nicht sich auch werden nach oder ich wir sie".split()),
    "es": frozenset("el los las del y es son en con para por que una este esta como más pero".split()),
    "pt": frozenset("o os as dos das e é são em com para por que uma este esta não mais".split()),
    "it": frozenset("il lo gli della del e è sono con per che una questo non nel alla dei più".split()),
    "nl": frozenset("het een zijn voor dat dit wordt worden niet aan door ook naar deze".split()),
    "pl": frozenset("jest się nie oraz przez dla są który która przed jako lub".split()),
    "id": frozenset("yang untuk dengan adalah pada tidak dari dalam oleh akan juga atau".split()),
    "sv": frozenset("och är det att som på för av inte till ett från".split()),
}
VIET = frozenset("là của và có được cho các một những trong với khi để này người về không phải sẽ đã nếu vì hoặc cũng nên thì mà do qua vào theo gồm mỗi nào cần còn nhưng thường yêu cầu".split())
VIET_PLAIN = frozenset("cua duoc nhung voi nguoi khong phai trong cac mot khi hoac neu theo moi la va co nay thuong yeu cau".split())
_SCRIPTS = [("ja", re.compile(r"[ぁ-ゖァ-ヺ]")), ("ko", re.compile(r"[가-힣]")), ("zh", re.compile(r"[㐀-鿿]")), ("ru", re.compile(r"[Ѐ-ӿ]")), ("ar", re.compile(r"[؀-ۿ]")), ("th", re.compile(r"[฀-๿]")), ("hi", re.compile(r"[ऀ-ॿ]"))]


#: Format characters, which show nothing.
_FORMAT = re.compile(r"[\xad\u0600-\u0605\u061c\u06dd\u070f\u0890\u0891\u08e2\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\ufff9-\ufffb\U000110bd\U000110cd\U00013430-\U0001343f\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0001\U000e0020-\U000e007f]")


def _seen(text: str) -> str:
    return _FORMAT.sub("", text if unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text))


@lru_cache(maxsize=1024)
def tidy(text: str | None) -> str:
    """One Unicode form, no markup, no outer space; the letter case stays."""
    if not text:
        return ""
    if not text.isascii():
        text = _seen(text)
    if "<" in text or "&" in text:
        text = _seen(html.unescape(_TAG.sub(" ", text)))
    return text.strip()


@lru_cache(maxsize=1024)
def plain(text: str) -> tuple[str, ...]:
    return tuple(fold(w) for w in words(text))


def is_empty(answer: str | None) -> bool:
    t = tidy(answer)
    c = canon(t)
    return not c or c in PLACEHOLDERS or not canon(_LABEL.sub("", t + " "))


def _near(a: str, b: str) -> bool:
    """Equal but for one slip of the fingers (a swap, a letter more, less or other) in words of four letters or more."""
    if a == b:
        return True
    if max(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def is_copy(question: str | None, answer: str | None) -> bool:
    """Every word of the answer is the question's or says that it is the question, and it repeats most of it."""
    q = plain(tidy(question))
    if len(q) < 2:
        return False
    a = plain(_LABEL.sub("", tidy(answer) + " "))
    if not a:
        return False
    if canon(" ".join(a)) == canon(" ".join(q)):
        return True
    known = set(q)
    said = [w for w in a if w not in known]
    if sum(w not in ECHO for w in said) > max(2, len(q) // 5) + 3:
        return False  # more than slips and torn words could explain
    slips = [w for w in said if w not in ECHO and any(_near(w, k) for k in known)]
    # two or three words run together, or a word torn apart, still spell the question
    rest = [w for w in said if w not in ECHO and w not in slips]
    joined_q, joined_a = "".join(q), "".join(a)
    if rest and not (len(rest) <= 3 and _edits(joined_a, joined_q, 4)):
        return False
    if len(slips) > max(2, len(q) // 5):
        return False
    repeated = sum(w in known for w in a) + len(slips)
    in_order = " ".join(q) in " ".join(a) or _follows(a, q)
    return (repeated >= 0.7 * len(q) or repeated >= max(5, 0.5 * len(q))) and in_order


def _follows(a: list[str], q: list[str]) -> bool:
    """Whether most neighbouring words of the answer are neighbours in the question."""
    pairs = set(zip(q, q[1:]))
    own = list(zip(a, a[1:]))
    return bool(own) and sum(p in pairs for p in own) >= 0.5 * len(own)


def _edits(a: str, b: str, most: int) -> bool:
    """Whether a and b differ in at most ``most`` letters (banded edit distance)."""
    if abs(len(a) - len(b)) > most:
        return False
    row = {j: j for j in range(most + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = row.get(j, most + 1) + 1
            if j:
                best = min(best, new.get(j - 1, most + 1) + 1, row.get(j - 1, most + 1) + (x != b[j - 1]))
            else:
                best = min(best, i)
            new[j] = best
        row = new
        if min(row.values()) > most:
            return False
    return row.get(len(b), most + 1) <= most


def is_refusal(answer: str | None) -> bool:
    """Some sentence refuses, none turns round, and what else is said is polite."""
    t = tidy(answer)
    if _THAI_REFUSAL.search(t):
        return True
    spoken = fold(even(t))
    if not _REFUSAL.search(re.sub(r"[^\w\s]+", " ", spoken)):
        return False
    for s in re.split(r"[.!?。！？\n]+", spoken):
        s = " ".join(re.sub(r"[^\w\s]+", " ", s).split())
        if not s:
            continue
        m = _REFUSAL.search(s)
        if m:
            if _TURN.search(s, m.end()) or (":" in spoken and _answers_after_colon(spoken)):
                return False
        elif not _POLITE.search(s) and len(s.split()) > 2:
            return False
    return not re.match(r"^(?:khong|co|duoc|yes|no)\s*[.,]\s*\S", spoken) or bool(re.match(r"^khong\s*[.,]\s*(?:toi|minh|em)\b", spoken))


def _answers_after_colon(spoken: str) -> bool:
    """An apology that goes on to answer after a colon ("xin lỗi vì ... bị nhầm: được, vì ...")."""
    tail = spoken.split(":", 1)[1]
    return not _REFUSAL.search(re.sub(r"[^\w\s]+", " ", tail)) and len(tail.split()) > 2


_BEYOND = re.compile(r"[\u0370-\u1dff\u2e80-\ufaff]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


@lru_cache(maxsize=100_000)
def _about(w: str) -> tuple[str, bool, bool, bool, tuple[str, ...]]:
    """(the word in one form, built as a Vietnamese syllable, with Vietnamese marks, common in Vietnamese, the languages it is common in)."""
    e = even(w)
    f = fold(e)
    return e, is_syllable(f), bool(_VIET.search(e)), e in VIET or f in VIET_PLAIN, tuple(k for k, v in COMMON.items() if e in v)


@lru_cache(maxsize=1024)
def spoken_language(text: str) -> str:
    """The language of a text, '' if names and terms are all there is; 'latin' is one in that script which isn't known here."""
    n = sum(map(str.isalpha, text))
    if not n:
        return ""
    if _BEYOND.search(text):
        for lang, script in _SCRIPTS:
            if (k := len(script.findall(text))) >= 4 and k > 0.08 * n:  # names around it may be in Latin script
                return lang
    if sum(map(str.isupper, text)) > 0.6 * n:
        text = text.lower()
    # capitals inside a sentence are names and terms
    own = [_about(w) for i, w in enumerate(_WORD.findall(text)) if w.islower() or (i == 0 and w[1:].islower())]
    kinds = {x[0]: x for x in own}
    if len(kinds) < 3:
        return ""
    votes = Counter(k for x in kinds.values() for k in x[4])
    best = max(COMMON, key=lambda k: votes[k])
    viet = sum(x[3] for x in kinds.values())
    syllables = sum(x[1] for x in own) / len(own)
    marks = sum(x[2] for x in own) / len(own)
    if votes[best] >= 2 and votes[best] > 2 * viet:  # around Vietnamese names, too
        return best
    if marks > 0.4 or (syllables >= 0.85 and marks > 0.1):
        return "vi"
    if syllables >= 0.8 and votes[best] < 0.3 * len(own):
        return "vi"
    if votes[best] >= max(1, 0.12 * len(own)):
        return best
    return "latin" if syllables < 0.5 else ""


def is_other_language(question: str | None, answer: str | None) -> bool:
    q, a = spoken_language(tidy(question)), spoken_language(strip_echo(question, tidy(answer)))
    if not q or not a or q == a:
        return False
    # a text of few common words may be in any language of Latin script but Vietnamese
    return not ("latin" in (q, a) and (q in COMMON or a in COMMON or q == a))


def strip_echo(question: str | None, t: str) -> str:
    """The answer after phrases that repeat the question before it."""
    for pattern in (_ECHOED, _ANSWER_IS):
        m = pattern.match(t)
        if m and _repeats(m[1], question):
            t = t[m.end() :].strip()
    return _LABEL.sub("", t) if _LABEL.match(t) else t


def _repeats(part: str, question: str | None) -> bool:
    q = set(plain(question or ""))
    p = plain(part)
    return bool(p) and sum(w in q or any(_near(w, k) for k in q if abs(len(k) - len(w)) < 2) for w in p) >= 0.8 * len(p)


def _open_ends(t: str) -> bool:
    for o, c in (("(", ")"), ("[", "]"), ("{", "}"), ("“", "”"), ("«", "»"), ("（", "）"), ("「", "」")):
        if t.count(o) > t.count(c) and not (o == "(" and re.search(r"[:;]-?\($", t)):
            return True
    return t.count('"') % 2 == 1 or t.count("```") % 2 == 1 or t.count("**") % 2 == 1 and not t.endswith("**")


def cut_state(question: str | None, answer: str | None) -> tuple[str, list[str], str]:
    """('cut' / 'whole' / 'list' / 'short', the endings of its list items, its opening): what one text alone shows.

    'list' and 'short' need the corpus: whether the last item ends as items do, whether such answers end with a stop.
    """
    t = strip_echo(question, tidy(answer))
    if not t:
        return "whole", [], ""
    ws = words(t)
    opening = " ".join("0" if w.isdigit() else fold(w) for w in ws[:3])
    items = [i for i in (x.strip() for x in _ITEM.split(re.sub(r"^[-*•–▪\s]+", "", _after_colon(t)))) if i]
    ends = [" ".join(fold(w) for w in words(i)[-2:]) for i in items] if len(items) > 1 else []
    if _open_ends(t) or _STUB.search(t) or re.search(r"[,;:，；：(\[{“«„\-–—/&]\s*$", t):
        return "cut", [], opening
    if _ELLIPSIS.search(t):
        return ("whole" if _ETC.search(t) else "cut"), [], opening
    ended = bool(_END.search(t))
    bare = " ".join(ws)
    folded = " ".join(fold(w) for w in ws)
    last = re.findall(r"[^\W\d_]+", t)[-1:]
    for k in (1, 2, 3, 4):
        if last and last[0].islower() and len(ws) > k and (" ".join(ws[-k:]) in _DANGLING or (k > 1 and " ".join(folded.split()[-k:]) in _DANGLING)) and not ended:
            return "cut", [], opening
    m = _PROMISE.search(t)
    if m and not _INNER_STOP.search(m[2]) and 1 < int(m[1]) <= 50:
        have = len([i for i in re.split(r"[;；\n]|,\s", m[2]) if canon(i)])
        if have < int(m[1]):
            return "cut", [], opening
    if ended or not bare:
        return "whole", ends[:-1] if ends else [], opening
    if _INNER_STOP.search(t):
        return "cut", [], opening
    if ends and (re.search(r"[;；\n|]", t) or all(len(words(i)) <= 4 for i in items)):
        return "list", ends, opening
    return ("short" if len(ws) <= 12 else "cut"), [], opening


def _after_colon(t: str) -> str:
    head, colon, tail = t.partition(":")
    return tail if colon and len(tail) > 3 and "\n" not in head else t


_LOCAL = "table_name string, row_key long, defects array<string>, state string, ends array<string>, opening string, stopped boolean"


def judge_locally(pairs: DataFrame, table_name: str, key: str, question: str, answer: str) -> DataFrame:
    """The rules that need no more than the pair, and what the others need of it. One pass, no shuffle, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for q, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if is_empty(a):
                    row = (["empty"], "whole", [], "", True)
                else:
                    found = [d for d, hit in (("copy", is_copy(q, a)), ("refusal", is_refusal(a)), ("other_language", is_other_language(q, a))) if hit]
                    state, ends, opening = cut_state(q, a)
                    if state == "cut":
                        found.append("truncated")
                    row = (found, state, ends, opening, state == "whole")
                for col, x in zip(out, (table_name, *row)):
                    col.append(x)
            types = [pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_()]
            cols = [pa.array(c, t) for c, t in zip(out, types)]
            yield pa.RecordBatch.from_arrays([cols[0], b.column(0), *cols[1:]], names=["table_name", "row_key", "defects", "state", "ends", "opening", "stopped"])

    t = pick(pairs, [key, question, answer]).withColumn(key, F.col(key).cast("long"))
    return t.mapInArrow(run, _LOCAL)


#: A closed set of items: most of a list's other items must end as items of other answers do, this often at least.
KNOWN = 3
#: An opening shows a habit from so many answers, of which so large a share ends with a stop.
HABIT, SHARE = 20, 0.9


def defects(tables: list[tuple[DataFrame, str, str, str, str]]) -> DataFrame:
    """(table_name, row_key, defects) of every pair; ``defects`` has every type that is triggered, [] if none.

    ``tables``: (table, its name, key column, question column, answer column). A null question can't be copied, nor have another
    language. Repeated pairs are judged alike. Very long texts are read whole. Empty tables give no rows.
    """
    local = cut(reduce(DataFrame.unionByName, [judge_locally(*t) for t in tables]))
    lists = local.filter("state = 'list'").select("table_name", "row_key", F.posexplode("ends").alias("at", "e"), (F.size("ends") - 1).alias("last"))
    # the last item of an unfinished list is no evidence for its own ending
    sure = local.withColumn("e", F.explode(F.when(F.col("state") == "list", F.slice("ends", 1, F.size("ends") - 1)).otherwise(F.col("ends")))).groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    seen = lists.join(sure, "e", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    open_lists = seen.groupBy("table_name", "row_key").agg(
        F.max(F.when(F.col("at") == F.col("last"), F.col("n"))).alias("last_n"), F.avg(F.when(F.col("at") < F.col("last"), (F.col("n") >= KNOWN).cast("int"))).alias("closed")
    )
    cut_lists = open_lists.filter((F.col("last_n") == 0) & (F.col("closed") > 0.5)).select("table_name", "row_key")
    habit = local.filter("opening <> ''").groupBy("opening").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("stopped").cast("int")).alias("share")).filter((F.col("n") >= HABIT) & (F.col("share") >= SHARE))
    cut_short = local.filter("state = 'short'").join(habit.select("opening"), "opening", "left_semi").select("table_name", "row_key")
    more = cut_lists.union(cut_short).distinct().withColumn("more", F.lit(True))
    both = local.select("table_name", "row_key", "defects").join(more, ["table_name", "row_key"], "left")
    return both.select("table_name", "row_key", F.when(F.col("more"), F.array_distinct(F.concat("defects", F.array(F.lit("truncated"))))).otherwise(F.col("defects")).alias("defects"))


def first_defect(found: DataFrame) -> DataFrame:
    """(table_name, row_key, defect) of the defective pairs: the first of DEFECTS that is triggered."""
    order = F.array(*[F.lit(d) for d in DEFECTS])
    return found.filter(F.size("defects") > 0).select("table_name", "row_key", F.element_at(F.array_intersect(order, F.col("defects")), 1).alias("defect"))
