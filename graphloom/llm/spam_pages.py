"""Keyword-stuffed and link-list pages.

Each text gives five features, all shares: the part of it that is not sentences, the repetition of its three-word runs, the deficit of
its word entropy, its density of links and list marks, and its lack of function words. Per language, a robust centre (medians) and
scatter (median absolute deviations, correlations of winsorised scores) are estimated over all distinct texts, so copies of a page
don't pull the centre to themselves. Two conditions make a page spam, both in Mahalanobis' metric of its language:

* distance: it is an outlier, and farther from the prose than a page half of which is lists (half the distance of the spam pole, a
  page without sentences or function words whose other features are just out of the ordinary);
* direction: it lies within 60 degrees of that pole. Odd characters, repeated prose and the like are outliers in other directions.

A short text shows little: it counts as its own words and some of usual prose, which draws it to the centre. A language of few texts
is drawn to the centre of all texts in the same way; so no rule switches at a size.

Fitting is one aggregation by text and three with partial sums; only a handful of numbers per language reach the driver.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.canon import SPACED, even, words
from graphloom.functions.columns import pick
from graphloom.session import cut

# Function words of each language that do not belong to keyword phrases ("in", "for", "de", "từ" and the like do).
FUNCTION_WORDS = {
    "vi": frozenset(
        "của và là có được cho các một những trong với khi để đến này người về không phải sẽ đã đang nếu vì hoặc cũng nên thì mà do qua "
        "vào trước sau theo gồm mỗi nào ai cần thêm còn đó như bạn họ khoảng rằng lại thể cùng nhất gần đây xong làm bằng lên bởi nơi "
        "nhưng ngoài trên dưới giữa sao rồi tự chỉ nhận".split()
    ),
    "vi_plain": frozenset("cua duoc nhung voi nguoi khong phai trong cac mot khi hoac neu truoc theo moi la va se da".split()),
    "en": frozenset("the of and to is are was were be with on that this by as from it or not have has their which who what when but than most each before after i we you they".split()),
    "fr": frozenset("le la les des du et un une est sont dans pour par avec que qui au aux ce cette se il plus ont chaque".split()),
    "de": frozenset("der die das und ist sind nicht eine einer für werden wird sich auch oder durch nach".split()),
    "es": frozenset("el los las una que por para como pero más este esta está sus entre también cada".split()),
    "pt": frozenset("os dos uma que para como mais está são não pelo pela também seu cada".split()),
    "it": frozenset("il gli della delle che per sono più anche nella dei questo una alla".split()),
    "nl": frozenset("het een zijn voor niet wordt ook door deze naar worden heeft".split()),
    "pl": frozenset("się nie jest oraz przez które który dla przed jego są lub".split()),
    "id": frozenset("yang untuk dengan adalah tidak atau akan juga dapat oleh".split()),
}

FEATURES = ["no_sentences", "repetition", "entropy_lack", "marks", "no_function_words"]
#: The 0.9999 quantile of chi-squared with five degrees of freedom.
OUTLIER = 25.74
#: Least scale of a feature, so a language whose texts are all alike doesn't make trifles into outliers.
FLOOR = 0.05
#: Robust scores from here are out of the ordinary; correlations are estimated from scores cut off there.
FAR = 3.0
#: The least cosine between a page's deviation and the direction of the spam pole.
TOWARDS = 0.5
#: The least distance, as a part of the spam pole's.
PART = 0.5
#: Words of usual prose that each text is taken to have besides its own, and texts of all languages that each language is.
PRIOR_WORDS, PRIOR_TEXTS = 12, 50

_LINK = re.compile(r"[hH][tT][tT][pP][sS]?:|[wW][wW][wW]\.|\.(?:example|test|invalid|com|vn|org|net|info|edu|io)\b|</?\w+")
#: One of these is in every text that has a link (in small letters).
_LINKISH = ("http", "www.", ".example", ".test", ".invalid", ".com", ".vn", ".org", ".net", ".info", ".edu", ".io", "<")
_SIGNS = "#|;,•▪·/–—:\n"
_PRICE = re.compile(r"\d\s?(?:đ|vnd|VND|usd|USD|€|\$)")
_SKU = re.compile(r"\bsku\b")
_BULLET = re.compile(r"[-*+](?=\s)")
_SPLIT = re.compile(r"[.!?…]+\s+|[。！？\n]+")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")
_KANA = re.compile(r"[ぁ-ゖァ-ヺ]")
_HIRA = re.compile(r"[ぁ-ゖ]")
_OTHER = re.compile(r"[Ѐ-ӿ֐-ۿऀ-෿฀-໿ᄀ-ᇿ㐀-鿿가-힣]")
_HAN = re.compile(r"[㐀-鿿]")
_TERMS = re.compile(r"[,;，；、،؛|｜/·•▪#\n]+")
_VIET = re.compile(r"[ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]")
#: Between segments while their words are split.
_BORDER = "\ue000"

#: The languages that a word is a function word of.
_OF: dict[str, tuple[str, ...]] = {}
for _lang, _known in FUNCTION_WORDS.items():
    for _w in _known:
        _OF[_w] = (*_OF.get(_w, ()), _lang)


def plain_text(text: str) -> str:
    """The text with escapes of characters undone, as odd exports leave them."""
    if "\\u" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if not 0xD800 <= int(m[1], 16) < 0xE000 else " ", text)
    return html.unescape(text) if "&" in text else text


def language(text: str, n_words: int, votes: Counter, latin: bool) -> str:
    """The language of FUNCTION_WORDS, ja, other (another script) or unknown, from the text itself: declared languages are often wrong. votes: its function words by language."""
    n = len(text) or 1
    if not latin:
        if len(_KANA.findall(text)) > 0.1 * n:
            return "ja"
        if len(_OTHER.findall(text)) > 0.3 * n:
            return "other"
    best = max(FUNCTION_WORDS, key=lambda k: votes[k])
    if votes[best] < max(2, 0.03 * n_words):  # keywords don't show their language; such a text is measured against all texts together
        return "vi" if not text.isascii() and len(_VIET.findall(text)) > 0.02 * n else "unknown"
    return "vi" if best == "vi_plain" else best


def _is_listed(segment: str, ws: list[str]) -> bool:
    """Whether a segment in a script without function words here is a run of short separated terms, or repeats its words over and over."""
    terms = [t for t in _TERMS.split(segment) if t.strip()]
    if len(_HAN.findall(segment)) > 0.3 * len(segment):  # prose in these has no spaces between its words
        terms = [x for t in terms for x in t.split()]
    short = sum(len(t.split()) <= 3 and len(_HAN.findall(t)) <= 6 and len(t.strip()) <= 30 for t in terms)
    return len(terms) >= 6 and short >= 0.8 * len(terms) or len(ws) >= 12 and len(set(ws)) < 0.4 * len(ws)


def sentence_share(segment: str, ws: list[str], latin: bool, linked: bool) -> float:
    """The part of a line or sentence that says something.

    ws: its words; latin: no other script is in the text; linked: some link is. A sentence has two different function words of one
    language and no link; tags (#word) beside it are no part of it. In another script it is no list of terms.
    """
    if not latin:
        if len(_KANA.findall(segment)) >= 4:
            return float(len(_HIRA.findall(segment)) >= 0.2 * len(segment))
        if len(_OTHER.findall(segment)) > 0.3 * len(segment):
            return float(not (linked and _LINK.search(segment)) and not _is_listed(segment, ws))
    if len(ws) < 4:
        return 0.0
    tags = [w for w in ws if w[0] == "#" and len(w) > 2] if "#" in segment else []
    found = [w for w in ws if w in _OF]
    if len(set(found)) < 2 or linked and _LINK.search(segment):
        return 0.0
    for k in {k for w in found for k in _OF[w]}:
        known = FUNCTION_WORDS[k]
        own = [w for w in found if w in known]
        if len(own) >= 0.06 * (len(ws) - len(tags)) and len(set(own)) >= 2:
            return max(0.0, 1 - sum(len(w) + 1 for w in tags) / len(segment)) if tags else 1.0
    return 0.0


def _split_words(segments: list[str]) -> list[list[str]]:
    """The words of each segment (functions.canon.words of each, in one go where a text's form is even)."""
    whole = _BORDER.join(segments)
    if not segments:
        return []
    if whole.count(_BORDER) != max(len(segments) - 1, 0) or not unicodedata.is_normalized("NFKC", whole):
        return [words(s) for s in segments]
    return [part.split() for part in even(whole).translate(_PARTS).split(_BORDER)]


class _Parts(dict[int, object]):
    """str.translate table of functions.canon's words, but the border stays; filled as code points turn up."""

    def __missing__(self, cp: int) -> object:
        self[cp] = cp if chr(cp) == _BORDER else chr(cp).translate(SPACED) or None
        return self[cp]


_PARTS = _Parts()


def features(text: str | None) -> tuple[str, int, list[float], bytes]:
    """(language, number of words, the five features, a digest of the words) of a text; null is as empty."""
    t = plain_text(text or "")
    segments = [s for s in _SPLIT.split(t) if s and not s.isspace()]
    by_segment = _split_words(segments)
    ws = [w for part in by_segment for w in part]
    key = hashlib.blake2b(" ".join(ws).encode("utf8", "surrogatepass"), digest_size=16).digest()
    low = t.lower()
    latin = t.isascii() or not _KANA.search(t) and not _OTHER.search(t)
    linked = any(x in low for x in _LINKISH)
    votes = Counter(k for w in ws if w in _OF for k in _OF[w])
    lang = language(even(t), len(ws), votes, latin)
    prose = sum(len(s) * sentence_share(s, w, latin, linked) for s, w in zip(segments, by_segment))
    if lang == "ja" or lang == "other":
        ws = [c for w in ws for c in (w if len(w) > 1 and _OTHER.search(w) or _KANA.search(w) else [w])]
    n = len(ws)
    if not n:
        return lang, 0, [0.0] * len(FEATURES), key
    runs = list(zip(ws, ws[1:], ws[2:]))
    repetition = 1 - len(set(runs)) / len(runs) if runs else 0.0
    sizes = Counter(Counter(ws).values())  # words of one count add the same
    entropy = -sum(k * c / n * math.log(c / n) for c, k in sizes.items()) / math.log(n) if n > 1 else 1.0
    marks = sum(map(t.count, _SIGNS)) + len(_PRICE.findall(t)) + len(_BULLET.findall(t))
    marks += (len(_LINK.findall(t)) if linked else 0) + (len(_SKU.findall(low)) if "sku" in low else 0)
    if lang == "ja":
        function = len(_HIRA.findall(t)) / n  # particles and endings
    elif lang == "vi":
        function = max(votes["vi"], votes["vi_plain"]) / n
    else:
        function = votes[lang] / n if lang in FUNCTION_WORDS else max(votes.values(), default=0) / n
    return lang, n, [1 - prose / (sum(map(len, segments)) or 1), repetition, max(0.0, 1 - entropy), min(marks / n, 1.0), 1 - min(function, 1.0)], key


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang, n_words, features..., text_key) of every document, whole texts, no shuffle. text_key: a digest of the text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t) for t in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64())]
            cols += [pa.array([g[2][i] for g in got], pa.float64()) for i in range(len(FEATURES))]
            cols.append(pa.array([g[3] for g in got], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang", "n_words", *FEATURES, "text_key"])

    t = pick(docs, [id_col, text_col]).toDF("doc_id", "text")
    return t.mapInArrow(run, f"doc_id {t.schema['doc_id'].dataType.simpleString()}, lang string, n_words long, " + ", ".join(f"{f} double" for f in FEATURES) + ", text_key binary")


def fit(measured: DataFrame) -> dict[str, dict]:
    """Centre, scale, inverse correlation and spam pole of each language, and of all texts together (''); a text counts once, however many copies it has."""
    kept = ["lang", *FEATURES]
    once = measured.filter("n_words > 0").groupBy("text_key").agg(F.min(F.struct(*kept)).alias("m"))
    texts = cut(once.select(*[F.col(f"m.{c}").alias(c) for c in kept]))  # read three times
    both = texts.withColumn("lang", F.explode(F.array("lang", F.lit(""))))
    half = lambda c: F.percentile_approx(c, 0.5, 10_000)
    rows = {r.lang: r for r in both.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[half(f).alias(f) for f in FEATURES]).collect()}
    if not rows:
        return {}
    own = {k: r.n / (r.n + PRIOR_TEXTS) if k not in ("", "unknown") else 0.0 for k, r in rows.items()}  # what a language's own texts weigh

    def drawn(got: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {k: own[k] * v + (1 - own[k]) * got[""] for k, v in got.items()}

    def of(values: dict[str, np.ndarray], i: int) -> Column:
        return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v[i])))])[F.col("lang")]

    vector = lambda r: np.array([float(r[f]) for f in FEATURES])
    centre = drawn({k: vector(r) for k, r in rows.items()})
    spread = {r.lang: vector(r) for r in both.groupBy("lang").agg(*[half(F.abs(F.col(f) - of(centre, i))).alias(f) for i, f in enumerate(FEATURES)]).collect()}
    scale = {k: np.maximum(v, FLOOR) for k, v in drawn({k: 1.4826 * v for k, v in spread.items()}).items()}
    z = both.select("lang", *[F.greatest(F.least((F.col(f) - of(centre, i)) / of(scale, i), F.lit(FAR)), F.lit(-FAR)).alias(f) for i, f in enumerate(FEATURES)])
    p = len(FEATURES)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    moments = {r.lang: r for r in z.groupBy("lang").agg(*[F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"m{i}_{j}") for i, j in pairs]).collect()}

    def correlation(m) -> np.ndarray:
        c = np.eye(p)
        for i, j in pairs:
            power = m[f"m{i}_{i}"] * m[f"m{j}_{j}"]
            if i != j and power > 0:
                c[i, j] = c[j, i] = 0.8 * m[f"m{i}_{j}"] / math.sqrt(power)  # shrunk towards independence, so it can be inverted
        return c

    inverse = {k: np.linalg.inv(c) for k, c in drawn({k: correlation(m) for k, m in moments.items()}).items()}
    out = {}
    for k, r in rows.items():
        pole = np.full(p, FAR)
        for i in (0, p - 1):
            pole[i] = max(FAR, (1 - centre[k][i]) / scale[k][i])
        out[k] = {"n": r.n, "centre": centre[k], "scale": scale[k], "inverse": inverse[k], "pole": pole, "reach": float(pole @ inverse[k] @ pole)}
    return out


def score(measured: DataFrame, model: dict[str, dict]) -> DataFrame:
    """measured with distance (squared Mahalanobis), reach (the distance from which it counts), towards (cosine with the spam pole) and spam."""
    if not model:
        return measured.withColumns({**{c: F.lit(None).cast("double") for c in ("distance", "reach", "towards")}, "spam": F.lit(False)})
    which = F.when(F.col("lang").isin(list(model)), F.col("lang")).otherwise(F.lit(""))
    p = len(FEATURES)
    # a language's numbers in one array, looked up once per document
    numbers = {k: [*m["centre"], *m["scale"], *m["pole"], *(m["inverse"] @ m["pole"]), *m["inverse"].ravel(), m["reach"]] for k, m in model.items()}
    looked = F.create_map(*[x for k, v in numbers.items() for x in (F.lit(k), F.array(*[F.lit(float(y)) for y in v]))])[which]
    at = lambda i: F.get("_m", F.lit(i))
    weight = F.col("n_words") / (F.col("n_words") + F.lit(PRIOR_WORDS))
    z = {f"z{i}": weight * (F.col(f) - at(i)) / at(p + i) for i, f in enumerate(FEATURES)}
    within = {f"y{i}": F.least(F.col(f"z{i}"), at(2 * p + i)) for i in range(p)}  # more of the pole's own is no other direction
    form = lambda v: sum((F.col(f"{v}{i}") * F.col(f"{v}{j}") * at(4 * p + i * p + j) for i in range(p) for j in range(p)), F.lit(0.0))
    along = sum((F.col(f"y{i}") * at(3 * p + i) for i in range(p)), F.lit(0.0))
    pole = at(4 * p + p * p)
    scored = measured.withColumn("_m", looked).withColumns(z).withColumns(within).withColumns({"distance": form("z"), "reach": F.greatest(F.lit(OUTLIER), F.lit(PART**2) * pole), "_size": form("y"), "_along": along})
    scored = scored.withColumn("towards", F.when(F.col("_size") > 0, F.col("_along") / F.sqrt(F.col("_size") * pole)).otherwise(F.lit(0.0)))
    spam = (F.col("distance") > F.col("reach")) & (F.col("towards") > TOWARDS)
    return scored.withColumn("spam", F.coalesce(spam, F.lit(False))).select(*measured.columns, "distance", "reach", "towards", "spam")


def spam_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang, n_words, features..., distance, reach, towards, spam), one row per document.

    Null and empty texts are never spam; repeated rows are judged alike; whole texts are read, however long. An empty table gives no
    rows. The measured features, not the texts, are kept between the passes in the shared checkpoint folder.
    """
    measured = cut(measure(docs, id_col, text_col))
    return score(measured.drop("text_key"), fit(measured))
