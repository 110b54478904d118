"""Data model: schemas, vocabulary and the fixed tables of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

STR = T.StringType()

# Node labels, and which field of an extracted node is its key and which its name.
LABELS = ["MAJOR", "SUBJECT", "SKILL", "CAREER", "TEACHER"]
NODE_KEY = {"MAJOR": "major_code", "SUBJECT": "subject_code", "SKILL": "skill_key", "CAREER": "career_key", "TEACHER": "teacher_key"}
NODE_NAME = {"MAJOR": "major_name_vi", "SUBJECT": "subject_name_vi", "SKILL": "skill_name", "CAREER": "career_name_vi", "TEACHER": "name"}

# Node types allowed in each kind of document, and the kind by prefix of its id.
NODES_BY_DOCTYPE = {"syllabus": ["SUBJECT", "TEACHER", "SKILL"], "curriculum": ["MAJOR", "SUBJECT", "CAREER", "TEACHER"], "career_description": ["CAREER", "SKILL"]}
DOC_PREFIX = {"curriculum": "CUR", "career_description": "CAR", "syllabus": "SYL"}
FOLDER_ORDER = ["curriculum", "career_description", "syllabus"]

# Extracted relationship types: canonical name, endpoints and the columns that hold them.
REL_TYPES = {
    "major_offers_subject": ("OFFERS", "MAJOR", "from_major_code", "SUBJECT", "to_subject_code"),
    "major_leads_to_career": ("LEADS_TO", "MAJOR", "from_major_code", "CAREER", "to_career_key"),
    "subject_provides_skill": ("PROVIDES", "SUBJECT", "from_subject_code", "SKILL", "to_skill_key"),
    "career_requires_skill": ("REQUIRES", "CAREER", "from_career_key", "SKILL", "to_skill_key"),
    "teacher_instructs_subject": ("TEACH", "TEACHER", "from_teacher_key", "SUBJECT", "to_subject_code"),
}
#: Every spelling of a relationship type, as the canonical one.
REL_ALIASES = {
    **{k: v[0] for k, v in REL_TYPES.items()},
    **{k.upper(): v[0] for k, v in REL_TYPES.items()},
    **{v[0]: v[0] for v in REL_TYPES.values()},
}
REL_WEIGHTS = {"PROVIDES": 3, "REQUIRES": 3, "TEACH": 2, "LEADS_TO": 2, "OFFERS": 1}

# Communities: level, labels, relationship types.
COMMUNITIES = {
    "L1_GLOBAL": (1, ["MAJOR", "SUBJECT", "SKILL", "CAREER", "TEACHER"], ["OFFERS", "LEADS_TO", "PROVIDES", "REQUIRES", "TEACH"]),
    "L2_ACADEMIC": (2, ["MAJOR", "SUBJECT", "TEACHER"], ["TEACH", "OFFERS"]),
    "L2_CAREER_ALIGNMENT": (2, ["SKILL", "CAREER", "SUBJECT"], ["PROVIDES", "REQUIRES"]),
    "L3_MAJOR_CENTRIC": (3, ["SUBJECT", "TEACHER", "SKILL"], ["OFFERS", "TEACH", "PROVIDES"]),
    "L3_SKILL_CENTRIC": (3, ["SUBJECT", "CAREER"], ["PROVIDES", "REQUIRES"]),
}
# Communities by rule, when none are detected: the number of each label.
RULE_COMMUNITY = {
    "L2_ACADEMIC": {"TEACHER": 0, "SUBJECT": 1, "MAJOR": 2},
    "L2_CAREER_ALIGNMENT": {"SKILL": 0, "CAREER": 1, "SUBJECT": 2},
    "L3_MAJOR_CENTRIC": {"SUBJECT": 0, "TEACHER": 1, "SKILL": 2},
    "L3_SKILL_CENTRIC": {"SUBJECT": 0, "CAREER": 1},
}
# Which community answers (mentioned label, asked label).
ROUTES = {
    ("MAJOR", "SUBJECT"): "L2_ACADEMIC", ("MAJOR", "TEACHER"): "L2_ACADEMIC", ("SUBJECT", "TEACHER"): "L2_ACADEMIC", ("TEACHER", "SUBJECT"): "L2_ACADEMIC", ("TEACHER", "MAJOR"): "L2_ACADEMIC",
    ("MAJOR", "CAREER"): "L2_CAREER_ALIGNMENT", ("MAJOR", "SKILL"): "L2_CAREER_ALIGNMENT", ("CAREER", "SKILL"): "L2_CAREER_ALIGNMENT", ("CAREER", "SUBJECT"): "L2_CAREER_ALIGNMENT", ("CAREER", "MAJOR"): "L2_CAREER_ALIGNMENT",
    ("SKILL", "MAJOR"): "L2_CAREER_ALIGNMENT", ("SKILL", "CAREER"): "L2_CAREER_ALIGNMENT", ("SKILL", "SUBJECT"): "L2_CAREER_ALIGNMENT", ("SUBJECT", "SKILL"): "L2_CAREER_ALIGNMENT", ("SUBJECT", "CAREER"): "L2_CAREER_ALIGNMENT",
    ("MAJOR", "MAJOR"): "L1_GLOBAL",
}

# Pattern of each (start label, asked label): steps from the start (type, '>' along the edge or '<' against it), whether
# the start's code may match, and whether the reported path begins at the start or at the end.
TEMPLATES = {
    ("MAJOR", "CAREER"): ([("LEADS_TO", ">")], True, "start"),
    ("CAREER", "SKILL"): ([("REQUIRES", ">")], False, "start"),
    ("MAJOR", "SKILL"): ([("OFFERS", ">"), ("PROVIDES", ">")], True, "start"),
    ("SKILL", "MAJOR"): ([("PROVIDES", "<"), ("OFFERS", "<")], False, "end"),
    ("SKILL", "CAREER"): ([("REQUIRES", "<")], False, "end"),
    ("CAREER", "SUBJECT"): ([("REQUIRES", ">"), ("PROVIDES", "<")], False, "start"),
    ("MAJOR", "SUBJECT"): ([("OFFERS", ">")], True, "start"),
    ("SKILL", "SUBJECT"): ([("PROVIDES", "<")], False, "end"),
    ("SUBJECT", "SKILL"): ([("PROVIDES", ">")], True, "start"),
    ("CAREER", "MAJOR"): ([("LEADS_TO", "<")], False, "end"),
    ("SUBJECT", "TEACHER"): ([("TEACH", "<")], True, "end"),
    ("TEACHER", "SUBJECT"): ([("TEACH", ">")], False, "start"),
    ("MAJOR", "TEACHER"): ([("OFFERS", ">"), ("TEACH", "<")], True, "start"),
    ("TEACHER", "MAJOR"): ([("TEACH", ">"), ("OFFERS", "<")], False, "start"),
}

# Questions answered by an aggregation, tested in this order.
_ALL_MAJORS = r"tất cả(?: các)? ngành|mọi ngành|các ngành đều|ngành nào cũng|chung cho(?: tất cả| mọi| các)?(?: các)? ngành|môn chung|môn bắt buộc chung|môn(?: học)? bắt buộc"
AGGREGATIONS = [
    ("subject_intersection_two", r"môn(?: học)?(?: nào)?(?: là)? chung(?: giữa| của)?(.*?)(?:\s+và\s+)(.*?)(?:\?|$)"),
    ("subject_intersection_all", rf"(?:môn(?: học)?(?: gì| nào)?.*?(?:{_ALL_MAJORS})|(?:{_ALL_MAJORS}).*?(?:môn|học phần))"),
    ("major_most_subjects", r"ngành(?: nào)?.{0,20}(?:nhiều môn|nhiều học phần).{0,15}nhất"),
    ("career_most_skills", r"(?:nghề|career|vị trí).{0,20}(?:nhiều kỹ năng|nhiều skill).{0,15}nhất"),
    ("subject_most_majors", r"môn(?: học)?(?: nào)?.{0,30}(?:nhiều ngành|phổ biến nhất|nhiều nhất)"),
    ("skill_most_subjects", r"(?:kỹ năng|skill)(?: nào)?.{0,30}(?:nhiều môn|phổ biến nhất)"),
    ("count_entities", r"(?:có|tổng)(?: tất cả)? bao nhiêu (ngành|môn|nghề|kỹ năng|giảng viên)"),
]
# Short forms in questions; up to three letters they must be written in capitals.
ABBREVIATIONS = {
    "da": ["data analyst", "phân tích dữ liệu"],
    "de": ["data engineer", "kỹ sư dữ liệu"],
    "ds": ["data scientist", "khoa học dữ liệu"],
    "ba": ["business analyst", "phân tích kinh doanh"],
    "pm": ["project manager", "quản lý dự án"],
    "po": ["product owner"],
    "qa": ["kiểm thử", "quality assurance"],
    "dev": ["lập trình viên", "developer"],
    "fe": ["front end", "lập trình viên frontend"],
    "be": ["back end", "lập trình viên backend"],
    "ml": ["machine learning", "học máy"],
    "ai": ["trí tuệ nhân tạo", "artificial intelligence"],
    "cntt": ["công nghệ thông tin"],
    "ktpm": ["kỹ thuật phần mềm"],
    "httt": ["hệ thống thông tin"],
    "qtkd": ["quản trị kinh doanh"],
    "tcnh": ["tài chính ngân hàng"],
    "kt": ["kế toán", "kinh tế"],
    "mkt": ["marketing"],
    "hr": ["quản trị nhân lực", "nhân sự"],
}
# What an answer is held to, by (mentioned, asked) label.
CONSTRAINTS = {
    ("MAJOR", "CAREER"): "MAJOR -[:LEADS_TO]-> CAREER. Liệt kê Career mà Major dẫn đến. KHÔNG đề cập SUBJECT trừ khi được hỏi.",
    ("CAREER", "SKILL"): "CAREER -[:REQUIRES]-> SKILL và SUBJECT -[:PROVIDES]-> SKILL. Trả lời kỹ năng cần + môn cung cấp kỹ năng đó.",
    ("MAJOR", "SKILL"): "MAJOR -[:MAJOR_OFFERS_SUBJECT]-> SUBJECT -[:PROVIDES]-> SKILL. Kỹ năng đạt được từ các môn trong chương trình. Kèm tên môn (mã môn).",
    ("SKILL", "MAJOR"): "SKILL <-[:PROVIDES]- SUBJECT <-[:MAJOR_OFFERS_SUBJECT]- MAJOR. Ngành học có môn cung cấp kỹ năng đó. Kèm mã ngành, tên môn trung gian.",
    ("CAREER", "SUBJECT"): "CAREER -[:REQUIRES]-> SKILL <-[:PROVIDES]- SUBJECT. Môn học cung cấp kỹ năng nghề yêu cầu. Kèm mã môn + kỹ năng tương ứng.",
    ("MAJOR", "SUBJECT"): "MAJOR -[:MAJOR_OFFERS_SUBJECT]-> SUBJECT. Môn học thuộc chương trình ngành, kèm mã môn và kỹ năng cung cấp.",
    ("SKILL", "CAREER"): "SKILL <-[:REQUIRES]- CAREER. Nghề nghiệp yêu cầu kỹ năng đó.",
    ("CAREER", "MAJOR"): "MAJOR -[:LEADS_TO]-> CAREER. Ngành học dẫn đến nghề đó, kèm mã ngành.",
    ("SUBJECT", "SKILL"): "SUBJECT -[:PROVIDES]-> SKILL. Kỹ năng đạt được sau khi học môn đó.",
    ("SKILL", "SUBJECT"): "SKILL <-[:PROVIDES]- SUBJECT. Môn học (kèm mã môn) cung cấp kỹ năng đó.",
    ("SUBJECT", "TEACHER"): "TEACHER -[:TEACH]-> SUBJECT. Giảng viên phụ trách môn đó.",
    ("TEACHER", "SUBJECT"): "TEACHER -[:TEACH]-> SUBJECT. Môn học thầy/cô đó phụ trách.",
    ("MAJOR", "TEACHER"): "MAJOR -[:MAJOR_OFFERS_SUBJECT]-> SUBJECT <-[:TEACH]- TEACHER. Giảng viên dạy trong chương trình ngành đó.",
    ("TEACHER", "MAJOR"): "TEACHER -[:TEACH]-> SUBJECT <-[:MAJOR_OFFERS_SUBJECT]- MAJOR. Ngành học thầy/cô đó tham gia giảng dạy.",
    ("MAJOR", "MAJOR"): "So sánh: MAJOR -[:LEADS_TO]-> CAREER và MAJOR -[:MAJOR_OFFERS_SUBJECT]-> SUBJECT. So sánh cơ hội nghề nghiệp và môn học đặc trưng của từng ngành.",
}
DEFAULT_CONSTRAINT = "Trả lời theo đúng câu hỏi, chỉ dùng dữ liệu trong Knowledge Graph."
# Targets of the retrieval metrics.
THRESHOLDS = {"precision": 0.7, "recall": 0.7, "f1": 0.65, "mrr": 0.6, "entity_coverage": 0.8, "path_relevance": 0.7, "comprehensiveness": 0.7}

NODE_FIELDS = [*NODE_KEY.values(), *NODE_NAME.values(), "major_name_en", "subject_name_en", "skill_type", "career_name_en", "field_name", "email", "title"]
REL_FIELDS = ["rel_type", "from_major_code", "from_subject_code", "from_career_key", "from_teacher_key", "to_subject_code", "to_skill_key", "to_career_key", "semester", "required_type", "mastery_level", "required_level"]
NODE_STRUCT = T.StructType([T.StructField("type", STR), *[T.StructField(f, STR) for f in NODE_FIELDS], T.StructField("major_names", T.ArrayType(STR)), T.StructField("major_codes", T.ArrayType(STR))])
REL_STRUCT = T.StructType([T.StructField(f, STR) for f in REL_FIELDS])
#: One document of extracted nodes and relationships; semester is read as a string and cast later.
KG_DOCUMENT = T.StructType([T.StructField("nodes", T.ArrayType(NODE_STRUCT)), T.StructField("relationships", T.ArrayType(REL_STRUCT))])
INTENT = T.StructType([T.StructField("keywords", T.ArrayType(STR)), T.StructField("mentioned_labels", T.ArrayType(STR)), T.StructField("asked_label", STR), T.StructField("negated_keywords", T.ArrayType(STR)), T.StructField("is_comparison", T.BooleanType())])
RESULT = T.StructType(
    [
        T.StructField("query_id", STR), T.StructField("query", STR), T.StructField("generated_answer", STR),
        T.StructField("retrieved_nodes", T.ArrayType(T.StructType([T.StructField("node_id", STR), T.StructField("content", STR), T.StructField("entities", T.ArrayType(STR))]))),
        T.StructField("traversal_path", T.ArrayType(T.StructType([T.StructField("from", STR), T.StructField("to", STR), T.StructField("relation", STR), T.StructField("hop", T.IntegerType())]))),
    ]
)
PLAIN_GRAPH = T.StructType([T.StructField("nodes", T.ArrayType(STR)), T.StructField("edges", T.ArrayType(T.MapType(STR, STR)))])
