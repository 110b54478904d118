"""Oracle SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from graphloom.llm.survivors import FILLERS

# DuckDB has NFC but not NFKC; punctuation goes anyway, so only compatibility letters and digits would differ.


def canon_sql(c: str) -> str:
    """Canonical text as in functions.canon; + and # are put aside as letters that no text has, and back."""
    kept = f"replace(replace(lower(nfc_normalize(coalesce({c}, ''))), '+', 'ꜩ'), '#', 'ꝁ')"
    return rf"replace(replace(regexp_replace({kept}, '[\p{{Z}}\p{{C}}\p{{P}}\p{{S}}]', '', 'g'), 'ꜩ', '+'), 'ꝁ', '#')"


def _p1() -> str:
    parts = []
    for kind, table, fields in (
        ("MAJOR", "major", ["major_code", "major_name_vi", "major_name_en"]),
        ("SKILL", "skill", ["skill_key", "skill_name", "skill_type"]),
        ("CAREER", "career", ["career_key", "career_name_vi", "career_name_en", "field_name"]),
    ):
        keys = ", ".join(f"{canon_sql(f)} k{i}" for i, f in enumerate(fields))
        by = ", ".join(f"k{i}" for i in range(len(fields)))
        parts.append(f"SELECT '{kind}' AS node_type, min(record_id) AS record_id, count(*) AS copies FROM (SELECT record_id, {keys} FROM {table}) GROUP BY {by} HAVING count(*) >= 2")
    return " UNION ALL ".join(parts)


def _p4() -> str:
    fill = ", ".join(f"'{f}'" for f in FILLERS)
    code, vi, en = (canon_sql(f"m.{c}") for c in ("major_code", "major_name_vi", "major_name_en"))
    return f"""
WITH k AS (
  SELECT m.record_id, m.major_code, m.extracted_at, coalesce(t.trust_rank, 1000000) AS rk,
         CASE WHEN regexp_full_match({code}, '[0-9]{{7}}') THEN {code} END AS code, {vi} AS vi,
         ({vi} <> '' AND {vi} NOT IN ({fill})) AS vi_ok, ({en} <> '' AND {en} NOT IN ({fill})) AS en_ok
  FROM major m LEFT JOIN source_trust t ON m.source_name = t.source_name),
names AS (SELECT vi, min(code) AS by_name FROM k WHERE code IS NOT NULL AND vi_ok GROUP BY vi),
g AS (SELECT k.*, coalesce('c' || code, 'c' || by_name, CASE WHEN vi_ok THEN 'n' || k.vi END, 'r' || record_id) AS grp
      FROM k LEFT JOIN names ON k.vi = names.vi AND k.code IS NULL AND k.vi_ok),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, coalesce(regexp_full_match(major_code, '[0-9]{{7}}'), false) ORDER BY rk, extracted_at DESC NULLS LAST, record_id) AS rc,
             row_number() OVER (PARTITION BY grp, vi_ok ORDER BY rk, extracted_at DESC NULLS LAST, record_id) AS rv,
             row_number() OVER (PARTITION BY grp, en_ok ORDER BY rk, extracted_at DESC NULLS LAST, record_id) AS re FROM g)
SELECT min(record_id) AS group_id,
       coalesce(max(CASE WHEN rc = 1 AND regexp_full_match(major_code, '[0-9]{{7}}') THEN record_id END), 0) AS code_from,
       coalesce(max(CASE WHEN rv = 1 AND vi_ok THEN record_id END), 0) AS name_vi_from,
       coalesce(max(CASE WHEN re = 1 AND en_ok THEN record_id END), 0) AS name_en_from
FROM r GROUP BY grp HAVING count(*) >= 2"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _p1(), "p4_found": _p4()}
