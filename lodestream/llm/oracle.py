"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

_CJK = "[぀-ヿ㐀-鿿]"


def _grams(texts: str, n: int) -> str:
    """(k, gram): every run of n words of (k, t) texts."""
    words = r"regexp_extract_all(regexp_replace(lower(t), '([㐀-鿿])', ' \1 ', 'g'), '[\p{L}\p{N}]+')"
    return f"""SELECT DISTINCT k, md5(array_to_string(w[i : i + {n - 1}], ' ')) AS gram
      FROM (SELECT k, w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT k, {words} AS w FROM ({texts})) WHERE len(w) >= {n})"""


_PASSAGES = "SELECT id AS k, unnest([query, expected_answer]) AS t FROM rag_eval_cases WHERE language {} 'zh'"
_DOCS = "SELECT doc_id AS k, text AS t FROM documents WHERE text IS NOT NULL"

SQL: dict[str, str] = {
    "p2_found": "SELECT DISTINCT 'media_response_faq' AS item_table, faq_id AS item_id FROM media_response_faq WHERE len(content) > 1200 UNION ALL SELECT DISTINCT 'rag_document', doc_key FROM rag_document WHERE len(content) > 1200",
    "p7_found": rf"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '{_CJK}')) + len(regexp_extract_all(regexp_replace(text, '{_CJK}', ' ', 'g'), '[\p{{L}}\p{{N}}]+|[^\s\p{{Z}}\p{{L}}\p{{N}}]')) > 1024",
    "p8_found": " UNION ".join(
        f"SELECT d.k AS doc_id, c.k AS case_id FROM ({_grams(_DOCS, n)}) d JOIN ({_grams(_PASSAGES.format(op), n)}) c USING (gram)" for n, op in ((12, "<>"), (24, "="))
    ),
}
