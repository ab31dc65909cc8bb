"""The queries of this subpackage, each over its whole table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from ruleframe.llm import class_lm, embedding_dedup, exact_dedup, html_text, language_id, line_dedup, mixing, packing, sharding, shingle_join
from ruleframe.llm.common import table

QUERIES = {
    "op1_line_dedup": lambda s, d: line_dedup.op1(s, table(s, d, "documents")),
    "op2_exact_dedup": lambda s, d: exact_dedup.op2(s, table(s, d, "documents")),
    "op3_sharding": lambda s, d: sharding.op3(s, table(s, d, "documents")),
    "op4_mixing": lambda s, d: mixing.op4(s, table(s, d, "documents")),
    "op5_embedding_dedup": lambda s, d: embedding_dedup.op5(s, table(s, d, "embeddings")),
    "op6_packing": lambda s, d: packing.op6(s, table(s, d, "documents")),
    "op7_html_extraction": lambda s, d: html_text.op7(s, table(s, d, "pages")),
    "op8_lm_scoring": lambda s, d: class_lm.op8(s, table(s, d, "documents")),
    "op9_shingle_join": lambda s, d: shingle_join.op9(s, table(s, d, "documents")),
    "op10_language_id": lambda s, d: language_id.op10(s, table(s, d, "documents")),
}

SQL = {
    "op2_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), w AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
""",
}
