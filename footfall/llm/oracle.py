"""The same questions in DuckDB SQL, where SQL can express them."""

ORACLE = {
    "op2_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(body) AS text_sha256
        FROM t WINDOW same AS (PARTITION BY body)
    """,
}
