"""Reference SQL of this subpackage's queries, where SQL can express them on whole tables."""

from __future__ import annotations

_P4 = r"""
WITH one AS (SELECT DISTINCT ON (id) id, lower(regexp_replace(chat_id, '^\s+|\s+$', '', 'g')) AS k, lower(regexp_replace(role, '^\s+|\s+$', '', 'g')) AS r, content, trim(created_at) AS c FROM messages ORDER BY id),
home AS (SELECT lower(trim(id)) AS k, min(id) AS chat_id FROM chats WHERE id IS NOT NULL GROUP BY 1),
m AS (SELECT chat_id, id, content, CASE WHEN r IN ('user', 'human') THEN 'user' WHEN r IN ('assistant', 'ai') THEN 'assistant' END AS speaker,
 CASE WHEN c IS NULL THEN NULL WHEN regexp_matches(c, '(Z|[+-]\d\d:?\d\d)$') AND length(c) > 10 THEN epoch_us(TRY_CAST(c AS TIMESTAMPTZ)) ELSE epoch_us(TRY_CAST(c AS TIMESTAMP)) END AS t FROM one JOIN home USING (k)),
w AS (SELECT *, lag(speaker) OVER o AS ps, lag(content) OVER o AS pc, last_value(speaker) OVER (PARTITION BY chat_id ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS closing,
 bool_or(t IS NULL OR speaker IS NULL OR content IS NULL OR NOT regexp_matches(content, '[^\s\p{Z}]')) OVER (PARTITION BY chat_id) AS broken FROM m WINDOW o AS (PARTITION BY chat_id ORDER BY t, id)),
l AS (SELECT *, CASE WHEN ps IS NULL THEN speaker <> 'user' ELSE ps = speaker END AS wrong FROM w WHERE NOT broken AND closing = 'assistant' AND NOT (ps IS NOT NULL AND ps = speaker AND pc = content)),
g AS (SELECT *, bool_or(wrong) OVER (PARTITION BY chat_id) AS bad FROM l)
"""

_P3 = """
WITH r AS (
  SELECT DISTINCT 'dataset' AS table_name, qid AS record_key, answer_span AS text FROM dataset WHERE qid IS NOT NULL AND length(answer_span) >= 120
  UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 120),
w AS (SELECT table_name, record_key, length(text) AS n, pos, md5_number_lower(substr(text, CAST(pos AS INTEGER), 120)) AS h FROM (SELECT *, unnest(range(1, length(text) - 118)) AS pos FROM r)),
c AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT table_name || '|' || record_key) > 1)
"""

_P7 = """
WITH m AS (SELECT item_table, max(max_chars) AS most FROM budgets WHERE purpose = 'cut' GROUP BY 1)
SELECT DISTINCT 'blocks' AS table_name, coalesce(stem, '') || '/' || coalesce(CAST(block_ix AS VARCHAR), '') AS item_key FROM blocks JOIN m ON item_table = 'blocks' WHERE length(text) > most
UNION ALL SELECT DISTINCT 'documents', CAST(doc_id AS VARCHAR) FROM documents JOIN m ON item_table = 'documents' WHERE length(text) > most
"""


def oracle_sql() -> dict[str, str]:
    turns = "row_number() OVER (PARTITION BY chat_id ORDER BY t, id)"
    return {
        "p3_found": f"{_P3} SELECT DISTINCT table_name, record_key FROM w JOIN c USING (h)",
        "p3_shared": f"""{_P3}, s AS (SELECT DISTINCT table_name, record_key, n, pos FROM w JOIN c USING (h)),
          g AS (SELECT *, least(120, pos - coalesce(lag(pos) OVER (PARTITION BY table_name, record_key ORDER BY pos), pos - 120)) AS gain FROM s)
          SELECT table_name, record_key, CAST(max(n) AS INTEGER) AS n_chars, CAST(sum(gain) AS BIGINT) AS shared_chars, round(sum(gain) / max(n), 6) AS share FROM g GROUP BY 1, 2""",
        "p4_found": f"{_P4} SELECT chat_id, CAST({turns} AS INTEGER) AS turn_no, id FROM g WHERE NOT bad",
        "p4_turns": f"{_P4} SELECT chat_id, CAST({turns} AS INTEGER) AS turn_no, id, speaker AS role FROM g WHERE NOT bad",
        "p7_found": _P7,
    }
