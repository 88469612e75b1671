"""SQL forms of the pN_ queries, where SQL can state them over whole tables.

The others rest on trained models, label sequences, parsing or token counts; they
are tested against brute force, exact round trips or held-out labels instead.
"""

from __future__ import annotations

# words of cells and items with their places; equal words with one shift between
# the places that follow each other in a run of 15 are a leaked passage
P8 = r"""
WITH cells AS MATERIALIZED (SELECT doc_id, substring(text, (c.start_pos + 1)::BIGINT, c.len_chars::BIGINT) AS t FROM (SELECT doc_id, text, unnest(cells) AS c FROM documents WHERE text IS NOT NULL)),
w AS MATERIALIZED (SELECT row_number() OVER () AS cell, doc_id, string_split(trim(regexp_replace(lower(t), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS ws FROM cells),
t AS MATERIALIZED (SELECT cell, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
b AS MATERIALIZED (SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS ws FROM benchmark WHERE text IS NOT NULL)),
m AS (SELECT DISTINCT t.doc_id, t.cell, b.item_id, t.i, t.i - b.k AS shift FROM t JOIN b USING (word) WHERE word <> ''),
r AS (SELECT *, i - row_number() OVER (PARTITION BY cell, item_id, shift ORDER BY i) AS run FROM m)
SELECT DISTINCT doc_id, item_id FROM r GROUP BY doc_id, cell, item_id, shift, run HAVING count(*) >= 15
"""


def oracle_sql() -> dict[str, str]:
    return {"p8_found": P8}
