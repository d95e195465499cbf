"""SQL for the operators that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from .sharding import TABLE_SIZE, lookup_table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DUPLICATES = f"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingled AS (
    SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS s FROM worded),
sized AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
linked AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id
    JOIN sized x ON x.doc_id = a.doc_id JOIN sized y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sized s USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)"""



def placement(shards: list[str]) -> str:
    """Slots by MD5; the table that the slots look up is made by the rule, as it is too long a recursion for SQL."""
    table = ",".join(map(str, lookup_table(shards).tolist()))
    names = ",".join(f"'{s}'" for s in shards)
    return f"""WITH t AS (SELECT [{table}] AS owner, [{names}] AS name)
SELECT doc_id, slot, CAST(owner[slot + 1] AS BIGINT) AS shard_no, name[owner[slot + 1] + 1] AS shard
FROM (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '\\N')), 1, 15)) AS BIGINT) % {TABLE_SIZE} AS slot FROM documents), t"""


def sql(shards: list[str]) -> dict[str, str]:
    return {"op5_sharding": placement(shards), "op7_near_duplicates": NEAR_DUPLICATES}
