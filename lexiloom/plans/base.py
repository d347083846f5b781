"""The registry that query modules fill."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Lines of documents as blocks, for the SQL twins.
BLOCKS = """blocks AS (
  SELECT doc_id, lang, source, i - 1 AS block_index, ls[i] AS text, CASE WHEN length(ls[i]) <= 40 THEN 'heading' ELSE 'paragraph' END AS type
  FROM (SELECT doc_id, lang, source, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS ls FROM documents))
)"""


#: ``named``: documents under short names, their first words (columns n_nationkey, n_regionkey, n_name), for the SQL twins.
NAMED = "(SELECT doc_id AS n_nationkey, doc_id % 40 AS n_regionkey, regexp_extract(text, '[A-Za-z]+') AS n_name FROM documents) named"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql.replace("FROM named", f"FROM {NAMED}")
        return f

    return keep
