"""The deduplicated views of the index in SQL, as common table expressions for the oracles."""

VIEWS = """
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, hash DESC NULLS LAST) AS version FROM files WHERE id IS NOT NULL) WHERE version = 1),
c AS (SELECT DISTINCT ON (id) * FROM code_chunks WHERE id IS NOT NULL),
s AS (SELECT DISTINCT ON (id) *, lower(name) AS name_lc FROM symbols WHERE id IS NOT NULL),
r AS (SELECT DISTINCT ON (id) *, lower(target_name) AS name_lc FROM symbol_references WHERE id IS NOT NULL),
d AS (SELECT DISTINCT ON (id) * FROM dependencies WHERE id IS NOT NULL),
runs AS (SELECT DISTINCT ON (id) * FROM ingestion_runs WHERE id IS NOT NULL)
"""


def sql(body: str, recursive: bool = False) -> str:
    """``body`` after the views; it may go on with further common table expressions after a comma."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{VIEWS}{body}"
