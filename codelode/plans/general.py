"""Queries of the general training-data operators (problem 4)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.operators.changefeed import ChangeCapture, append, changed_records
from codelode.sources.tables import table
from codelode.workspace import shared_dir


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Scans that report a file as new or changed since it was last indexed."""
    return changed_records(table(spark, root, "file_scans"), table(spark, root, "files").select("repo", "path", "hash", "indexed_at")).select("scan_id")


def p4_changes(spark: SparkSession, root: str) -> DataFrame:
    """The same changes with their key and kind."""
    found = changed_records(table(spark, root, "file_scans"), table(spark, root, "files").select("repo", "path", "hash", "indexed_at"))
    return found.selectExpr("repo", "path_key AS path", "scan_id", "hash_key AS hash", "change")


def p4_increments(spark: SparkSession, root: str) -> DataFrame:
    """The files still to be indexed after the scans arrived in three parts, each in a run of its own, in no order of time."""
    scans, files = table(spark, root, "file_scans"), table(spark, root, "files").select("repo", "path", "hash", "indexed_at")
    home = f"{shared_dir(spark)}/increments-{uuid.uuid4().hex}"
    capture = ChangeCapture(spark, f"{home}/state", compact_every=2)
    for part in range(3):
        append(scans.where(F.pmod(F.xxhash64("scan_id"), F.lit(3)) == part), f"{home}/log")
        capture.run(spark.read.parquet(f"{home}/log"), files)
    return capture.outstanding(files).select("scan_id", "change")


QUERIES = {"p4_found": p4_found, "p4_changes": p4_changes, "p4_increments": p4_increments}

_P4 = """
WITH scans AS (
  SELECT scan_id, repo, regexp_replace(replace(path, '\\', '/'), '^(\\./+)+', '') AS path,
         lower(nullif(regexp_replace(hash, '^\\s+|\\s+$', '', 'g'), '')) AS hash, scanned_at
  FROM file_scans
), best AS (
  SELECT * FROM (
    SELECT DISTINCT *, row_number() OVER (PARTITION BY repo, path ORDER BY scanned_at DESC, scan_id DESC) AS rn
    FROM (SELECT DISTINCT * FROM scans WHERE hash IS NOT NULL AND repo IS NOT NULL AND path IS NOT NULL AND scanned_at IS NOT NULL)
  ) WHERE rn = 1
), stored AS (
  SELECT repo, path, hash, indexed_at FROM (
    SELECT repo, regexp_replace(replace(path, '\\', '/'), '^(\\./+)+', '') AS path,
           lower(nullif(regexp_replace(hash, '^\\s+|\\s+$', '', 'g'), '')) AS hash, indexed_at,
           row_number() OVER (PARTITION BY repo, regexp_replace(replace(path, '\\', '/'), '^(\\./+)+', '') ORDER BY indexed_at DESC NULLS LAST) AS rn
    FROM files
  ) WHERE rn = 1
)
"""
_P4_CASES = """
FROM best b LEFT JOIN stored s ON b.repo = s.repo AND b.path = s.path
WHERE s.path IS NULL OR (coalesce(s.hash <> b.hash, true) AND coalesce(b.scanned_at > s.indexed_at, true))
"""

ORACLE = {
    "p4_found": _P4 + "SELECT b.scan_id" + _P4_CASES,
    "p4_changes": _P4 + "SELECT b.repo, b.path, b.scan_id, b.hash, CASE WHEN s.path IS NULL THEN 'new' ELSE 'changed' END AS change" + _P4_CASES,
    "p4_increments": _P4 + "SELECT b.scan_id, CASE WHEN s.path IS NULL THEN 'new' ELSE 'changed' END AS change" + _P4_CASES,
}
