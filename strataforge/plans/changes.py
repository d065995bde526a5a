"""Snapshot-change queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataforge.operators.snapshot_changes import change_set, snapshot_changes
from strataforge.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "entity_states"), table(spark, sf_dir, "snapshots"))


def p1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_set(p1_found(spark, sf_dir))


_FOUND_SQL = """
WITH chain AS (
  SELECT repo_id, version, lead(version) OVER (PARTITION BY repo_id ORDER BY version) AS nxt
  FROM (SELECT DISTINCT repo_id, version FROM snapshots WHERE is_full_snapshot) s
), held AS (
  SELECT * FROM (
    SELECT e.*, row_number() OVER (PARTITION BY repo_id, version, entity_id ORDER BY ingested_at DESC) AS rn
    FROM entity_states e SEMI JOIN chain USING (repo_id, version)) WHERE rn = 1
), a AS (SELECT h.*, c.nxt FROM held h JOIN chain c USING (repo_id, version) WHERE c.nxt IS NOT NULL),
b AS (SELECT h.*, c.version AS prv FROM held h JOIN chain c ON h.repo_id = c.repo_id AND h.version = c.nxt),
j AS (
  SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.version, b.prv) AS from_version,
         coalesce(a.nxt, b.version) AS to_version, coalesce(a.entity_id, b.entity_id) AS entity_id,
         CASE WHEN a.entity_id IS NULL THEN 'added' WHEN b.entity_id IS NULL THEN 'removed'
              WHEN a.kind IS DISTINCT FROM b.kind OR a.entity_name IS DISTINCT FROM b.entity_name OR a.path IS DISTINCT FROM b.path
                OR a.architecture_role IS DISTINCT FROM b.architecture_role OR a.criticality IS DISTINCT FROM b.criticality
                OR a.complexity IS DISTINCT FROM b.complexity
                OR NOT (a.importance IS NOT DISTINCT FROM b.importance OR coalesce(abs(a.importance - b.importance) < 1e-6, false))
                OR NOT (a.health_score IS NOT DISTINCT FROM b.health_score OR coalesce(abs(a.health_score - b.health_score) < 1e-6, false))
                OR list_sort(list_distinct(a.risks)) IS DISTINCT FROM list_sort(list_distinct(b.risks))
                OR list_sort(list_distinct(a.depends_on)) IS DISTINCT FROM list_sort(list_distinct(b.depends_on))
                OR a.belongs_to_domain IS DISTINCT FROM b.belongs_to_domain OR a.belongs_to_layer IS DISTINCT FROM b.belongs_to_layer
              THEN 'modified' END AS change_kind
  FROM a FULL OUTER JOIN b ON a.repo_id = b.repo_id AND a.nxt = b.version AND a.entity_id = b.entity_id
)
SELECT repo_id, from_version, to_version, entity_id, change_kind FROM j WHERE change_kind IS NOT NULL
"""

QUERIES = {"p1_found": p1_found, "p1_summary": p1_summary}
SQL = {
    "p1_found": _FOUND_SQL,
    "p1_summary": f"""SELECT repo_id, from_version, to_version,
      count(*) FILTER (WHERE change_kind = 'added') AS n_added,
      count(*) FILTER (WHERE change_kind = 'removed') AS n_removed,
      count(*) FILTER (WHERE change_kind = 'modified') AS n_modified
    FROM ({_FOUND_SQL}) GROUP BY ALL""",
}
