"""Queries on changes between full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.operators.snapshot_diff import snapshot_changes
from lodestrata.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and symbols added, removed or changed since the previous complete scan."""
    return snapshot_changes(table(spark, sf_dir, "scan_runs"), table(spark, sf_dir, "inventory_files"), table(spark, sf_dir, "generation_symbols"))


QUERIES = {"p2_found": p2_found}
ORACLES = {
    "p2_found": r"""
WITH runs AS (
  SELECT scan_id, repo, max(created_at) AS made FROM scan_runs
  WHERE lower(trim(state)) = 'complete' AND scan_id IS NOT NULL AND repo IS NOT NULL AND created_at IS NOT NULL
  GROUP BY scan_id, repo
), seq AS (
  SELECT scan_id, repo, lag(scan_id) OVER w AS prev_scan FROM runs WINDOW w AS (PARTITION BY repo ORDER BY made, scan_id)
), items AS (
  SELECT 'file' AS entity, scan_id,
    array_to_string(list_filter(string_split(nfc_normalize(replace(path, chr(92), '/')), '/'), lambda s: s NOT IN ('', '.')), '/') AS item_key,
    CASE WHEN trim(content_sha256) <> '' THEN lower(trim(content_sha256)) END AS value, loaded_at
  FROM inventory_files
  UNION ALL
  SELECT 'symbol', scan_id, fqsn, regexp_replace(signature, '\s+', '', 'g'), loaded_at FROM generation_symbols
), held AS (
  SELECT entity, r.scan_id, repo, prev_scan, item_key, value FROM items r JOIN seq USING (scan_id)
  WHERE item_key <> ''
  QUALIFY row_number() OVER (PARTITION BY entity, r.scan_id, item_key ORDER BY loaded_at DESC NULLS LAST, value IS NULL, value DESC) = 1
), pairs AS (
  SELECT c.entity, c.scan_id, c.item_key, CASE WHEN p.item_key IS NULL THEN 'added' WHEN p.value <> c.value THEN 'changed' END AS change
  FROM held c LEFT JOIN held p ON p.entity = c.entity AND p.scan_id = c.prev_scan AND p.item_key = c.item_key
  WHERE c.prev_scan IS NOT NULL
  UNION ALL
  SELECT p.entity, s.scan_id, p.item_key, 'removed'
  FROM held p JOIN seq s ON s.prev_scan = p.scan_id
  WHERE NOT EXISTS (SELECT 1 FROM held c WHERE c.entity = p.entity AND c.scan_id = s.scan_id AND c.item_key = p.item_key)
)
SELECT entity, scan_id, item_key, change FROM pairs WHERE change IS NOT NULL
""",
}
