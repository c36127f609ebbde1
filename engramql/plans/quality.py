"""Queries of the general data-quality operators (orphan references, timestamps)."""

from __future__ import annotations

import hashlib

from engramql.operators import references, timestamps
from engramql.storage import shared_dir, table


def p2_found(spark, d):
    t = references.find_orphans(table(spark, d, "node"), table(spark, d, "edge"), table(spark, d, "episode"))
    return t.select("field", "from_id", "to_id", "rel", "state").distinct()


def p2_report(spark, d):
    return references.orphan_report(table(spark, d, "node"), table(spark, d, "edge"), table(spark, d, "episode"))


def p5_found(spark, d):
    """The dictionary of a data folder lies in the shared folder, so a second run parses only what is new."""
    path = f"{shared_dir(spark)}/start_dictionary/{hashlib.sha256(d.encode()).hexdigest()[:16]}"
    return timestamps.normalise_starts(table(spark, d, "raw_calendar_event"), table(spark, d, "calendar_account"), table(spark, d, "zone_alias"), path)


_ORPHANS = r"""
WITH refs AS (
  SELECT 'node' AS target, lower(trim(src)) AS k, 'edge.src' AS field, src AS from_id, dst AS to_id, rel, min(landed_at) AS at FROM edge GROUP BY src, dst, rel
  UNION ALL
  SELECT 'node', lower(trim(dst)), 'edge.dst', src, dst, rel, min(landed_at) FROM edge GROUP BY src, dst, rel
  UNION ALL
  SELECT DISTINCT 'episode', lower(trim(e.source_inference_id)), 'episode.source_inference_id', e.id, e.source_inference_id, '', f.at
  FROM episode e JOIN (SELECT lower(trim(id)) AS k, min(landed_at) AS at FROM episode GROUP BY 1) f ON f.k = lower(trim(e.id))
  WHERE trim(coalesce(e.source_inference_id, '')) <> ''
), targets AS (
  SELECT 'node' AS target, lower(trim(id)) AS k, min(landed_at) AS first_at, arg_max(coalesce(tombstoned, false), landed_at) AS dead FROM node GROUP BY 2
  UNION ALL
  SELECT 'episode', lower(trim(id)), min(landed_at), false FROM episode GROUP BY 2
), found AS (
  SELECT r.*, CASE WHEN t.k IS NULL OR coalesce(r.k, '') = '' THEN 'missing' WHEN t.dead THEN 'deleted' WHEN t.first_at > r.at THEN 'late' END AS state
  FROM refs r LEFT JOIN targets t ON t.target = r.target AND t.k = r.k
)
"""


def queries():
    return {"p2_found": p2_found, "p2_report": p2_report, "p5_found": p5_found}


def oracle_sql():
    return {
        "p2_found": _ORPHANS + "SELECT DISTINCT field, from_id, to_id, rel, state FROM found WHERE state IS NOT NULL",
        "p2_report": _ORPHANS
        + "SELECT split_part(field, '.', 1) AS table_name, field, strftime(found.at, '%Y-%m') AS month, state, count(*) AS n FROM found WHERE state IS NOT NULL GROUP BY ALL",
    }
