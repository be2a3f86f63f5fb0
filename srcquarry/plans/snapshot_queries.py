"""Queries on the full snapshots of ``active_index``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.snapshots import change_events, committed_sequence, validity_intervals
from ..tables import table


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "active_index").withColumn("sha256", F.lower("sha256"))
    builds = table(spark, sf_dir, "build_log")
    sequence = committed_sequence(builds, ["repo_dir"], "snapshot_no", F.col("status") == "active")
    return validity_intervals(
        rows,
        sequence,
        group=["repo_dir"],
        key=["relative_path"],
        snapshot="snapshot_no",
        values=["sha256", "chunks"],
        received="received_at",
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files added, removed or changed in each committed build after the first."""
    return change_events(
        _intervals(spark, sf_dir), group=["repo_dir"], key=["relative_path"], snapshot="snapshot_no"
    ).select("repo_dir", F.col("snapshot_no").cast("int"), "relative_path", "change")


def p2_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity intervals of every file: the committed builds through which it stayed the same."""
    return _intervals(spark, sf_dir).select(
        "repo_dir", "relative_path", "first_snapshot", "last_snapshot", "sha256", "chunks"
    )


_ONE = """
  build AS (SELECT repo_dir, snapshot_no, row_number() OVER (PARTITION BY repo_dir ORDER BY snapshot_no) AS seq
            FROM (SELECT DISTINCT repo_dir, snapshot_no FROM build_log WHERE status = 'active')),
  one AS (SELECT a.repo_dir, b.seq, a.snapshot_no, a.relative_path, lower(a.sha256) AS sha256, a.chunks
          FROM active_index a JOIN build b ON a.repo_dir = b.repo_dir AND a.snapshot_no = b.snapshot_no
          QUALIFY row_number() OVER (PARTITION BY a.repo_dir, a.snapshot_no, a.relative_path
                    ORDER BY a.received_at DESC NULLS LAST, lower(a.sha256) DESC NULLS LAST, a.chunks DESC NULLS LAST) = 1)
"""

SQL = {
    "p2_found": f"""
WITH {_ONE},
  later AS (SELECT * FROM one WHERE seq > 1),
  former AS (SELECT o.*, b.snapshot_no AS at FROM one o JOIN build b ON o.repo_dir = b.repo_dir AND b.seq = o.seq + 1)
SELECT coalesce(l.repo_dir, f.repo_dir) AS repo_dir, coalesce(l.snapshot_no, f.at) AS snapshot_no,
       coalesce(l.relative_path, f.relative_path) AS relative_path,
       CASE WHEN f.seq IS NULL THEN 'A' WHEN l.seq IS NULL THEN 'D' ELSE 'M' END AS change
FROM later l FULL JOIN former f
  ON l.repo_dir = f.repo_dir AND l.seq = f.seq + 1 AND l.relative_path IS NOT DISTINCT FROM f.relative_path
WHERE f.seq IS NULL OR l.seq IS NULL OR l.sha256 IS DISTINCT FROM f.sha256 OR l.chunks IS DISTINCT FROM f.chunks""",
    "p2_intervals": f"""
WITH {_ONE},
  marked AS (SELECT *, CASE WHEN lag(seq) OVER w = seq - 1 AND lag(sha256) OVER w IS NOT DISTINCT FROM sha256
                             AND lag(chunks) OVER w IS NOT DISTINCT FROM chunks THEN 0 ELSE 1 END AS fresh
             FROM one WINDOW w AS (PARTITION BY repo_dir, relative_path ORDER BY seq)),
  numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY repo_dir, relative_path ORDER BY seq) AS island FROM marked)
SELECT repo_dir, relative_path, min(snapshot_no) AS first_snapshot, max(snapshot_no) AS last_snapshot,
       any_value(sha256) AS sha256, any_value(chunks) AS chunks
FROM numbered GROUP BY repo_dir, relative_path, island""",
}

QUERIES = {"p2_found": p2_found, "p2_intervals": p2_intervals}
