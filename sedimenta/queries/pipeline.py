"""Queries p1 and p6."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import hierarchy as H
from sedimenta.operators import incremental as I
from sedimenta.plans.workspace import shared_dir


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return H.code_hierarchies(_t(spark, d, "edges"), _t(spark, d, "flow_nodes"))


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every node with its path; nodes on or below a cycle have none."""
    full = H.code_hierarchies(_t(spark, d, "edges"), _t(spark, d, "flow_nodes"), with_path=True)
    return full.select("graph", "project", "node", F.array_join("path", " > ").alias("path"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a node and a descendant."""
    full = H.code_hierarchies(_t(spark, d, "edges"), _t(spark, d, "flow_nodes"), with_path=True)
    keyed = full.withColumn("node", F.struct("graph", "project", "node")).withColumn(
        "path", F.transform("path", lambda x: F.struct(F.col("graph"), F.col("project"), x.alias("node")))
    )
    return H.descendants(keyed).select("node.graph", "node.project", F.col("ancestor.node").alias("ancestor"), F.col("node.node").alias("node"), "distance")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Two refreshes of the table kept for this folder: with what was there when the newest run began, then with everything. The second,
    like that of a later call, recomputes only the partitions with changes since."""
    changes, hashes, runs = (_t(spark, d, n) for n in ("file_changes", "file_hashes", "index_runs"))
    table = I.IncrementalTable(spark, f"{shared_dir(spark)}/pending-{hashlib.sha256(d.encode()).hexdigest()[:16]}")
    newest = runs.agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"), F.max("started_at").alias("began")).first()
    if newest.run_id is not None and newest.began is not None:
        I.refresh_pending(table, changes.where(F.col("ts") < F.lit(newest.began)), hashes.where(F.col("run_id") != newest.run_id), runs.where(F.col("run_id") != newest.run_id))
    return I.refresh_pending(table, changes, hashes, runs).select("project", "rel_path", "action")


def p6_projects(spark: SparkSession, d: str) -> DataFrame:
    """Per project the pending files by action, beside what project_meta says; its status may be out of date."""
    pending = p6_found(spark, d).groupBy("project").agg(
        *(F.count(F.when(F.col("action") == a, 1)).alias(a) for a in ("added", "removed", "updated"))
    )
    meta = _t(spark, d, "project_meta").where("collection_name like 'codebase%' and project is not null").groupBy("project").agg(
        F.max_by("indexing_status", F.struct("last_indexed_at", "point_id")).alias("status"), F.date_format(F.max("last_indexed_at"), "yyyy-MM-dd HH:mm:ss").alias("last_indexed_at")
    )
    zero = {a: F.coalesce(a, F.lit(0)) for a in ("added", "removed", "updated")}
    return pending.join(meta, "project", "full_outer").withColumns(zero)


_HIERARCHY = r"""
links0 AS (
  SELECT DISTINCT 'edges' AS graph, project, regexp_replace(replace(dst, '\', '/'), '^(\./)+', '') AS child,
         regexp_replace(replace(src, '\', '/'), '^(\./)+', '') AS parent
  FROM edges WHERE type = 're-export' AND dst IS NOT NULL
), flow AS (SELECT node_id, min(project) AS project FROM flow_nodes GROUP BY node_id
), kids AS (SELECT DISTINCT node_id AS parent, unnest(children) AS child FROM flow_nodes
), links AS (
  SELECT * FROM links0
  UNION ALL
  SELECT 'flow_nodes', p.project, CAST(k.child AS VARCHAR), CAST(k.parent AS VARCHAR)
  FROM kids k JOIN flow c ON c.node_id = k.child JOIN flow p ON p.node_id = k.parent
), nodes AS (
  SELECT graph, project, child AS node FROM links UNION SELECT graph, project, parent FROM links
  UNION SELECT 'flow_nodes', project, CAST(node_id AS VARCHAR) FROM flow
), tree AS (
  SELECT graph, project, node, node AS root, 0 AS depth, node AS path FROM nodes n
  WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.graph = n.graph AND l.project = n.project AND l.child = n.node)
  UNION ALL
  SELECT l.graph, l.project, l.child, t.root, t.depth + 1, t.path || ' > ' || l.child
  FROM tree t JOIN links l ON l.graph = t.graph AND l.project = t.project AND l.parent = t.node
), lost AS (
  SELECT n.* FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.graph = n.graph AND t.project = n.project AND t.node = n.node)
), walk AS (
  SELECT l.graph, l.project, l.node AS start, k.parent AS cur FROM lost l JOIN links k ON k.graph = l.graph AND k.project = l.project AND k.child = l.node
  UNION
  SELECT w.graph, w.project, w.start, k.parent FROM walk w JOIN links k ON k.graph = w.graph AND k.project = w.project AND k.child = w.cur
), pairs AS (
  SELECT graph, project, parent AS ancestor, child AS node, 1 AS distance FROM links l
  WHERE EXISTS (SELECT 1 FROM tree t WHERE t.graph = l.graph AND t.project = l.project AND t.node = l.child)
  UNION ALL
  SELECT p.graph, p.project, p.ancestor, l.child, p.distance + 1
  FROM pairs p JOIN links l ON l.graph = p.graph AND l.project = p.project AND l.parent = p.node
)
"""

_PENDING = """
now0 AS (
  SELECT project, rel_path, CASE WHEN kind <> 'delete' THEN content_hash END AS hash,
         row_number() OVER (PARTITION BY project, rel_path ORDER BY ts DESC, change_id DESC) AS rn FROM file_changes
), reached AS (SELECT run_id, max(coalesce(batches_processed, 0)) AS reached FROM index_runs GROUP BY run_id
), then0 AS (
  SELECT project, rel_path, content_hash AS hash, row_number() OVER (PARTITION BY project, rel_path ORDER BY h.run_id DESC, batch_no DESC, content_hash DESC) AS rn
  FROM file_hashes h LEFT JOIN reached r ON r.run_id = h.run_id WHERE batch_no <= coalesce(reached, 0)
), pending AS (
  SELECT coalesce(a.project, b.project) AS project, coalesce(a.rel_path, b.rel_path) AS rel_path,
         CASE WHEN b.hash IS NULL THEN 'added' WHEN a.hash IS NULL THEN 'removed' ELSE 'updated' END AS action
  FROM (SELECT * FROM now0 WHERE rn = 1) a FULL OUTER JOIN (SELECT * FROM then0 WHERE rn = 1) b
    ON a.project = b.project AND a.rel_path = b.rel_path
  WHERE a.hash IS DISTINCT FROM b.hash
)
"""

QUERIES = {"p1_found": p1_found, "p1_paths": p1_paths, "p1_descendants": p1_descendants, "p6_found": p6_found, "p6_projects": p6_projects}

SQL = {
    "p1_found": f"""WITH RECURSIVE {_HIERARCHY}
        SELECT graph, project, node, root, depth FROM tree
        UNION ALL
        SELECT l.graph, l.project, l.node, '', CASE WHEN EXISTS (SELECT 1 FROM walk w WHERE w.graph = l.graph AND w.project = l.project AND w.start = l.node AND w.cur = l.node)
            THEN -1 ELSE -2 END FROM lost l""",
    "p1_paths": f"""WITH RECURSIVE {_HIERARCHY}
        SELECT graph, project, node, path FROM tree UNION ALL SELECT graph, project, node, NULL FROM lost""",
    "p1_descendants": f"WITH RECURSIVE {_HIERARCHY} SELECT graph, project, ancestor, node, distance FROM pairs",
    "p6_found": f"WITH {_PENDING} SELECT project, rel_path, action FROM pending",
    "p6_projects": f"""WITH {_PENDING},
        p AS (SELECT project, count(*) FILTER (action = 'added') AS added, count(*) FILTER (action = 'removed') AS removed,
                     count(*) FILTER (action = 'updated') AS updated FROM pending GROUP BY project),
        m AS (SELECT project, arg_max_null(indexing_status, (last_indexed_at, point_id)) AS status, strftime(max(last_indexed_at), '%Y-%m-%d %H:%M:%S') AS last_indexed_at
              FROM project_meta WHERE collection_name LIKE 'codebase%' AND project IS NOT NULL GROUP BY project)
        SELECT coalesce(p.project, m.project) AS project, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed,
               coalesce(updated, 0) AS updated, status, last_indexed_at FROM p FULL OUTER JOIN m ON p.project = m.project""",
}
