"""Queries of the general problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossaflow.operators import orphans, shredding
from glossaflow.session import read


def p2_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_references(read(spark, sf_dir, "annotations"), read(spark, sf_dir, "relations"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_orphans(spark, sf_dir).select("rel_key", "node_no")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(p2_orphans(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    adjacent = shredding.adjacency(read(spark, sf_dir, "bioc_raw"))
    return shredding.links(adjacent, ["annotation", "node"], infons_of="passage")


def p5_table(entity: str):
    def table(spark: SparkSession, sf_dir: str) -> DataFrame:
        adjacent = shredding.adjacency(read(spark, sf_dir, "bioc_raw"))
        return shredding.infon_table(adjacent) if entity == "infon" else shredding.entity_table(adjacent, entity)

    return table


QUERIES = {"p2_found": p2_found, "p2_orphans": p2_orphans, "p2_report": p2_report, "p5_found": p5_found} | {f"p5_{e}s": p5_table(e) for e in [*shredding.FIELDS, "infon"]}

_P2 = r"""
WITH refs AS (
  SELECT rel_key, node_no, article_id, node.refid AS refid, lower(regexp_replace(node.refid, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS ref, asked_at FROM (
    SELECT rel_key, article_id, asked_at, unnest(nodes) AS node, generate_subscripts(nodes, 1) - 1 AS node_no FROM (
      SELECT rel_key, article_id, received_at AS asked_at, nodes, row_number() OVER (PARTITION BY rel_key ORDER BY received_at, article_id) AS k FROM relations) WHERE k = 1)
), targets AS (
  SELECT article_id, lower(regexp_replace(id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS ref, 1 AS a, received_at, deleted_at FROM annotations
  UNION ALL SELECT article_id, lower(regexp_replace(id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), 0, received_at, deleted_at FROM relations
), judged AS (
  SELECT r.rel_key, r.node_no, r.article_id, r.refid, r.asked_at, count(t.ref) AS n, max(t.a) AS a,
    count(*) FILTER (WHERE t.received_at <= r.asked_at) AS before_it, count(*) FILTER (WHERE t.received_at <= r.asked_at AND (t.deleted_at IS NULL OR t.deleted_at > r.asked_at)) AS alive
  FROM refs r LEFT JOIN targets t ON t.article_id = r.article_id AND t.ref = r.ref WHERE r.ref <> '' GROUP BY ALL
), orphans AS (
  SELECT rel_key, CAST(node_no AS INTEGER) AS node_no, article_id, refid, CASE WHEN n = 0 THEN 'unknown' WHEN a = 1 THEN 'annotation' ELSE 'relation' END AS kind,
    CASE WHEN n = 0 THEN 'missing' WHEN before_it = 0 THEN 'late' ELSE 'deleted' END AS reason, asked_at FROM judged WHERE alive = 0)
"""
ORACLE = {
    "p2_found": _P2 + "SELECT rel_key, node_no FROM orphans",
    "p2_orphans": _P2 + "SELECT rel_key, node_no, article_id, refid, kind, reason, asked_at FROM orphans",
    "p2_report": _P2 + "SELECT kind, reason, strftime(asked_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n FROM orphans GROUP BY ALL",
}
