"""References to records that do not exist: a sorted merge of references with the validity intervals of their targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Length of a time slice. A hot target is merged slice by slice, with what is alive at the start of a slice carried in.
SLICE_SECONDS = 7 * 24 * 3600


def normal_id(c: Column) -> Column:
    """``c`` without case and surrounding blanks of any kind; null if nothing is left."""
    bare = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(bare != "", bare)


def first_deliveries(relations: DataFrame) -> DataFrame:
    """One row per rel_key: that of its earliest received_at; equal times give the smallest row. Null keys are dropped."""
    row = F.struct("received_at", "article_id", "nodes")
    return (
        relations.where(F.col("rel_key").isNotNull() & F.col("received_at").isNotNull())
        .groupBy("rel_key")
        .agg(F.min(row).alias("first"))
        .select("rel_key", "first.received_at", "first.article_id", "first.nodes")
    )


def references(relations: DataFrame) -> DataFrame:
    """(rel_key, node_no, article_id, refid, ref, at): the references of each relation as first delivered.

    Null nodes keep their number. Null or blank refids are no references.
    """
    return (
        first_deliveries(relations)
        .select("rel_key", "article_id", F.col("received_at").alias("at"), F.posexplode("nodes").alias("node_no", "node"))
        .select("rel_key", "node_no", "article_id", F.col("node.refid").alias("refid"), normal_id(F.col("node.refid")).alias("ref"), "at")
        .where(F.col("ref").isNotNull())
    )


def targets(annotations: DataFrame, relations: DataFrame) -> DataFrame:
    """(article_id, ref, is_annotation, opened, closed): every delivery of a possible target with its validity interval."""
    parts = [
        t.select("article_id", normal_id(F.col("id")).alias("ref"), F.lit(flag).alias("is_annotation"), F.col("received_at").alias("opened"), F.col("deleted_at").alias("closed"))
        for t, flag in ((annotations, 1), (relations, 0))
    ]
    return parts[0].unionByName(parts[1]).where(F.col("ref").isNotNull() & F.col("opened").isNotNull() & F.col("article_id").isNotNull())


def orphan_references(annotations: DataFrame, relations: DataFrame) -> DataFrame:
    """References of ``relations`` that lead to no live record, one row (rel_key, node_no, article_id, refid, kind, reason, asked_at) each.

    A target lives in [received_at, deleted_at) of any of its deliveries; a reference is judged at the first delivery of
    its relation. ``reason``: 'missing' (no delivery at any time), 'late' (all deliveries come after the reference) or
    'deleted' (earlier deliveries ended before). ``kind``: the table that has the id at any time ('annotation' before
    'relation'), else 'unknown'. A reference in an article that is null has no target. Null or blank refids, null nodes
    and null node lists are no references; repeated rows and redeliveries change nothing; empty tables give no rows.

    Both streams are reduced to distinct moments per (article, id), co-partitioned by (article, id, time slice), sorted
    by time and merged by a running sum of openings and closings; slices of one id are linked by their totals, so that
    an id with a third of all rows is spread over its slices.
    """
    refs = references(relations)
    live = targets(annotations, relations)
    slice_of = F.floor(F.unix_timestamp("at") / SLICE_SECONDS)
    points = refs.select("article_id", "ref", "at").distinct()
    lasts = F.col("closed").isNull() | (F.col("closed") > F.col("opened"))
    begins = F.struct(F.col("opened").alias("at"), F.when(lasts, 1).otherwise(0).alias("delta"), F.lit(1).alias("opens"))
    ends = F.struct(F.col("closed").alias("at"), F.lit(-1).alias("delta"), F.lit(0).alias("opens"))
    # both moments of an interval come from one scan
    moments = (
        live.select("article_id", "ref", "is_annotation", F.explode(F.when(F.col("closed") > F.col("opened"), F.array(begins, ends)).otherwise(F.array(begins))).alias("m"))
        .select("article_id", "ref", "is_annotation", "m.at", "m.delta", "m.opens")
        .withColumn("asked", F.lit(0))
        .unionByName(points.select("article_id", "ref", F.lit(None).cast("int").alias("is_annotation"), "at", F.lit(0).alias("delta"), F.lit(0).alias("opens"), F.lit(1).alias("asked")))
        .groupBy("article_id", "ref", slice_of.alias("slice"), "at")
        .agg(F.sum("delta").alias("delta"), F.sum("opens").alias("opens"), F.max("asked").alias("asked"), F.max("is_annotation").alias("has_annotation"))
    )
    key = ["article_id", "ref"]
    by_slice = moments.groupBy(*key, "slice").agg(
        F.sum("delta").alias("delta"), F.sum("opens").alias("opens"), F.max("has_annotation").alias("has_annotation")
    )
    whole = Window.partitionBy(*key)
    before = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_slice.select(
        F.col("article_id").alias("c_article"),
        F.col("ref").alias("c_ref"),
        F.col("slice").alias("c_slice"),
        F.coalesce(F.sum("delta").over(before), F.lit(0)).alias("alive_before"),
        F.coalesce(F.sum("opens").over(before), F.lit(0)).alias("opened_before"),
        F.sum("opens").over(whole).alias("opened_ever"),
        F.max("has_annotation").over(whole).alias("annotation_ever"),
    )
    so_far = Window.partitionBy(*key, "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    judged = (
        moments.withColumn("alive", F.sum("delta").over(so_far))
        .withColumn("opened", F.sum("opens").over(so_far))
        .where("asked = 1")
        .join(carried, F.col("article_id").eqNullSafe(F.col("c_article")) & (F.col("ref") == F.col("c_ref")) & (F.col("slice") == F.col("c_slice")))
        .where(F.col("alive") + F.col("alive_before") <= 0)
        .select(
            F.col("article_id").alias("j_article"),
            F.col("ref").alias("j_ref"),
            F.col("at").alias("j_at"),
            F.when(F.col("opened_ever") == 0, "unknown").when(F.col("annotation_ever") == 1, "annotation").otherwise("relation").alias("kind"),
            F.when(F.col("opened_ever") == 0, "missing").when(F.col("opened") + F.col("opened_before") == 0, "late").otherwise("deleted").alias("reason"),
        )
    )
    return refs.join(judged, F.col("article_id").eqNullSafe(F.col("j_article")) & (F.col("ref") == F.col("j_ref")) & (F.col("at") == F.col("j_at"))).select(
        "rel_key", "node_no", "article_id", "refid", "kind", "reason", F.col("at").alias("asked_at")
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Number of orphans by kind of target, reason and month of the reference (UTC session)."""
    return orphans.groupBy("kind", "reason", F.date_format("asked_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
