"""Annotated articles as a set of tables, and how raw texts become one."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossaflow.functions import segments
from glossaflow.functions import text as T
from glossaflow.operators import recognize
from glossaflow.schema import INFO


@dataclass(frozen=True)
class Content:
    """sections (doc_id, sec_id, type, text, start, end), sentences (doc_id, sec_id, sent_id, sent_no, type, text, start, end) and entities (doc_id, sec_id, sent_id, sent_no, section_type, id, text, start, end, info fields).

    ``type`` of a sentence is that of its section; sent_id counts within the section from 0, sent_no within the article from 1.
    """

    sections: DataFrame
    sentences: DataFrame
    entities: DataFrame | None = None

    def with_entities(self, entities: DataFrame) -> Content:
        return replace(self, entities=entities)


def union(a: Content, b: Content) -> Content:
    """The articles of two contents. Entities of either stay."""
    entities = a.entities if b.entities is None else b.entities if a.entities is None else a.entities.unionByName(b.entities)
    return Content(a.sections.unionByName(b.sections, allowMissingColumns=True), a.sentences.unionByName(b.sentences), entities)


def numbered(sentences: DataFrame) -> DataFrame:
    """``sentences`` with sent_no, from 1 within each article."""
    return sentences.withColumn("sent_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("sec_id", "sent_id")))


def from_sections(sections: DataFrame, given: bool = False) -> Content:
    """The content of sections (doc_id, sec_id, type, text, start), cut into sentences by rule, or at line ends where these are given."""
    whole = sections.withColumn("start", F.coalesce("start", F.lit(0))).withColumn("end", F.col("start") + F.length("text"))
    cut = segments.given_lines if given else segments.sentences
    parts = segments.explode_parts(whole.select("doc_id", "sec_id", "type", "text", "start"), cut(F.col("text")), "sent_id", "start")
    return Content(whole, numbered(parts))


def from_texts(texts: DataFrame, doc_id: str = "doc_id", text: str = "text", single: bool = False) -> Content:
    """The content of plain texts, sections parted by blank lines."""
    plain = texts.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    parts = segments.explode_parts(plain, segments.sections(F.col("text"), single), "sec_id")
    return from_sections(parts.select("doc_id", "sec_id", F.lit("").alias("type"), "text", "start"))


def annotate(content: Content, index: DataFrame, normalisers: str = "lowercase", pattern: str = T.TOKEN, keep: bool = True) -> Content:
    """``content`` with the entities of a dictionary added to those it has; ids go on from the greatest numeric one."""
    keys = ["doc_id", "sec_id", "sent_id", "sent_no", "section_type"]
    placed = recognize.recognise(content.sentences.withColumnRenamed("type", "section_type"), index, keys, start="start", normalisers=normalisers, pattern=pattern)
    old = content.entities if keep else None
    named = recognize.with_ids(placed, ["doc_id"], ["sent_no", "start", "end", "recognizer", *INFO], old)
    columns = [*keys, "id", "text", "start", "end", *INFO]
    new = named.select(*columns)
    return content.with_entities(new if old is None else old.select(*columns).unionByName(new))


def assign_to_sentences(annotations: DataFrame, sentences: DataFrame) -> DataFrame:
    """``annotations`` (doc_id, start, ...) with the sentence that holds their start; those outside all sentences are left out.

    Starts of sentences and annotations of an article are merged in order, so that no pair is built: each annotation
    takes the last sentence begun at or before it, if it ends later.
    """
    begun = F.last(F.col("__sent"), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0))
    events = (
        sentences.select("doc_id", F.col("start").alias("__at"), F.lit(0).alias("__kind"), F.struct("sec_id", "sent_id", "sent_no", F.col("type").alias("section_type"), F.col("end").alias("__end")).alias("__sent"))
        .unionByName(annotations.select("doc_id", F.col("start").alias("__at"), F.lit(1).alias("__kind"), F.struct(*[c for c in annotations.columns if c != "doc_id"]).alias("__anno")), allowMissingColumns=True)
        .withColumn("__sent", begun)
    )
    return events.where("__kind = 1 and __at < __sent.__end").select("doc_id", "__anno.*", "__sent.sec_id", "__sent.sent_id", "__sent.sent_no", "__sent.section_type")
