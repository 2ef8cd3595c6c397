"""Formats of lines: one row per line, with all that orders and partitions them, before it is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossaflow.content import Content
from glossaflow.functions import text as T
from glossaflow.operators.recognize import token_spans
from glossaflow.schema import INFO

TSV_HEADER = ["DOCUMENT ID", "TYPE", "START POSITION", "END POSITION", "MATCHED TERM", "PREFERRED FORM", "ENTITY ID", "ZONE", "SENTENCE ID", "ORIGIN", "UMLS CUI"]
#: Tags for outside, inside, begin, end and single.
TAGSETS = {"IOBES": dict(zip("OIBES", "OIBES")), "IOB": dict(zip("OIBES", "OIBIB")), "IO": dict(zip("OIBES", "OIIII"))}
#: T.WORD_PUNCT in Python.
WORDS = r"\w+|[^\w\s]+"
_SENT = ["doc_id", "sec_id", "sent_id"]


def word_tokens(content: Content, pattern: str = T.WORD_PUNCT) -> DataFrame:
    """(doc_id, sec_id, sent_id, sent_no, tok_id, token, start, end) of all sentences."""
    regex = WORDS if pattern == T.WORD_PUNCT else pattern
    spans = token_spans(content.sentences.select(*_SENT, "sent_no", "text", "start"), start="start", pattern=regex)
    return spans.select(*_SENT, "sent_no", F.posexplode("tokens").alias("tok_id", "t")).select(*_SENT, "sent_no", "tok_id", "t.token", "t.start", "t.end")


def tsv(content: Content) -> DataFrame:
    """Entity rows in 11 columns, in order of sentence and place."""
    e = content.entities
    return e.select(
        "doc_id", "type", "start", "end", T.one_line(F.col("text")).alias("term"), "preferred_form", "native_id", F.coalesce("section_type", F.lit("")).alias("zone"),
        F.concat(F.lit("S"), F.col("sent_no").cast("string")).alias("sentence"), "original_resource", "umls_cui",
    )


def text_tsv(content: Content) -> DataFrame:
    """tsv with a sparse row for each token outside all entities of its sentence.

    Tokens and entities of a sentence are merged in order; a token is outside if it reaches beyond all ends of entities
    that begin before its end, or none does.
    """
    tokens = word_tokens(content)
    rows = content.entities.select(*_SENT, F.lit(0).alias("kind"), F.col("start").alias("at"), F.col("end").alias("reach")).unionByName(
        tokens.select(*_SENT, F.lit(1).alias("kind"), (F.col("end") - 1).alias("at"), F.lit(None).cast("int").alias("reach"), "sent_no", "token", "start", "end"), allowMissingColumns=True
    )
    reach = F.max("reach").over(Window.partitionBy(*_SENT).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    outside = rows.withColumn("reach", reach).where("kind = 1 and (reach is null or reach <= start)")
    none = F.lit("")
    sparse = outside.select(
        "doc_id", none.alias("type"), "start", "end", F.col("token").alias("term"), none.alias("preferred_form"), none.alias("native_id"), none.alias("zone"),
        F.concat(F.lit("S"), F.col("sent_no").cast("string")).alias("sentence"), none.alias("original_resource"), none.alias("umls_cui"),
    )
    return tsv(content).unionByName(sparse)


def _number(*order: str | Column, by: list[str] = ("doc_id",)) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def bionlp(content: Content) -> DataFrame:
    """(doc_id, t, line): stand-off lines T<n>, concept id, offsets and text."""
    e = content.entities.withColumn("t", _number("sent_no", "start", "end", F.col("id").cast("bigint"), "id"))
    return e.select("doc_id", "t", F.format_string("T%d\t%s %d %d\t%s", "t", F.coalesce("native_id", F.lit("")), "start", "end", T.one_line(F.col("text"))).alias("line"))


def brat_mentions(content: Content) -> DataFrame:
    """(doc_id, t, start, end, name, text, members): mentions with their text-bound number; members are the information of all their entities."""
    name = T.field_name(F.coalesce("type", F.lit("")))
    e = content.entities.select("doc_id", "start", "end", name.alias("name"), T.one_line(F.col("text")).alias("text"), F.struct("sent_no", "id", *INFO).alias("e"))
    grouped = e.groupBy("doc_id", "start", "end", "name", "text").agg(F.array_sort(F.collect_list("e")).alias("members"))
    return grouped.withColumn("t", _number("start", "end", "name", "text"))


def brat(content: Content, attributes: list[tuple[str, bool]] = ()) -> DataFrame:
    """(doc_id, t, n, part, line): T lines, each followed by its notes (part 0: the T line; 1: AnnotatorNotes; 2: attributes).

    ``attributes`` are (field, multi-valued) pairs; empty values give no line. Ids of each sort run through an article.
    """
    m = brat_mentions(content)
    spots = m.select("doc_id", "t", F.lit(0).alias("n"), F.lit(0).alias("part"), F.format_string("T%d\t%s %d %d\t%s", "t", "name", "start", "end", "text").alias("line"))
    each = m.select("doc_id", "t", F.explode("members").alias("e")).withColumn("n", _number("t", "e"))
    notes = each.select("doc_id", "t", "n", F.lit(1).alias("part"), F.format_string("#%d\tAnnotatorNotes T%d\t%s", "n", "t", F.concat_ws("\t", *[F.coalesce(F.col(f"e.{f}"), F.lit("")) for f in INFO[1:]])).alias("line"))
    out = spots.unionByName(notes)
    if attributes:
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("key"), F.lit(many).alias("many"), F.col(f"e.{f}").alias("value")) for i, (f, many) in enumerate(attributes)])
        lines = each.select("doc_id", "t", "n", F.explode(pairs).alias("a")).where("a.value <> ''").withColumn("k", _number("n", "a.i"))
        line = F.when(F.col("a.many"), F.format_string("A%d\t%s T%d %s", "k", "a.key", "t", "a.value")).otherwise(F.format_string("A%d\t%s T%d", "k", "a.value", "t"))
        out = out.unionByName(lines.select("doc_id", "t", "n", F.lit(2).alias("part"), line.alias("line")))
    return out


def conll(content: Content, tagset: str = "IOBES", pattern: str = T.WORD_PUNCT) -> DataFrame:
    """(doc_id, sec_id, sent_id, sent_no, tok_id, token, start, end, tag): each token with the tag of the concepts that overlap it.

    Concepts of a token are joined by semicolons in order of place. Neighbours with the same label belong together.
    Entities find the first and last of their tokens by counting tokens in two sorted passes over their sentence, so that
    only tokens within entities are paired with them.
    """
    tokens = word_tokens(content, pattern)
    e = content.entities.select(*_SENT, "start", "end", F.struct("start", "end", F.col("id").cast("bigint"), "id", F.coalesce("native_id", F.lit("")).alias("cid")).alias("e"))
    so_far = Window.partitionBy(*_SENT).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)

    def counted(entities: DataFrame, place: str, border: str, kind: int, name: str) -> DataFrame:
        """``entities`` with the number of tokens whose ``border`` lies before their ``place``, or at it if ``kind`` is 1."""
        spots = tokens.select(*_SENT, F.col(border).alias("at"), F.lit(1 - kind).alias("kind"), F.lit(1).alias("one"))
        own = entities.select("*", F.col(place).alias("at"), F.lit(kind).alias("kind"), F.lit(0).alias("one"))
        both = own.unionByName(spots, allowMissingColumns=True).withColumn(name, F.sum("one").over(so_far))
        return both.where(F.col("e").isNotNull()).drop("at", "kind", "one")

    ranged = counted(counted(e, "start", "end", 1, "i"), "end", "start", 0, "j").where("i < j")
    over = ranged.select(*_SENT, F.explode(F.sequence("i", F.col("j") - 1)).alias("tok_id"), "e")
    labels = over.groupBy(*_SENT, F.col("tok_id").cast("int").alias("tok_id")).agg(F.array_sort(F.collect_list("e")).alias("es")).select(*_SENT, "tok_id", F.array_join(F.transform("es", lambda x: x["cid"]), ";").alias("label"))
    order = Window.partitionBy(*_SENT).orderBy("tok_id")
    tagged = tokens.join(labels, [*_SENT, "tok_id"], "left").withColumn("label", F.coalesce("label", F.lit("")))
    tagged = tagged.withColumn("before", F.lag("label", 1, "").over(order)).withColumn("after", F.lead("label", 1, "").over(order))
    names = TAGSETS[tagset]
    same_before, same_after = F.col("before") == F.col("label"), F.col("label") == F.col("after")
    sort = F.when(same_before & same_after, names["I"]).when(same_before, names["E"]).when(same_after, names["B"]).otherwise(names["S"])
    tag = F.when(F.col("label") == "", names["O"]).otherwise(F.concat(sort, F.lit("-"), F.col("label")))
    return tagged.select(*_SENT, "sent_no", "tok_id", "token", "start", "end", tag.alias("tag"))


def becalm(content: Content, drop_database_id: bool = False) -> DataFrame:
    """(document_id, section, init, end, score, annotated_text, type, database_id), without the last with ``drop_database_id``."""
    out = content.entities.select(
        F.col("doc_id").alias("document_id"), F.when(F.lower("section_type") == "title", "T").otherwise("A").alias("section"), F.col("start").alias("init"), "end", F.lit(0.5).alias("score"),
        F.col("text").alias("annotated_text"), "type", F.col("native_id").alias("database_id"),
    )
    return out.drop("database_id") if drop_database_id else out


def pubtator(content: Content, fbk: bool = False) -> DataFrame:
    """(doc_id, part, sec_id, start, end, id, line): text lines (part 0) and annotation lines (part 1).

    Newlines within sections become blanks and final blanks go, which shifts what follows; offsets count from the first
    sentence.
    """
    flat = F.rtrim(F.translate("text", "\r\n", "  "))
    by_doc = Window.partitionBy("doc_id").orderBy("sec_id")
    secs = content.sections.withColumn("flat", flat).withColumn("delta", F.length("flat") + 1 - F.length("text"))
    secs = secs.withColumn("shift", F.coalesce(F.sum("delta").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.first("start").over(by_doc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    kind = F.when(F.coalesce("type", F.lit("")) == "", "x").otherwise(F.lower(F.substring("type", 1, 1)))
    none = F.lit(None).cast("int")
    texts = secs.select("doc_id", F.lit(0).alias("part"), "sec_id", none.alias("start"), none.alias("end"), F.lit("").alias("id"), F.concat_ws("|", "doc_id", kind, "flat").alias("line"))
    e = content.entities.join(secs.select("doc_id", "sec_id", "shift"), ["doc_id", "sec_id"]).withColumn("start", (F.col("start") + F.col("shift")).cast("int")).withColumn("end", (F.col("end") + F.col("shift")).cast("int"))
    surface, cid = T.one_line(F.col("text")), F.coalesce("native_id", F.lit(""))
    mark = F.when(F.col("id").rlike("^[0-9]+$"), F.concat(F.lit("T"), F.col("id"))).otherwise(F.col("id"))
    fields = ["doc_id", mark, "type", "start", "end", surface] if fbk else ["doc_id", "start", "end", surface, "type", cid]
    return texts.unionByName(e.select("doc_id", F.lit(1).alias("part"), "sec_id", "start", "end", "id", F.concat_ws("\t", *fields).alias("line")))


def colocated(content: Content) -> DataFrame:
    """(doc_id, sent_no, location, start, end, exact, section_type, type, tags): entities of one span and type as one, the spans of a sentence numbered from 1; tags are the distinct (name, uri), in order."""
    e = content.entities.withColumn("location", F.dense_rank().over(Window.partitionBy(*_SENT).orderBy("start", "end")))
    tags = F.array_sort(F.collect_set(F.struct(F.coalesce("preferred_form", F.lit("")).alias("name"), F.coalesce("native_id", F.lit("")).alias("uri")))).alias("tags")
    return e.groupBy("doc_id", "sent_no", "location", "start", "end", "section_type", "type").agg(F.min("text").alias("exact"), tags)


def odin_mentions(content: Content) -> DataFrame:
    """(doc_id, sec_id, sent_id, mention, start, end, allvalues, types): overlapping entities of a sentence lumped, with offsets from the section's start."""
    order = Window.partitionBy(*_SENT).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    e = content.entities.withColumn("new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)).withColumn("mention", F.sum("new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    value = F.concat_ws(":", F.coalesce("native_id", F.lit("")), "type", "text")
    lumped = e.groupBy(*_SENT, "mention").agg(
        F.min("start").alias("a"), F.max("end").alias("b"), F.array_sort(F.collect_list(F.struct("start", "end", F.col("id").cast("bigint").alias("n"), "id", value.alias("v")))).alias("es"), F.array_sort(F.collect_set("type")).alias("ts")
    )
    base = content.sections.select("doc_id", "sec_id", F.col("start").alias("base"))
    return lumped.join(base, ["doc_id", "sec_id"]).select(
        *_SENT, "mention", (F.col("a") - F.col("base")).alias("start"), (F.col("b") - F.col("base")).alias("end"), F.array_join(F.transform("es", lambda x: x["v"]), "|").alias("allvalues"), F.array_join("ts", "|").alias("types")
    )


def og_dict(content: Content) -> DataFrame:
    """(doc_id, cid, cname, type): the first entity of each concept of an article."""
    order = F.struct("sent_no", "start", "end", F.col("id").cast("bigint"), "id")
    return content.entities.groupBy("doc_id", F.coalesce("native_id", F.lit("")).alias("cid")).agg(F.min_by(F.struct("preferred_form", "type"), order).alias("x")).select("doc_id", "cid", F.col("x.preferred_form").alias("cname"), "x.type")


def by_priority(entities: DataFrame, priority: list[str]) -> DataFrame:
    """(doc_id, start, end, type): of each span the type that comes first in ``priority``, others after, by name."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("type")), F.lit(0)) if priority else F.lit(0)
    rank = F.when(rank == 0, len(priority) + 1).otherwise(rank)
    return entities.groupBy("doc_id", "start", "end").agg(F.min_by("type", F.struct(rank.alias("r"), "type")).alias("type"))


def plain_text(content: Content) -> DataFrame:
    """(doc_id, text): the text of each article, sections parted by as many newlines as their offsets leave room for."""
    by_doc = Window.partitionBy("doc_id").orderBy("sec_id")
    gap = F.greatest(F.col("start") - F.lag("end").over(by_doc), F.lit(0))
    padded = content.sections.withColumn("padded", F.concat(F.repeat(F.lit("\n"), F.coalesce(gap, F.lit(0))), "text"))
    return padded.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sec_id", "padded"))).alias("s")).select("doc_id", F.array_join(F.transform("s", lambda x: x["padded"]), "").alias("text"))
