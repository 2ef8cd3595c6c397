"""Readers of annotated-text files. All give sections, most also entities; parsing runs where the files lie."""

from __future__ import annotations

import csv
import gzip
import io
import os
import tarfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from glossaflow.functions import segments
from glossaflow.operators import shredding
from glossaflow.schema import INFO, UNKNOWN

SECTION_ROWS = "doc_id string, sec_id int, type string, text string, start int"
ENTITY_ROWS = "doc_id string, id string, text string, start int, end int, " + ", ".join(f"{f} string" for f in INFO)


def stem(path: Column) -> Column:
    """The name of a file without folder and extension."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def read_txt(spark: SparkSession, path: str, single: bool = False) -> DataFrame:
    """Sections of plain-text files, one article each; the id is the file's stem."""
    files = spark.read.text(path, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("text"))
    return _plain(files, single)


def _plain(texts: DataFrame, single: bool = False) -> DataFrame:
    parts = segments.explode_parts(texts.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), segments.sections(F.col("text"), single), "sec_id")
    return parts.select("doc_id", "sec_id", F.lit("").alias("type"), "text", "start")


def read_txt_json(spark: SparkSession, path: str, single: bool = False) -> DataFrame:
    """Sections of JSON arrays of {id, text}."""
    rows = spark.read.schema("id string, text string").json(path, multiLine=True)
    return _plain(rows.select(F.col("id").alias("doc_id"), "text"), single)


def from_txt_json(bodies: DataFrame, single: bool = False) -> DataFrame:
    """read_txt_json() of rows (body)."""
    items = bodies.select(F.explode(F.from_json("body", "array<struct<id:string,text:string>>")).alias("x"))
    return _plain(items.select(F.col("x.id").alias("doc_id"), "x.text"), single)


def read_txt_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Sections of tab-separated files of id and text with a header; each text is one section."""
    rows = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', multiLine=True, schema="doc_id string, text string", enforceSchema=True)
    return _plain(rows, True)


#: What broken files raise.
BROKEN = (ET.ParseError, tarfile.TarError, OSError, EOFError, zlib.error, UnicodeDecodeError, ValueError, KeyError, TypeError, AttributeError)


def contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files, as bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _parsed(files: DataFrame, parse, schema: str, skip_broken: bool = False) -> DataFrame:
    """Rows that ``parse`` (path, bytes) gives for each of some files (path, content). A broken file gives none with ``skip_broken``, else it raises."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            for p, data in zip(b["path"], b["content"]):
                data = bytes(data)
                try:
                    rows = list(parse(p, gzip.decompress(data) if data[:2] == b"\x1f\x8b" and not p.endswith((".tar.gz", ".tgz")) else data))
                except BROKEN:
                    if not skip_broken:
                        raise
                    continue
                yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def read_txt_tar(spark: SparkSession, path: str, single: bool = False, skip_broken: bool = False) -> DataFrame:
    """Sections of the regular members of tar archives, compressed or not; the id is the member's stem."""
    return from_txt_tar(contents(spark, path), single, skip_broken)


def from_txt_tar(archives: DataFrame, single: bool = False, skip_broken: bool = False) -> DataFrame:
    """read_txt_tar() of rows (path, content)."""

    def members(_: str, data: bytes) -> Iterator[tuple]:
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            for m in tar:
                if m.isreg():
                    yield os.path.splitext(os.path.basename(m.name))[0], tar.extractfile(m).read().decode("utf-8")

    return _plain(_parsed(archives, members, "doc_id string, text string", skip_broken), single)


def read_bioc_json(spark: SparkSession, path: str, byte_offsets: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sections, entities) of BioC collections or documents in JSON. An annotation with several locations gives an entity for each."""
    raw = spark.read.text(path, wholetext=True).select(F.xxhash64("_metadata.file_path").alias("rec_id"), F.col("value").alias("body"))
    return from_adjacency(shredding.adjacency(raw), byte_offsets)


def code_point_places(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (keys, sec_id, text, start, spots) with start and spots, arrays of (start, end) in bytes of the article from 0, in code points.

    One pass over each article's sections in order: a place beyond the text of its section counts on from the section's
    end, one within a character from its begin.
    """
    out = StructType([*[rows.schema[c] for c in rows.columns]])

    def convert(article: pd.DataFrame) -> pd.DataFrame:
        article, shift = article.sort_values("start"), 0
        starts, spots = [], []
        for text, start, marks in zip(article["text"], article["start"], article["spots"]):
            raw = text.encode()
            # bytes that continue a character, up to each byte
            more = np.concatenate(([0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) == 0x80)))
            place = lambda b, more=more, start=start, shift=shift, n=len(raw): int(b - shift - (more[min(max(b - start, 0), n)]))
            starts.append(start - shift)
            spots.append([{"n": m["n"], "start": place(m["start"]), "end": place(m["end"])} for m in marks])
            shift += int(more[-1])
        return article.assign(start=starts, spots=spots)

    return rows.groupBy(*keys).applyInPandas(convert, out)


def from_adjacency(adjacent: DataFrame, byte_offsets: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sections, entities) of shredded BioC bodies. A passage without text gives its sentences, each at its offset. With ``byte_offsets`` the offsets of the bodies count bytes."""
    top = lambda c, n: F.regexp_extract(c, f"^((?:[a-z]\\d+/?){{{n}}})", 1)
    docs = shredding.entity_table(adjacent, "document").select("rec_id", F.col("path").alias("doc_path"), F.coalesce("id", F.lit(UNKNOWN)).alias("doc_id"))
    kinds = shredding.infon_table(adjacent).where("infon_key = 'type'").select("rec_id", F.col("parent_path").alias("path"), F.col("infon_value").alias("type"))
    passages = shredding.entity_table(adjacent, "passage").join(kinds, ["rec_id", "path"], "left").withColumnRenamed("parent_path", "doc_path")
    sentences = shredding.entity_table(adjacent, "sentence").select("rec_id", F.col("parent_path").alias("path"), F.col("ordinal").alias("k"), F.col("offset").cast("int").alias("s_start"), F.coalesce("text", F.lit("")).alias("s_text"))
    given = sentences.groupBy("rec_id", "path").agg(F.array_sort(F.collect_list(F.struct("s_start", "k", "s_text"))).alias("ss"))
    p = passages.join(given, ["rec_id", "path"], "left").withColumn("begin", F.coalesce(F.when(F.coalesce("text", F.lit("")) == "", F.col("ss")[0]["s_start"]), F.col("offset").cast("int"), F.lit(0)))
    joined = F.aggregate(
        "ss", F.lit(""), lambda a, s: F.concat(a, F.repeat(F.lit(" "), F.greatest(s["s_start"] - F.col("begin") - F.length(a), F.lit(0))), s["s_text"])
    )
    text = F.when((F.coalesce("text", F.lit("")) == "") & F.col("ss").isNotNull(), joined).otherwise(F.coalesce("text", F.lit("")))
    placed = p.join(docs, ["rec_id", "doc_path"]).select("rec_id", "path", "doc_path", "doc_id", F.col("ordinal").alias("sec_id"), "type", text.alias("text"), F.col("begin").alias("start"))
    sections = placed.select("doc_id", "sec_id", "type", "text", "start")
    info = shredding.infon_table(adjacent).where(F.col("infon_key").isin(INFO)).groupBy("rec_id", F.col("parent_path").alias("path")).agg(*[F.max(F.when(F.col("infon_key") == f, F.col("infon_value"))).alias(f) for f in INFO])
    spots = shredding.entity_table(adjacent, "location").select("rec_id", F.col("parent_path").alias("path"), F.col("offset").cast("int").alias("start"), F.col("length").cast("int").alias("n"))
    annos = shredding.entity_table(adjacent, "annotation").select("rec_id", "path", "id", "text", top(F.col("path"), 1).alias("doc_path")).withColumn("doc_path", F.regexp_extract("path", "^(d\\d+)", 1))
    entities = annos.join(spots, ["rec_id", "path"]).join(info, ["rec_id", "path"], "left").join(docs, ["rec_id", "doc_path"])
    entities = entities.withColumn("end", F.col("start") + F.col("n"))
    if byte_offsets:
        numbered = entities.withColumn("n", F.row_number().over(Window.partitionBy("rec_id", "doc_path").orderBy("path", "start", "end")))
        within = F.regexp_extract("path", r"^(d\d+/p\d+)", 1)
        marks = numbered.groupBy("rec_id", within.alias("path")).agg(F.collect_list(F.struct("n", "start", "end")).alias("spots"))
        none = F.array().cast("array<struct<n:int,start:int,end:int>>")
        both = placed.join(marks, ["rec_id", "path"], "left").withColumn("spots", F.coalesce("spots", none))
        moved = code_point_places(both, ["rec_id", "doc_path"])
        sections = moved.select("doc_id", "sec_id", "type", "text", "start")
        entities = numbered.drop("start", "end").join(moved.select("rec_id", "doc_path", F.explode("spots").alias("s")).select("rec_id", "doc_path", "s.*"), ["rec_id", "doc_path", "n"])
    return sections, entities.select("doc_id", "id", "text", "start", "end", *[F.coalesce(f, F.lit(UNKNOWN)).alias(f) for f in INFO])


def _bioc_xml(data: bytes) -> Iterator[dict]:
    """BioC documents of an XML file in the shape of BioC JSON."""

    def infons(n):
        return {i.get("key"): i.text for i in n.findall("infon")}

    def annotations(n):
        return [
            {"id": a.get("id"), "text": a.findtext("text"), "infons": infons(a), "locations": [{"offset": int(x.get("offset")), "length": int(x.get("length"))} for x in a.findall("location")]}
            for a in n.findall("annotation")
        ]

    def passage(n):
        out = {"offset": int(n.findtext("offset") or 0), "infons": infons(n), "annotations": annotations(n)}
        if (text := n.find("text")) is not None:
            out["text"] = text.text or ""
        out["sentences"] = [passage(s) for s in n.findall("sentence")]
        return out

    for _, d in ET.iterparse(io.BytesIO(data)):
        if d.tag == "document":
            yield {"id": d.findtext("id"), "infons": infons(d), "passages": [passage(p) for p in d.findall("passage")]}
            d.clear()


def read_bioc_xml(spark: SparkSession, path: str, skip_broken: bool = False, byte_offsets: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sections, entities) of BioC XML, plain or gzipped."""
    return from_bioc_xml(contents(spark, path), skip_broken, byte_offsets)


def from_bioc_xml(files: DataFrame, skip_broken: bool = False, byte_offsets: bool = False) -> tuple[DataFrame, DataFrame]:
    """read_bioc_xml() of rows (path, content)."""
    import hashlib
    import json

    def parse(p: str, data: bytes) -> Iterator[tuple]:
        for k, d in enumerate(_bioc_xml(data)):
            yield int.from_bytes(hashlib.blake2b(f"{k} {p}".encode(), digest_size=8).digest(), signed=True), json.dumps(d)

    return from_adjacency(shredding.adjacency(_parsed(files, parse, "rec_id bigint, body string", skip_broken)), byte_offsets)


def pubtator_blocks(lines: DataFrame) -> DataFrame:
    """(block, doc_id, kind, fields, n) of the lines of PubTator texts (source, text): blocks are parted by blank lines, kind is 't', 'a', ... or 'anno'."""
    blocks = lines.select("source", F.posexplode(F.filter(F.split(F.regexp_replace("text", r"\r", ""), r"\n[^\S\n]*(?:\n[^\S\n]*)+"), lambda b: F.trim(b) != "")).alias("k", "block"))
    rows = blocks.select("source", "k", F.posexplode(F.filter(F.split("block", "\n"), lambda x: F.trim(x) != "")).alias("n", "line"))
    head = F.regexp_extract("line", r"^([^|\t]+)\|([^|]*)\|(.*)$", 1)
    is_text = F.col("line").rlike(r"^[^|\t]+\|[^|]*\|")
    return rows.select(
        "source", "k", "n", F.when(is_text, head).otherwise(F.split("line", "\t")[0]).alias("doc_id"), F.when(is_text, F.regexp_extract("line", r"^([^|\t]+)\|([^|]*)\|", 2)).otherwise("anno").alias("kind"),
        F.when(is_text, F.array(F.regexp_extract("line", r"^[^|\t]+\|[^|]*\|(.*)$", 1))).otherwise(F.split("line", "\t")).alias("fields"),
    )


def from_pubtator(lines: DataFrame, fbk: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sections, entities) of PubTator texts (source, text). Relation lines, of three fields after the id, are left out. Without ids of their own, entities are numbered per article."""
    rows = pubtator_blocks(lines)
    order = Window.partitionBy("source", "k").orderBy("n")
    names = F.when(F.col("kind") == "t", "Title").when(F.col("kind") == "a", "Abstract")
    secs = rows.where("kind <> 'anno'").withColumn("text", F.concat(F.col("fields")[0], F.lit("\n")))
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sections = secs.select("doc_id", (F.row_number().over(order) - 1).alias("sec_id"), names.alias("type"), "text", before.cast("int").alias("start"))
    f = F.col("fields")
    if fbk:
        anno = rows.where("kind = 'anno' and size(fields) = 6").select("doc_id", F.regexp_replace(f[1], "^T+", "").alias("id"), f[5].alias("text"), f[3].cast("int").alias("start"), f[4].cast("int").alias("end"), f[2].alias("type"), F.lit(UNKNOWN).alias("native_id"))
    else:
        anno = rows.where("kind = 'anno' and size(fields) = 6").select("doc_id", F.row_number().over(order).cast("string").alias("id"), f[3].alias("text"), f[1].cast("int").alias("start"), f[2].cast("int").alias("end"), f[4].alias("type"), f[5].alias("native_id"))
    return sections, anno.select("doc_id", "id", "text", "start", "end", *[F.col(c) if c in ("type", "native_id") else F.lit(UNKNOWN).alias(c) for c in INFO])


def read_pubtator(spark: SparkSession, path: str, fbk: bool = False) -> tuple[DataFrame, DataFrame]:
    return from_pubtator(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text")), fbk)


def fix_tags(tokens: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``tokens`` (tag) with valid IOB tags in iob and label: B after outside, another label, B or S; else I; O has no label."""
    outside = F.col("tag").isin("O", "O-NIL")
    rows = tokens.withColumn("label", F.when(~outside, F.regexp_extract("tag", "^[^-]*-(.*)$", 1)))
    before = F.lag("label").over(Window.partitionBy(*by).orderBy(*order))
    begins = F.substring("tag", 1, 1).isin("B", "S") | before.isNull() | (before != F.col("label"))
    return rows.withColumn("iob", F.when(outside, "O").when(begins, "B").otherwise("I"))


def from_conll(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections, sentences, entities) of numbered lines (source, n, line) of token, start, end, tag.

    '# doc_id = X' begins an article, a blank line ends a sentence; the first sentence is the title, the rest the body. A
    token whose length differs from its offsets raises.
    """
    order = Window.partitionBy("source").orderBy("n")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    named = F.regexp_extract("line", r"^#\s*doc_id\s*=\s*(.*)$", 1)
    is_head = F.col("line").rlike(r"^#\s*doc_id\s*=")
    blank = F.trim("line") == ""
    marked = rows.withColumn("doc_id", F.coalesce(F.last(F.when(is_head, named), ignorenulls=True).over(upto), F.lit(UNKNOWN))).withColumn("cut", F.sum(F.when(is_head | blank, 1).otherwise(0)).over(upto))
    f = F.split("line", "\t")
    tok = marked.where(~is_head & ~blank).select("source", "n", "doc_id", "cut", f[0].alias("token"), f[1].cast("int").alias("start"), f[2].cast("int").alias("end"), f[3].alias("tag"))
    fits = F.when(F.length("token") == F.col("end") - F.col("start"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("length mismatch: "), "token")).cast("boolean"))
    tok = fix_tags(tok.where(fits), ["source", "doc_id", "cut"], ["n"])
    line = F.aggregate(
        F.array_sort(F.collect_list(F.struct("start", "end", "token"))), F.struct(F.lit("").alias("t"), F.lit(None).cast("int").alias("e")),
        lambda a, x: F.struct(F.concat(a["t"], F.repeat(F.lit(" "), F.greatest(x["start"] - F.coalesce(a["e"], x["start"]), F.lit(0))), x["token"]).alias("t"), x["end"].alias("e")),
    )["t"]
    sents = tok.groupBy("source", "doc_id", "cut").agg(line.alias("text"), F.min("start").alias("start"), F.max("end").alias("end"))
    sents = sents.withColumn("sent_no", F.row_number().over(Window.partitionBy("source", "doc_id").orderBy("cut")))
    sents = sents.withColumn("sec_id", F.when(F.col("sent_no") == 1, 0).otherwise(1)).withColumn("type", F.when(F.col("sec_id") == 0, "title").otherwise("body")).withColumn("sent_id", F.when(F.col("sec_id") == 0, 0).otherwise(F.col("sent_no") - 2))
    runs = tok.withColumn("run", F.sum(F.when(F.col("iob") == "B", 1).otherwise(0)).over(Window.partitionBy("source", "doc_id", "cut").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))).where("iob <> 'O'")
    spans = runs.groupBy("source", "doc_id", "cut", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("label").alias("native_id"))
    e = spans.join(sents.select("source", "doc_id", "cut", F.col("text").alias("sent"), F.col("start").alias("base")), ["source", "doc_id", "cut"])
    e = e.withColumn("text", F.substring("sent", F.col("start") - F.col("base") + 1, F.col("end") - F.col("start"))).withColumn("id", F.row_number().over(Window.partitionBy("source").orderBy("cut", "start")).cast("string"))
    entities = e.select("doc_id", "id", "text", "start", "end", *[F.col(c) if c == "native_id" else F.lit(UNKNOWN).alias(c) for c in INFO])
    sentences = sents.select("doc_id", "sec_id", "sent_id", "sent_no", "type", "text", "start", "end")
    sections = sents.groupBy("doc_id", "sec_id", "type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_no", "text"))), lambda x: x["text"]), " ").alias("text"), F.min("start").alias("start"), F.max("end").alias("end"))
    return sections, sentences, entities


def read_conll(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    return from_conll(whole)


def _itertext(node: ET.Element | None) -> str:
    return "" if node is None else "".join(node.itertext())


def _medline(data: bytes, single: bool, mesh: bool) -> Iterator[tuple[str, str | None, str | None, list[tuple[str, str]], list[tuple[str, str]]]]:
    """(PMID, year, type, sections, MeSH headings) of each citation."""
    for _, node in ET.iterparse(io.BytesIO(data)):
        if node.tag != "MedlineCitation":
            continue
        sections = [("Title", _itertext(node.find(".//ArticleTitle")) + "\n")]
        parts = [(part.get("Label") or parent.tag, text) for parent in node.iter() for part in parent.findall("AbstractText") if (text := _itertext(part))]
        names = [(d.text, d.get("UI", UNKNOWN)) for d in node.findall(".//MeshHeading/DescriptorName") if d.text] if mesh else []
        if single:
            body = "".join(("" if label in ("UNLABELLED", "Abstract") else label + ": ") + text + "\n" for label, text in parts)
            if names:
                body += "MeSH descriptor names: " + "".join(n + "\n" for n, _ in names)
            sections += [("Abstract", body)]
        else:
            sections += [(label, text + "\n") for label, text in parts]
            if names:
                sections.append(("MeSH descriptor names", "".join(n + "\n" for n, _ in names)))
        yield node.findtext(".//PMID"), node.findtext(".//DateCompleted/Year"), node.findtext(".//PublicationType"), sections, names
        node.clear()


def read_medline(spark: SparkSession, path: str, single: bool = False, mesh: bool = False, skip_broken: bool = False) -> DataFrame:
    """Sections of Medline XML, plain or gzipped: title, abstract parts by label and, with ``mesh``, the MeSH headings, a line each."""
    return from_medline(contents(spark, path), single, mesh, skip_broken)


def from_medline(files: DataFrame, single: bool = False, mesh: bool = False, skip_broken: bool = False) -> DataFrame:
    """read_medline() of rows (path, content)."""

    def parse(_: str, data: bytes) -> Iterator[tuple]:
        for pmid, _, _, sections, _ in _medline(data, single, mesh):
            at = 0
            for k, (kind, text) in enumerate(sections):
                yield pmid, k, kind, text, at
                at += len(text)

    return _parsed(files, parse, SECTION_ROWS, skip_broken)


def read_medline_mesh(spark: SparkSession, path: str, single: bool = False, skip_broken: bool = False) -> DataFrame:
    """The MeSH headings of Medline XML as entities, placed on the names that read_medline() with ``mesh`` has in its text."""
    return from_medline_mesh(contents(spark, path), single, skip_broken)


def from_medline_mesh(files: DataFrame, single: bool = False, skip_broken: bool = False) -> DataFrame:
    """read_medline_mesh() of rows (path, content)."""

    def parse(_: str, data: bytes) -> Iterator[tuple]:
        for pmid, _, _, sections, names in _medline(data, single, True):
            at = sum(len(t) for _, t in sections) - sum(len(n) + 1 for n, _ in names)
            for k, (name, ui) in enumerate(names, 1):
                yield pmid, str(k), name, at, at + len(name), UNKNOWN, UNKNOWN, "MeSH", ui, UNKNOWN
                at += len(name) + 1

    return _parsed(files, parse, ENTITY_ROWS, skip_broken)


def read_medline_articles(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, type, year) of Medline XML."""
    return _parsed(contents(spark, path), lambda _, data: ((p, t, y) for p, y, t, _, _ in _medline(data, False, False)), "doc_id string, type string, year string")


def _first(root: ET.Element, *paths: str) -> ET.Element | None:
    return next((n for p in paths if (n := root.find(p)) is not None), None)


def _pmc(data: bytes) -> tuple[str, list[tuple[str, str]]]:
    """(id, sections) of a full text, by one walk down the tree that carries the top section it is in."""
    root = ET.fromstring(data)
    text = lambda n: _itertext(n).strip() + "\n\n"
    named = _first(root, ".//article-id[@pub-id-type='pmc']", ".//article-id[@pub-id-type='pubmed']", ".//article-id")
    abstracts: list[str] = []
    body: list[list] = []  # of [top section, name, text]
    todo: list[tuple[ET.Element, str, ET.Element | None]] = [(root, "", None)]
    while todo:
        node, part, top = todo.pop()
        if node.tag == "abstract":
            abstracts.append((node.get("abstract-type") or "abstract").capitalize() + "\n\n")
            part = "abstract"
        elif node.tag == "body":
            part, top = "body", None
        elif part == "body" and node.tag == "sec" and top is None:
            top = node
        if part == "abstract" and node.tag in ("title", "p"):
            abstracts.append(text(node))
        elif part == "body" and node.tag in ("title", "p", "label"):
            if not body or body[-1][0] is not top or top is None and body[-1][1] != "body":
                body.append([top, "body" if top is None else top.get("sec-type", "section"), ""])
            body[-1][2] += text(node)
        todo += [(child, part, top) for child in reversed(node)]
    title = _first(root, ".//title-group/article-title", ".//article-categories/subj-group/subject")
    return UNKNOWN if named is None else named.text, [("title", text(title)), ("abstract", "".join(abstracts)), *[(kind, words) for _, kind, words in body]]


def read_pmc(spark: SparkSession, path: str, skip_broken: bool = False) -> DataFrame:
    """Sections of PMC full-text XML: title, abstracts, and the paragraphs of the body by top-level section."""
    return from_pmc(contents(spark, path), skip_broken)


def from_pmc(files: DataFrame, skip_broken: bool = False) -> DataFrame:
    """read_pmc() of rows (path, content)."""

    def parse(_: str, data: bytes) -> Iterator[tuple]:
        doc_id, sections = _pmc(data)
        at = 0
        for k, (kind, text) in enumerate(sections):
            yield doc_id, k, kind, text, at
            at += len(text)

    return _parsed(files, parse, SECTION_ROWS, skip_broken)


def write_lines(rows: DataFrame, path: str, order: list[str], line: str = "line") -> None:
    """Writes the column ``line`` as text, sorted over all files by ``order``."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(line).write.mode("overwrite").text(path)


def tsv_lines(text: str) -> list[list[str]]:
    """The rows of a tab-separated text without quoting."""
    return list(csv.reader(io.StringIO(text), delimiter="\t", quoting=csv.QUOTE_NONE))
