"""Formats of whole documents: JSON built by the engine, XML serialised an Arrow batch at a time, and archives."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossaflow.content import Content
from glossaflow.functions import text as T
from glossaflow.schema import INFO
from glossaflow.sinks.lines import WORDS, colocated, odin_mentions, og_dict, plain_text, word_tokens

_ORDER = ["start", "end", "id"]
#: Characters of XML that are passed on together.
_BATCH = 4_000_000
PMC_SECTIONS = "Title,Abstract,Introduction,Methods,Results,Discussion,Acknowledgments,References,Table,Figure,Case study,Supplementary material,Conclusion,Abbreviations,Competing Interests".split(",")


def _nested(content: Content, by: list[str]) -> DataFrame:
    """Entities of each ``by`` as one sorted array."""
    e = content.entities.select(*by, F.struct("start", "end", F.col("id").cast("bigint").alias("n"), "id", "text", *INFO).alias("e"))
    return e.groupBy(*by).agg(F.array_sort(F.collect_list("e")).alias("entities"))


def _or_empty(c: str):
    return F.coalesce(c, F.array())


def pubannotation(content: Content, sourcedb: str = "unknown") -> DataFrame:
    """(doc_id, json): text and denotations with ids T1, T2, ... of each article."""
    docs = plain_text(content).join(_nested(content, ["doc_id"]), "doc_id", "left")
    marks = F.transform(_or_empty("entities"), lambda e, i: F.struct(F.concat(F.lit("T"), (i + 1).cast("string")).alias("id"), F.struct(e["start"].alias("begin"), e["end"].alias("end")).alias("span"), e["native_id"].alias("obj")))
    return docs.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("sourceid"), "text", marks.alias("denotations"), F.lit(sourcedb).alias("sourcedb"))).alias("json"))


def pubannotation_sections(content: Content, sourcedb: str = "unknown") -> DataFrame:
    """(doc_id, sec_id, json): one object per section, with offsets from its start."""
    secs = content.sections.join(_nested(content, ["doc_id", "sec_id"]), ["doc_id", "sec_id"], "left")
    marks = F.transform(_or_empty("entities"), lambda e, i: F.struct(F.concat(F.lit("T"), (i + 1).cast("string")).alias("id"), F.struct((e["start"] - F.col("start")).alias("begin"), (e["end"] - F.col("start")).alias("end")).alias("span"), e["native_id"].alias("obj")))
    return secs.select("doc_id", "sec_id", F.to_json(F.struct(F.col("doc_id").alias("sourceid"), (F.col("sec_id") + 1).alias("divid"), "text", marks.alias("denotations"), F.lit(sourcedb).alias("sourcedb"))).alias("json"))


def becalm_json(content: Content) -> DataFrame:
    """(document_id, json): the entries of each article."""
    from glossaflow.sinks.lines import becalm

    rows = becalm(content)
    return rows.groupBy("document_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("init", "end", *[c for c in rows.columns if c not in ("init", "end")])))).alias("json"))


def europepmc_annotations(content: Content, source: str = "MED") -> DataFrame:
    """(doc_id, position, prefix, exact, postfix, section, type, tags): one row per span and type with 20 characters around."""
    texts = plain_text(content).withColumnRenamed("text", "whole")
    base = content.sections.groupBy("doc_id").agg(F.min("start").alias("base"))
    name = F.when(F.col("section_type").isin(PMC_SECTIONS), F.col("section_type")).otherwise("Article") if source == "PMC" else F.when(F.col("section_type") == "Title", "Title").otherwise("Abstract")
    c = colocated(content).join(texts, "doc_id").join(base, "doc_id").withColumn("a", F.col("start") - F.col("base")).withColumn("b", F.col("end") - F.col("base"))
    first = F.greatest(F.col("a") - 20, F.lit(0))
    return c.select(
        "doc_id", F.concat_ws(".", F.col("sent_no").cast("string"), F.col("location").cast("string")).alias("position"), F.substring("whole", first + 1, F.col("a") - first).alias("prefix"),
        F.substring("whole", F.col("a") + 1, F.col("b") - F.col("a")).alias("exact"), F.substring("whole", F.col("b") + 1, F.lit(20)).alias("postfix"), name.alias("section"), "type", "tags",
    )


def europepmc(content: Content, source: str = "MED", provider: str = "glossaflow") -> DataFrame:
    """(doc_id, json): one object per article that has annotations."""
    rows = europepmc_annotations(content, source)
    anns = F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c != "doc_id"]))).alias("anns")
    return rows.groupBy("doc_id").agg(anns).select("doc_id", F.to_json(F.struct(F.lit(source).alias("src"), F.lit(provider).alias("provider"), F.col("doc_id").alias("id"), "anns")).alias("json"))


def bioc_documents(content: Content, sentence_level: bool = False, byte_offsets: bool = False) -> DataFrame:
    """(doc_id, document): each article as a BioC document in JSON, text and annotations at passages or at sentences. ``byte_offsets`` counts in bytes of the article's text."""
    e = content.entities
    whole = None
    if byte_offsets:
        whole = plain_text(content).withColumnRenamed("text", "__whole").join(content.sections.groupBy("doc_id").agg(F.min("start").alias("__base")), "doc_id")

    def at(df: DataFrame) -> DataFrame:
        if whole is None:
            return df.withColumn("offset", F.col("start")).withColumn("length", F.col("end") - F.col("start"))
        # the text of an article meets all its rows at once, and is read once
        rows = df.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "doc_id"])).alias("__rows")).join(whole, "doc_id")
        begins, ends = F.transform("__rows", lambda r: r["start"] - F.col("__base")), F.transform("__rows", lambda r: r["end"] - F.col("__base"))
        places = [T.byte_places(F.col("__whole"), begins).alias("__start"), T.byte_places(F.col("__whole"), ends).alias("__end")]
        each = rows.select("doc_id", "__base", "__rows", *places).select("doc_id", "__base", F.explode(F.arrays_zip("__rows", "__start", "__end")).alias("x"))
        return each.select("doc_id", "x.__rows.*", (F.col("x.__start") + F.col("__base")).alias("offset"), (F.col("x.__end") - F.col("x.__start")).alias("length"))

    infons = F.map_from_arrays(F.array(*[F.lit(f) for f in INFO]), F.array(*[F.coalesce(f, F.lit("")) for f in INFO]))
    one = F.to_json(F.struct("id", infons.alias("infons"), "text", F.array(F.struct("offset", "length")).alias("locations")))
    level = ["doc_id", "sec_id", "sent_id"] if sentence_level else ["doc_id", "sec_id"]
    annos = at(e).groupBy(*level).agg(_joined(F.struct("start", "end", F.col("id").cast("bigint").alias("n"), "id", one.alias("j"))).alias("annotations"))
    none = F.lit("")
    typed = F.create_map(F.lit("type"), F.coalesce("type", F.lit("")))
    if sentence_level:
        body = _object(F.struct(F.create_map().cast("map<string,string>").alias("infons"), "offset", "text"), annotations=F.coalesce("annotations", none))
        sents = at(content.sentences).join(annos, level, "left").groupBy("doc_id", "sec_id").agg(_joined(F.struct("sent_id", body.alias("j"))).alias("sentences"))
        parts = at(content.sections).join(sents, ["doc_id", "sec_id"], "left")
        body = _object(F.struct(typed.alias("infons"), "offset", none.alias("text")), sentences=F.coalesce("sentences", none), annotations=none)
    else:
        parts = at(content.sections).join(annos, level, "left")
        body = _object(F.struct(typed.alias("infons"), "offset", "text"), sentences=none, annotations=F.coalesce("annotations", none))
    docs = parts.groupBy("doc_id").agg(_joined(F.struct("sec_id", body.alias("j"))).alias("passages"))
    return docs.select("doc_id", _object(F.struct(F.col("doc_id").alias("id"), F.create_map().cast("map<string,string>").alias("infons")), passages=F.col("passages")).alias("document"))


def _joined(row):
    """The field j of some rows, in their order, parted by commas."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["j"]), ",")


def _object(head, **lists):
    """A JSON object of a struct and some lists of JSON values."""
    start = F.to_json(head)
    more = [x for k, v in lists.items() for x in (F.lit(f',"{k}":['), v, F.lit("]"))]
    return F.concat(start.substr(F.lit(1), F.length(start) - 1), *more, F.lit(',"relations":[]}'))


def bioc_json(content: Content, source: str = "", date: str = "", key: str = "", **options) -> DataFrame:
    """(doc_id, json): each article as a BioC collection of one document."""
    head = F.to_json(F.struct(F.lit(source).alias("source"), F.lit(date).alias("date"), F.lit(key).alias("key")))
    return bioc_documents(content, **options).select("doc_id", F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"infons":{},"documents":['), F.col("document"), F.lit("]}")).alias("json"))


def _serialised(rows: DataFrame, build: Callable[[pd.Series], ET.Element]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "xml": [ET.tostring(build(r), encoding="unicode") for _, r in b.iterrows()]})

    return rows.mapInPandas(run, "doc_id string, xml string")


def entity_xml(content: Content) -> DataFrame:
    """(doc_id, xml): the entities of each article, information as attributes."""

    def build(r) -> ET.Element:
        root = ET.Element("entities", article_id=r["doc_id"])
        for e in r["entities"]:
            ET.SubElement(root, "entity", id=str(e["id"]), start=str(e["start"]), end=str(e["end"]), **{f: e[f] or "" for f in INFO}).text = e["text"]
        return root

    return _serialised(_nested(content, ["doc_id"]), build)


def text_xml(content: Content) -> DataFrame:
    """(doc_id, xml): sections, sentences and tokens of each article.

    Sections, each followed by its sentences, pass a task in order and become text at once; tokens are never rows. A task
    holds one article, and batches of about ``_BATCH`` characters.
    """
    heads = content.sections.select("doc_id", "sec_id", F.lit(-1).alias("sent_id"), F.col("type").alias("text"), F.lit(0).alias("start"))
    rows = heads.unionByName(content.sentences.select("doc_id", "sec_id", "sent_id", "text", "start"))
    # the window brings the rows of an article together and in order; its number tells where the next one begins
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("sec_id", "sent_id")))

    words, quoted = re.compile(WORDS), {'"': "&quot;", "\r": "&#13;", "\n": "&#10;", "\t": "&#09;"}

    def attribute(value: str | None) -> str:
        return '"' + escape(value or "", quoted) + '"'

    def sentence(number: int, text: str | None, start: int) -> str:
        spans = [m.span() for m in words.finditer(text or "")]
        if not spans:
            return f'<sentence id="{number}" />'
        own = escape if "&" in text or "<" in text or ">" in text else str
        # per cent formatting takes a third less time than an f-string here
        tokens = ['<token id="%d" start="%d" end="%d" length="%d">%s</token>' % (k, a + start, b + start, b - a, own(text[a:b])) for k, (a, b) in enumerate(spans)]
        return f'<sentence id="{number}">{"".join(tokens)}</sentence>'

    def article(doc: str, secs: list[tuple[int, str | None, list[str]]]) -> str:
        parts = []
        for number, kind, sents in secs:
            head = f'<section id="{number}" type={attribute(kind)}'
            parts += [head, ">", *sents, "</section>"] if sents else [head, " />"]
        return f"<article id={attribute(doc)}>{''.join(parts)}</article>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xmls, size, doc, secs = [], [], 0, None, []

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(xmls, pa.string())], names=["doc_id", "xml"])

        def close() -> None:
            nonlocal size
            if secs:
                ids.append(doc)
                xmls.append(article(doc, secs))
                size += len(xmls[-1])

        for b in batches:
            for name, sec, sent, text, start, n in zip(*(c.to_pylist() for c in b.columns)):
                if n == 1:
                    close()
                    doc, secs = name, []
                    if size >= _BATCH:
                        yield full()
                        ids, xmls, size = [], [], 0
                if sent < 0:
                    secs.append((sec, text, []))
                elif secs and secs[-1][0] == sec:
                    secs[-1][2].append(sentence(sent, text, start or 0))
        close()
        if ids:
            yield full()

    return rows.mapInArrow(run, "doc_id string, xml string")


def bioc_xml(content: Content, source: str = "", date: str = "", key: str = "", **options) -> DataFrame:
    """(doc_id, xml): bioc_json as XML."""
    import json

    def infons(node: ET.Element, values: dict) -> None:
        for k, v in values.items():
            ET.SubElement(node, "infon", key=k).text = v

    def level(node: ET.Element, part: dict) -> None:
        infons(node, part.get("infons") or {})
        ET.SubElement(node, "offset").text = str(part["offset"])
        for s in part.get("sentences") or ():
            level(ET.SubElement(node, "sentence"), s)
        if not part.get("sentences"):
            ET.SubElement(node, "text").text = part["text"]
        for a in part.get("annotations") or ():
            one = ET.SubElement(node, "annotation", id=str(a["id"]))
            infons(one, a["infons"])
            for x in a["locations"]:
                ET.SubElement(one, "location", offset=str(x["offset"]), length=str(x["length"]))
            ET.SubElement(one, "text").text = a["text"]

    def build(r) -> ET.Element:
        root = ET.Element("collection")
        for tag, value in (("source", source), ("date", date), ("key", key)):
            ET.SubElement(root, tag).text = value
        doc, data = ET.SubElement(root, "document"), json.loads(r["document"])
        ET.SubElement(doc, "id").text = data["id"]
        for p in data["passages"]:
            level(ET.SubElement(doc, "passage"), p)
        return root

    return _serialised(bioc_documents(content, **options), build)


def odin_xml(content: Content) -> DataFrame:
    """(doc_id, xml): sections with sentences (S), tokens (W) and lumped mentions (Term), and the dictionary of the article."""
    sec = ["doc_id", "sec_id"]
    base = content.sections.select(*sec, F.col("start").alias("base"))
    tokens = word_tokens(content).join(base, sec).select(*sec, "sent_id", F.struct("sent_no", F.col("tok_id"), "token", (F.col("start") - F.col("base")).alias("o1"), (F.col("end") - F.col("base")).alias("o2")).alias("t"))
    tokens = tokens.groupBy(*sec, "sent_id").agg(F.array_sort(F.collect_list("t")).alias("tokens"))
    terms = odin_mentions(content).groupBy(*sec, "sent_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "allvalues", "types"))).alias("terms"))
    sents = content.sentences.select(*sec, "sent_id", "sent_no").join(tokens, [*sec, "sent_id"], "left").join(terms, [*sec, "sent_id"], "left")
    sents = sents.groupBy(*sec).agg(F.sort_array(F.collect_list(F.struct("sent_id", "sent_no", "tokens", "terms"))).alias("sents"))
    docs = content.sections.join(sents, sec, "left").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sec_id", "type", "sents"))).alias("secs"))
    entries = og_dict(content).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("cid", "cname", "type"))).alias("dict"))
    tags = {"title": "article-title", "abstract": "abstract", "mesh descriptor names": "mesh"}

    def build(r) -> ET.Element:
        root, w = ET.Element("article", id=r["doc_id"]), 0
        for s in r["secs"]:
            part = ET.SubElement(root, tags.get((s["type"] or "").lower(), "section"), id=str(s["sec_id"]))
            for x in s["sents"] if s["sents"] is not None else ():
                node = ET.SubElement(part, "S", i=str(x["sent_id"]), id=f"S{x['sent_no']}")
                toks = list(x["tokens"]) if x["tokens"] is not None else []
                terms, k = (list(x["terms"]) if x["terms"] is not None else []), 0
                open_: ET.Element | None = None
                for n, t in enumerate(toks):
                    w += 1
                    while k < len(terms) and terms[k]["end"] <= t["o1"]:
                        k, open_ = k + 1, None
                    one = ET.Element("W", id=f"W{w}", o1=str(t["o1"]), o2=str(t["o2"]))
                    one.text = t["token"]
                    space = " " if n + 1 < len(toks) and toks[n + 1]["o1"] > t["o2"] else None
                    if k < len(terms) and terms[k]["start"] < t["o2"]:
                        if open_ is None:
                            open_ = ET.SubElement(node, "Term", allvalues=terms[k]["allvalues"], type=terms[k]["types"], o1=str(terms[k]["start"]), o2=str(terms[k]["end"]))
                        open_.append(one)
                        open_.set("id", "T_" + "_".join(c.get("id") for c in open_))
                        last = n + 1 == len(toks) or toks[n + 1]["o1"] >= terms[k]["end"]
                        (open_ if last else one).tail = space
                    else:
                        node.append(one)
                        one.tail = space
        out = ET.SubElement(root, "og-dict")
        for e in r["dict"] if r["dict"] is not None else ():
            ET.SubElement(out, "og-dict-entry", cid=e["cid"], cname=e["cname"] or "", type=e["type"] or "")
        return root

    return _serialised(docs.join(entries, "doc_id", "left"), build)


def archives(bodies: DataFrame, kind: str = "tgz", members: int = 10_000, name: str = "doc_id", body: str = "json", ext: str = "json") -> DataFrame:
    """(archive, members, content): the (name, body) rows packed into archives of at most ``members`` members each, in parallel. The same rows give the same bytes."""

    def packed(rows: list[tuple[str, str]]) -> bytes:
        out = io.BytesIO()
        if kind == "zip":
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                for n, t in rows:
                    z.writestr(zipfile.ZipInfo(f"{n}.{ext}"), t, zipfile.ZIP_DEFLATED)
        else:
            with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as file, tarfile.open(fileobj=file, mode="w") as z:
                for n, t in rows:
                    info = tarfile.TarInfo(f"{n}.{ext}")
                    info.size = len(data := t.encode())
                    z.addfile(info, io.BytesIO(data))
        return out.getvalue()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, k, rows = TaskContext.get().partitionId(), 0, []

        def flush() -> pd.DataFrame:
            nonlocal k, rows
            full, rows, k = rows, [], k + 1
            return pd.DataFrame([(f"part-{part:05d}-{k - 1:03d}.{kind}", len(full), packed(full))], columns=["archive", "members", "content"])

        for b in batches:
            for n, t in zip(b[name], b[body]):
                rows.append((n, t))
                if len(rows) == members:
                    yield flush()
        if rows:
            yield flush()

    return bodies.select(F.col(name).cast("string").alias(name), body).mapInPandas(run, "archive string, members int, content binary")


def write_archives(bodies: DataFrame, folder: str, kind: str = "tgz", members: int = 10_000, **options) -> DataFrame:
    """Writes archives() as files of ``folder``, an absolute path or a URI of any file system that all executors reach, and returns (archive, members).

    Each executor writes its own archives under a temporary name and moves them in place; a retried task writes the same
    bytes again.
    """

    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = pafs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for b in batches:
            for name, content in zip(b["archive"], b["content"]):
                with system.open_output_stream(f"{base}/{name}.tmp") as out:
                    out.write(content)
                system.move(f"{base}/{name}.tmp", f"{base}/{name}")
            yield pd.DataFrame({"archive": [f"{folder.rstrip('/')}/{n}" for n in b["archive"]], "members": b["members"]})

    return archives(bodies, kind, members, **options).mapInPandas(store, "archive string, members int")
