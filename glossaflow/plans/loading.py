"""Queries of the loaders: each table row is put into a file of the format, parsed, and compared with what SQL makes of the row."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaflow.session import read
from glossaflow.sources import files

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


#: Characters that XML can't hold.
_BARRED = r"[\x00-\x08\x0b-\x1f\x{fffe}\x{ffff}]"


def articles(spark, sf_dir) -> DataFrame:
    """(id, journal, lang, text) of the documents with a text, without characters that XML can't hold."""
    d = read(spark, sf_dir, "documents").where("text is not null")
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("none")), _BARRED, " ").alias(c)
    return d.select(F.col("doc_id").cast("string").alias("id"), clean("journal"), clean("lang"), clean("text"))


_ARTICLES = rf"a AS (SELECT CAST(doc_id AS VARCHAR) AS id, regexp_replace(coalesce(journal, 'none'), '{_BARRED}', ' ', 'g') AS journal, regexp_replace(coalesce(lang, 'none'), '{_BARRED}', ' ', 'g') AS lang, regexp_replace(text, '{_BARRED}', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL)"
_SECTIONS = "SELECT id AS doc_id, CAST({k} AS INTEGER) AS sec_id, {kind} AS type, {text} AS text, CAST({start} AS INTEGER) AS start_ FROM a"


def _union(*parts: tuple) -> str:
    """SQL of some sections of each article, (type, text) one behind the other."""
    out = []
    for k, (kind, text) in enumerate(parts):
        start = " + ".join(["0", *[f"length({t})" for _, t in parts[:k]]])
        out.append(_SECTIONS.format(k=k, kind=f"'{kind}'", text=text, start=start))
    return f"WITH {_ARTICLES} " + " UNION ALL ".join(out)


def _xml(c: str) -> Column:
    return F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _file(*parts: Column | str) -> list[Column]:
    body = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return [F.concat(F.col("id"), F.lit(".xml")).alias("path"), F.encode(body, "UTF-8").alias("content")]


def _sections(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "sec_id", "type", "text", F.col("start").alias("start_"))


def _medline(spark, sf_dir) -> DataFrame:
    head = "<MedlineCitationSet><MedlineCitation><PMID>"
    return articles(spark, sf_dir).select(
        *_file(
            head, F.col("id"), "</PMID><DateCompleted><Year>2020</Year></DateCompleted><Article><ArticleTitle>", _xml("journal"), '</ArticleTitle><Abstract><AbstractText Label="BODY">', _xml("text"),
            '</AbstractText><AbstractText Label="UNLABELLED">', _xml("lang"), '</AbstractText></Abstract></Article><MeshHeadingList><MeshHeading><DescriptorName UI="D1">', _xml("journal"),
            '</DescriptorName></MeshHeading><MeshHeading><DescriptorName UI="D2">', _xml("lang"), "</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></MedlineCitationSet>",
        )
    )


_NL = "chr(10)"
#: A part without text is none.
_BODY = f"(CASE WHEN text = '' THEN '' ELSE text || {_NL} END)"


@query(f"SELECT * FROM ({_union(('Title', f'(journal || {_NL})'), ('BODY', _BODY), ('UNLABELLED', f'(lang || {_NL})'))}) WHERE text <> ''".replace("AS sec_id", "AS k").replace("SELECT * FROM", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS sec_id, type, text, start_ FROM"))
def load_medline(spark, sf_dir):
    return _sections(files.from_medline(_medline(spark, sf_dir)))


@query(_union(("Title", f"(journal || {_NL})"), ("Abstract", f"(CASE WHEN text = '' THEN '' ELSE 'BODY: ' || text || {_NL} END || lang || {_NL})")))
def load_medline_single(spark, sf_dir):
    return _sections(files.from_medline(_medline(spark, sf_dir), single=True))


@query(f"""WITH {_ARTICLES}, b AS (SELECT *, length(journal) + length({_BODY}) + length(lang) + 2 AS base FROM a)
SELECT id AS doc_id, '1' AS id, journal AS text, CAST(base AS INTEGER) AS start_, 'D1' AS native_id FROM b UNION ALL SELECT id, '2', lang, CAST(base + length(journal) + 1 AS INTEGER), 'D2' FROM b""")
def load_medline_mesh(spark, sf_dir):
    return files.from_medline_mesh(_medline(spark, sf_dir)).select("doc_id", "id", "text", F.col("start").alias("start_"), "native_id")


_strip = lambda c: rf"(regexp_replace({c}, '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g') || chr(10) || chr(10))"


@query(_union(("title", _strip("journal")), ("abstract", "('Abstract' || chr(10) || chr(10) || " + _strip("lang") + ")"), ("intro", f"({_strip('journal')} || {_strip('text')})"), ("section", _strip("lang"))))
def load_pmc(spark, sf_dir):
    a = articles(spark, sf_dir).select(
        *_file(
            '<article><front><article-meta><article-id pub-id-type="pmc">', F.col("id"), "</article-id><title-group><article-title>", _xml("journal"), "</article-title></title-group><abstract><p>", _xml("lang"),
            '</p></abstract></article-meta></front><body><sec sec-type="intro"><title>', _xml("journal"), "</title><sec><p>", _xml("text"), "</p></sec></sec><sec><p>", _xml("lang"), "</p></sec></body></article>",
        )
    )
    return _sections(files.from_pmc(a))


def _bioc_xml(spark, sf_dir, unit) -> tuple[DataFrame, DataFrame]:
    """A title passage and the text, with the whole title and text as annotations; ``unit`` measures lengths."""
    size, n = unit(F.col("journal")), unit(F.col("text"))
    a = articles(spark, sf_dir).where("text <> ''").select(
        *_file(
            "<collection><document><id>", F.col("id"), '</id><passage><infon key="type">title</infon><offset>0</offset><text>', _xml("journal"), '</text><annotation id="1"><infon key="type">J</infon><location offset="0" length="',
            size.cast("string"), '"/><text>', _xml("journal"), '</text></annotation></passage><passage><infon key="type">body</infon><offset>', (size + 1).cast("string"), "</offset><text>", _xml("text"),
            '</text><annotation id="2"><infon key="type">T</infon><location offset="', (size + 1).cast("string"), '" length="', n.cast("string"), '"/><text>', _xml("lang"), "</text></annotation></passage></document></collection>",
        )
    )
    return files.from_bioc_xml(a, byte_offsets=unit is F.octet_length)


_BIOC_SECTIONS = f"WITH {_ARTICLES} SELECT id AS doc_id, CAST(0 AS INTEGER) AS sec_id, 'title' AS type, journal AS text, CAST(0 AS INTEGER) AS start_ FROM a WHERE text <> '' UNION ALL SELECT id, 1, 'body', text, CAST(length(journal) + 1 AS INTEGER) FROM a WHERE text <> ''"
_BIOC_ENTITIES = f"WITH {_ARTICLES} SELECT id AS doc_id, '1' AS id, 'J' AS type, CAST(0 AS INTEGER) AS start_, CAST(length(journal) AS INTEGER) AS end_ FROM a WHERE text <> '' UNION ALL SELECT id, '2', 'T', CAST(length(journal) + 1 AS INTEGER), CAST(length(journal) + 1 + length(text) AS INTEGER) FROM a WHERE text <> ''"


def _entities(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "id", "type", F.col("start").alias("start_"), F.col("end").alias("end_"))


@query(_BIOC_SECTIONS)
def load_bioc_xml(spark, sf_dir):
    return _sections(_bioc_xml(spark, sf_dir, F.length)[0])


@query(_BIOC_ENTITIES)
def load_bioc_xml_entities(spark, sf_dir):
    return _entities(_bioc_xml(spark, sf_dir, F.length)[1])


@query(_BIOC_SECTIONS)
def load_bioc_byte_offsets(spark, sf_dir):
    """Offsets that count bytes come out in code points."""
    return _sections(_bioc_xml(spark, sf_dir, F.octet_length)[0])


@query(_BIOC_ENTITIES)
def load_bioc_byte_entities(spark, sf_dir):
    return _entities(_bioc_xml(spark, sf_dir, F.octet_length)[1])


_TEXT_SECTIONS = r"""WITH parts AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '(\S[^\S\n]*\n(?:[^\S\n]*\n)+)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL))
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(k - 1 AS INTEGER) AS sec_id, '' AS type, text, CAST(stop - length(text) AS INTEGER) AS start_ FROM (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM parts)"""


@query(_TEXT_SECTIONS)
def load_txt_tar(spark, sf_dir):
    """Each stretch of documents is packed into an archive, which is then loaded."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for n, b in enumerate(batches):
            out = io.BytesIO()
            with tarfile.open(fileobj=out, mode="w:gz") as tar:
                for doc, text in zip(b["doc_id"], b["text"]):
                    info = tarfile.TarInfo(f"in/{doc}.txt")
                    info.size = len(data := text.encode())
                    tar.addfile(info, io.BytesIO(data))
            yield pd.DataFrame({"path": [f"{n}.tar.gz"], "content": [out.getvalue()]})

    d = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return _sections(files.from_txt_tar(d.mapInPandas(pack, "path string, content binary")))


@query(_TEXT_SECTIONS)
def load_txt_json(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where("text is not null")
    return _sections(files.from_txt_json(d.select(F.to_json(F.array(F.struct(F.col("doc_id").cast("string").alias("id"), "text"))).alias("body"))))


_FLAT = r"f AS (SELECT id, regexp_replace(journal, '\s', ' ', 'g') AS title, regexp_replace(text, '\s', ' ', 'g') AS body FROM a WHERE regexp_matches(text, '[^\s\p{Z}\x{85}]'))"


def _pubtator(spark, sf_dir, fbk: bool) -> tuple[DataFrame, DataFrame]:
    flat = lambda c: F.regexp_replace(c, r"\s", " ").alias(c)
    d = articles(spark, sf_dir).where(F.col("text").rlike(r"[^\s\p{Z}\x{85}]")).select("id", flat("journal"), flat("text"))
    n = F.length("journal").cast("string")
    mark = F.concat_ws("\t", "id", F.lit("T7"), F.lit("J"), F.lit("0"), n, "journal") if fbk else F.concat_ws("\t", "id", F.lit("0"), n, "journal", F.lit("J"), F.lit("C1"))
    block = F.concat_ws("\n", F.concat_ws("|", "id", F.lit("t"), "journal"), F.concat_ws("|", "id", F.lit("a"), "text"), mark, F.concat_ws("\t", "id", F.lit("CID"), F.lit("C1"), F.lit("C2")))
    return files.from_pubtator(d.select(F.col("id").alias("source"), F.concat(block, F.lit("\n\n")).alias("text")), fbk)


@query(f"""WITH {_ARTICLES}, {_FLAT} SELECT id AS doc_id, CAST(0 AS INTEGER) AS sec_id, 'Title' AS type, title || chr(10) AS text, CAST(0 AS INTEGER) AS start_ FROM f
UNION ALL SELECT id, 1, 'Abstract', body || chr(10), CAST(length(title) + 1 AS INTEGER) FROM f""")
def load_pubtator(spark, sf_dir):
    return _sections(_pubtator(spark, sf_dir, False)[0])


def _marks(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "id", "text", "type", "native_id", F.col("start").alias("start_"), F.col("end").alias("end_"))


@query(f"WITH {_ARTICLES}, {_FLAT} SELECT id AS doc_id, '1' AS id, title AS text, 'J' AS type, 'C1' AS native_id, CAST(0 AS INTEGER) AS start_, CAST(length(title) AS INTEGER) AS end_ FROM f")
def load_pubtator_entities(spark, sf_dir):
    return _marks(_pubtator(spark, sf_dir, False)[1])


@query(f"WITH {_ARTICLES}, {_FLAT} SELECT id AS doc_id, '7' AS id, title AS text, 'J' AS type, 'unknown' AS native_id, CAST(0 AS INTEGER) AS start_, CAST(length(title) AS INTEGER) AS end_ FROM f")
def load_pubtator_fbk(spark, sf_dir):
    return _marks(_pubtator(spark, sf_dir, True)[1])
