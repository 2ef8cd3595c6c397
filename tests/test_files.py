import gzip
import io
import json
import tarfile
import zipfile
from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F

from glossaflow import config
from glossaflow import content as C
from glossaflow.__main__ import main
from glossaflow.operators import termlist
from glossaflow.pipeline import Pipeline
from glossaflow.sinks import documents as D
from glossaflow.sinks import lines as L
from glossaflow.sources import files, pointers

TERMS = [("gene a", "Gene", "Gene A", "db", "G1", "c1"), ("a", "Gene", "A", "db", "G2", "c2"), ("b c", "Chem", "BC", "db", "C1", "c3")]
TERM_SCHEMA = "term string, type string, preferred_form string, original_resource string, native_id string, umls_cui string"


@pytest.fixture(scope="module")
def content(spark):
    secs = spark.createDataFrame([("d1", 0, "title", "Gene a\n", 0), ("d1", 1, "abstract", "We saw é b\nc. Then gene a, a.\n", 7), ("d2", 0, "title", "None here\n", 0)], files.SECTION_ROWS)
    return C.annotate(C.from_sections(secs), termlist.build_index(spark.createDataFrame(TERMS, TERM_SCHEMA)))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_entities(content):
    assert rows(content.entities.where("doc_id = 'd1'"), "sent_no", "start", "end", "text", "native_id") == [
        (1, 0, 6, "Gene a", "G1"), (1, 5, 6, "a", "G2"), (2, 16, 19, "b\nc", "C1"), (3, 26, 32, "gene a", "G1"), (3, 31, 32, "a", "G2"), (3, 34, 35, "a", "G2"),
    ]


def test_tables_of_lines(content):
    tsv = rows(L.tsv(content), "sentence", "start", "term", "zone")
    assert ("S2", 16, "b c", "abstract") in tsv and len(tsv) == 6
    sparse = rows(L.text_tsv(content).where("type = '' and doc_id = 'd1'"), "start", "term")
    assert sparse == [(7, "We"), (10, "saw"), (14, "é"), (19, "."), (21, "Then"), (32, ","), (35, ".")]
    assert rows(L.bionlp(content), "line")[0] == ("T1\tG1 0 6\tGene a",)
    brat = [r.line for r in L.brat(content, [("umls_cui", True)]).orderBy("t", "n", "part").collect()]
    assert brat[:3] == ["T1\tGene 0 6\tGene a", "#1\tAnnotatorNotes T1\tGene A\tdb\tG1\tc1", "A1\tumls_cui T1 c1"]
    assert rows(L.colocated(content), "sent_no", "location")[-1] == (3, 3)
    assert rows(L.og_dict(content), "cid", "cname") == [("C1", "BC"), ("G1", "Gene A"), ("G2", "A")]
    assert rows(L.odin_mentions(content).where("sec_id = 0"), "start", "end", "allvalues") == [(0, 6, "G1:Gene:Gene a|G2:Gene:a")]
    assert rows(L.becalm(content), "section", "init")[-1] == ("T", 5)
    assert "database_id" not in L.becalm(content, True).columns


def test_pubtator_round_trip(spark, content):
    lines = L.pubtator(content).orderBy("doc_id", "part", "sec_id", "start", "end").collect()
    text = "\n\n".join("\n".join(r.line for r in lines if r.doc_id == d) for d in ("d1", "d2"))
    sections, entities = files.from_pubtator(spark.createDataFrame([("f", text + "\nd2\t1\t2\trelation\n")], "source string, text string"))
    assert rows(sections, "doc_id", "sec_id", "type", "text", "start")[:2] == [("d1", 0, "Title", "Gene a\n", 0), ("d1", 1, "Abstract", "We saw é b c. Then gene a, a.\n", 7)]
    assert rows(entities, "start", "end", "text", "native_id") == [(s, e, t.replace("\n", " "), c) for s, e, t, c in rows(content.entities, "start", "end", "text", "native_id")]
    fbk = files.from_pubtator(spark.createDataFrame([("f", "x|t|Ab c\nx\tT4\tGene\t0\t2\tAb")], "source string, text string"), True)[1]
    assert rows(fbk, "id", "type", "start") == [("4", "Gene", 0)]


def test_conll_round_trip(spark, content):
    c = L.conll(content).orderBy("doc_id", "sent_no", "tok_id").collect()
    assert [r.tag for r in c if r.sent_no == 1 and r.doc_id == "d1"] == ["S-G1", "S-G1;G2"]
    out, last = [], None
    for r in c:
        if (r.doc_id, r.sent_no) != last:
            out += [""] + ([f"# doc_id = {r.doc_id}"] if last is None or last[0] != r.doc_id else [])
            last = (r.doc_id, r.sent_no)
        out.append(f"{r.token}\t{r.start}\t{r.end}\t{r.tag}")
    lines = spark.createDataFrame([("f", n, x) for n, x in enumerate(out)], "source string, n int, line string")
    sections, sentences, entities = files.from_conll(lines)
    assert ("d1", 3, "Then gene a, a.") in rows(sentences, "doc_id", "sent_no", "text")
    assert ("d1", "C1", "b c", 16, 19) in rows(entities, "doc_id", "native_id", "text", "start", "end")
    assert rows(sections, "doc_id", "type")[0] == ("d1", "body")
    bad = spark.createDataFrame([("f", 0, "abc\t0\t2\tO")], "source string, n int, line string")
    with pytest.raises(Exception, match="length mismatch"):
        files.from_conll(bad)[1].collect()


def test_iob_repair(spark):
    tags = ["O", "I-x", "E-x", "B-x", "I-y", "O-NIL", "S-y", "I-y"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(tags)], "s int, k int, tag string")
    assert [r.iob for r in files.fix_tags(df, ["s"], ["k"]).orderBy("k").collect()] == ["O", "B", "I", "B", "B", "O", "B", "I"]


@pytest.mark.parametrize("sentences", [False, True])
def test_bioc_round_trips(spark, content, tmp_path, sentences):
    for r in D.bioc_json(content, sentence_level=sentences).collect():
        (tmp_path / f"{r.doc_id}.json").write_text(r.json)
    for r in D.bioc_xml(content, sentence_level=sentences).collect():
        (tmp_path / f"{r.doc_id}.xml.gz").write_bytes(gzip.compress(r.xml.encode()))
    want = rows(content.entities, "doc_id", "start", "end", "text", "type", "native_id")
    for secs, ents in (files.read_bioc_json(spark, f"{tmp_path}/*.json"), files.read_bioc_xml(spark, f"{tmp_path}/*.xml.gz")):
        assert rows(ents, "doc_id", "start", "end", "text", "type", "native_id") == want
        assert rows(secs, "doc_id", "sec_id", "type", "text", "start") == rows(content.sections, "doc_id", "sec_id", "type", "text", "start")


def test_byte_offsets(content):
    d = json.loads(D.bioc_documents(content, byte_offsets=True).where("doc_id = 'd1'").first().document)
    assert [a["locations"][0]["offset"] for a in d["passages"][1]["annotations"]] == [17, 27, 32, 35]


def test_json_and_xml(content):
    p = {r.doc_id: json.loads(r.json) for r in D.pubannotation(content).collect()}
    assert p["d1"]["denotations"][2] == {"id": "T3", "span": {"begin": 16, "end": 19}, "obj": "C1"} and p["d2"]["denotations"] == []
    s = {(r.doc_id, r.sec_id): json.loads(r.json) for r in D.pubannotation_sections(content).collect()}
    assert s["d1", 1]["denotations"][0]["span"] == {"begin": 9, "end": 12} and s["d1", 1]["divid"] == 2
    e = [json.loads(r.json) for r in D.europepmc(content).collect()]
    assert len(e) == 1 and e[0]["anns"][0]["exact"] == "Gene a" and e[0]["anns"][2]["postfix"] == ". Then gene a, a.\n"
    odin = ET.fromstring(D.odin_xml(content).where("doc_id = 'd1'").first().xml)
    assert "".join(odin.find("abstract").itertext()) == "We saw é b c.Then gene a, a."
    assert [t.get("allvalues") for t in odin.iter("Term")][0] == "G1:Gene:Gene a|G2:Gene:a" and odin.find(".//Term").get("id") == "T_W1_W2"
    assert len(ET.fromstring(D.entity_xml(content).first().xml)) == 6
    assert ET.fromstring(D.text_xml(content).where("doc_id = 'd2'").first().xml).find(".//token").text == "None"
    assert len(json.loads(D.becalm_json(content).first().json)) == 6


def test_archives(content, tmp_path):
    made = D.write_archives(D.europepmc(content), str(tmp_path / "z"), "zip").collect()
    with zipfile.ZipFile(made[0].archive) as z:
        assert z.namelist() == ["d1.json"]
    made = D.write_archives(D.pubannotation(content).coalesce(1), str(tmp_path / "t"), "tgz", members=1).collect()
    assert [m.members for m in made] == [1, 1]


MEDLINE = """<MedlineCitationSet><MedlineCitation><PMID>7</PMID><DateCompleted><Year>2001</Year></DateCompleted><Article><ArticleTitle>On <i>x</i></ArticleTitle><Abstract><AbstractText Label="AIM">One.</AbstractText><AbstractText>Two.</AbstractText></Abstract>
<PublicationTypeList><PublicationType>Review</PublicationType></PublicationTypeList></Article><MeshHeadingList><MeshHeading><DescriptorName UI="D1">Mice</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></MedlineCitationSet>"""
PMC = """<article><front><article-id pub-id-type="pmid">1</article-id><article-id pub-id-type="pmc">22</article-id><title-group><article-title>T <b>x</b></article-title></title-group><abstract><p>A.</p></abstract></front>
<body><p>Lead.</p><sec sec-type="intro"><title>I</title><p>P1</p><sec><p>P2</p></sec></sec><sec><p>P3</p></sec></body></article>"""


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One.\n\nTwo.\n")
    (tmp_path / "a.json").write_text('[{"id": "x", "text": "é"}, {"id": "y", "text": null}]')
    (tmp_path / "a.tsv").write_text('id\ttext\n1\t"say ""hi"""\n')
    with tarfile.open(tmp_path / "a.tar", "w") as tar:
        info = tarfile.TarInfo("m/doc7.txt")
        info.size = 3
        tar.addfile(info, io.BytesIO(b"abc"))
    (tmp_path / "m.xml").write_text(MEDLINE)
    (tmp_path / "p.nxml").write_text(PMC)
    at = lambda n: str(tmp_path / n)
    assert rows(files.read_txt(spark, at("a.txt")), "doc_id", "sec_id", "text") == [("a", 0, "One.\n\n"), ("a", 1, "Two.\n")]
    assert rows(files.read_txt_json(spark, at("a.json")), "doc_id", "text") == [("x", "é")]
    assert rows(files.read_txt_tsv(spark, at("a.tsv")), "doc_id", "text") == [("1", 'say "hi"')]
    assert rows(files.read_txt_tar(spark, at("a.tar")), "doc_id", "text") == [("doc7", "abc")]
    m = rows(files.read_medline(spark, at("m.xml"), mesh=True), "sec_id", "type", "text", "start")
    assert m == [(0, "Title", "On x\n", 0), (1, "AIM", "One.\n", 5), (2, "Abstract", "Two.\n", 10), (3, "MeSH descriptor names", "Mice\n", 15)]
    assert rows(files.read_medline(spark, at("m.xml"), single=True), "text")[0] == ("AIM: One.\nTwo.\n",)
    assert rows(files.read_medline_mesh(spark, at("m.xml")), "text", "start", "end", "native_id") == [("Mice", 15, 19, "D1")]
    assert rows(files.read_medline_articles(spark, at("m.xml")), "doc_id", "type", "year") == [("7", "Review", "2001")]
    p = rows(files.read_pmc(spark, at("p.nxml")), "doc_id", "sec_id", "type", "text")
    assert p == [("22", 0, "title", "T x\n\n"), ("22", 1, "abstract", "Abstract\n\nA.\n\n"), ("22", 2, "body", "Lead.\n\n"), ("22", 3, "intro", "I\n\nP1\n\nP2\n\n"), ("22", 4, "section", "P3\n\n")]


def test_pointers(spark):
    ids = spark.createDataFrame([(k,) for k in range(25)], "id int")
    assert {r.chunk for r in pointers.chunked(ids, 10).where("id between 10 and 19").collect()} == {1}
    assert pointers.file_name(ids, "x/{id!p}.xml").where("id = 3").first().file == "x/00000003.xml"
    assert rows(pointers.missing(ids, ids.where("id > 1")), "id") == [(0,), (1,)]
    first, second = ids.where("id < 3").withColumn("o", F.lit(1)), ids.where("id < 5").withColumn("o", F.lit(2))
    assert rows(pointers.with_fallback(ids, first, second), "id", "o") == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2)]
    one = spark.createDataFrame([("pmc12", "a/b/c.txt"), ("9", "c.txt")], "i string, p string")
    assert rows(one.select(pointers.pmc_number(F.col("i")).alias("n"), pointers.collection_of(F.col("p")).alias("c")), "n", "c") == [("12", "b"), ("9", "unknown")]


def test_settings(tmp_path):
    (tmp_path / "s.ini").write_text("[Main]\narticle-format = pubtator\nexport_format = [\"tsv\", \"brat\"]\nsingle-section = yes\n[Paths]\nroot = /x\n[Termlist]\nlayout = 4\n[Termlist10]\npath = ${Paths:root}/b\n[Termlist2]\npath = a\nlayout = 6\n")
    s = config.load([str(tmp_path / "s.ini")], postfilter="frequentFP remove_overlaps")
    assert s.single_section and s.export_format == ["tsv", "brat"] and s.postfilter == ["frequentFP", "remove_overlaps"]
    assert [(d.path, d.layout) for d in s.dictionaries] == [("a", "6"), ("/x/b", "4")]
    with pytest.raises(ValueError, match="unknown setting"):
        config.load(nonsense=1)


def test_pipeline_end_to_end(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "d.txt").write_text("Gene a (GA) works.\n\nGA is b c.\n")
    (tmp_path / "t.tsv").write_text("".join("\t".join((t[5], t[3], t[4], t[0], t[2], t[1])) + "\n" for t in TERMS))
    (tmp_path / "f.py").write_text("def postfilter(entities, keys):\n    return entities.where('length(text) > 1')\n")
    formats = ["tsv", "text_tsv", "txt", "xml", "bioc_json", "odin", "brat", "bionlp", "conll", "becalm_tsv", "becalm_json", "pubanno_json.tgz", "pubtator", "europepmc.zip", "parquet"]
    s = config.load(
        input_directory=str(tmp_path / "in"), output_directory=str(tmp_path / "out"), pointers=["*.txt"], export_format=formats, postfilter=["builtin:remove_submatches", str(tmp_path / "f.py")],
        dictionaries=[config.Dictionary(path=str(tmp_path / "t.tsv"), abbrev_detection=True)],
    )
    assert [p.rsplit("/", 1)[1] for p in Pipeline(spark, s).run()] == formats
    got = rows(spark.read.parquet(str(tmp_path / "out" / "parquet")), "start", "text", "native_id")
    assert got == [(0, "Gene a", "G1"), (8, "GA", "G1"), (8, "GA", "G2"), (20, "GA", "G1"), (20, "GA", "G2"), (26, "b c", "C1")]
    with pytest.raises(ValueError, match="unknown output format"):
        Pipeline(spark, s).export(C.Content(None, None), "nope")
    main(["version"])
    assert capsys.readouterr().out.strip()


def test_load_by_id_with_fallback(spark, tmp_path):
    (tmp_path / "1.txt").write_text("one")
    (tmp_path / "2.txt").write_text("two")
    s = config.load(input_directory=str(tmp_path), article_format="txt", fallback_format="txt")
    ids = spark.createDataFrame([("1",), ("9",)], "id string")
    assert rows(Pipeline(spark, s).load_ids(ids).sections, "doc_id") == [("1",)]
