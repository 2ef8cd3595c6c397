"""From files to annotated output: load, recognise, filter, write."""

from __future__ import annotations

import hashlib
import importlib.util
import logging
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaflow import content as C
from glossaflow.config import Dictionary, Settings
from glossaflow.functions import text as T
from glossaflow.operators import abbreviations, postfilters, recognize, termlist
from glossaflow.schema import INFO
from glossaflow.sinks import documents as D
from glossaflow.sinks import lines as L
from glossaflow.sources import files, pointers

log = logging.getLogger("glossaflow")

SOURCES = ["txt", "txt_json", "txt.tar", "txt_tsv", "bioc", "bioc_xml", "bioc_json", "pubtator", "pubtator_fbk", "pxml", "pxml.gz", "nxml", "conll"]
SINKS = ["tsv", "text_tsv", "txt", "xml", "text_xml", "bioc_xml", "bioc_json", "odin", "brat", "bionlp", "conll", "becalm_tsv", "becalm_json", "pubanno_json", "pubanno_json.tgz", "pubtator", "pubtator_fbk", "europepmc", "europepmc.zip", "parquet"]


def dictionary_key(d: Dictionary) -> str:
    """A key of the settings of a dictionary: 16 hexadecimal digits of their hash."""
    return hashlib.sha1(repr(d).encode()).hexdigest()[-16:]


class Pipeline:
    """A run of some settings on a session. Every step is a lazy DataFrame; write() starts the work."""

    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark, self.settings = spark, settings

    def load(self, path: str, form: str | None = None) -> C.Content:
        """The content of files in one of SOURCES. Files that can't be read or parsed are left out with ignore_load_errors."""
        s, form = self.settings, form or self.settings.article_format
        skip = s.ignore_load_errors
        if skip:
            self.spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
            self.spark.conf.set("spark.sql.files.ignoreMissingFiles", "true")
        plain = {"txt": files.read_txt, "txt_json": files.read_txt_json, "txt.tar": lambda *x: files.read_txt_tar(*x, skip)}
        entities = None
        if form in plain:
            sections = plain[form](self.spark, path, s.single_section)
        elif form == "txt_tsv":
            sections = files.read_txt_tsv(self.spark, path)
        elif form in ("bioc", "bioc_xml", "bioc_json"):
            sections, entities = files.read_bioc_json(self.spark, path, s.byte_offsets_in) if form == "bioc_json" else files.read_bioc_xml(self.spark, path, skip, s.byte_offsets_in)
        elif form in ("pubtator", "pubtator_fbk"):
            sections, entities = files.read_pubtator(self.spark, path, form == "pubtator_fbk")
        elif form in ("pxml", "pxml.gz"):
            sections = files.read_medline(self.spark, path, s.single_section, s.include_mesh or s.mesh_as_entities, skip)
            entities = files.read_medline_mesh(self.spark, path, s.single_section, skip) if s.mesh_as_entities else None
        elif form == "nxml":
            sections = files.read_pmc(self.spark, path, skip)
        elif form == "conll":
            sections, sentences, entities = files.read_conll(self.spark, path)
            return self._placed(C.Content(sections, sentences), entities)
        else:
            raise ValueError(f"unknown input format: {form}")
        content = C.from_sections(sections, s.sentence_split)
        return content if entities is None else self._placed(content, entities)

    @staticmethod
    def _placed(content: C.Content, entities: DataFrame) -> C.Content:
        columns = ["doc_id", "sec_id", "sent_id", "sent_no", "section_type", "id", "text", "start", "end", *INFO]
        return content.with_entities(C.assign_to_sentences(entities, content.sentences).select(*columns))

    def load_ids(self, ids: DataFrame) -> C.Content:
        """The content of the articles of some ids (id), by fn_format_in; those that aren't there come from the fallback format."""
        s = self.settings
        named = ids.select(F.col("id").cast("string").alias("id")).distinct()
        there, lacking = self._files(named, s.fn_format_in)
        content = self.load(there, s.article_format) if there else None
        if s.fallback_format:
            wanted = self.spark.createDataFrame([(i,) for i in lacking], "id string")
            others, lacking = self._files(wanted, s.fn_format_fallback or s.fn_format_in.rsplit(".", 1)[0] + "." + s.fallback_format)
            if others:
                second = self.load(others, s.fallback_format)
                content = second if content is None else C.union(content, second)
        if lacking:
            log.warning("%d ids without a file, the first: %s", len(lacking), ", ".join(lacking[:5]))
        if content is None:
            raise FileNotFoundError(f"none of the ids has a file in {s.input_directory}")
        return content

    def _files(self, ids: DataFrame, pattern: str) -> tuple[list[str], list[str]]:
        """(the files of some ids that exist, the ids that have none). Only the listing of the folder is read."""
        names = [(r.id, os.path.join(self.settings.input_directory, r.file)) for r in pointers.file_name(ids, pattern).orderBy("id").toLocalIterator()]
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        exists = lambda f: (p := jvm.org.apache.hadoop.fs.Path(f)).getFileSystem(conf).exists(p)
        held = [(i, f, exists(f)) for i, f in names]
        return [f for _, f, e in held if e], [i for i, _, e in held if not e]

    def index(self, d: Dictionary, number: int = 0) -> DataFrame:
        """The index of a dictionary, read from its term list, or from the index cache if that has one of the same settings and files."""
        if not self.settings.index_cache:
            return self._built(d, number)
        seen = self.spark.read.format("binaryFile").load(d.path).select("path", "modificationTime", "length").orderBy("path").collect()
        place = os.path.join(self.settings.index_cache, dictionary_key(d) + hashlib.sha1(repr(seen).encode()).hexdigest()[:8])
        try:
            return self.spark.read.parquet(place).withColumn("recognizer", F.lit(number))
        except AnalysisException:
            self._built(d, number).write.mode("overwrite").parquet(place)
            return self.spark.read.parquet(place).withColumn("recognizer", F.lit(number))

    def _built(self, d: Dictionary, number: int) -> DataFrame:
        terms = termlist.read_termlist(self.spark, d.path, d.layout, d.skip_header, d.extra_fields)
        return termlist.build_index(terms, d.normalize, self.stopwords(d) if d.stopwords else (), self.pattern(d), number)

    @staticmethod
    def pattern(d: Dictionary) -> str:
        return d.term_token or (T.TOKEN_PARENS if d.abbrev_detection else T.TOKEN)

    def stopwords(self, d: Dictionary) -> DataFrame | None:
        """The keys (k) of the stopwords of a dictionary: a file of one per line, or words parted by blanks."""
        if not d.stopwords:
            return None
        words = self.spark.read.text(d.stopwords).select(F.col("value").alias("w")) if os.path.exists(d.stopwords) else self.spark.createDataFrame([(w,) for w in d.stopwords.split()], "w string")
        return words.select(termlist.term_key(F.col("w"), d.normalize, pattern=self.pattern(d)).alias("k")).distinct()

    def process(self, content: C.Content) -> C.Content:
        """``content`` with the entities of all dictionaries, in their order, added to those it came with."""
        for number, d in enumerate(self.settings.dictionaries):
            index = self.index(d, number)
            if d.abbrev_detection:
                found = abbreviations.recognise_abbreviations(content.sentences.select("doc_id", F.col("sent_no").alias("sent_id"), "text", "start"), index, start="start", stopwords=[r.k for r in self.stopwords(d).collect()] if d.stopwords else []).withColumnRenamed("sent_id", "sent_no")
                at = content.sentences.select("doc_id", "sec_id", "sent_id", "sent_no", F.col("type").alias("section_type"), F.col("text").alias("sent"), F.col("start").alias("base"))
                placed = found.join(at, ["doc_id", "sent_no"]).withColumn("text", F.substring("sent", F.col("start") - F.col("base") + 1, F.col("end") - F.col("start")))
                named = recognize.with_ids(placed, ["doc_id"], ["sent_no", "start", "end", *INFO], content.entities)
                new = named.select("doc_id", "sec_id", "sent_id", "sent_no", "section_type", "id", "text", "start", "end", *INFO)
                content = content.with_entities(new if content.entities is None else content.entities.unionByName(new))
            else:
                content = C.annotate(content, index, d.normalize, self.pattern(d))
            if d.match_hook and content.entities is not None:
                content = content.with_entities(own_filter(d.match_hook)(content.entities, ["doc_id", "sec_id", "sent_id"]))
        return content

    def postfilter(self, content: C.Content) -> C.Content:
        """``content`` after the filters of the settings: built-in names, or path[:function] of own code."""
        if content.entities is None or not self.settings.postfilter:
            return content
        filters = [f if f.removeprefix("builtin:") in postfilters.BUILTIN else own_filter(f) for f in self.settings.postfilter]
        return content.with_entities(postfilters.apply_filters(content.entities, filters, ["doc_id", "sec_id", "sent_id"]))

    def export(self, content: C.Content, form: str) -> DataFrame:
        """The rows of one of SINKS."""
        s = self.settings
        bioc = {"sentence_level": s.sentence_level, "byte_offsets": s.byte_offsets_out}
        attributes = [(a.removesuffix("*"), a.endswith("*")) for a in s.brat_attributes]
        makers = {
            "tsv": lambda c: L.tsv(c), "text_tsv": L.text_tsv, "txt": L.plain_text, "xml": D.entity_xml, "text_xml": D.text_xml, "bioc_xml": lambda c: D.bioc_xml(c, **bioc), "bioc_json": lambda c: D.bioc_json(c, **bioc),
            "odin": D.odin_xml, "brat": lambda c: L.brat(c, attributes), "bionlp": L.bionlp, "conll": lambda c: L.conll(c, s.conll_tagset), "becalm_tsv": L.becalm, "becalm_json": D.becalm_json, "pubanno_json": D.pubannotation,
            "pubanno_json.tgz": D.pubannotation_sections, "pubtator": L.pubtator, "pubtator_fbk": lambda c: L.pubtator(c, True), "europepmc": D.europepmc, "europepmc.zip": D.europepmc, "parquet": lambda c: c.entities,
        }
        if form not in makers:
            raise ValueError(f"unknown output format: {form}")
        return makers[form](content)

    def write(self, content: C.Content) -> list[str]:
        """Writes ``content`` in all formats of the settings, each to a folder of its name, and returns the folders."""
        out = []
        for form in self.settings.export_format:
            rows, path = self.export(content, form), os.path.join(self.settings.output_directory, form)
            if form in ("tsv", "text_tsv", "becalm_tsv"):
                keys = ["document_id", "init", "end"] if form == "becalm_tsv" else ["doc_id", "start", "end"]
                header = L.TSV_HEADER if form != "becalm_tsv" else [c.upper() for c in rows.columns]
                ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).toDF(*header)
                ordered.write.mode("overwrite").csv(path, sep="\t", header=self.settings.include_header, quote="", emptyValue="", nullValue="")
            elif form in ("brat", "bionlp", "pubtator", "pubtator_fbk"):
                order = {"brat": ["doc_id", "t", "n", "part"], "bionlp": ["doc_id", "t"]}.get(form, ["doc_id", "part", "sec_id", "start", "end", "id"])
                rows.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)
            elif form == "conll":
                order = ["doc_id", "sent_no", "tok_id"]
                line = F.concat_ws("\t", F.when(F.col("tok_id") == 0, F.concat(F.lit("\n"), "token")).otherwise(F.col("token")), F.col("start").cast("string"), F.col("end").cast("string"), "tag")
                rows.repartitionByRange(*order).sortWithinPartitions(*order).select(line.alias("line")).write.mode("overwrite").text(path)
            elif form in ("europepmc.zip", "pubanno_json.tgz"):
                named = rows.withColumn("doc_id", F.concat_ws("_", *[c for c in ("doc_id", "sec_id") if c in rows.columns]))
                D.write_archives(named, path, form.rsplit(".", 1)[1]).count()
            elif form == "parquet":
                rows.write.mode("overwrite").parquet(path)
            else:
                body = next(c for c in ("json", "xml", "text") if c in rows.columns)
                rows.select(F.regexp_replace(body, "\n", "\\\\n").alias("value") if body == "text" else F.col(body).alias("value")).write.mode("overwrite").text(path)
            out.append(path)
        return out

    def run(self) -> list[str]:
        """Loads the pointers of the settings and writes their annotations."""
        s = self.settings
        if s.pointer_type == "id":
            ids = self.spark.createDataFrame([(p,) for p in s.pointers], "id string")
            content = self.load_ids(ids)
        else:
            content = self.load([os.path.join(s.input_directory, p) for p in s.pointers] or s.input_directory)
        return self.write(self.postfilter(self.process(content)))


def own_filter(name: str):
    """The filter of a file 'path[:function]', a function of entities and keys named postfilter by default."""
    path, _, function = name.partition(":")
    spec = importlib.util.spec_from_file_location(os.path.basename(path).removesuffix(".py"), path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return getattr(module, function or "postfilter")
