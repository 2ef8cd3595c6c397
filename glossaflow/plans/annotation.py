"""Queries of tokenisation, recognition, filters, evaluation and formats, over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glossaflow import content as C
from glossaflow.functions import segments
from glossaflow.functions import text as T
from glossaflow.operators import abbreviations, evaluation, postfilters, recognize, termlist
from glossaflow.schema import INFO
from glossaflow.session import read, spread
from glossaflow.sinks import documents as D
from glossaflow.sinks import lines as L
from glossaflow.sources import files, pointers

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Words that are compared exactly.
STOP = ["gda\x0127", "type"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- shared inputs


def docs(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")


def terms(spark, sf_dir) -> DataFrame:
    t = read(spark, sf_dir, "termlist")
    return t.select("term", F.col("entity_type").alias("type"), "preferred_form", F.col("resource_name").alias("original_resource"), "native_id", F.col("cui").alias("umls_cui"))


def sections(spark, sf_dir) -> DataFrame:
    """The passages as sections, each once, numbered within the article by offset. A passage without text gives its sentences, each at its offset."""
    given = F.array_sort(F.transform("sentences", lambda s: F.struct(s["char_offset"].alias("o"), F.coalesce(s["text"], F.lit("")).alias("t"))))
    p = read(spark, sf_dir, "passages").where("text is not null or sentences is not null").withColumn("ss", given)
    gap = lambda s, i: F.greatest(F.coalesce(F.get("ss", i + 1)["o"] - s["o"] - F.length(s["t"]), F.lit(0)), F.lit(0))
    joined = F.array_join(F.transform("ss", lambda s, i: F.concat(s["t"], F.repeat(F.lit(" "), gap(s, i)))), "")
    begin = F.when(F.col("text").isNull(), F.get("ss", F.lit(0))["o"]).otherwise(F.col("passage_offset")).alias("passage_offset")
    row = F.struct("article_id", begin, F.coalesce("text", joined).alias("text"), F.element_at("infons", F.lit("type")).alias("type"))
    once = p.groupBy("passage_id").agg(F.min(row).alias("x")).select("passage_id", "x.*")
    number = F.row_number().over(Window.partitionBy("article_id").orderBy("passage_offset", "passage_id")) - 1
    return once.select(F.col("article_id").alias("doc_id"), number.alias("sec_id"), F.coalesce("type", F.lit("")).alias("type"), "text", F.col("passage_offset").alias("start"))


def corpus(spark, sf_dir) -> C.Content:
    return C.from_sections(sections(spark, sf_dir))


def annotated(spark, sf_dir) -> C.Content:
    return C.annotate(corpus(spark, sf_dir), termlist.build_index(terms(spark, sf_dir)))


_PIECES = r"(\p{Nd}+|[\p{L}\p{Nl}\p{No}]+|[^\p{L}\p{N}]+)"
_PARENS = r"(\p{Nd}+|[\p{L}\p{Nl}\p{No}]+|[()]|[^\p{L}\p{N}()]+)"
_TOK = r"(\p{Nd}+|[\p{L}\p{Nl}\p{No}]+)"


def _tokens_sql(source: str, keys: str, pattern: str = _PIECES, keep: str = r"^[\p{L}\p{N}]", shift: str = "0") -> str:
    """SQL of (keys, i, token, start_, end_) of the texts of ``source``."""
    return rf"""(SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY pos) - 1 AS i, piece AS token, stop - length(piece) + shift AS start_, stop + shift AS end_ FROM (
      SELECT {keys}, pos, piece, shift, sum(length(piece)) OVER (PARTITION BY {keys} ORDER BY pos) AS stop FROM (
        SELECT {keys}, {shift} AS shift, unnest(p) AS piece, generate_subscripts(p, 1) AS pos FROM (SELECT *, regexp_extract_all(text, '{pattern}', 1) AS p FROM {source}))) WHERE regexp_matches(piece, '{keep}'))"""


_SECTIONS = """
secs AS (SELECT article_id AS doc_id, row_number() OVER (PARTITION BY article_id ORDER BY passage_offset, passage_id) - 1 AS sec_id, coalesce(type, '') AS type, text, passage_offset AS start_ FROM (
  SELECT passage_id, x.a AS article_id, x.o AS passage_offset, x.t AS text, x.k AS type FROM (
    SELECT passage_id, min({'a': article_id, 'o': CASE WHEN text IS NULL THEN ss[1].o ELSE passage_offset END, 't': coalesce(text, array_to_string(list_transform(ss, lambda s, i: s.t || repeat(' ', greatest(coalesce(ss[i + 1].o - s.o - length(s.t), 0), 0))), '')), 'k': map_extract(infons, 'type')[1]}) AS x
    FROM (SELECT *, list_sort(list_transform(sentences, lambda s: {'o': s.char_offset, 't': coalesce(s.text, '')})) AS ss FROM passages WHERE text IS NOT NULL OR sentences IS NOT NULL) GROUP BY passage_id)))
"""
_SENTENCES = r"""
cuts AS (SELECT doc_id, sec_id, type, start_, pos, piece, coalesce(sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, sec_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent_id FROM (
  SELECT *, regexp_matches(piece, '^[.?!]+["'')\]]*[ \t\n\r\f]+$') AND NOT regexp_matches(coalesce(lead(piece) OVER (PARTITION BY doc_id, sec_id ORDER BY pos), ''), '^\p{Ll}') AS brk FROM (
    SELECT doc_id, sec_id, type, start_, unnest(p) AS piece, generate_subscripts(p, 1) AS pos FROM (SELECT *, regexp_extract_all(text, '([^.?!]+|[.?!]+["'')\]]*[ \t\n\r\f]+|[.?!]+["'')\]]*)', 1) AS p FROM secs)))),
parts AS (SELECT doc_id, sec_id, type, start_, sent_id, string_agg(piece, '' ORDER BY pos) AS text FROM cuts GROUP BY ALL),
sents AS (SELECT doc_id, sec_id, CAST(sent_id AS INTEGER) AS sent_id, type, text, CAST(stop - length(text) AS INTEGER) AS start_, CAST(stop AS INTEGER) AS end_, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec_id, sent_id) AS INTEGER) AS sent_no FROM (
  SELECT *, start_ + sum(length(text)) OVER (PARTITION BY doc_id, sec_id ORDER BY sent_id) AS stop FROM parts))
"""
_INDEX = rf"""
idx AS (SELECT DISTINCT length(t) AS n, lower(t[1]) AS first_, array_to_string(list_transform(t, lambda x: lower(x)), chr(1)) AS key, entity_type AS type, preferred_form, resource_name AS original_resource, native_id, cui AS umls_cui
  FROM (SELECT *, regexp_extract_all(term, '{_TOK}', 1) AS t FROM termlist) WHERE length(t) > 0),
firsts AS (SELECT DISTINCT first_, n FROM idx)
"""


def _match_sql(keys: str, key: str = "norm") -> str:
    return rf"""
lists AS (SELECT {keys}, list(lower(token) ORDER BY i) AS norms, list(token ORDER BY i) AS toks, list(start_ ORDER BY i) AS ss, list(end_ ORDER BY i) AS es FROM tok GROUP BY ALL),
grams AS (SELECT {keys}, ss[i] AS start_, es[i + n - 1] AS end_, array_to_string(norms[i:i + n - 1], chr(1)) AS norm, array_to_string(toks[i:i + n - 1], chr(1)) AS exact FROM (
  SELECT l.*, f.n, u.i FROM (SELECT *, generate_subscripts(norms, 1) AS i FROM lists) u JOIN firsts f ON f.first_ = u.norms[u.i] JOIN lists l USING ({keys})) WHERE i + n - 1 <= length(norms)),
hits AS (SELECT {keys}, CAST(start_ AS INTEGER) AS start_, CAST(end_ AS INTEGER) AS end_, type, preferred_form, original_resource, native_id, umls_cui FROM grams JOIN idx ON idx.key = {key})
"""


_DOCS = "docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"
_DOC_TOKENS = f"WITH {_DOCS}, tok AS {_tokens_sql('docs', 'doc_id')}"
_DOC_HITS = f"{_DOC_TOKENS}, {_INDEX}, {_match_sql('doc_id')}"
_ENTITIES = f"""WITH {_SECTIONS}, {_SENTENCES}, src AS (SELECT doc_id, sec_id, sent_id, text, start_ AS shift0 FROM sents), tok AS {_tokens_sql("src", "doc_id, sec_id, sent_id", shift="shift0")}, {_INDEX}, {_match_sql("doc_id, sec_id, sent_id").replace("hits AS (SELECT doc_id, sec_id, sent_id,", "hits0 AS (SELECT doc_id, sec_id, sent_id,")},
ents AS (SELECT h.doc_id, h.sec_id, h.sent_id, s.sent_no, s.type AS section_type, CAST(row_number() OVER (PARTITION BY h.doc_id ORDER BY sent_no, h.start_, h.end_, h.type NULLS FIRST, preferred_form NULLS FIRST, original_resource NULLS FIRST, native_id NULLS FIRST, umls_cui NULLS FIRST) AS VARCHAR) AS id,
  substring(s.text, h.start_ - s.start_ + 1, h.end_ - h.start_) AS text, h.start_, h.end_, h.type, preferred_form, original_resource, native_id, umls_cui FROM hits0 h JOIN sents s USING (doc_id, sec_id, sent_id))
"""


# ---- text functions


@query(f"{_DOC_TOKENS} SELECT doc_id, CAST(i AS INTEGER) AS tok_id, token, CAST(start_ AS INTEGER) AS start_, CAST(end_ AS INTEGER) AS end_ FROM tok")
def tok_spans(spark, sf_dir):
    t = recognize.token_spans(spread(docs(spark, sf_dir)))
    return t.select("doc_id", F.posexplode("tokens").alias("tok_id", "t")).select("doc_id", "tok_id", "t.token", F.col("t.start").alias("start_"), F.col("t.end").alias("end_"))


@query(f"WITH {_DOCS}, tok AS {_tokens_sql('docs', 'doc_id', _PARENS, r'^[\p{L}\p{N}()]')} SELECT token, count(*) AS n, CAST(sum(start_) AS BIGINT) AS places FROM tok GROUP BY token")
def tok_with_parens(spark, sf_dir):
    t = recognize.token_spans(spread(docs(spark, sf_dir)), pattern=T.TOKEN_PARENS)
    return t.select(F.explode("tokens").alias("t")).groupBy("t.token").agg(F.count("*").alias("n"), F.sum("t.start").alias("places"))


def _vocabulary(spark, sf_dir):
    return docs(spark, sf_dir).select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


_VOCABULARY = rf"WITH voc AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_TOK}', 1)) AS token FROM documents WHERE text IS NOT NULL) GROUP BY token)"


@query(f"{_VOCABULARY} SELECT lower(token) AS norm, CAST(sum(n) AS BIGINT) AS n FROM voc GROUP BY 1")
def norm_lower(spark, sf_dir):
    return _vocabulary(spark, sf_dir).groupBy(T.normalise(F.col("token")).alias("norm")).agg(F.sum("n").alias("n"))


@query(rf"{_VOCABULARY} SELECT token, regexp_replace(token, '([iy])s(e[sd]?|ing|ations?)\b', '\1z\2', 'g') AS norm FROM voc WHERE regexp_replace(token, '([iy])s(e[sd]?|ing|ations?)\b', '\1z\2', 'g') <> token")
def norm_ise(spark, sf_dir):
    v = _vocabulary(spark, sf_dir).select("token", T.ise(F.col("token")).alias("norm"))
    return v.where("norm <> token")


_greek_sql = "token"
for _k, _v in T.GREEK.items():
    _greek_sql = f"replace({_greek_sql}, '{_k}', '{_v}')"


@query(f"{_VOCABULARY} SELECT token, {_greek_sql} AS norm FROM voc WHERE {_greek_sql} <> token")
def norm_greek(spark, sf_dir):
    v = _vocabulary(spark, sf_dir).select("token", T.greektranslit(F.col("token")).alias("norm"))
    return v.where("norm <> token")


@query(rf"{_VOCABULARY} SELECT CASE WHEN regexp_matches(token, '^[\p{{Nd}}²³¹⁰-⁹₀-₉]+$') THEN '0' ELSE lower(token) END AS norm, CAST(sum(n) AS BIGINT) AS n FROM voc GROUP BY 1")
def norm_mask_digits(spark, sf_dir):
    v = _vocabulary(spark, sf_dir)
    return v.groupBy(T.normalise(F.col("token"), "mask-0-digits lowercase").alias("norm")).agg(F.sum("n").alias("n"))


@query("SELECT DISTINCT passage_id, nfc_normalize(text) AS norm FROM passages WHERE nfc_normalize(text) <> text")
def norm_unicode_nfc(spark, sf_dir):
    """Of whole texts, as tokens hold no combining marks."""
    v = read(spark, sf_dir, "passages").select("passage_id", "text", T.normalise(F.col("text"), "unicode-NFC").alias("norm"))
    return v.where("norm <> text").select("passage_id", "norm").distinct()


@query()
def norm_stem_porter(spark, sf_dir):
    return _vocabulary(spark, sf_dir).groupBy(T.normalise(F.col("token"), "stem-porter").alias("norm")).agg(F.sum("n").alias("n"))


@query()
def norm_stem_lancaster(spark, sf_dir):
    return _vocabulary(spark, sf_dir).groupBy(T.normalise(F.col("token"), "lowercase stem-lancaster").alias("norm")).agg(F.sum("n").alias("n"))


@query(f"{_DOC_TOKENS} SELECT d.doc_id, count(*) AS n, CAST(sum(strlen(substring(d.text, 1, CAST(start_ AS BIGINT)))) AS BIGINT) AS byte_starts FROM tok JOIN docs d USING (doc_id) GROUP BY 1")
def byte_offsets(spark, sf_dir):
    t = recognize.token_spans(spread(docs(spark, sf_dir))).where("size(tokens) > 0")
    places = t.select("doc_id", T.byte_places(F.col("text"), F.transform("tokens", lambda x: x["start"])).alias("p"))
    return places.select("doc_id", F.size("p").cast("bigint").alias("n"), F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("byte_starts"))


@query(r"SELECT doc_id, regexp_replace(text, '\s', ' ', 'g') AS line FROM documents WHERE text IS NOT NULL")
def text_one_line(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.one_line(F.col("text")).alias("line"))


_SECTION_SQL = r"""WITH parts AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '(\S[^\S\n]*\n(?:[^\S\n]*\n)+)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL))
SELECT doc_id, CAST(k - 1 AS INTEGER) AS sec_id, CAST(stop - length(text) AS INTEGER) AS start_, CAST(stop AS INTEGER) AS end_ FROM (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM parts)"""


@query(_SECTION_SQL)
def sections_blankline(spark, sf_dir):
    s = segments.explode_parts(docs(spark, sf_dir), segments.sections(F.col("text")), "sec_id")
    return s.select("doc_id", "sec_id", F.col("start").alias("start_"), F.col("end").alias("end_"))


@query(r"""WITH parts AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '([^\n]*\n|[^\n]+)', 1) AS p FROM documents WHERE text IS NOT NULL))
SELECT doc_id, CAST(k - 1 AS INTEGER) AS sent_id, CAST(stop - length(text) AS INTEGER) AS start_, CAST(stop AS INTEGER) AS end_ FROM (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM parts)""")
def sentences_given_lines(spark, sf_dir):
    s = segments.explode_parts(docs(spark, sf_dir), segments.given_lines(F.col("text")), "sent_id")
    return s.select("doc_id", "sent_id", F.col("start").alias("start_"), F.col("end").alias("end_"))


@query(f"WITH {_SECTIONS}, {_SENTENCES} SELECT doc_id, CAST(sec_id AS INTEGER) AS sec_id, sent_id, sent_no, text, start_, end_ FROM sents")
def sentences_rule(spark, sf_dir):
    return corpus(spark, sf_dir).sentences.select("doc_id", "sec_id", "sent_id", "sent_no", "text", F.col("start").alias("start_"), F.col("end").alias("end_"))


@query(f"WITH {_SECTIONS}, {_SENTENCES} SELECT doc_id, 'S' || sent_no AS sentence, type FROM sents")
def sentence_numbering(spark, sf_dir):
    return corpus(spark, sf_dir).sentences.select("doc_id", F.concat(F.lit("S"), F.col("sent_no").cast("string")).alias("sentence"), "type")


# ---- dictionaries and recognition


@query(f"WITH {_INDEX} SELECT CAST(n AS INTEGER) AS n_toks, first_, replace(key, chr(1), ' ') AS key, type, preferred_form, original_resource, native_id, umls_cui FROM idx")
def termlist_bth(spark, sf_dir):
    line = F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in ("cui", "resource_name", "native_id", "term", "preferred_form", "entity_type")])
    fields = read(spark, sf_dir, "termlist").select(termlist.fields_of_line(F.replace(line, F.lit("\\"), F.lit("\\\\"))).alias("fields"))
    return termlist.build_index(termlist.from_fields(fields, "bth")).select("n_toks", F.col("first").alias("first_"), F.replace("key", F.lit(T.GAP), F.lit(" ")).alias("key"), *INFO)


@query("SELECT DISTINCT native_id, term, entity_type AS type, preferred_form, 'unknown' AS original_resource, 'none' AS umls_cui FROM termlist")
def termlist_4(spark, sf_dir):
    fields = read(spark, sf_dir, "termlist").select(F.array("native_id", "term", "entity_type", "preferred_form").alias("fields"))
    return termlist.from_fields(fields, "4").distinct()


@query("SELECT DISTINCT native_id, term, entity_type AS type, preferred_form, resource_name AS original_resource, cui AS umls_cui FROM termlist")
def termlist_6(spark, sf_dir):
    fields = read(spark, sf_dir, "termlist").select(F.array("native_id", "term", "entity_type", "preferred_form", "resource_name", "cui").alias("fields"))
    return termlist.from_fields(fields, "6").distinct()


@query(f"WITH {_INDEX} SELECT first_, array_to_string(list_sort(list(DISTINCT n)), ',') AS lengths FROM idx GROUP BY 1")
def termlist_lengths(spark, sf_dir):
    index = termlist.first_index(termlist.build_index(terms(spark, sf_dir)))
    return index.select(F.col("first").alias("first_"), F.array_join("lengths", ",").alias("lengths"))


def _out(e: DataFrame, *keys: str) -> DataFrame:
    return e.select(*keys, F.col("start").alias("start_"), F.col("end").alias("end_"), "text", *INFO)


@query(f"{_DOC_HITS} SELECT doc_id, start_, end_, substring(text, start_ + 1, end_ - start_) AS text, type, preferred_form, original_resource, native_id, umls_cui FROM hits JOIN docs USING (doc_id)")
def er_match_basic(spark, sf_dir):
    index = termlist.build_index(terms(spark, sf_dir))
    return _out(recognize.recognise(spread(docs(spark, sf_dir)), index, ["doc_id"]), "doc_id")


_STOP_SQL = "('gda' || chr(1) || '27', 'type')"


@query(
    f"{_DOC_TOKENS}, {_INDEX.replace('idx AS (', 'idx0 AS (').replace('array_to_string(list_transform(t, lambda x: lower(x)), chr(1)) AS key', 'array_to_string(list_transform(t, lambda x: lower(x)), chr(1)) AS norm, array_to_string(t, chr(1)) AS exact').replace('firsts AS (SELECT DISTINCT first_, n FROM idx)', f'idx AS (SELECT DISTINCT n, first_, CASE WHEN norm IN {_STOP_SQL} THEN exact ELSE norm END AS key, type, preferred_form, original_resource, native_id, umls_cui FROM idx0), firsts AS (SELECT DISTINCT first_, n FROM idx)')}, "
    f"{_match_sql('doc_id', f'(CASE WHEN norm IN {_STOP_SQL} THEN exact ELSE norm END)')} SELECT doc_id, start_, end_, type, native_id, umls_cui, preferred_form, original_resource FROM hits"
)
def er_match_stopwords(spark, sf_dir):
    index = termlist.build_index(terms(spark, sf_dir), stopwords=STOP)
    return _out(recognize.recognise(spread(docs(spark, sf_dir)), index, ["doc_id"]), "doc_id").drop("text")


@query(f"{_ENTITIES} SELECT doc_id, CAST(sec_id AS INTEGER) AS sec_id, sent_id, id, start_, end_, text, type, preferred_form, original_resource, native_id, umls_cui FROM ents")
def er_match_sentence_bounded(spark, sf_dir):
    return _out(annotated(spark, sf_dir).entities, "doc_id", "sec_id", "sent_id", "id")


@query(f"{_DOC_HITS}, parts AS (SELECT *, 0 AS r FROM hits WHERE type = 'Gene' UNION ALL SELECT *, 1 FROM hits WHERE type <> 'Gene') SELECT doc_id, start_, end_, native_id, umls_cui, preferred_form, type, original_resource, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_, end_, r, type NULLS FIRST, preferred_form NULLS FIRST, original_resource NULLS FIRST, native_id NULLS FIRST, umls_cui NULLS FIRST) AS VARCHAR) AS id FROM parts")
def er_multi_recognizer(spark, sf_dir):
    t = terms(spark, sf_dir)
    indices = [termlist.build_index(t.where("type = 'Gene'")), termlist.build_index(t.where("type <> 'Gene'"))]
    e = recognize.with_ids(recognize.recognise_all(spread(docs(spark, sf_dir)), indices, ["doc_id"]), ["doc_id"], recognize.entity_order())
    return _out(e, "doc_id", "id").drop("text")


_ONCE = "once AS (SELECT anno_key, x.a AS doc_id, x.i AS id, x.t AS text, s.char_offset AS start_, s.char_offset + s.span_length AS end_, x.k AS type, x.c AS native_id FROM (SELECT *, unnest(CASE WHEN len(x.l) > 0 THEN x.l ELSE [NULL] END) AS s FROM (SELECT anno_key, min({'r': received_at, 'a': article_id, 'i': id, 't': text, 'l': locations, 'k': entity_type, 'c': native_id}) AS x FROM annotations GROUP BY anno_key)))"


def gold(spark, sf_dir) -> DataFrame:
    """The annotations as entities: one for each span of a key, or one without a place."""
    a = read(spark, sf_dir, "annotations")
    row = F.struct("received_at", "article_id", "id", "text", "locations", "entity_type", "native_id")
    x = a.groupBy("anno_key").agg(F.min(row).alias("x")).select("x", F.explode_outer("x.locations").alias("s"))
    return x.select(F.col("x.article_id").alias("doc_id"), "x.id", "x.text", F.col("s.char_offset").alias("start"), (F.col("s.char_offset") + F.col("s.span_length")).alias("end"), F.col("x.entity_type").alias("type"), "x.native_id", *[F.lit(None).cast("string").alias(f) for f in ("preferred_form", "original_resource", "umls_cui")])


@query(f"WITH {_SECTIONS}, {_SENTENCES}, {_ONCE} SELECT o.doc_id, o.id, CAST(sec_id AS INTEGER) AS sec_id, sent_id, o.start_, o.end_ FROM once o JOIN sents s ON s.doc_id = o.doc_id AND o.start_ >= s.start_ AND o.start_ < s.end_")
def assign_annotation_to_sentence(spark, sf_dir):
    placed = C.assign_to_sentences(gold(spark, sf_dir).where("start is not null"), corpus(spark, sf_dir).sentences)
    return placed.select("doc_id", "id", "sec_id", "sent_id", F.col("start").alias("start_"), F.col("end").alias("end_"))


@query(
    f"""{_ENTITIES}, {_ONCE}, last AS (SELECT doc_id, max(TRY_CAST(id AS BIGINT)) AS m FROM once GROUP BY 1)
SELECT doc_id, CAST(CAST(id AS BIGINT) + coalesce(m, 0) AS VARCHAR) AS id, start_, end_, native_id FROM ents LEFT JOIN last USING (doc_id)"""
)
def er_entity_ids(spark, sf_dir):
    e = annotated(spark, sf_dir).entities.drop("id").withColumn("recognizer", F.lit(0))
    ids = recognize.with_ids(e, ["doc_id"], ["sent_no", "start", "end", *INFO], gold(spark, sf_dir).select("doc_id", "id"))
    return ids.select("doc_id", "id", F.col("start").alias("start_"), F.col("end").alias("end_"), "native_id")


@query()
def er_abbrev(spark, sf_dir):
    index = termlist.build_index(terms(spark, sf_dir), pattern=T.TOKEN_PARENS)
    return abbreviations.recognise_abbreviations(corpus(spark, sf_dir).sentences.withColumn("sent_id", F.col("sent_no")), index, start="start").withColumnsRenamed({"start": "start_", "end": "end_"})


@query(
    f"""WITH src AS (SELECT term AS doc_id, min(term || ' (' || {"translate(native_id, '0123456789:_-', 'abcdefghij')"} || ') was seen') AS text FROM termlist WHERE native_id IS NOT NULL GROUP BY 1), tok AS {_tokens_sql("src", "doc_id", _PARENS, r"^[\p{L}\p{N}()]")}, {_INDEX.replace(_TOK, r"(\p{Nd}+|[\p{L}\p{Nl}\p{No}]+|[()])")}, {_match_sql("doc_id")}
SELECT DISTINCT h.doc_id, b.token AS short, CAST(b.start_ AS INTEGER) AS place, h.native_id FROM hits h JOIN tok e ON e.doc_id = h.doc_id AND e.end_ = h.end_
JOIN tok a ON a.doc_id = h.doc_id AND a.i = e.i + 1 AND a.token = '(' JOIN tok b ON b.doc_id = h.doc_id AND b.i = e.i + 2 JOIN tok c ON c.doc_id = h.doc_id AND c.i = e.i + 3 AND c.token = ')'"""
)
def er_abbrev_one_level(spark, sf_dir):
    """Each term of the dictionary, defined with a name in parentheses."""
    index = termlist.build_index(terms(spark, sf_dir), pattern=T.TOKEN_PARENS)
    t = read(spark, sf_dir, "termlist")
    short = F.translate("native_id", "0123456789:_-", "abcdefghij")
    s = t.select(F.col("term").alias("doc_id"), F.concat("term", F.lit(" ("), short, F.lit(") was seen")).alias("text")).where("text is not null").distinct().groupBy("doc_id").agg(F.min("text").alias("text"))
    spans = recognize.token_spans(s.select("doc_id", F.lit(1).alias("sent_id"), "text"), pattern=T.TOKEN_PARENS)
    hits = recognize.match(spans.select("doc_id", "sent_id", "tokens"), index, ["doc_id", "sent_id"])
    toks = spans.select("doc_id", "sent_id", F.posexplode("tokens").alias("i", "t")).select("doc_id", "sent_id", "i", "t.token", "t.start", "t.end")
    return abbreviations.definitions(toks, hits).select("doc_id", "short", "place", "native_id").distinct()


# ---- filters


def _filtered(spark, sf_dir, name: str) -> DataFrame:
    e = postfilters.apply_filters(annotated(spark, sf_dir).entities, [name], ["doc_id", "sec_id", "sent_id"])
    return e.select("doc_id", "id", F.col("start").alias("start_"), F.col("end").alias("end_"), "type")


def _overlaps_sql(by: str) -> str:
    return f"""{_ENTITIES}, a AS (SELECT *, CASE WHEN start_ < max(end_) OVER (PARTITION BY {by} ORDER BY start_, end_, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ents),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY {by} ORDER BY start_, end_, id) AS chain FROM a), c AS (SELECT *, max(end_ - start_) OVER (PARTITION BY {by}, chain) AS longest FROM b)
SELECT doc_id, id, start_, end_, type FROM c WHERE end_ - start_ = longest"""


def _submatches_sql(more: str) -> str:
    return f"""{_ENTITIES} SELECT doc_id, id, start_, end_, type FROM ents a WHERE NOT EXISTS (SELECT 1 FROM ents b WHERE b.doc_id = a.doc_id AND b.sec_id = a.sec_id AND b.sent_id = a.sent_id {more}
AND ((b.start_ <= a.start_ AND b.end_ > a.end_) OR (b.start_ < a.start_ AND b.end_ >= a.end_)))"""


@query(_overlaps_sql("doc_id, sec_id, sent_id"))
def post_remove_overlaps(spark, sf_dir):
    return _filtered(spark, sf_dir, "remove_overlaps")


@query(_overlaps_sql("doc_id, sec_id, sent_id, type"))
def post_remove_sametype_overlaps(spark, sf_dir):
    return _filtered(spark, sf_dir, "remove_sametype_overlaps")


@query(_submatches_sql(""))
def post_remove_submatches(spark, sf_dir):
    return _filtered(spark, sf_dir, "remove_submatches")


@query(_submatches_sql("AND b.type = a.type"))
def post_remove_sametype_submatches(spark, sf_dir):
    return _filtered(spark, sf_dir, "remove_sametype_submatches")


_FP_WORDS = "|".join([*postfilters.STOPWORDS, *[w.title() for w in postfilters.STOPWORDS if len(w) > 1]])
_FP_SQL = rf"(regexp_matches(text, '^(?:{_FP_WORDS})[^\p{{L}}\p{{N}}_]+\p{{Nd}}+$') OR regexp_matches(text, '^μ[A-Za-z](?:[^\p{{L}}\p{{N}}_]|\p{{Nd}})*$') OR lower(text) IN ('to a', 'a 3d', '') OR regexp_matches(text, '[<=>]'))"


@query(f"{_DOC_TOKENS}, pairs AS (SELECT a.doc_id, substring(d.text, CAST(a.start_ AS BIGINT) + 1, CAST(b.end_ - a.start_ AS BIGINT)) AS text FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.i = a.i + 1 JOIN docs d ON d.doc_id = a.doc_id) SELECT text, count(*) AS n FROM pairs WHERE {_FP_SQL} GROUP BY text")
def post_frequent_fp(spark, sf_dir):
    """The filter on the surfaces of all token pairs, as names seldom are such."""
    t = recognize.token_spans(spread(docs(spark, sf_dir)))
    pairs = t.select(F.explode(F.arrays_zip(F.col("tokens").alias("a"), F.slice("tokens", F.lit(2), F.greatest(F.size("tokens") - 1, F.lit(0))).alias("b"))).alias("p")).where("p.b is not null")
    return pairs.select(F.concat("p.a.token", "p.a.gap", "p.b.token").alias("text")).where(postfilters.is_frequent_false(F.col("text"))).groupBy("text").agg(F.count("*").alias("n"))


@query(f"{_ENTITIES} SELECT doc_id, id, text FROM ents WHERE length(text) >= 6")
def post_remove_short(spark, sf_dir):
    return postfilters.remove_short(annotated(spark, sf_dir).entities, 6).select("doc_id", "id", "text")


@query(f"{_ENTITIES} SELECT doc_id, id, 'corpus' AS original_resource FROM ents")
def post_change_origin(spark, sf_dir):
    return postfilters.change_origin(annotated(spark, sf_dir).entities, "corpus").select("doc_id", "id", "original_resource")


# ---- evaluation


_RECORDS = f"{_ENTITIES}, {_ONCE}, g AS (SELECT DISTINCT doc_id, start_, end_, native_id FROM once WHERE start_ IS NOT NULL), f AS (SELECT DISTINCT doc_id, start_, end_, native_id FROM ents), verdicts AS (SELECT doc_id, start_, end_, native_id, CASE WHEN max(g) + max(f) = 2 THEN 'TP' WHEN max(f) = 1 THEN 'FP' ELSE 'FN' END AS verdict FROM (SELECT *, 1 AS g, 0 AS f FROM g UNION ALL SELECT *, 0, 1 FROM f) GROUP BY 1, 2, 3, 4)"
_COUNTS = "count(*) FILTER (WHERE verdict = 'TP')::DOUBLE AS tp, count(*) FILTER (WHERE verdict = 'FP')::DOUBLE AS fp, count(*) FILTER (WHERE verdict = 'FN')::DOUBLE AS fn"
_P, _R = "(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END)", "(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END)"
_F1 = f"(CASE WHEN {_P} + {_R} = 0 THEN 0 ELSE 2 * {_P} * {_R} / ({_P} + {_R}) END)"


def _verdicts(spark, sf_dir) -> DataFrame:
    found = annotated(spark, sf_dir).entities.select("doc_id", "start", "end", "native_id")
    return evaluation.judged(gold(spark, sf_dir).where("start is not null"), found, ["doc_id", "start", "end", "native_id"])


@query(f"{_RECORDS} SELECT * FROM verdicts")
def eval_records(spark, sf_dir):
    return _verdicts(spark, sf_dir).withColumnsRenamed({"start": "start_", "end": "end_"})


@query(f"{_RECORDS}, c AS (SELECT {_COUNTS} FROM verdicts) SELECT tp, fp, fn, round({_P}, 6) AS p, round({_R}, 6) AS r, round({_F1}, 6) AS f1 FROM c")
def eval_strict_micro(spark, sf_dir):
    return evaluation.scores(evaluation.counts(_verdicts(spark, sf_dir)))


@query(f"{_RECORDS}, c AS (SELECT doc_id, {_COUNTS} FROM verdicts GROUP BY 1) SELECT round(avg(round({_P}, 6)), 6) AS p, round(avg(round({_R}, 6)), 6) AS r, round(avg(round({_F1}, 6)), 6) AS f1, count(*) AS documents FROM c")
def eval_macro(spark, sf_dir):
    return evaluation.macro(evaluation.counts(_verdicts(spark, sf_dir), ["doc_id"]))


@query()
def eval_lenient(spark, sf_dir):
    v = evaluation.partial_positives(_verdicts(spark, sf_dir), ["doc_id", "native_id"])
    return evaluation.scores(evaluation.counts(v, measure="lenient"))


@query(f"{_RECORDS} SELECT a.doc_id, a.native_id, a.start_ AS g_start, a.end_ AS g_end, b.start_, b.end_ FROM verdicts a JOIN verdicts b ON a.doc_id = b.doc_id AND a.native_id = b.native_id AND a.verdict = 'FN' AND b.verdict = 'FP' AND greatest(a.start_, b.start_) < least(a.end_, b.end_)")
def eval_partial_candidates(spark, sf_dir):
    v = _verdicts(spark, sf_dir)
    fn = v.where("verdict = 'FN'").select("doc_id", "native_id", F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    fp = v.where("verdict = 'FP'").select("doc_id", "native_id", F.col("start").alias("start_"), F.col("end").alias("end_"))
    return fn.join(fp, ["doc_id", "native_id"]).where(F.greatest("g_start", "start_") < F.least("g_end", "end_"))


@query(
    f"""{_ENTITIES}, many AS (SELECT anno_key, x.a AS doc_id, x.l AS l FROM (SELECT anno_key, min({{'a': article_id, 'l': locations}}) AS x FROM annotations GROUP BY anno_key) WHERE length(x.l) > 1)
SELECT a.anno_key AS a_key, e.id AS e_id FROM many a JOIN ents e ON a.doc_id = e.doc_id AND EXISTS (SELECT 1 FROM (SELECT unnest(a.l) AS s) x WHERE greatest(s.char_offset, e.start_) < least(s.char_offset + s.span_length, e.end_))"""
)
def eval_multispan_overlap(spark, sf_dir):
    """Annotations of several spans and the recognised entities that any of their spans meets; lists of offsets as evaluation files have them."""
    a = read(spark, sf_dir, "annotations").groupBy("anno_key").agg(F.min(F.struct("article_id", "locations")).alias("x")).where("size(x.locations) > 1")
    many = a.select("anno_key", F.col("x.article_id").alias("doc_id"), F.array_join(F.transform("x.locations", lambda s: s["char_offset"].cast("string")), ";").alias("starts"), F.array_join(F.transform("x.locations", lambda s: (s["char_offset"] + s["span_length"]).cast("string")), "; ").alias("ends"))
    e = annotated(spark, sf_dir).entities.select("doc_id", F.col("id").alias("e_id"), F.col("start").cast("string").alias("e_starts"), F.col("end").cast("string").alias("e_ends"))
    return many.join(e, "doc_id").where(evaluation.spans_overlap(F.col("starts"), F.col("ends"), F.col("e_starts"), F.col("e_ends"))).select(F.col("anno_key").alias("a_key"), "e_id")


@query("SELECT DISTINCT doc_id::VARCHAR || chr(9) || coalesce(lang, '') || chr(9) || coalesce(source, '') AS line, coalesce(source, '') || '|' || doc_id::VARCHAR AS record FROM documents")
def eval_field_selection(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))).alias("line")).distinct()
    return evaluation.selected(lines, ["3,1"]).select("line", F.array_join("record", "|").alias("record"))


# ---- formats

_WORDS = r"(\s+|[\p{L}\p{N}\p{M}_]+|[^\s\p{L}\p{N}\p{M}_]+)"
_WORD_TOKENS = f"words AS {_tokens_sql('src', 'doc_id, sec_id, sent_id', r'([\p{L}\p{N}_]+|\s+|[^\p{L}\p{N}_\s]+)', r'^\S', 'shift0')}"
#: Words and runs of other visible signs as Python's \\w has them, marks apart.
_WORDS_SQL, _WORD_START = r"([\p{L}\p{N}_]+|[\s\p{Z}\x1c-\x1f\x{85}]+|[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x{85}]+)", r"^[^\s\p{Z}\x1c-\x1f\x{85}]"
_TSV = "SELECT doc_id, type, start_, end_, regexp_replace(text, '\\s', ' ', 'g') AS term, preferred_form, native_id, section_type AS zone, 'S' || sent_no AS sentence, original_resource, umls_cui FROM ents"


@query(f"{_ENTITIES} {_TSV}")
def sink_tsv(spark, sf_dir):
    return L.tsv(annotated(spark, sf_dir)).withColumnsRenamed({"start": "start_", "end": "end_"})


@query(
    f"""{_ENTITIES}, wsrc AS (SELECT doc_id, sec_id, sent_id, sent_no, text, start_ AS shift0 FROM sents), words AS {_tokens_sql("wsrc", "doc_id, sec_id, sent_id, sent_no", _WORDS_SQL, _WORD_START, "shift0")}
{_TSV} UNION ALL SELECT w.doc_id, '', w.start_, w.end_, w.token, '', '', '', 'S' || w.sent_no, '', '' FROM words w WHERE NOT EXISTS (SELECT 1 FROM ents e WHERE e.doc_id = w.doc_id AND e.sec_id = w.sec_id AND e.sent_id = w.sent_id AND greatest(e.start_, w.start_) < least(e.end_, w.end_))"""
)
def sink_text_tsv(spark, sf_dir):
    return L.text_tsv(annotated(spark, sf_dir)).withColumnsRenamed({"start": "start_", "end": "end_"})


@query(f"{_ENTITIES} SELECT doc_id, 'T' || row_number() OVER (PARTITION BY doc_id ORDER BY sent_no, start_, end_, CAST(id AS BIGINT)) || chr(9) || coalesce(native_id, '') || ' ' || start_ || ' ' || end_ || chr(9) || regexp_replace(text, '\\s', ' ', 'g') AS line FROM ents")
def sink_bionlp(spark, sf_dir):
    return L.bionlp(annotated(spark, sf_dir)).select("doc_id", "line")


@query(f"{_ENTITIES}, m AS (SELECT doc_id, start_, end_, regexp_replace(coalesce(type, ''), '[^\\p{{L}}\\p{{N}}_]+', '_', 'g') AS name, regexp_replace(text, '\\s', ' ', 'g') AS text FROM ents GROUP BY ALL) SELECT doc_id, 'T' || row_number() OVER (PARTITION BY doc_id ORDER BY start_, end_, name, text) || chr(9) || name || ' ' || start_ || ' ' || end_ || chr(9) || text AS line FROM m")
def sink_brat_t(spark, sf_dir):
    return L.brat(annotated(spark, sf_dir)).where("part = 0").select("doc_id", "line")


@query(
    f"""{_ENTITIES}, m AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY start_, end_, name, line_text) AS t FROM (SELECT *, regexp_replace(coalesce(type, ''), '[^\\p{{L}}\\p{{N}}_]+', '_', 'g') AS name, regexp_replace(text, '\\s', ' ', 'g') AS line_text FROM ents)),
each AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY t, sent_no, id, type NULLS FIRST, preferred_form NULLS FIRST, original_resource NULLS FIRST, native_id NULLS FIRST, umls_cui NULLS FIRST) AS n FROM m)
SELECT DISTINCT doc_id, CAST(t AS INTEGER) AS t, CAST(0 AS INTEGER) AS n, CAST(0 AS INTEGER) AS part, 'T' || t || chr(9) || name || ' ' || start_ || ' ' || end_ || chr(9) || line_text AS line FROM m
UNION ALL SELECT doc_id, t, n, 1, '#' || n || chr(9) || 'AnnotatorNotes T' || t || chr(9) || coalesce(preferred_form, '') || chr(9) || coalesce(original_resource, '') || chr(9) || coalesce(native_id, '') || chr(9) || coalesce(umls_cui, '') FROM each
UNION ALL SELECT doc_id, t, n, 2, 'A' || row_number() OVER (PARTITION BY doc_id ORDER BY n) || chr(9) || 'native_id T' || t || ' ' || native_id FROM each WHERE native_id <> ''"""
)
def sink_brat(spark, sf_dir):
    return L.brat(annotated(spark, sf_dir), [("native_id", True)]).select("doc_id", "t", "n", "part", "line")


_COVERED = """, lab AS (SELECT w.doc_id, w.sec_id, w.sent_id, w.i, coalesce(string_agg(coalesce(e.native_id, ''), ';' ORDER BY e.start_, e.end_, CAST(e.id AS BIGINT)), '') AS label FROM tok w LEFT JOIN ents e ON e.doc_id = w.doc_id AND e.sec_id = w.sec_id AND e.sent_id = w.sent_id AND greatest(e.start_, w.start_) < least(e.end_, w.end_) GROUP BY ALL),
nb AS (SELECT *, lag(label, 1, '') OVER w AS b, lead(label, 1, '') OVER w AS a FROM lab WINDOW w AS (PARTITION BY doc_id, sec_id, sent_id ORDER BY i))"""


def _conll_sql(s: str, e: str) -> str:
    return f"{_ENTITIES}{_COVERED} SELECT doc_id, CAST(sec_id AS INTEGER) AS sec_id, sent_id, CAST(i AS INTEGER) AS tok_id, CASE WHEN label = '' THEN 'O' WHEN b = label AND a = label THEN 'I-' || label WHEN b = label THEN '{e}-' || label WHEN a = label THEN 'B-' || label ELSE '{s}-' || label END AS tag FROM nb"


def _conll(spark, sf_dir, tagset: str) -> DataFrame:
    """Tags of dictionary tokens, so that SQL has the same ones."""
    c = annotated(spark, sf_dir)
    return L.conll(c, tagset, pattern=T.TOKEN).select("doc_id", "sec_id", "sent_id", "tok_id", "tag")


@query(_conll_sql("S", "E"))
def sink_conll_iobes(spark, sf_dir):
    return _conll(spark, sf_dir, "IOBES")


@query(_conll_sql("B", "I"))
def sink_conll_iob(spark, sf_dir):
    return _conll(spark, sf_dir, "IOB")


@query(f"{_ENTITIES} SELECT doc_id AS document_id, CASE WHEN lower(section_type) = 'title' THEN 'T' ELSE 'A' END AS section, start_ AS init, end_, 0.5 AS score, text AS annotated_text, type, native_id AS database_id FROM ents")
def sink_becalm(spark, sf_dir):
    return L.becalm(annotated(spark, sf_dir)).withColumnRenamed("end", "end_")


@query(
    rf"""{_ENTITIES}, flat AS (SELECT *, rtrim(replace(replace(text, chr(10), ' '), chr(13), ' '), ' ') AS flat FROM secs), sh AS (SELECT *, coalesce(sum(length(flat) + 1 - length(text)) OVER (PARTITION BY doc_id ORDER BY sec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - first_value(start_) OVER (PARTITION BY doc_id ORDER BY sec_id) AS shift FROM flat)
SELECT doc_id, doc_id || '|' || CASE WHEN type = '' THEN 'x' ELSE lower(type[1]) END || '|' || flat AS line FROM sh
UNION ALL SELECT doc_id, concat_ws(chr(9), doc_id, CAST(e.start_ + shift AS INTEGER), CAST(e.end_ + shift AS INTEGER), regexp_replace(e.text, '\s', ' ', 'g'), e.type, coalesce(native_id, '')) FROM ents e JOIN sh USING (doc_id, sec_id)"""
)
def sink_pubtator(spark, sf_dir):
    return L.pubtator(annotated(spark, sf_dir)).select("doc_id", "line")


@query(
    rf"""{_ENTITIES}, flat AS (SELECT *, rtrim(replace(replace(text, chr(10), ' '), chr(13), ' '), ' ') AS flat FROM secs), sh AS (SELECT *, coalesce(sum(length(flat) + 1 - length(text)) OVER (PARTITION BY doc_id ORDER BY sec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - first_value(start_) OVER (PARTITION BY doc_id ORDER BY sec_id) AS shift FROM flat)
SELECT doc_id, doc_id || '|' || CASE WHEN type = '' THEN 'x' ELSE lower(type[1]) END || '|' || flat AS line FROM sh
UNION ALL SELECT doc_id, concat_ws(chr(9), doc_id, 'T' || e.id, e.type, CAST(e.start_ + shift AS INTEGER), CAST(e.end_ + shift AS INTEGER), regexp_replace(e.text, '\s', ' ', 'g')) FROM ents e JOIN sh USING (doc_id, sec_id)"""
)
def sink_pubtator_fbk(spark, sf_dir):
    return L.pubtator(annotated(spark, sf_dir), True).select("doc_id", "line")


_COLOCATED = ", loc AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, sec_id, sent_id ORDER BY start_, end_) AS location FROM ents)"


@query(f"{_ENTITIES}{_COLOCATED} SELECT doc_id, sent_no, CAST(location AS INTEGER) AS location, start_, end_, type, array_to_string(list_sort(list(DISTINCT coalesce(preferred_form, '') || '=' || coalesce(native_id, ''))), ';') AS tags FROM loc GROUP BY ALL")
def colocated_groups(spark, sf_dir):
    c = L.colocated(annotated(spark, sf_dir))
    tags = F.array_join(F.array_sort(F.transform("tags", lambda t: F.concat_ws("=", t["name"], t["uri"]))), ";")
    return c.select("doc_id", "sent_no", "location", F.col("start").alias("start_"), F.col("end").alias("end_"), "type", tags.alias("tags"))


@query()
def sink_europepmc(spark, sf_dir):
    return D.europepmc(annotated(spark, sf_dir))


@query(f"{_ENTITIES}{_COLOCATED} SELECT doc_id, sent_no || '.' || location AS position, substring(s.text, start_ - s.start0 + 1, end_ - start_) AS exact, CASE WHEN section_type = 'Title' THEN 'Title' ELSE 'Abstract' END AS section, type FROM loc JOIN (SELECT doc_id, sec_id, text, start_ AS start0 FROM secs) s USING (doc_id, sec_id) GROUP BY ALL")
def europepmc_rows(spark, sf_dir):
    return D.europepmc_annotations(annotated(spark, sf_dir)).select("doc_id", "position", "exact", "section", "type")


_WHOLE = "whole AS (SELECT doc_id, string_agg(padded, '' ORDER BY sec_id) AS text, min(start_) AS base FROM (SELECT *, repeat(chr(10), greatest(coalesce(start_ - lag(start_ + length(text)) OVER (PARTITION BY doc_id ORDER BY sec_id), 0), 0)) || text AS padded FROM secs) GROUP BY 1)"


def _denotations(by: str, begin: str = "0") -> str:
    return f"marks AS (SELECT {by}, list({{'id': 'T' || k, 'span': {{'begin': start_ - base, 'end': end_ - base}}, 'obj': native_id}} ORDER BY k) AS d FROM (SELECT e.*, {begin} AS base, row_number() OVER (PARTITION BY {', '.join('e.' + c for c in by.split(', '))} ORDER BY e.start_, e.end_, CAST(id AS BIGINT)) AS k FROM ents e JOIN secs s USING (doc_id, sec_id)) GROUP BY ALL)"


@query(f"{_ENTITIES}, {_WHOLE}, {_denotations('doc_id')} SELECT doc_id, CAST(to_json({{'sourceid': doc_id, 'text': text, 'denotations': coalesce(d, []), 'sourcedb': 'unknown'}}) AS VARCHAR) AS json FROM whole LEFT JOIN marks USING (doc_id)")
def sink_pubanno(spark, sf_dir):
    return D.pubannotation(annotated(spark, sf_dir))


@query(f"{_ENTITIES}, {_denotations('doc_id, sec_id', 's.start_')} SELECT doc_id, CAST(sec_id AS INTEGER) AS sec_id, CAST(to_json({{'sourceid': doc_id, 'divid': sec_id + 1, 'text': text, 'denotations': coalesce(d, []), 'sourcedb': 'unknown'}}) AS VARCHAR) AS json FROM secs LEFT JOIN marks USING (doc_id, sec_id)")
def sink_pubanno_sections(spark, sf_dir):
    return D.pubannotation_sections(annotated(spark, sf_dir))


@query(f"""{_ENTITIES} SELECT doc_id AS document_id, CAST(to_json(list({{'init': start_, 'end': end_, 'document_id': doc_id, 'section': CASE WHEN lower(section_type) = 'title' THEN 'T' ELSE 'A' END, 'score': 0.5::DOUBLE, 'annotated_text': text, 'type': type, 'database_id': native_id}}
ORDER BY start_, end_, section_type = 'Title' DESC, text, type, native_id)) AS VARCHAR) AS json FROM ents GROUP BY doc_id""")
def sink_becalm_json(spark, sf_dir):
    return D.becalm_json(annotated(spark, sf_dir))


@query(f"""{_ENTITIES}, {_WHOLE}, p AS (SELECT doc_id, count(*) AS passages FROM secs GROUP BY 1), a AS (SELECT e.doc_id, count(*) AS annotations, CAST(sum(strlen(substring(w.text, 1, CAST(e.start_ - base AS BIGINT))) + base) AS BIGINT) AS offsets, CAST(sum(strlen(e.text)) AS BIGINT) AS lengths FROM ents e JOIN whole w USING (doc_id) GROUP BY 1)
SELECT doc_id, passages, coalesce(annotations, 0) AS annotations, coalesce(offsets, 0) AS offsets, coalesce(lengths, 0) AS lengths FROM p LEFT JOIN a USING (doc_id)""")
def sink_bioc_bytes(spark, sf_dir):
    """BioC documents whose offsets count bytes, by their numbers and sums."""
    schema = "id string, passages array<struct<offset:int,annotations:array<struct<locations:array<struct<offset:int,length:int>>>>>>"
    d = D.bioc_documents(annotated(spark, sf_dir), byte_offsets=True).select(F.from_json("document", schema).alias("d"))
    places = F.flatten(F.transform("d.passages", lambda p: F.transform(p["annotations"], lambda a: a["locations"][0])))
    total = lambda f: F.aggregate(places, F.lit(0).cast("bigint"), lambda a, x: a + x[f])
    return d.select(F.col("d.id").alias("doc_id"), F.size("d.passages").cast("bigint").alias("passages"), F.size(places).cast("bigint").alias("annotations"), total("offset").alias("offsets"), total("length").alias("lengths"))


@query()
def sink_bioc_json(spark, sf_dir):
    return D.bioc_json(annotated(spark, sf_dir))


@query(f"{_ENTITIES}, p AS (SELECT doc_id, count(*) AS passages FROM secs GROUP BY 1), a AS (SELECT doc_id, count(*) AS annotations, CAST(sum(start_) AS BIGINT) AS offsets FROM ents GROUP BY 1) SELECT doc_id, passages, coalesce(annotations, 0) AS annotations, coalesce(offsets, 0) AS offsets FROM p LEFT JOIN a USING (doc_id)")
def sink_bioc_counts(spark, sf_dir):
    schema = "id string, passages array<struct<offset:int,annotations:array<struct<locations:array<struct<offset:int,length:int>>>>>>"
    d = D.bioc_documents(annotated(spark, sf_dir)).select(F.from_json("document", schema).alias("d"))
    places = F.flatten(F.transform("d.passages", lambda p: F.transform(p["annotations"], lambda a: a["locations"][0]["offset"])))
    return d.select(F.col("d.id").alias("doc_id"), F.size("d.passages").cast("bigint").alias("passages"), F.size(places).cast("bigint").alias("annotations"), F.aggregate(places, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("offsets"))


@query()
def sink_bioc_xml(spark, sf_dir):
    return D.bioc_xml(annotated(spark, sf_dir), sentence_level=True)


@query()
def sink_entity_xml(spark, sf_dir):
    return D.entity_xml(annotated(spark, sf_dir))


@query()
def sink_text_xml(spark, sf_dir):
    return D.text_xml(corpus(spark, sf_dir))


@query()
def sink_odin(spark, sf_dir):
    return D.odin_xml(annotated(spark, sf_dir))


@query(
    f"""{_ENTITIES}, a AS (SELECT *, CASE WHEN start_ < max(end_) OVER (PARTITION BY doc_id, sec_id, sent_id ORDER BY start_, end_, CAST(id AS BIGINT) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ents),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, sec_id, sent_id ORDER BY start_, end_, CAST(id AS BIGINT)) AS mention FROM a)
SELECT doc_id, CAST(sec_id AS INTEGER) AS sec_id, sent_id, CAST(min(b.start_) - min(s.start0) AS INTEGER) AS start_, CAST(max(b.end_) - min(s.start0) AS INTEGER) AS end_, string_agg(coalesce(native_id, '') || ':' || type || ':' || text, '|' ORDER BY b.start_, b.end_, CAST(id AS BIGINT)) AS allvalues, array_to_string(list_sort(list(DISTINCT type)), '|') AS types
FROM b JOIN (SELECT doc_id, sec_id, start_ AS start0 FROM secs) s USING (doc_id, sec_id) GROUP BY doc_id, sec_id, sent_id, mention"""
)
def odin_mentions(spark, sf_dir):
    return L.odin_mentions(annotated(spark, sf_dir)).drop("mention").withColumnsRenamed({"start": "start_", "end": "end_"})


@query(f"{_ENTITIES} SELECT doc_id, cid, cname, type FROM (SELECT doc_id, coalesce(native_id, '') AS cid, preferred_form AS cname, type, row_number() OVER (PARTITION BY doc_id, coalesce(native_id, '') ORDER BY CAST(id AS BIGINT)) AS k FROM ents) WHERE k = 1")
def og_dict(spark, sf_dir):
    return L.og_dict(annotated(spark, sf_dir))


@query(f"{_ENTITIES}, r AS (SELECT *, CASE type WHEN 'Disease' THEN 1 WHEN 'Gene' THEN 2 ELSE 3 END AS r FROM ents) SELECT doc_id, start_, end_, arg_min(type, {{'r': r, 't': type}}) AS type FROM r GROUP BY 1, 2, 3")
def highlight_types(spark, sf_dir):
    return L.by_priority(annotated(spark, sf_dir).entities, ["Disease", "Gene"]).withColumnsRenamed({"start": "start_", "end": "end_"})


@query(f"{_ENTITIES} SELECT e.doc_id, e.id, substring(s.text, greatest(e.start_ - s.start0 - 20, 0) + 1, e.start_ - s.start0 - greatest(e.start_ - s.start0 - 20, 0)) AS prefix, substring(s.text, e.end_ - s.start0 + 1, 20) AS postfix FROM ents e JOIN (SELECT doc_id, sec_id, text, start_ AS start0 FROM secs) s USING (doc_id, sec_id)")
def token_context_20(spark, sf_dir):
    c = annotated(spark, sf_dir)
    e = c.entities.select("doc_id", "sec_id", "id", "start", "end").join(c.sections.select("doc_id", "sec_id", "text", F.col("start").alias("base")), ["doc_id", "sec_id"])
    a = F.col("start") - F.col("base")
    first = F.greatest(a - 20, F.lit(0))
    return e.select("doc_id", "id", F.substring("text", first + 1, a - first).alias("prefix"), F.substring("text", F.col("end") - F.col("base") + 1, F.lit(20)).alias("postfix"))


@query(f"WITH {_SECTIONS} SELECT doc_id, string_agg(padded, '' ORDER BY sec_id) AS text FROM (SELECT *, repeat(chr(10), greatest(coalesce(start_ - lag(start_ + length(text)) OVER (PARTITION BY doc_id ORDER BY sec_id), 0), 0)) || text AS padded FROM secs) GROUP BY 1")
def sink_txt(spark, sf_dir):
    return L.plain_text(corpus(spark, sf_dir))


# ---- sources and pointers


@query(
    f"""{_ENTITIES}{_COVERED}, io AS (SELECT doc_id, sec_id, sent_id, i, label FROM nb), fixed AS (SELECT *, lag(label, 1, '') OVER (PARTITION BY doc_id, sec_id, sent_id ORDER BY i) AS before_ FROM io)
SELECT doc_id, CAST(sec_id AS INTEGER) AS sec_id, sent_id, CAST(i AS INTEGER) AS tok_id, CASE WHEN label = '' THEN 'O' WHEN before_ <> label THEN 'B' ELSE 'I' END AS iob FROM fixed"""
)
def load_conll_fix_tags(spark, sf_dir):
    t = L.conll(annotated(spark, sf_dir), "IO", pattern=T.TOKEN)
    return files.fix_tags(t, ["doc_id", "sec_id", "sent_id"], ["tok_id"]).select("doc_id", "sec_id", "sent_id", "tok_id", "iob")


@query()
def load_bioc_json(spark, sf_dir):
    from glossaflow.operators import shredding

    return files.from_adjacency(shredding.adjacency(read(spark, sf_dir, "bioc_raw")))[0]


@query()
def load_bioc_entities(spark, sf_dir):
    from glossaflow.operators import shredding

    return files.from_adjacency(shredding.adjacency(read(spark, sf_dir, "bioc_raw")))[1].withColumnsRenamed({"start": "start_", "end": "end_"})


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def missing_ids(spark, sf_dir):
    asked = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return pointers.missing(asked, read(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")))


@query("SELECT article_id AS id, 'passages' AS origin FROM passages WHERE article_id IS NOT NULL GROUP BY 1 HAVING max(text) IS NOT NULL UNION ALL SELECT DISTINCT article_id, 'annotations' FROM annotations WHERE article_id NOT IN (SELECT article_id FROM passages WHERE text IS NOT NULL)")
def fallback_union(spark, sf_dir):
    a = read(spark, sf_dir, "annotations").select(F.col("article_id").alias("id")).distinct()
    p = read(spark, sf_dir, "passages").where("text is not null").select(F.col("article_id").alias("id")).distinct()
    return pointers.with_fallback(a, p.withColumn("origin", F.lit("passages")), a.withColumn("origin", F.lit("annotations")))


@query("SELECT doc_id AS id, (row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS chunk FROM documents")
def chunk_ids(spark, sf_dir):
    return pointers.chunked(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), 1000)


@query("SELECT doc_id AS id, 'in/' || CASE WHEN length(doc_id::VARCHAR) < 8 THEN lpad(doc_id::VARCHAR, 8, '0') ELSE doc_id::VARCHAR END || '.txt' AS file FROM documents")
def pointer_files(spark, sf_dir):
    return pointers.file_name(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "in/{id!p}.txt")
