"""Queries of the text problems and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossaflow.llm import encoding, leakage, lookalikes, mixing, residue, sentences, termfreq
from glossaflow.session import read, spread


def _texts(spark, sf_dir, names):
    """(table_name, row_key, text) of the texts of some tables, each once per key."""
    keys = {"documents": "doc_id", "passages": "passage_id", "annotations": "anno_key"}
    parts = [read(spark, sf_dir, n).where("text is not null").select(F.lit(n).alias("table_name"), F.col(keys[n]).alias("row_key"), "text") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p1_repaired(spark, sf_dir):
    """Each garbled text with what could be restored."""
    texts = _texts(spark, sf_dir, ["documents", "passages"]).where(encoding.candidates(F.col("text")))
    fixed = encoding.repaired(spread(texts), ["table_name", "row_key"]).where("garbled")
    return fixed.groupBy("table_name", "row_key").agg(F.min(F.struct("text", "lossy")).alias("x")).select("table_name", "row_key", F.col("x.text").alias("restored"), F.col("x.lossy").alias("lossy"))


def p1_found(spark, sf_dir):
    return p1_repaired(spark, sf_dir).select("table_name", "row_key")


def p3_terms(spark, sf_dir):
    return termfreq.term_frequencies(read(spark, sf_dir, "annotations"))


def p3_found(spark, sf_dir):
    return p3_terms(spark, sf_dir).where("mark <> 'useful'").select("term", "mark")


def p3_ngrams(spark, sf_dir):
    return termfreq.gram_counts(termfreq.annotation_values(read(spark, sf_dir, "annotations")), max_n=termfreq.ALL)


def p3_grams_to_4(spark, sf_dir):
    """Of all n-grams those of up to four pieces."""
    return p3_ngrams(spark, sf_dir).where("size <= 4")


def p4_sentences(spark, sf_dir):
    """Sentence units of all passages: split, or as given where the text is null."""
    passages = read(spark, sf_dir, "passages")
    return sentences.sentences(passages).unionByName(sentences.given_sentences(passages))


def p4_found(spark, sf_dir):
    return sentences.sentences(read(spark, sf_dir, "passages")).select("passage_id", "char_offset")


def p6_consistent(spark, sf_dir):
    """Each text that is not in its consistent form, and that form."""
    return lookalikes.consistent(spread(_texts(spark, sf_dir, ["passages", "annotations"])))


def p6_found(spark, sf_dir):
    return p6_consistent(spark, sf_dir).where("found").select("table_name", "row_key")


def p7_leaks(spark, sf_dir):
    """The items in each affected document, with the characters of each place."""
    return leakage.leaks(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), read(spark, sf_dir, "eval_items"))


def p7_found(spark, sf_dir):
    return p7_leaks(spark, sf_dir).select("item_id", "doc_id").distinct()


def p7_spans(spark, sf_dir):
    return leakage.removal_spans(p7_leaks(spark, sf_dir))


def p7_clean(spark, sf_dir):
    """The documents without the leaked stretches."""
    documents = read(spark, sf_dir, "documents")
    return leakage.without_leaks(documents.select("doc_id", "text"), p7_leaks(spark, sf_dir))


def p8_mix(spark, sf_dir):
    """The chosen documents with their repeats."""
    return mixing.mixed(spread(read(spark, sf_dir, "documents").select("doc_id", "source", "text")), read(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark, sf_dir):
    return mixing.mixed(spread(read(spark, sf_dir, "documents").select("doc_id", "source", "text")), read(spark, sf_dir, "mix_targets"))[1]


def p9_evidence(spark, sf_dir):
    return residue.residue(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def p9_found(spark, sf_dir):
    return p9_evidence(spark, sf_dir).select("doc_id")


def p9_clean(spark, sf_dir):
    """The documents that remain."""
    return residue.without_residue(read(spark, sf_dir, "documents"))


QUERIES = {"p1_found": p1_found, "p1_repaired": p1_repaired, "p3_found": p3_found, "p4_found": p4_found, "p4_sentences": p4_sentences, "p9_found": p9_found, "p9_evidence": p9_evidence, "p9_clean": p9_clean, "p8_mix": p8_mix, "p8_shares": p8_shares, "p7_found": p7_found, "p7_leaks": p7_leaks, "p7_spans": p7_spans, "p7_clean": p7_clean, "p6_found": p6_found, "p6_consistent": p6_consistent, "p3_terms": p3_terms, "p3_ngrams": p3_ngrams, "p3_grams_to_4": p3_grams_to_4}

_P3 = """
WITH once AS (SELECT anno_key, min(text) AS term, arg_min(article_id, text) AS article_id FROM annotations WHERE text IS NOT NULL GROUP BY anno_key),
terms AS (SELECT term, count(*) AS occurrences, count(DISTINCT article_id) AS articles FROM once GROUP BY term),
marked AS (SELECT term, occurrences, articles, CASE WHEN articles < 3 THEN 'rare' WHEN articles > 0.05 * (SELECT count(DISTINCT article_id) FROM annotations WHERE text IS NOT NULL) THEN 'common' ELSE 'useful' END AS mark FROM terms)
"""
ORACLE = {"p3_found": _P3 + "SELECT term, mark FROM marked WHERE mark <> 'useful'", "p3_terms": _P3 + "SELECT * FROM marked", "p3_grams_to_4": _P3 + r"""
, cut AS (SELECT article_id, regexp_extract_all(term, '(\p{Nd}+|[\p{L}\p{M}\p{Nl}\p{No}]+|[^\s\p{L}\p{M}\p{N}])', 1) AS p FROM once),
spots AS (SELECT article_id, p, n, unnest(generate_series(1, length(p) - n + 1)) AS i FROM cut, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE length(p) >= n)
SELECT array_to_string(p[i:i + n - 1], ' ') AS gram, CAST(n AS INTEGER) AS size, count(*) AS occurrences, count(DISTINCT article_id) AS records FROM spots GROUP BY 1, 2"""}
