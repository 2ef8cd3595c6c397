"""Dictionaries: layouts of term lists, and the index that recognition joins with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaflow.functions import text as T
from glossaflow.schema import INFO, UNKNOWN

#: Column orders of the layouts.
LAYOUTS = {
    "4": ["native_id", "term", "type", "preferred_form"],
    "6": ["native_id", "term", "type", "preferred_form", "original_resource", "umls_cui"],
    "bth": ["umls_cui", "original_resource", "native_id", "term", "preferred_form", "type"],
}


def fields_of_line(line: Column) -> Column:
    """The fields of a line of tab-separated values where a backslash takes the next character literally."""
    raw = F.regexp_extract_all(F.concat(F.lit("\t"), line), F.lit(r"\t((?:\\.|[^\t\\])*)"), 1)
    return F.transform(raw, lambda f: F.regexp_replace(f, r"\\(.)", "$1"))


def from_fields(fields: DataFrame, layout: str = "bth", extra: list[str] | None = None) -> DataFrame:
    """(term, info fields, extra fields) of rows with an array ``fields`` in one of the LAYOUTS. Rows with another number of fields raise."""
    names = [*LAYOUTS[layout], *(extra or [])]
    wrong = F.raise_error(F.concat(F.lit(f"expected {len(names)} fields, found "), F.size("fields").cast("string"))).cast("array<string>")
    checked = fields.select(F.when(F.size("fields") == len(names), F.col("fields")).otherwise(wrong).alias("fields"))
    out = checked.select(*[F.col("fields")[i].alias(n) for i, n in enumerate(names)])
    if layout == "4":
        out = out.withColumn("original_resource", F.lit(UNKNOWN)).withColumn("umls_cui", F.lit("none"))
    return out.select("term", *INFO, *(extra or []))


def read_termlist(spark: SparkSession, path: str, layout: str = "bth", header: bool = False, extra: list[str] | None = None) -> DataFrame:
    """A dictionary file. A header is skipped in each file."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("n"), F.input_file_name().alias("file"))
    if header:
        firsts = lines.groupBy("file").agg(F.min("n").alias("n"))
        lines = lines.join(F.broadcast(firsts), ["file", "n"], "left_anti")
    return from_fields(lines.where("value <> ''").select(fields_of_line(F.col("value")).alias("fields")), layout, extra)


def term_key(term: Column, normalisers: str = "lowercase", stopwords: list[str] = (), pattern: str = T.TOKEN) -> Column:
    """The key of a term: its normalised tokens, or its exact ones if the normalised ones are a stopword."""
    exact = T.tokens(term, pattern)
    norm = F.array_join(F.transform(exact, lambda t: T.normalise(t, normalisers)), T.GAP)
    return F.when(norm.isin(list(stopwords)), F.array_join(exact, T.GAP)).otherwise(norm) if stopwords else norm


def build_index(terms: DataFrame, normalisers: str = "lowercase", stopwords: list[str] | DataFrame = (), pattern: str = T.TOKEN, recognizer: int = 0) -> DataFrame:
    """(recognizer, n_toks, first, key, info fields, extra fields): the entries of a dictionary, each once per key.

    ``stopwords`` are keys, a few in a list or any number in a frame (k). With some, the index has norm, the normalised
    key, and stopped, whether that is a stopword, so that key is the exact one. Terms that are null or have no token are
    left out, as they can't match.
    """
    info = [c for c in terms.columns if c != "term"]
    exact = T.tokens(F.col("term"), pattern)
    rows = terms.where(F.size(exact) > 0).select(
        F.lit(recognizer).alias("recognizer"),
        F.size(exact).alias("n_toks"),
        T.normalise(F.element_at(exact, 1), normalisers).alias("first"),
        term_key(F.col("term"), normalisers, pattern=pattern).alias("key"),
        F.array_join(exact, T.GAP).alias("__exact"),
        *info,
    )
    if isinstance(stopwords, DataFrame):
        marked = rows.withColumn("norm", F.col("key")).join(stopwords.select(F.col("k").alias("norm"), F.lit(True).alias("stopped")).distinct(), "norm", "left").withColumn("stopped", F.coalesce("stopped", F.lit(False)))
    elif stopwords:
        marked = rows.withColumn("norm", F.col("key")).withColumn("stopped", F.col("key").isin(list(stopwords)))
    else:
        return rows.drop("__exact").dropDuplicates()
    return marked.withColumn("key", F.when(F.col("stopped"), F.col("__exact")).otherwise(F.col("key"))).select("recognizer", "n_toks", "first", "key", *info, "norm", "stopped").dropDuplicates()


def first_index(index: DataFrame) -> DataFrame:
    """(first, lengths): the lengths of the terms that begin with a token, ascending."""
    return index.groupBy("first").agg(F.array_sort(F.collect_set("n_toks")).alias("lengths"))
