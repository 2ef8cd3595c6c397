"""Recognition that learns abbreviations: a match followed by a name in parentheses makes that name a term for the rest of the article."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaflow.functions import text as T
from glossaflow.operators.recognize import checked
from glossaflow.schema import INFO

_find = re.compile(r"\d+|[^\W\d_]+|[()]").finditer


class Dictionary:
    """An index in memory: lengths by first token and entries by key; what an article teaches lies in layers over it."""

    def __init__(self, rows, stopwords: frozenset[str]):
        self.lengths: dict[str, set[int]] = {}
        self.entries: dict[str, list[tuple]] = {}
        self.stopwords = stopwords
        for n, first, key, *info in rows:
            self.lengths.setdefault(first, set()).add(n)
            self.entries.setdefault(key, []).append(tuple(info))

    def article(self, sentences: list[tuple[int, str]]) -> Iterator[tuple]:
        """(sentence number, start, end, entry) of the sentences of an article, in order."""
        lengths: dict[str, set[int]] = {}
        entries: dict[str, set[tuple]] = {}
        exact_only: set[str] = set()
        for number, text in sentences:
            spans = [(m.group(), m.start(), m.end()) for m in _find(text or "")]
            toks = [s[0] for s in spans]
            norm = [t.lower() for t in toks]
            for i, first in enumerate(norm):
                for n in sorted(self.lengths.get(first, set()) | lengths.get(first, set())):
                    j = i + n
                    if j > len(toks):
                        break
                    key = T.GAP.join(norm[i:j])
                    if key in self.stopwords or key in exact_only:
                        key = T.GAP.join(toks[i:j])
                    found = sorted({*self.entries.get(key, ()), *entries.get(key, ())}, key=lambda e: tuple(x or "" for x in e))
                    for e in found:
                        yield number, spans[i][1], spans[j - 1][2], e
                    if found and j + 2 < len(toks) and toks[j] == "(" and toks[j + 2] == ")":
                        short = toks[j + 1]
                        exact_only.add(norm[j + 1])
                        lengths.setdefault(norm[j + 1], set()).add(1)
                        entries.setdefault(short, set()).update(found)


def recognise_abbreviations(sentences: DataFrame, index: DataFrame, doc: str = "doc_id", number: str = "sent_id", text: str = "text", start: str | None = None, stopwords: list[str] = ()) -> DataFrame:
    """(doc, number, start, end, info fields): the entities of the sentences of each article, abbreviations included.

    An abbreviation counts from the place after its definition to the end of the article, and is compared exactly.
    The sentences of an article are one group, held by one task, with the entries of a dictionary of any size that begin
    with a token of the article. ``index`` must be built with parentheses as tokens.
    """
    sentences, index = sentences.withColumn("__start", F.coalesce(F.col(start), F.lit(0)) if start else F.lit(0)), index
    shared = sentences.sparkSession.sparkContext.broadcast(frozenset(stopwords))
    fields = {f.name: f.dataType.simpleString() for f in sentences.schema}
    schema = f"{doc} {fields[doc]}, {number} {fields[number]}, start int, end int, " + ", ".join(f"{f} string" for f in INFO)

    def learn(articles: pd.DataFrame) -> pd.DataFrame:
        articles = articles.sort_values(number)
        entries = {tuple(e.values()) for some in articles["__entries"] if some is not None for e in some}
        shifts = dict(zip(articles[number], articles["__start"]))
        found = Dictionary(entries, shared.value).article(list(zip(articles[number], articles["__text"])))
        out = [(articles[doc].iloc[0], k, a + shifts[k], b + shifts[k], *e) for k, a, b, e in found]
        return pd.DataFrame(out, columns=[doc, number, "start", "end", *INFO])

    # of the dictionary, an article needs the terms that begin with one of its tokens
    plain = sentences.select(doc, number, F.col(text).alias("__text"), "__start")
    begun = plain.select(doc, number, F.explode(F.array_distinct(F.transform(T.tokens(F.coalesce("__text", F.lit("")), T.TOKEN_PARENS), F.lower))).alias("first"))
    terms = begun.join(checked(index.select("n_toks", "first", "key", *INFO).distinct()), "first")
    held = terms.groupBy(doc, number).agg(F.collect_list(F.struct("n_toks", "first", "key", *INFO)).alias("__entries"))
    return plain.join(held, [doc, number], "left").groupBy(doc).applyInPandas(learn, schema)


def definitions(tokens: DataFrame, matches: DataFrame, doc: str = "doc_id", number: str = "sent_id") -> DataFrame:
    """(doc, number, place, short, info fields): the abbreviations that follow a match, as a join of matches with the tokens behind them (one level, no chains).

    ``tokens`` (doc, number, i, token, start, end) with parentheses, ``matches`` (doc, number, end, info fields).
    """
    def at(k: int) -> DataFrame:
        return tokens.select(doc, number, (F.col("i") - k).alias("i"), F.col("token").alias(f"t{k}"), *([F.col("start").alias("place")] if k == 2 else []))

    last = tokens.select(doc, number, "i", F.col("end").alias("end"))
    joined = matches.join(last, [doc, number, "end"]).join(at(1), [doc, number, "i"]).where("t1 = '('").join(at(2), [doc, number, "i"]).join(at(3), [doc, number, "i"]).where("t3 = ')'")
    return joined.select(doc, number, "place", F.col("t2").alias("short"), *INFO).distinct()


def regex_definition(tail):
    """The name in parentheses right behind a match, of a column with the text that follows it; null if there is none."""
    name = F.regexp_extract(tail, r"^\s+\(([\p{L}\p{N}_]+)\)", 1)
    return F.when(name != "", name)
