"""Sections and sentences of a text as column expressions, with offsets, computed within the row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

_CUT = "\x00"
#: A sentence ends after closing signs and blanks unless a small letter follows; the blanks belong to it.
SENTENCE_END = r"([.?!]++[\"')\]]*+[ \t\n\r\f]++)(?!\p{Ll})"
#: A section ends after a run of blank lines that follows text; the blank lines belong to it.
SECTION_END = r"(\S[^\S\n]*\n(?:[^\S\n]*\n)+)"


def _cut(text: Column, pattern: str) -> Column:
    parts = F.split(F.regexp_replace(F.replace(text, F.lit(_CUT), F.lit(" ")), pattern, "$1" + _CUT), _CUT)
    return F.filter(parts, lambda p: p != "")


def sentences(text: Column) -> Column:
    """The sentences of a text by rule. They concatenate to the text; an empty text has none."""
    return _cut(text, SENTENCE_END)


def sections(text: Column, single: bool = False) -> Column:
    """The sections of a plain text, parted by blank lines; the whole text with ``single``."""
    return F.filter(F.array(text), lambda p: p != "") if single else _cut(text, SECTION_END)


def given_lines(text: Column) -> Column:
    """The lines of a text with their ends, as sentences that are given."""
    return F.regexp_extract_all(text, F.lit(r"([^\n]*\n|[^\n]+)"), 1)


def starts(parts: Column) -> Column:
    """Where each of some parts begins in their concatenation: one running sum of their lengths."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def sums(lengths: pd.Series) -> pd.Series:
        return lengths.map(lambda x: x if x is None else np.cumsum(x) - x)

    return sums(F.transform(parts, F.length))


def explode_parts(df: DataFrame, parts: Column, number: str, start: str | None = None) -> DataFrame:
    """A row for each part: its ``number`` from 0, text, start and end, counted from column ``start`` if given. Rows without parts give none."""
    kept = [c for c in df.columns if c not in ("text", "start", "end", number)]
    shift = F.coalesce(F.col(start), F.lit(0)) if start else F.lit(0)
    cut = df.select(*kept, shift.alias("__shift"), parts.alias("__parts"))
    both = cut.select(*kept, "__shift", F.posexplode(F.arrays_zip(F.col("__parts").alias("part"), starts(F.col("__parts")).alias("at"))).alias(number, "__x"))
    at = F.col("__shift") + F.col("__x.at")
    return both.select(*kept, number, F.col("__x.part").alias("text"), at.alias("start"), (at + F.length("__x.part")).alias("end"))
