"""Scalar functions on text as column expressions: tokens, normalisation, offsets."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from glossaflow.functions import stemming

#: A token is a run of digits or of letters; everything else lies between tokens.
TOKEN = r"\p{Nd}+|[\p{L}\p{Nl}\p{No}]+"
#: With abbreviation detection, single parentheses are tokens too.
TOKEN_PARENS = TOKEN + r"|[()]"
#: Total segmentations: tokens and what lies between them, so that the pieces of a text concatenate to it.
PIECES = rf"({TOKEN}|[^\p{{L}}\p{{N}}]+)"
PIECES_PARENS = rf"({TOKEN_PARENS}|[^\p{{L}}\p{{N}}()]+)"
#: Words and runs of other visible signs, for output.
WORD_PUNCT = r"[\p{L}\p{N}\p{M}_]+|[^\s\p{L}\p{N}\p{M}_]+"
#: Joins the tokens of a term to a key.
GAP = "\x01"
#: Fixed values. Names of the small Greek letters.
GREEK = dict(
    zip(
        "αβγδεζηθικλμνξοπρςστυφχψω",
        "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma sigma tau upsilon phi chi psi omega".split(),
        strict=True,
    )
)


def tokens(text: Column, pattern: str = TOKEN) -> Column:
    """All tokens of a text, in order; null for null."""
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)


def pieces(text: Column, parens: bool = False) -> Column:
    """The total segmentation of a text."""
    return F.regexp_extract_all(text, F.lit(PIECES_PARENS if parens else PIECES), 1)


def one_line(text: Column) -> Column:
    """A text with every white-space character as a blank."""
    return F.regexp_replace(text, r"\s", " ")


def field_name(name: Column) -> Column:
    """A name whose runs of other characters than letters, digits and underscores are underscores."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}_]+", "_")


def byte_offset(text: Column, place: Column) -> Column:
    """The UTF-8 byte offset of a code-point offset."""
    return F.octet_length(F.substring(text, F.lit(1), place))


def byte_places(text: Column, places: Column) -> Column:
    """The UTF-8 byte offsets of many code-point offsets of a text, by one pass over it; a place beyond the text counts on from its end. Null for null."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def counted(texts: pd.Series, spots: pd.Series) -> pd.Series:
        def one(t: str | None, at) -> np.ndarray | None:
            if t is None or at is None:
                return None
            at = np.asarray(at, dtype=np.int64)
            if t.isascii():
                return at
            codes = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
            more = np.concatenate(([0], np.cumsum((codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF))))
            return at + more[np.clip(at, 0, len(codes))]

        return pd.Series([one(t, a) for t, a in zip(texts, spots)])

    return counted(text, places)


def code_point_offset(text: Column, place: Column) -> Column:
    """The code-point offset of a UTF-8 byte offset at a character border."""
    return F.length(F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), place), "UTF-8"))


def lowercase(token: Column) -> Column:
    return F.lower(token)


def ise(token: Column) -> Column:
    """British spellings in -ise and -yse with a z, wherever they end a word."""
    return F.regexp_replace(token, r"([iy])s(e[sd]?|ing|ations?)\b", "$1z$2")


def greektranslit(token: Column) -> Column:
    """Small Greek letters by name; capital and accented ones stay."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), GREEK.items(), token)


def mask(replacement: str, target: str, words: list[str] | None = None) -> Callable[[Column], Column]:
    """Tokens that consist of 'digits', 'numeric' signs or 'punct', or are among ``words``, as ``replacement``."""
    whole = {"digits": r"^[\p{Nd}²³¹⁰-⁹₀-₉]+$", "numeric": r"^\p{N}+$", "punct": r"^[\p{P}\p{S}]+$"}
    if target in whole:
        return lambda token: F.when(token.rlike(whole[target]), F.lit(replacement)).otherwise(token)
    if words is None:
        raise ValueError(f"unknown mask target: {target}")
    return lambda token: F.when(F.array_contains(F.array(*[F.lit(w) for w in words]), token), F.lit(replacement)).otherwise(token)


def unicode_form(form: str = "NFKC") -> Callable[[Column], Column]:
    """Unicode normalisation of whole columns. Spark has no built-in for it; ASCII text skips nothing but costs little."""

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return normal


def stem(algorithm: str = "lancaster") -> Callable[[Column], Column]:
    """Stems of tokens, by 'porter' or 'lancaster'."""
    function = {"porter": stemming.porter, "lancaster": stemming.lancaster}[algorithm]

    @F.pandas_udf("string")
    def stemmed(words: pd.Series) -> pd.Series:
        known = {w: None if w is None else function(w) for w in words.unique()}
        return words.map(known)

    return stemmed


def normaliser(name: str) -> Callable[[Column], Column]:
    """A normaliser by name, parameters after dashes: lowercase, ise, greektranslit, mask-R-T, unicode-FORM, stem-ALGORITHM."""
    head, *rest = name.split("-")
    if head == "mask":
        words = None
        if rest[1] not in ("digits", "numeric", "punct"):
            with open("-".join(rest[1:]), encoding="utf-8") as lines:
                words = [x.rstrip("\n") for x in lines]
        return mask(rest[0], rest[1] if words is None else "words", words)
    plain = {"lowercase": lowercase, "ise": ise, "greektranslit": greektranslit}
    if head in plain:
        return plain[head]
    if head in ("unicode", "stem"):
        return {"unicode": unicode_form, "stem": stem}[head](*rest)
    raise ValueError(f"unknown normaliser: {name}")


def normalise(token: Column, names: str | list[str] = "lowercase") -> Column:
    """A token after a cascade of normalisers, given by names in a list or separated by blanks."""
    return reduce(lambda c, n: normaliser(n)(c), names.split() if isinstance(names, str) else names, token)


def is_vectorised(names: str | list[str]) -> bool:
    """Whether a cascade needs Python, so that it can't run inside a higher-order function."""
    return any(n.split("-")[0] in ("unicode", "stem") for n in (names.split() if isinstance(names, str) else names))
