"""Visually identical text with different characters: one consistent form, with look-alike letters judged by script and corpus vocabulary."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossaflow.llm import encoding
from glossaflow.session import checkpointed

#: Fixed values. Letters of Cyrillic and Greek that look like a Latin letter, in the same order.
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝӏАВЕКМНОРСТХУІЈЅԌԚԜҮҺ", "aeopcyxijshdqwlABEKMHOPCTXYIJSGQWYh", strict=True))
GREEK = dict(zip("οΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oABEZHIKMNOPTYX", strict=True))
#: Latin letters that look like a Russian one.
RUSSIAN = dict(zip("aeopcyxABEKMHOPCTXk", "аеорсухАВЕКМНОРСТХк", strict=True))
#: Signs of units with an ordinary twin.
UNITS = {"\u00b5": "\u03bc", "\u2126": "\u03a9", "\u212a": "\u004b", "\u212b": "\u00c5", "\u2103": "\u00b0C", "\u2109": "\u00b0F"}
LIGATURES = "\ufb00-\ufb06"
INVISIBLE = "\u00ad\u034f\u061c\u115f-\u1160\u17b4-\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0"
BLANKS = "\u0009\u000b\u000c\u000d\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters whose composed form the standard excludes: their decomposed form is the ordinary one.
_EXCLUDED = re.compile("[\u0958-\u095f\u09dc-\u09df\u0a33\u0a36\u0a59-\u0a5e\u0b5c\u0b5d\u0f43\u0f4d\u0f52\u0f57\u0f5c\u0f69\ufb1d\ufb1f\ufb2a-\ufb4e]")

_wide = re.compile("[\uff21-\uff3a\uff41-\uff5a\uff10-\uff19]")
_other = re.compile(f"[{LIGATURES}{''.join(UNITS)}\u3380-\u33df]")
#: Joiners are proper after a virama or between letters of the scripts that shape with them.
_joiner = re.compile("(?<=[\u094d\u09cd\u0a4d\u0acd\u0b4d\u0bcd\u0c4d\u0ccd\u0d4d])[\u200c\u200d]|(?<=[\u0600-\u06ff])\u200c(?=[\u0600-\u06ff])|(?<=[\u2600-\u27bf\U0001f300-\U0001faff])[\u200d\ufe0f]|(?<=\ufe0f)\u200d")
_invisible = re.compile(f"[{INVISIBLE}]")
_blank = re.compile(f"[{BLANKS}]")
_token = re.compile("[A-Za-zÀ-ÖØ-öø-ʯͰ-ϿЀ-ԯἀ-῿0-9]+")
_cyr, _gre, _lat = re.compile("[Ѐ-ԯ]"), re.compile("[Ͱ-Ͽἀ-῿]"), re.compile("[A-Za-zÀ-ÖØ-öø-ʯ]")
#: What the JVM looks for before a text goes to Python: any sign beyond ASCII, and the blanks within ASCII.
SCREEN = r"[\t\x0b\f\r\x1c-\x1f]|[^\x00-\x7f]"


def basic_form(text: str) -> str:
    """``text`` with full-width letters, signs with a composed form, invisible characters, blanks, ligatures and unit signs in their ordinary form.

    Full-width punctuation stays. Joiners stay where a script needs them. Blanks become U+0020.
    """
    out = _wide.sub(lambda m: chr(ord(m.group()) - 0xFEE0), text)
    out = _other.sub(lambda m: UNITS.get(m.group()) or unicodedata.normalize("NFKC", m.group()), out)
    kept = {m.start() for m in _joiner.finditer(out)}
    out = "".join(c for i, c in enumerate(out) if i in kept or not _invisible.match(c)) if _invisible.search(out) else out
    out = _blank.sub(" ", out)
    return out if unicodedata.is_normalized("NFC", out) else unicodedata.normalize("NFC", out)


def _deviates(text: str) -> bool:
    """Whether the basic form differs for a reason that counts."""
    if _wide.search(text) or _other.search(text) or _blank.search(text):
        return True
    if _invisible.search(text):
        kept = {m.start() for m in _joiner.finditer(text)}
        if any(m.start() not in kept for m in _invisible.finditer(text)):
            return True
    if unicodedata.is_normalized("NFC", text):
        return False
    bare = _EXCLUDED.sub(lambda m: unicodedata.normalize("NFD", m.group()), text)
    return unicodedata.normalize("NFC", bare) != bare


def dominant(token: str) -> str:
    """The script that most letters of a token are of: 'Latin', 'Cyrillic' or 'Greek'; of equal ones the first of these."""
    counts = {name: sum(bool(p.match(c)) for c in token) for name, p in (("Latin", _lat), ("Cyrillic", _cyr), ("Greek", _gre))}
    return max(counts, key=counts.get)


def suspects(text: str) -> list[tuple[str, str, str | None, str]]:
    """(token, form with its look-alikes replaced, form in the other script, kind) of the tokens of a text in basic form that may hold look-alikes.

    kind 'mixed': Latin and Cyrillic letters in a word, where those of one script all have a twin in the other; if those of
    both have, the form is that of the token's dominant script. kind 'greek': Greek twins in a word of Latin letters, or
    a word of them alone. kind 'whole': a word of Cyrillic twins alone in a text with Russian words, 'lone' in one without.
    """
    if not (_cyr.search(text) or _gre.search(text)):
        return []
    out = []
    native = any(_cyr.search(t) and any(_cyr.match(c) and c not in CYRILLIC for c in t) and not re.search("[a-zA-Z]", t) for t in _token.findall(text))
    for m in _token.finditer(text):
        token = m.group()
        if token.isascii() or (len(token) == 1 and _gre.match(token) and text[m.end() : m.end() + 1] in ("-", "\u2010", "\u2011", "\u2013")):
            continue
        cyr = [c for c in token if _cyr.match(c)]
        gre = [c for c in token if _gre.match(c)]
        lat = [c for c in token if _lat.match(c)]
        if cyr and lat:
            latin = "".join(CYRILLIC.get(c, GREEK.get(c, c) if c in "ο" else c) for c in token) if all(c in CYRILLIC for c in cyr) else None
            russian = "".join(RUSSIAN.get(c, c) for c in token) if all(c in RUSSIAN for c in lat) else None
            forms = [f for f in ((russian, latin) if dominant(token) == "Cyrillic" else (latin, russian)) if f]
            if forms:
                out.append((token, forms[0], forms[1] if len(forms) > 1 else None, "mixed"))
        elif cyr and all(c in CYRILLIC for c in cyr) and not gre:
            out.append((token, "".join(CYRILLIC.get(c, c) for c in token), None, "whole" if native else "lone"))
        elif cyr and gre and all(c in CYRILLIC for c in cyr):
            out.append((token, "".join(CYRILLIC.get(c, c) for c in token), None, "mixed"))
        elif gre and any(c in GREEK for c in gre):
            new = "".join(GREEK.get(c, c) for c in token)
            out.append((token, new, None, "mixed" if "ο" in token and lat and all(c in GREEK for c in gre) and token.lower().count("ο") else "greek"))
    return out


_beside = re.compile(f"[A-Za-zÀ-ÖØ-öø-ʯͰ-ϿЀ-ԯἀ-῿0-9\u0300-\u036f{INVISIBLE}]")


def marred(text: str) -> set[str]:
    """The tokens, in basic form, at or beside the signs of a text that can't be restored."""
    out: set[str] = set()
    for a, b in encoding.unrestored_places(text):
        while a and _beside.match(text[a - 1]):
            a -= 1
        while b < len(text) and _beside.match(text[b]):
            b += 1
        out.update(_token.findall(basic_form(text[a:b])))
    return out


_FORMS = "table_name string, row_key bigint, form string, deviates boolean, tokens array<struct<token:string,form:string,alt:string,kind:string>>"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for table, key, text in zip(b["table_name"], b["row_key"], b["text"]):
            sound, garbled, lossy = encoding.repair(text)
            deviates = _deviates(encoding.masked(sound) if garbled else sound)
            form = basic_form(sound)
            tokens = suspects(form)
            if lossy and tokens:
                beside = marred(sound) | marred(text)
                tokens = [t for t in tokens if t[0] not in beside]
            if deviates or tokens or form != text:
                rows.append((table, key, form, deviates, [{"token": t, "form": f, "alt": o, "kind": k} for t, f, o, k in dict.fromkeys(tokens)]))
        yield pd.DataFrame(rows, columns=["table_name", "row_key", "form", "deviates", "tokens"])


def scanned(texts: DataFrame) -> DataFrame:
    """Rows of ``texts`` (table_name, row_key, text) that are not in basic form or have suspect tokens. Garbled text is restored before it is judged."""
    return texts.where(F.col("text").rlike(SCREEN)).mapInPandas(_scan, _FORMS)


def vocabulary(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(word, n, native, small_greek): of the words ``wanted`` (word, in small letters), how often ``texts`` have them in any case, how often in texts with Russian words, and how often with a small Greek letter."""
    words = F.regexp_extract_all(F.col("text"), F.lit(r"([a-zA-Z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2AF}\x{370}-\x{3FF}\x{400}-\x{52F}0-9]+)"), 1)
    counted = (
        texts.where("text is not null")
        .select(words.alias("words"), F.col("text").rlike("[бвгджзилнптфцчшщэюя]{2}").cast("long").alias("native"))
        .select(F.explode("words").alias("w"), "native")  # apart, else the text is searched again for each of its words
        .groupBy(F.lower("w").alias("word"))
        .agg(F.count("*").alias("n"), F.sum("native").alias("native"), F.sum(F.col("w").rlike("[α-ω&&[^ο]]").cast("long")).alias("small_greek"))
    )
    return counted.join(wanted.select("word").distinct(), "word", "left_semi")


def confirmed(texts: DataFrame, scan: DataFrame) -> DataFrame:
    """(table_name, row_key, token, form): the suspect tokens that are look-alikes, each with the form that the corpus vocabulary confirms.

    The vocabulary is asked for every token. Of a mixed word with twins in both directions the form that it has more often
    is taken, and that of the dominant script if it has both as often; a mixed word is replaced even if the vocabulary has
    neither form, as no ordinary word mixes scripts and many names occur only once. A word with Greek twins is one unless
    the vocabulary has it with a small Greek letter (a name in capitals) and not its replaced form; a word of Cyrillic
    twins in a Russian text is one if the vocabulary has its replaced form more often than Russian texts have the word,
    and in another text unless Russian texts have it more often than any text its replaced form.
    """
    tokens = scan.select("table_name", "row_key", F.explode("tokens").alias("t")).select("table_name", "row_key", "t.*")
    asked = tokens.select("token", "form", "alt", "kind").distinct()
    wanted = asked.select(F.explode(F.array("token", "form", "alt")).alias("word")).where("word is not null").select(F.lower("word").alias("word"))
    words = checkpointed(vocabulary(texts, wanted))

    def known(column: str) -> DataFrame:
        return words.select(F.col("word").alias(f"w_{column}"), F.col("n").alias(f"n_{column}"), F.col("native").alias(f"native_{column}"), F.col("small_greek").alias(f"greek_{column}"))

    judged = asked
    for column in ("token", "form", "alt"):
        judged = judged.join(known(column), F.lower(column) == F.col(f"w_{column}"), "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    good = judged.where(
        F.when(F.col("kind") == "mixed", True)
        .when(F.col("kind") == "greek", (n("greek_token") == 0) | (F.col("n_form") > F.col("n_token")))
        .when(F.col("kind") == "whole", (F.length("token") > 1) & (F.col("n_form") > 4 * n("native_token")))
        .otherwise((F.length("token") == 1) | (n("native_token") <= n("n_form")))
    ).select("token", F.col("form").alias("first_form"), "kind", F.when(n("n_alt") > n("n_form"), F.col("alt")).otherwise(F.col("form")).alias("form"))
    return tokens.withColumnRenamed("form", "first_form").join(good, ["token", "first_form", "kind"]).select("table_name", "row_key", "token", "form")


def consistent(texts: DataFrame) -> DataFrame:
    """(table_name, row_key, form, found) of the rows of ``texts`` whose text is not in its consistent form, or was garbled.

    ``found`` tells whether the text holds a character of the kinds that are to be unified. Null and empty texts and
    texts already in form give no row; repeated rows of one key give one. What the scan of all texts leaves, and the few
    words that the vocabulary is asked for, are checkpointed, so that each is computed once.
    """
    scan = checkpointed(scanned(texts).groupBy("table_name", "row_key").agg(F.min(F.struct("form", "deviates", "tokens")).alias("x")).select("table_name", "row_key", "x.*"))
    swaps = confirmed(texts, scan).groupBy("table_name", "row_key").agg(F.collect_set(F.struct("token", "form")).alias("swaps"))
    joined = scan.join(swaps.withColumnsRenamed({"table_name": "t2", "row_key": "k2"}), (F.col("table_name") == F.col("t2")) & (F.col("row_key") == F.col("k2")), "left")
    return joined.select("table_name", "row_key", F.when(F.col("swaps").isNull(), F.col("form")).otherwise(_swap(F.col("form"), F.col("swaps"))).alias("form"), (F.col("deviates") | F.col("swaps").isNotNull()).alias("found"))


def _swap(form: Column, swaps: Column) -> Column:
    @F.pandas_udf("string")
    def swapped(forms: pd.Series, pairs: pd.Series) -> pd.Series:
        out = []
        for form, some in zip(forms, pairs):
            table = {p["token"]: p["form"] for p in some} if some is not None else {}
            out.append(_token.sub(lambda m: table.get(m.group(), m.group()), form) if table else form)
        return pd.Series(out, dtype=object)

    return swapped(form, swaps)
