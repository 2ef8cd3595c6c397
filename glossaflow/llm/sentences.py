"""Sentence units across languages and scripts: character-property break rules, abbreviations by language, closing quotations."""

from __future__ import annotations

from collections.abc import Iterator

import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossaflow.llm import encoding
from glossaflow.llm.lookalikes import CYRILLIC
from glossaflow.session import spread_shuffled

#: Fixed values. Abbreviations by language that never end a sentence, and some that may.
NEVER = {
    "en": "e.g i.e cf vs fig figs dr prof mr mrs ms st approx no nos ver suppl tab eq ref refs vol resp ca viz",
    "de": "z b d h bzw ggf ca gem tab abb vgl dr prof nr med evtl sog inkl exkl u z.b d.h u.a s o.g z.t bspw st",
    "fr": "p ex c.-à-d cf fig figs env m mm dr pr v p.ex n tabl no",
    "es": "p ej v fig figs dr dra sr sra prof aprox p.ej ee núm n tab pág cf",
    "pt": "p ex v fig figs dr dra sr sra prof aprox p.ex núm n tab pág cf",
    "ru": "рис табл см проф акад т ср напр ул им стр д-р п",
    "hi": "डॉ श्री प्रो सं",
}
MAY = {
    "en": "al etc a.m p.m i.v i.m s.c u.s e.u u.k inc corp ltd co jr sr sp spp",
    "de": "usw etc al a u.a",
    "fr": "coll etc al",
    "es": "col etc al uu a.m p.m",
    "pt": "col etc al a.m p.m",
    "ru": "г гг др п т.п т.д т.е",
}
#: Units of two parts that never end a sentence.
PAIRS = regex.compile(r"(?i)(?<![^\W\d_])(?:z\. ?B|d\. ?h|u\. ?a|o\. ?ä|i\. ?d\. ?R|z\. ?T|p\. ?ex|p\. ?ej|c\.-à-d|т\. ?е|т\. ?к)\.$")
#: Signs of Sentence_Break class Close that close, not open, and what is left of lost ones.
CLOSERS = "".join(c for c in map(chr, range(0x2FFFF)) if regex.match(r"\p{SB=Close}", c) and unicodedata.category(c) in ("Pe", "Pf")) + "\"'�"
OPENERS = "\"'“‘„«([{「『（【〈《‹¿¡"

_closing = regex.escape(CLOSERS)
#: A terminator with what Extend, Format and closing signs follow it.
_end = regex.compile(rf"[\p{{SB=STerm}}\p{{SB=ATerm}}…]+(?:[^\S\n]?[»›](?!\w)|[{_closing}]|(?<=[\p{{SB=STerm}}\p{{SB=ATerm}}…])[\p{{SB=Extend}}\u200b]+(?=[{_closing}])|â€[\x80-\x9f™œ]?(?=\s|$))*")
#: Behind a terminator, a sign of class SContinue, or a semicolon, goes on with the sentence.
_continues = regex.compile(r"[\p{SB=SContinue};；]")
_invisible = "­​-‏⁠﻿"
_word_before = regex.compile(rf"[^\s(\[{{«“„\"—–…,;:/]*$")
_thai_gap = regex.compile(rf"(?<=\p{{Thai}}[{_invisible}]*)\s+(?=[{_invisible}]*\p{{Thai}})")
_lead = regex.compile(rf"[\s{_invisible}]*")
_blank = regex.compile(r"\s*")
_speech = regex.compile(r"\s*[,，—–-]")
_initial = regex.compile(r"\p{L}\.")
_year_or_name = regex.compile(r"\(\s*\p{Lu}")
_unit = regex.compile(r"\d[^\S\n]?$")
_after_ordinal = regex.compile(r"\s(?:Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Messung|Woche|Tag|Monat|Jahr|Mal|Auflage|Kapitel)")
_before_ordinal = regex.compile(r"(?:\b[Dd](?:er|ie|as|em|en|es)|\b[Aa]m|\b[Vv]om|\b[Zz]um|\b[Ii]m|\b[Bb]is)\s\d+$")
_initials = regex.compile(r"(?:\p{L}\.)+\p{L}")
_small_or_digit = regex.compile(r"[a-z0-9]")
_coded = regex.compile(r"\p{Ll}\S*[\d\-–]")
_thai = regex.compile(r"\p{Thai}")
#: Marks that open and what closes them.
PAIRED = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]"}
_mark = regex.compile("[“”„«»「」『』()（）\\[\\]]")

#: Frequent words that tell the languages of Latin script apart, where a text names none.
WORDS = {"en": "the of and with was in", "de": "der die das und bei mit von", "fr": "la le de du les une est", "es": "el la los en un de no", "pt": "o a os em um não com"}
_hints = {k: frozenset(v.split()) for k, v in WORDS.items()}
_never = {k: frozenset(v.split()) for k, v in NEVER.items()}
#: Abbreviations that are no words of another language, so that they count in any.
_anywhere = frozenset(x for v in _never.values() for x in v) - {"nos", "ver", "ref", "vol", "med", "cap", "ref", "refs"}
_may = {k: frozenset(v.split()) for k, v in MAY.items()}


_scripts = [(k, regex.compile(p)) for k, p in (("ja", r"[\p{Hiragana}\p{Katakana}]"), ("zh", r"\p{Han}"), ("th", r"\p{Thai}"), ("hi", r"\p{Devanagari}"), ("ru", r"\p{Cyrillic}{3}"))]
_letters = regex.compile(r"\p{L}+")


def language(text: str, named: str | None) -> str:
    """The language of ``text``: as named, else by its script and frequent words."""
    if named and (code := named.strip().lower()[:2]) in (*_never, "zh", "ja", "th"):
        return code
    for code, script in _scripts:
        if script.search(text):
            return code
    words = _letters.findall(text.lower())
    return max(_hints, key=lambda k: (sum(w in _hints[k] for w in words), k == "en"))


_not_alphabetic = regex.compile(r"^.*[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}ー]")
_alphabetic_end = regex.compile(r"[\p{L}\p{M}\p{Nd}.'’–-]*$")
_hidden = regex.compile(f"[{_invisible}]")
_latin_twins = {ord(k): v for k, v in CYRILLIC.items()}


def _plain(word: str) -> str:
    """``word`` as abbreviations are listed: without invisible characters, look-alikes and what precedes its alphabetic end."""
    if word.isascii():
        return _alphabetic_end.search(word).group()
    word = unicodedata.normalize("NFKC", _alphabetic_end.search(_not_alphabetic.sub("", _hidden.sub("", word))).group())
    return word.translate(_latin_twins) if any(c.isascii() and c.isalpha() for c in word) else word


def _number_or_abbreviation(text: str, at: int, after: int, lang: str) -> bool:
    """Whether the full stop at ``at`` belongs to a number, an abbreviation or an initial, so that no sentence ends before ``after``. Only the signs around it are read."""
    before, behind = text[at - 1 : at] if at else "", text[at + 1 : at + 2]
    if behind.isdigit() and not before.isalpha():
        return True
    if behind in ("-", "‐", "‑") and behind or (before.isalpha() and not text[max(0, at - 2) : at - 1].isalpha() and _initial.match(text, at + 1)):
        return True
    word = _plain(_word_before.search(text, max(0, at - 24), at).group())
    follow = text[after : after + 1]
    low = word.lower()
    if PAIRS.search(text[max(0, at - 10) : at + 1]):
        return True
    bare = low.rstrip(".")
    if bare in _may.get(lang, ()) or (lang not in _may and bare in _may["en"]):
        if follow == "(" and not _year_or_name.match(text, after):
            return True
        return not (follow and (follow.isupper() or follow in OPENERS or follow.isdigit() and bare not in ("u.s", "e.u", "u.k", "г")))
    if bare in _never.get(lang, ()) or (len(bare) > 2 and bare in _anywhere):
        # units of one letter after a number end a sentence
        return not (len(bare) == 1 and _unit.search(text, max(0, at - 3), at - 1))
    if len(word) == 1 and word.isupper() and text[max(0, at - 2) : at - 1] not in ("°", "º"):
        return bool(follow) and (follow.islower() or lang == "fr" and word == "M")
    if lang == "de" and word.isdigit() and len(word) < 3:
        return bool(_after_ordinal.match(text, at + 1) or _before_ordinal.search(text[max(0, at - 16) : at]))
    if _initials.fullmatch(word):
        return not (follow and follow.isupper())
    return bool(not behind.isspace() and _small_or_digit.match(behind) and "." in word)


class Marks:
    """The quotation marks and brackets of a text, paired in one pass; each open one is known while the text is read on."""

    def __init__(self, text: str):
        self.places = [(m.start(), m.group()) for m in _mark.finditer(text)]
        self.closed: dict[int, int] = {}
        open_: dict[str, list[int]] = {}
        for at, c in self.places:
            for mark, closing in PAIRED.items():
                if c == closing and open_.get(mark):
                    self.closed[open_[mark].pop()] = at
                    break
            else:
                if c in PAIRED:
                    open_.setdefault(c, []).append(at)
        self.next, self.stack = 0, []

    def opened(self, start: int, at: int) -> tuple[str, int] | None:
        """(mark, place): the innermost mark within [start, at) that is still open at ``at``; places are asked for in order."""
        while self.next < len(self.places) and self.places[self.next][0] < at:
            place, c = self.places[self.next]
            self.next += 1
            if place < start:
                continue
            while self.stack and self.stack[-1][1] < start:
                self.stack.pop()
            if self.stack and c == PAIRED[self.stack[-1][0]]:
                self.stack.pop()
            elif c in PAIRED:
                self.stack.append((c, place))
        return self.stack[-1] if self.stack and self.stack[-1][1] >= start else None


def sentence_spans(text: str, lang: str | None = None, title: bool = False) -> list[tuple[int, int]]:
    """[start, end) of the sentences of ``text``, without the blanks around them; their starts are non-blank.

    A title is one sentence; blank text has none.
    """
    first = _blank.match(text).end()
    if first == len(text):
        return []
    if title:
        return [(first, len(text.rstrip()))]
    lang = language(text, lang)
    cuts = [m.end() for m in _thai_gap.finditer(text)] if _thai.search(text) else []
    start, marks = first, Marks(text)
    lost = set(encoding.lost_marks(text)) if "?" in text else ()
    for m in _end.finditer(text):
        if m.start() < start or m.start() in lost:
            continue
        stop = m.end()
        if text[stop : stop + 1] == "“" and (opened := marks.opened(start, m.start())) is not None and opened[0] == "„":
            stop += 1
        after = _lead.match(text, stop).end()
        if after >= len(text):
            break
        if _ends(text, start, m, stop, after, lang, marks):
            cuts.append(_blank.match(text, stop).end())
            start = cuts[-1]
    edges = sorted({first, *cuts})
    spans = [(a, len(text[a:b].rstrip()) + a) for a, b in zip(edges, [*edges[1:], len(text)], strict=True)]
    return [(a, b) for a, b in spans if b > a]


def _ends(text: str, start: int, m: regex.Match, stop: int, after: int, lang: str, marks: Marks) -> bool:
    mark, follow = text[m.start() : stop], text[after]
    sign = mark.rstrip("\u00e2\u20ac\u2122\u0153\u201c \u00a0\u202f\u200b" + CLOSERS)
    closed = mark[len(sign) :].strip()
    gap = text[stop:after]
    opened = marks.opened(start, m.start())
    if sign == "." and not closed and _number_or_abbreviation(text, m.start(), after, lang):
        return False
    if sign[-1] == "…" or sign == "...":
        return (follow.isupper() and bool(gap)) or "\n" in gap
    if follow in CLOSERS and follow not in "\"'“" or _continues.match(follow):
        return False
    if closed:
        if opened is None:
            return True
        sort, place = opened
        lead = text[start:place].rstrip()
        if sort in "([（":
            return not lead or follow.isupper()
        if _speech.match(text, stop):
            return False
        if follow.islower() and not _coded.match(text, after) and lang not in ("zh", "ja", "th", "hi"):
            return bool(lead) and lead[-1] in ":：,，" and bool(gap)
        if lang in ("zh", "ja", "hi"):
            if lead and lead[-1] in ":：":
                return True
            if not lead:
                return bool(gap) or lang == "zh" and sign[-1] in "。."
            return False
        return True
    if opened is not None:
        # within a quotation or bracket that closes further on: its sentences are parts of the whole one
        return marks.closed.get(opened[1], -1) < stop
    return True


def _placed(stored: str, restored: str, places: list[int]) -> list[int] | None:
    """Places in the ``restored`` text as places in the ``stored`` one; None if their ASCII characters differ.

    ASCII characters are the same in both; between them a place follows from the bytes of the characters before it.
    """
    if [c for c in stored if c < "\x80"] != [c for c in restored if c < "\x80"]:
        return None
    anchors = [(-1, -1), *zip((i for i, c in enumerate(restored) if c < "\x80"), (i for i, c in enumerate(stored) if c < "\x80")), (len(restored), len(stored))]
    out, k = [], 0
    for p in places:
        while k + 1 < len(anchors) and anchors[k + 1][0] <= p:
            k += 1
        a, b = anchors[k]
        if a == p:
            out.append(b)
            continue
        c, d = anchors[k + 1]
        part, whole = len(restored[a + 1 : p].encode()), len(restored[a + 1 : c].encode())
        out.append(b + 1 + round(part * (d - b - 1) / max(1, whole)))
    return out


def stored_spans(text: str, lang: str | None, title: bool) -> list[tuple[int, int]]:
    """sentence_spans of a text as stored: one that is garbled is restored, split and mapped back."""
    restored, garbled, _ = encoding.repair(text) if not title else (text, False, False)
    if garbled and restored != text:
        spans = sentence_spans(restored, lang, title)
        if (starts := _placed(text, restored, [a for a, _ in spans])) is not None:
            return [(a, len(text[a:b].rstrip()) + a) for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
    return sentence_spans(text, lang, title)


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [
            (key, offset + a, text[a:e])
            for key, offset, text, lang, title in zip(b["passage_id"], b["passage_offset"], b["text"], b["lang"], b["title"], strict=True)
            for a, e in stored_spans(text, lang, bool(title))
        ]
        yield pd.DataFrame(rows, columns=["passage_id", "char_offset", "text"])


def sentences(passages: DataFrame) -> DataFrame:
    """(passage_id, char_offset, text): the sentences of the passages with a text, each passage once.

    Passages without a text, which came with sentences, are not split again: given_sentences() has theirs. Empty and
    blank texts have none; a null offset counts as 0; of repeated rows one counts.
    """
    row = F.struct("text", F.coalesce("passage_offset", F.lit(0)).alias("passage_offset"), "lang", _is_title(passages).alias("title"))
    once = passages.where("passage_id is not null and text is not null").groupBy("passage_id").agg(F.min(row).alias("x")).select("passage_id", "x.*")
    return spread_shuffled(once).mapInPandas(_rows, "passage_id bigint, char_offset int, text string")


def _is_title(passages: DataFrame):
    return F.coalesce(F.lower(F.element_at("infons", F.lit("type"))) == "title", F.lit(False))


def given_sentences(passages: DataFrame) -> DataFrame:
    """(passage_id, char_offset, text) as the source gave them, for the passages without a text; final blanks are cut, order is by offset."""
    given = passages.where("passage_id is not null and text is null").select("passage_id", F.explode("sentences").alias("s")).distinct()
    return given.where("s.text is not null").select("passage_id", F.col("s.char_offset").alias("char_offset"), F.rtrim(F.col("s.text")).alias("text"))
