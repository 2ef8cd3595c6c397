"""Text decoded with a wrong character encoding: found and restored by strict round trips through candidate encodings."""

from __future__ import annotations

import re
from codecs import getincrementaldecoder
from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values. Encodings that UTF-8 bytes are wrongly read in.
READ_AS = ["cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "cp1250"]
#: (read as, meant as) of one byte a character.
SWAPPED = [("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1250"), ("cp1250", "cp1252")]
SWAPPED_CYRILLIC = [("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("mac_roman", "cp1251"), ("cp1252", "iso8859_5")]
#: (read as, meant as) of two bytes a character.
WIDE = [("cp1252", "gb18030"), ("cp1252", "cp932"), ("cp1252", "euc_jp")]
#: Russian letters by frequency per cent.
RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (10.97, 8.45, 8.01, 7.35, 6.70, 6.26, 5.47, 4.73, 4.54, 4.40, 3.49, 3.21, 2.98, 2.81, 2.62, 2.01, 1.90, 1.74, 1.70, 1.65, 1.59, 1.44, 1.21, 0.97, 0.94, 0.73, 0.64, 0.48, 0.36, 0.32, 0.26, 0.04, 0.04), strict=True))
#: Ranges of characters that restored text may consist of.
SOUND = [
    (0xA0, 0xFF), (0x152, 0x153), (0x160, 0x161), (0x178, 0x178), (0x17D, 0x17E), (0x192, 0x192), (0x2C6, 0x2DC), (0x300, 0x36F), (0x386, 0x3CE), (0x401, 0x45F), (0x490, 0x491), (0x900, 0x97F), (0xE00, 0xE5B), (0x1EA0, 0x1EF9), (0x2000, 0x200F),
    (0x2010, 0x2027), (0x202F, 0x203A), (0x2060, 0x2060), (0x2070, 0x208E), (0x20A0, 0x20BF), (0x2100, 0x212B), (0x2150, 0x215F), (0x2190, 0x2193), (0x2200, 0x2265), (0x2500, 0x25CF),
    (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xFB00, 0xFB04), (0xFEFF, 0xFEFF), (0xFF01, 0xFF5E),
]
#: Least drop of the cost for a swap of one-byte encodings, which unlike UTF-8 has no form of its own.
DROP = 0.5
#: Texts that the search goes on from at each layer.
BEAM = 3

#: Cyrillic letters that stand for Latin ones in look-alike text.
_TWINS = "аеорсухіјѕһАВЕКМНОРСТХУІЈЅ"
_no_controls = dict.fromkeys(range(0x80, 0xA0))
_cyrillic = re.compile("[Ѐ-ӿ]")
_latin = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]")
_odd_sign = "÷§¶©®¬¾¼½¤¦¨¯´¸ºª¹³±¡¿‚„ƒ†‡ˆ‰‹›•˜™√∂∫≈≠∞≤≥Ω∑∏π◊"
_boxes = "─-▟╀-╿⌐₧"
#: What no sound text of this kind contains: C1 controls, replacement signs, box drawing, accents and signs within words, capitals after small letters.
_ODD = [
    (3, re.compile(f"[\x80-\x9f�{_boxes}]")),
    (2, re.compile(f"(?<=[A-Za-zÀ-ÿ])[{_odd_sign}·¥£¢€«»×](?=[a-zß-ÿ])|(?<![^\\s(])[³¾¶™§](?=[a-zß-ÿ]{{2}})|(?<=[a-zß-ÿ])[¾¶¬¤](?!\\w)|(?<=[A-ZÀ-ÖØ-Þ])[{_odd_sign}](?=[A-ZÀ-ÖØ-Þ])")),
    (2, re.compile("(?<=[a-zß-öø-ÿ])[À-ÖØ-ÞŒŠŽŸ]")),
    (1, re.compile("[ŠšŽžŸÐðÞþƒˆ˜]")),
    (1, re.compile("(?<![^\\s(])[ÈÒÓÔÙÛÊË](?![^\\s,.;:!?)])|(?<![^\\s(])[ÒÔ](?=[a-z])|(?<![^\\s(])ô(?=[a-z])|(?<=[a-z])[ÓÕö](?![^\\s,.;:!?)])|(?<![^\\s(])ô(?=[A-Z])|(?<=[.,!?])[öÓÒÈÕ](?!\\w)|(?<=[A-Za-z])Æ(?=[a-z])")),
    (0.06, re.compile("[òìùëõåøæÿýÌÙÒÏËØÓÔÕÈÊÚÛ]")),
    (1.5, re.compile("(?<![^\\s(])[‹¸ⁿ∙⌠∩ΘΦΣ](?=[a-z])|(?<=[A-Za-zà-ÿ])[ΘΦΣΓΩ⌠∩∙ⁿτεδ](?=[a-zà-ÿ])|(?<=[a-zß-ÿ])[一-鿿぀-ヿ](?=[a-zß-ÿ])")),
    (1, re.compile("(?<=[а-яё])[А-ЯЁ]|(?<=[a-z])[—–](?=[\\s,.])|(?<=[.,!?])[À-ÿ](?!\\w)|(?<![^\\s(])[à-ÿ](?=[A-Z])")),
    (0.1, re.compile("(?<=[А-ЯЁ])[А-ЯЁ](?=[А-ЯЁ])")),
    (1, re.compile("[¿¡](?=[\\s,.;:)])|(?<=[a-z])[¿¡]|(?<![^\\s(])[żˇ](?=[A-Z])")),
    (1, re.compile("(?<=[a-z])[ÃÂ](?![a-z])|[ÃÂ](?=[^\\sA-Za-zÀ-ÿ]|$)|â(?=[^\\sA-Za-z’',.;:)!?-])|â€|Î(?=[^\\sA-Za-zÀ-ÿ])|√(?=[^\\s\\d(])|(?<=[a-z]),(?=Ä)")),
]


#: Cyrillic beside Latin letters: a cost, but no reason to suspect a text, as look-alike words have it too.
_mixed = re.compile("[a-zA-Z][Ѐ-џ]|[Ѐ-џ][a-zA-Z]")


@cache
def _to_char(encoding: str) -> dict[int, str]:
    """Characters of the bytes from 0x80; bytes that the encoding doesn't know are C1 controls, as lenient decoders have it."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


@cache
def _to_byte(encoding: str) -> dict[str, int]:
    table = {c: b for b, c in _to_char(encoding).items()}
    return table | {chr(b): b for b in range(0x80, 0xA0) if chr(b) not in table} | {c: b for b, c in ((b, chr(b)) for b in range(0xA0, 0x100)) if encoding == "cp1252"}


def _chars(encoding: str, low: int, high: int) -> str:
    return "".join(re.escape(c) for c, b in _to_byte(encoding).items() if low <= b <= high)


@cache
def _utf8_runs(encoding: str) -> re.Pattern:
    tail = f"[{_chars(encoding, 0x80, 0xBF)}]"
    one = f"(?:[{_chars(encoding, 0xC2, 0xDF)}]{tail}|[{_chars(encoding, 0xE0, 0xEF)}]{tail}{{2}}|[{_chars(encoding, 0xF0, 0xF4)}]{tail}{{3}})"
    return re.compile(f"{one}+")


@cache
def _wide_runs(meant: str) -> re.Pattern:
    high = _chars("cp1252", 0xA1, 0xFE)
    if meant == "gb18030":
        lead = _chars("cp1252", 0x81, 0xFE)
        return re.compile(f"(?:[{lead}][0-9][{lead}][0-9]|[{high}][{high}]|[{lead}][@-~{_chars('cp1252', 0x80, 0xFE)}])+")
    if meant == "euc_jp":
        return re.compile(f"(?:[{high}][{high}])+")
    lead = _chars("cp1252", 0x81, 0x9F) + _chars("cp1252", 0xE0, 0xFC)
    return re.compile(f"(?:[{lead}][@-~{_chars('cp1252', 0x80, 0xFC)}])+")


def _bytes(text: str, encoding: str) -> bytes:
    table = _to_byte(encoding)
    return bytes(table[c] if c >= "\x80" else ord(c) for c in text)


#: Fixed values. Cost of a character by range; ranges further down hold before those above them.
CHAR_COST = [
    (0x80, 0x10FFFF, 3), (0xA0, 0xBF, 0.05), (0xA2, 0xAA, 0.3), (0xA7, 0xA7, 0.05), (0xA9, 0xA9, 0.05), (0xAC, 0xAC, 0.3), (0xAE, 0xAF, 0.1), (0xB3, 0xB4, 0.2), (0xB6, 0xB6, 0.3), (0xB8, 0xB9, 0.2), (0xC0, 0xFF, 0.01), (0xE3, 0xE3, 0.02), (0xEB, 0xEB, 0.02), (0xEE, 0xF1, 0.02), (0xD0, 0xD0, 0.3), (0xD7, 0xD7, 0.2), (0xF7, 0xF7, 0.3), (0xDD, 0xDE, 0.3), (0xF0, 0xF0, 0.3), (0xFD, 0xFF, 0.3), (0x100, 0x24F, 0.8), (0x152, 0x153, 0.1), (0x160, 0x161, 0.02), (0x178, 0x178, 0.02), (0x17D, 0x17E, 0.02), (0x192, 0x192, 0.5), (0x2B0, 0x2FF, 1), (0x300, 0x36F, 0.05), (0x370, 0x3FF, 0.6),
    (0x391, 0x3C9, 0.01), (0x400, 0x52F, 1.5), (0x900, 0x97F, 0.02), (0xE00, 0xE5B, 0.02), (0x1EA0, 0x1EF9, 0.5), (0x2000, 0x206F, 0.05), (0x2013, 0x2026, 0.01), (0x2020, 0x2021, 0.5), (0x2030, 0x2030, 0.5), (0x2039, 0x203A, 0.3), (0x2070, 0x208E, 0.05),
    (0x207F, 0x207F, 0.5), (0x20A0, 0x20BF, 0.5), (0x20A7, 0x20A7, 3), (0x20AC, 0x20AC, 0.1), (0x2100, 0x212B, 0.2), (0x2150, 0x215F, 0.2), (0x2190, 0x2193, 0.1), (0x2200, 0x22FF, 1), (0x2212, 0x2212, 0.05), (0x2264, 0x2265, 0.05),
    (0x2248, 0x2248, 0.1), (0x2260, 0x2260, 0.1), (0x3001, 0x3011, 0.02), (0x3040, 0x30FF, 0.02), (0x4E00, 0x9FFF, 0.8), (0xFB00, 0xFB04, 0.3), (0xFEFF, 0xFEFF, 0.1), (0xFF01, 0xFF5E, 0.03), (0xFF61, 0xFF9F, 1.5),
]


@cache
def _char_cost(c: str) -> float:
    """What a character costs by itself: Russian letters by their rarity, hanzi by whether a national standard has them among its frequent ones."""
    if c < "\x80":
        return 0
    if (share := RUSSIAN.get(c.lower())) is not None:
        return 0.05 + min(1, max(0, 0.12 * (-log(share / 100) - 3.2)))
    if "一" <= c <= "鿿":
        for e, low, high in (("gb2312", 0xB0, 0xD7), ("shift_jis", 0x88, 0x97)):
            try:
                if low <= c.encode(e)[0] <= high:
                    return 0.05
            except UnicodeEncodeError:
                pass
    return next(w for a, b, w in reversed(CHAR_COST) if a <= ord(c) <= b)


@cache
def _layered() -> re.Pattern:
    """What is UTF-8 in a Western encoding; leads that are quotation marks or dashes are left out, as these stand before letters."""
    parts = []
    for e in ("cp1252", "mac_roman", "cp437", "cp850"):
        two = "".join(c for c in _to_byte(e) if 0xC2 <= _to_byte(e)[c] <= 0xDF and c not in "«»…–—“”‘’‹› ")
        tail = f"[{_chars(e, 0x80, 0xBF)}]"
        parts.append(f"[{re.escape(two)}]{tail}|[{_chars(e, 0xE0, 0xEF)}]{tail}{{2}}")
    return re.compile("|".join(parts))


def cost(text: str) -> float:
    """The garbling cost of ``text``: its letters and signs that are out of place, and what can be read as UTF-8, weighted, and a little for each non-ASCII character."""
    if text.isascii():
        return 0.0
    return len(_layered().findall(text)) + 1.5 * len(_mixed.findall(text)) + sum(w * len(p.findall(text)) for w, p in _ODD) + sum(n * _char_cost(c) for c, n in Counter(text).items() if c > "\x7f")


def _sound_run(run: str, new: str, before: str, after: str, encoding: str) -> bool:
    """Whether a restored run can stand between its neighbours."""
    if encoding in ("cp866", "koi8_r") and (len(run) < 6 and not re.search(f"[{_boxes}]", run) or _cyrillic.match(before) or _cyrillic.match(after)):
        return False
    if encoding == "cp1251" and (_latin.match(before) or _latin.match(after)) and not set(run) - set(_TWINS):
        return False
    if encoding == "cp1251" and (_cyrillic.match(before) or (len(new) == 1 and _cyrillic.match(after))):
        return False
    if any("̀" <= c <= "ͯ" for c in new) and (encoding == "mac_roman" or not before.isalpha()):
        return False
    if encoding in ("mac_roman", "cp1251", "koi8_r") and _cyrillic.match(new) and len(new) == 1:
        return not (_latin.match(before) or _latin.match(after)) and before in " \n(«" and after in " \n),.;:»" and before + after != "  "
    return True


def _from_utf8(text: str, encoding: str) -> tuple[str, bool]:
    """(``text`` with its runs that are UTF-8 in ``encoding``, whether they hold all its characters beyond ASCII)."""
    runs, left = _utf8_runs(encoding), 0
    whole = len(_nonascii.findall(text)) > 5 and not _nonascii.search(runs.sub("", text))

    def restore(m: re.Match) -> str:
        nonlocal left
        run = m.group()
        try:
            new = _bytes(run, encoding).decode("utf-8")
        except UnicodeDecodeError:
            return run
        before, after = text[m.start() - 1 : m.start()] or " ", text[m.end() : m.end() + 1] or " "
        if not whole and (cost(new) > cost(run) or not _sound_run(run, new, before, after, encoding)):
            return run
        left += len(run)
        return new

    new = runs.sub(restore, text)
    return new, left > 3 and left == len(_nonascii.findall(text))


_hanzi = re.compile("[一-鿿]")
_kana = re.compile("[぀-ヿ]")
_wide_sound = re.compile("[一-鿿　-〿぀-ヿ！-～Α-Ωα-ωÀ-ÿ\x00-\x7f‘-”…—–μ°±×℃·]*")


def _utf8_so_far(raw: bytes) -> bool:
    """Whether ``raw`` is UTF-8, but for a character that its end cuts."""
    try:
        getincrementaldecoder("utf-8")().decode(raw)
    except UnicodeDecodeError:
        return False
    return True


def _from_wide(text: str, meant: str) -> str:
    """Runs of two-byte characters read as Western. One that can't be anything else must be there; then all that decode to sound characters count."""
    strong = False
    utf8 = sum(len(x) for x in _utf8_runs("cp1252").findall(text) if _utf8_so_far(_bytes(x, "cp1252")))
    if 2 * utf8 > sum(c > "\x7f" for c in text):
        return text  # most of it is UTF-8

    def restore(m: re.Match, weak: bool) -> str:
        nonlocal strong
        run = m.group()
        for cut in (0, 1):
            part = run[: len(run) - cut]
            try:
                raw = _bytes(part, "cp1252")
                if meant != "cp932" and min(raw) >= 0x80 and _utf8_so_far(raw):
                    return run
                new = raw.decode(meant)
            except (UnicodeDecodeError, KeyError):
                continue
            if not new or not _wide_sound.fullmatch(new):
                continue
            kana, hanzi = len(_kana.findall(new)), len(_hanzi.findall(new))
            if meant == "gb18030":
                good = len(set(_hanzi.findall(new))) >= min(hanzi, 3) and hanzi >= 2 and sum(b >= 0x80 for b in raw) >= 1.7 * len(new) and kana <= 0.3 * len(new)
            elif meant == "cp932":
                good = kana >= 1 and kana + hanzi >= 3 or hanzi >= 3 and any("\x80" <= c <= "\x9f" for c in run)
            else:
                good = kana >= 2 and kana >= 0.3 * len(new)
            strong = strong or good
            if good or (weak and (min(raw[::2]) >= 0x80) and any(c > "\x7f" for c in new)):
                return new + run[len(run) - cut :]
        return run

    new = _wide_runs(meant).sub(lambda m: restore(m, False), text)
    return _wide_runs(meant).sub(lambda m: restore(m, True), new) if strong else text


_gbk_run = re.compile("[¤-￥�]+")


def _from_gbk(text: str) -> str:
    """UTF-8 read as GBK: the longest stretches of each run that are strict UTF-8 again. Only beside a replacement sign may a character be cut; it is lost with it."""

    def stretch(raw: list[bytes | None], i: int, skip: int) -> tuple[int, str]:
        decoder, best, got, so_far = getincrementaldecoder("utf-8")(), i, "", ""
        for j in range(i, len(raw)):
            if raw[j] is None:
                return j, so_far
            try:
                so_far += decoder.decode(raw[j][skip if j == i else 0 :])
            except UnicodeDecodeError:
                break
            if not decoder.getstate()[0]:
                best, got = j + 1, so_far
        return best, got

    def restore(m: re.Match) -> str:
        run, out, i = m.group(), [], 0
        raw = [None if c == "�" else _gbk_bytes(c) for c in run]
        if not any(raw) or any(r is None and c != "�" for r, c in zip(raw, run)):
            return run
        while i < len(run):
            end, new = i, ""
            if raw[i] is not None:
                end, new = stretch(raw, i, 0)
                if end == i and i and raw[i - 1] is None:
                    for skip in (1, 2):
                        if all(0x80 <= x < 0xC0 for x in raw[i][:skip]) and end == i:
                            end, new = stretch(raw, i, skip)
            if end > i and (end - i > 2 or end - i == len(run) or end < len(run) and raw[end] is None) and cost(new) < cost(run[i:end]):
                out.append(new)
                i = end
            else:
                out.append(run[i])
                i += 1
        return re.sub("�+", "�", "".join(out))

    return _gbk_run.sub(restore, text)


@cache
def _gbk_bytes(c: str) -> bytes | None:
    try:
        return c.encode("gbk")
    except UnicodeEncodeError:
        return None


#: Signs that stand beside words.
_PLAIN = set("“”„‘’–—…±°·«»×µ•")
_elided = re.compile("[«(“]?[LlDdNnMmTtSsJjCc]’[a-zà-ÿ]")


def _swapped(text: str, read_as: str, meant: str) -> str:
    """``text`` with its words, of letters beyond ASCII in ``read_as``, as ``meant``: those that improve; if some clearly do, also those that a sign begins or cuts and that then are words."""
    table, back = _to_byte(read_as), _to_char(meant)

    def words(drop: float) -> str:
        def word(m: re.Match) -> str:
            w = m.group()
            if w.isascii() or any(c > "\x7f" and c not in table for c in w):
                return w
            new = "".join(back[table[c]] if c > "\x7f" else c for c in w)
            less = cost(w) - cost(new)
            better = less > drop or drop < DROP and less > -0.1 and (not set(w) & _PLAIN and sum(map(str.isalpha, new)) > sum(map(str.isalpha, w)) or _elided.match(new) is not None or new == "à")
            return new if better else w

        return re.sub(r"\S+", word, text)

    return words(0.04) if words(DROP) != text else text


_beside_latin = re.compile(r"(?<=[A-Za-z])[^\x00-\x7f]|[^\x00-\x7f](?=[A-Za-z])")
_piece_ru = re.compile(r"[^.!?\n]+[.!?\n]*")


def _swapped_cyrillic(text: str, read_as: str, meant: str) -> str:
    """``text`` with its sentences in which the swap gives Russian at a lower cost; if some clearly do, also those that gain little."""
    table, back = _to_byte(read_as), _to_char(meant)

    def pieces(drop: float) -> str:
        def piece(m: re.Match) -> str:
            p = m.group()
            high = [c for c in p if c > "\x7f" and c in table]
            if not high or drop == DROP and len(high) < 4 or len(_beside_latin.findall(p)) > 0.1 * len(high):
                return p
            new = "".join(back[table[c]] if c > "\x7f" and c in table else c for c in p)
            if sum("Ѐ" <= back[table[c]] <= "ӿ" for c in high) < 0.7 * len(high):
                return p
            return new if cost(new) < cost(p) - drop else p

        return _piece_ru.sub(piece, text)

    return pieces(0.02) if pieces(DROP) != text else text


_ask = re.compile(
    r"^\W*(does|do|did|is|are|was|were|has|have|can|could|should|will|would|what|which|who|why|when|where|how|führt|wirkt|ist|sind|hat|kann|soll|welche|was|warum|wie|weshalb|est-ce|faut-il|quel|quelle|es|sirve|name)\b", re.I
)
_lost_in_word = re.compile(r"(?<=[^\W\d_])\?+(?=[a-zß-ÿ])|(?<![^\s(„“«])\?+(?=[A-Za-zÀ-ÿ])")


def lost_marks(text: str) -> list[int]:
    """Places of question marks that stand for lost characters: within a word or before one. One that ends a question before a small-lettered sentence without a blank does not count."""
    out = []
    for m in _lost_in_word.finditer(text):
        at = m.start()
        if at and text[at - 1].isalpha():
            begin = max(text.rfind(c, 0, at) for c in ".!?\n") + 1
            tail = re.match(r"[^\W_]*[-\w]*", text[m.end() :]).group()
            if _ask.match(text[begin:at]) and (re.search(r"[\d-]", tail) or len(tail) > 9 or not re.search(r"[àâäçéèêëîïôöùûüñáíóúãõßÀ-Þ]", text)):
                continue
        out.append(at)
    return out


@cache
def _suspects() -> re.Pattern:
    """What may start a repair; text without is sound. Leads and tails are those of UTF-8 characters that sound text has."""
    parts = []
    for e in READ_AS:
        if e in ("cp866", "koi8_r"):
            continue
        lead = "".join(_chars(e, a, b) for a, b in ((0xC2, 0xC6), (0xCB, 0xD2), (0xE0, 0xE0), (0xE2, 0xE9), (0xEF, 0xF0)))
        parts.append(f"[{lead}][{_chars(e, 0x80, 0xBF)}]")
    return re.compile("|".join([*parts, f"[\x80-\x9f�{_boxes}]", "[¡-þ]{4}", *[p.pattern for w, p in _ODD if w >= 1], "[ЂЃЉЊЌЋЏђѓљњќћџЎўЈҐЄЇІіґєјЅѕї]", "[а-я][А-Я]", "[А-Я]{4}"]))


_nonascii = re.compile(r"[^\x00-\x7f]")
_around = re.compile(r"[^\n]?[^\x00-\x7f]+[^\n]?", re.S)


def suspicious(text: str) -> bool:
    """Whether the non-ASCII characters of ``text``, each with its neighbours, may be garbled."""
    if text.isascii():
        return False
    near = "\n".join(_around.findall(text))
    return bool(_suspects().search(near)) or (_hanzi.search(near) is not None and (new := _from_gbk(near)) != near and cost(new) < cost(near))


_odd_hanzi = re.compile("[㐀-鿿�]")
_swap_signs = re.compile("[À-ÿ]|[╩╚■═╧]|[\x80-\x9f]|[Ѐ-ӿ]")


def readings(text: str) -> list[tuple[bool, float, str]]:
    """(whether all characters beyond ASCII are UTF-8, cost, another reading of ``text``), one layer taken off.

    What has a form of its own goes first: UTF-8 throughout, then two-byte characters, then some UTF-8; only texts that
    none of these explains are read as a swap of one-byte encodings, which must lower the cost clearly, as must those of
    two-byte characters.
    """
    before = cost(text)

    def judged(layers, drop: float = 0) -> list[tuple[bool, float, str]]:
        rows = [(whole, cost(new), new) for new, whole in layers if new != text]
        return [r for r in rows if not drop or r[1] < before - drop]

    layers = judged([_from_utf8(text, e) for e in READ_AS])
    if whole := [x for x in layers if x[0]]:
        return whole
    cyrillic = judged([(_swapped_cyrillic(text, *x), False) for x in SWAPPED_CYRILLIC], DROP) if _swap_signs.search(text) else []
    if re.search("[\x80-\x9f¡-þ‚ƒ]{2}", text) and (wide := judged([(_from_wide(text, meant), False) for _, meant in WIDE], DROP)):
        high = len(_nonascii.findall(text))
        if wide := [x for x in wide if (less := len(text) - len(x[2])) >= 3 or 3 * less > high]:
            return wide + cyrillic
    if _odd_hanzi.search(text):
        layers += judged([(_from_gbk(text), False)])
    if any(c < before for _, c, _ in layers):
        return layers
    swaps = judged([(_swapped(text, *x), False) for x in SWAPPED], DROP) if not _cut_utf8.search(text) and any(p.search(text) for w, p in _ODD if w >= 1) else []
    return layers + cyrillic + swaps


def restored(text: str) -> str:
    """The reading of ``text`` of least cost, over any number of layers: the BEAM best readings are read on until one is sound or there are no others.

    UTF-8 has a form of its own and shortens the text, so that a layer of it may come off before the cost drops; readings
    that explain all characters beyond ASCII go first.
    """
    best, least = text, cost(text)
    open_, seen = [text], {text}
    while open_:
        found = []
        for t in open_:
            for whole, c, new in readings(t):
                if new not in seen:
                    seen.add(new)
                    found.append((not whole, c, new))
                    if c < least:
                        least, best = c, new
        if best != text and not suspicious(best):
            break
        open_ = [new for _, _, new in sorted(found)[:BEAM]]
    return best


def repair(text: str | None) -> tuple[str | None, bool, bool]:
    """(restored text, whether ``text`` was garbled, whether something can't be restored).

    Layer by layer, and over any number of them, text is read as it may have been meant: UTF-8 read in a one-byte
    encoding or GBK, two-byte encodings read as Western, one one-byte encoding read as another, each decoded strictly. The
    reading of least cost is taken. Null and empty texts are sound.
    """
    if not text:
        return text, False, False
    lost = bool(lost_marks(text)) if "?" in text else False
    if not suspicious(text):
        return text, lost, lost
    now = restored(text)
    rest = lost or _unrestored(now) or now != text and bool(_out_of_place.search(now))
    return now, now != text or rest, rest


#: What is left of UTF-8 in a Western encoding where bytes are lost.
_cut_utf8 = re.compile("â€|[ÃÂ](?=[°±²³·»«¿¡§©®?])|(?<=[a-zß-öø-ÿ])[ÃÂ](?![A-ZÀ-ÖØ-Þ])|â(?=[⁰-⁹º¹²³¶µ™])")
_leftover = re.compile(f"[\x80-\x9f�{_boxes}]|â€|(?<=[a-zß-öø-ÿ])[ÃÂ](?![A-ZÀ-ÖØ-Þ])|[ÃÂ](?=[°±²³·»«¿¡§©®—–¼½¾])|â(?=[⁰-⁹º¹²³¶µ€™œ]|[ -⃿])|Ã(?=[\\s?.,;)]|$)|Î(?=[±-¿])|ƒ|√(?=[A-Za-zÀ-ÿ©®±])")


#: Signs that in a restored text show that some of it is not.
_out_of_place = re.compile("|".join([p.pattern for w, p in _ODD if w >= 2]) + "|[ЂЃЉЊЌЋЏђѓљњќћџЎўЈҐЄЇґєјїĂăĄąĆćĐđĘęĽľŃńŇňŐőŔŕŘřŚśŞşŢţŤťŮůŰűŹźŻż]|(?<=[A-Za-zà-ÿ])[一-鿿぀-ヿ](?=[a-zà-ÿ])")


def _unrestored(text: str) -> bool:
    return bool(_leftover.search(text)) or sum(w * len(p.findall(text)) for w, p in _ODD[1:3]) >= 2


def unrestored_places(text: str) -> list[tuple[int, int]]:
    """[begin, end) of the signs of a restored text that can't be restored: what makes repair() call it lossy."""
    odd = [m.span() for _, p in _ODD[1:3] for m in p.finditer(text)] if sum(w * len(p.findall(text)) for w, p in _ODD[1:3]) >= 2 else []
    return [(a, a + 1) for a in lost_marks(text)] + [m.span() for m in _leftover.finditer(text)] + odd


def _apply(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repair(t) for t in texts], columns=["text", "garbled", "lossy"])


def candidates(c: Column) -> Column:
    """Whether a text can be garbled at all: it has a non-ASCII character, or a question mark beside a letter. Everything else skips Python."""
    return c.rlike(r"[^\x00-\x7f]") | c.rlike(r"\?[A-Za-z]")


def repaired(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and (text, garbled, lossy) of the rows of ``df`` that may be garbled; null texts are left out."""
    schema = df.select(*keys).schema
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b[keys].reset_index(drop=True), _apply(b["__text"])], axis=1)

    return df.where(F.col(text).isNotNull() & candidates(F.col(text))).select(*keys, F.col(text).alias("__text")).mapInPandas(run, f"{names}, text string, garbled boolean, lossy boolean")


def masked(text: str) -> str:
    """``text`` without what is left of garbling: C1 controls, and blanks and soft hyphens beside leftover signs."""
    return re.sub("[\x80-\x9f]|(?<=[ÃÂâРСÐÑ])[\xa0\xad]|(?<=[^\x00-\x7f])[\xa0\xad](?=[^\x00-\x7f])", "", text)
