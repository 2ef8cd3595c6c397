"""Porter (1980) and Lancaster (Paice 1990) stemming, from the published algorithms."""

from __future__ import annotations

import re



def _shape(stem: str) -> str:
    out = ""
    for i, c in enumerate(stem):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _cvc(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replace(word: str, rules: list[tuple[str, str]], least: int) -> str:
    for end, new in rules:
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            return stem + new if _measure(stem) > least else word
    return word


#: Fixed values of the algorithm's steps 2 to 4; longer endings stand before those they end in.
_STEP2 = [tuple(x.split(">")) for x in "ational>ate tional>tion enci>ence anci>ance izer>ize abli>able alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble".split()]
_STEP3 = [tuple(x.split(">")) for x in "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>".split()]
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    """The Porter stem of a word; words of one or two letters stay."""
    w = word.lower()
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(w, _STEP2, 0)
    w = _replace(w, _STEP3, 0)
    for end in sorted([*_STEP4, "sion", "tion"], key=len, reverse=True):
        if w.endswith(end):
            cut = w[: len(w) - (3 if end in ("sion", "tion") else len(end))]
            if _measure(cut) > 1:
                w = cut
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


#: Fixed values. The published rules: reversed ending, * for intact words only, letters to remove, letters to append, > to go on or . to stop.
_RULES = (
    "ai*2. a*1. bb1. city3s. ci2> cn1t> dd1. dei3y> deec2ss. dee1. de2> dooh4> e1> feil1v. fi2> gni3> gai3y. ga2> gg1. ht*2. hsiug5ct. hsi3> i*1. i1y> ji1d. juf1s. ju1d. jo1d. jeh1r. jrev1t. jsim2t. jn1d. j1s. "
    "lbaifi6. lbai4y. lba3> lbi3. lib2l> lc1. lufi4y. luf3> lu2. lai3> lau3> la2> ll1. mui3. mu*2. msi3> mm1. nois4j> noix4ct. noi3> nai3> na2> nee0. ne2> nn1. pihs4> pp1. re2> rae0. ra2. ro2> ru2> rr1. rt1> rei3y> "
    "sei3y> sis2. si2> ssen4> ss0. suo3> su*2. s*1> s0. tacilp4y. ta2> tnem4> tne3> tna3> tpir2b. tpro2b. tcud1. tpmus2. tpec2iv. tulo2v. tsis0. tsi3> tt1. uqi3. ugo1. vis3j> vie0. vi2> ylb1> yli3y> ylp0. yl2> ygo1. "
    "yhp1. ymo1. ypo1. yti3> yte3> ytl2. yrtsi5. yra3> yro3> yfi3. ycn2t> yca3> zi2> zy1s."
)
_rules: dict[str, list[tuple[str, bool, int, str, bool]]] = {}
for _r in _RULES.split():
    _m = re.fullmatch(r"([a-z]+)(\*?)(\d)([a-z]*)([>.])", _r)
    _rules.setdefault(_r[0], []).append((_m[1][::-1], bool(_m[2]), int(_m[3]), _m[4], _m[5] == ">"))


def lancaster(word: str) -> str:
    """The Lancaster stem of a word."""
    w = whole = word.lower()
    going = True
    while going and w:
        going = False
        for end, intact, remove, append, more in _rules.get(w[-1], ()):
            if not w.endswith(end) or (intact and w != whole):
                continue
            new = w[: len(w) - remove] + append
            rest = w[: len(w) - remove]
            good = len(rest) >= 2 if rest[:1] in tuple("aeiouy") else len(rest) >= 3 and any(c in "aeiouy" for c in rest[:3])
            if good:
                w, going = new, more
                break
    return w
