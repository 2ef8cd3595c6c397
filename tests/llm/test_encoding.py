import itertools

import pytest

from glossaflow.llm import encoding as E

SOUND = [
    "EM CAMPINHÃO, A AÇÃO DE X confirmou A FUNÇÃO ÂNTERO-POSTERIOR", "L’état à l’âge adulte — « sûr ? » demandaient 3 malades. FONCTIONNÉ»", "Die Größe der Entzündung; ÄRZTE FÜR ÜBELKEIT", "«Опасен ли GDA27?» — спрашивали больные. ПЕЧЕНЬ И МОСКВА",
    "小鼠体内活性促进了4天后的代谢，见图4。“安全吗？”", "マウスにおける炎症を増加させた。「安全ですか。」", "β-ziosioxan at 5 °C, 4 × 10⁶ cells/ml ± 2 µm", "क्या सुरक्षित है?", "การติดเชื้อ DVD27 นี้", "", "safe?We then", "Is it safe?miR-970 was seen.", "ﬁshmonger ofｅ Ρaeneöm Gіѕugеѕіdіnе",
]
TEXTS = {
    "de": "Die Größe der Ausschüttung veränderte die Übelkeit über 7 Wochen („Wirkt β-X?“).", "fr": "L’infection à X a précédé la récidive après 3 mois à 4 °C.", "ru": "Введение XMH-912 ускоряло кровообращение печени через пять дней.",
    "zh": "小鼠体内活性显著提高了四天后的血流，没有改变坏死的程度。", "ja": "マウスにおけるリスクを有意に改善した。ダメージを増加させなかった。", "hi": "क्या यह दवा सुरक्षित है और उत्तर मिला।",
}


@pytest.mark.parametrize("text", SOUND)
def test_sound_texts_stay(text):
    assert E.repair(text) == (text, False, False)


@pytest.mark.parametrize(("lang", "read_as"), [*itertools.product(TEXTS, ["cp1252"]), *itertools.product(["de", "fr"], ["mac_roman", "cp437"]), ("ru", "cp1251"), ("zh", "gbk")])
def test_utf8_read_otherwise(lang, read_as):
    text = TEXTS[lang]
    raw = text.encode()
    if read_as == "gbk":
        try:
            garbled = raw.decode("gbk")
        except UnicodeDecodeError:
            garbled = raw.decode("gbk", "replace")
    else:
        garbled = "".join(chr(b) if b < 0x80 else E._to_char(read_as)[b] for b in raw)
    fixed, found, lossy = E.repair(garbled)
    assert found and (fixed == text or lossy)


def test_nested_and_partial():
    once = lambda t: "".join(chr(b) if b < 0x80 else E._to_char("cp1252")[b] for b in t.encode())
    assert E.repair(once(once(TEXTS["de"])))[:2] == (TEXTS["de"], True)
    assert E.repair("Größe. " + once("Größe größer"))[:2] == ("Größe. Größe größer", True)


@pytest.mark.parametrize(("meant", "read_as", "lang"), [("mac_roman", "cp1252", "de"), ("cp1252", "cp850", "fr"), ("cp1251", "koi8_r", "ru"), ("gb18030", "cp1252", "zh"), ("cp932", "cp1252", "ja")])
def test_other_encodings(meant, read_as, lang):
    text = TEXTS[lang].replace("β", "B")
    raw = text.encode(meant, "ignore")
    garbled = "".join(chr(b) if b < 0x80 else E._to_char(read_as)[b] for b in raw)
    fixed, found, _ = E.repair(garbled)
    assert found and sum(a == b for a, b in zip(fixed, text)) > 0.9 * len(text)


@pytest.mark.parametrize("text", ["La r?cidive du foie", "Gr��e der Leber", "the Tuxtriot?m fevers", "aquÃ?", "10â¶ cells"])
def test_lost_characters(text):
    assert E.repair(text)[1:] == (True, True)


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "plain", "x"), (4, "GrÃ¶ÃŸe", "x"), (4, "GrÃ¶ÃŸe", "x"), (5, "tÃ© " * 30_000, "x")]
    got = E.repaired(spark.createDataFrame(rows, "k int, t string, text string"), ["k"], "t").where("garbled").collect()
    assert sorted((r.k, r.text[:5]) for r in got) == [(4, "Größe"), (4, "Größe"), (5, "té té")]


def _read(raw: bytes, encoding: str) -> str:
    return "".join(chr(b) if b < 0x80 else E._to_char(encoding)[b] for b in raw)


@pytest.mark.parametrize(
    ("text", "pairs"),
    [
        ("Die Übung der Ärzte über die Größe.", [("cp1252", "mac_roman")]), ("Die Übung der Ärzte über die Größe.", [("cp1252", "mac_roman"), ("utf-8", "cp1252")]), ("über uns", [("cp1252", "cp437")]),
        ("Les élèves ont été vus à l’école", [("cp1252", "cp437")]), ("小鼠体内活性显著提高了四天后的血流。", [("gb18030", "cp1252"), ("utf-8", "cp1252")]), ("Введение препарата ускоряло кровообращение.", [("koi8_r", "cp1251"), ("utf-8", "mac_roman")]),
        ("L’infection a précédé la récidive.", [("utf-8", "gbk")]), ("β-X на печень влияло сильно", [("utf-8", "cp866"), ("utf-8", "cp437")]),
    ],
)
def test_nested_pairs_of_encodings(text, pairs):
    """Each (meant, read as) is undone, or what is left is called lossy."""
    garbled = text
    for meant, read_as in pairs:
        garbled = garbled.encode(meant, "replace").decode("gbk") if read_as == "gbk" else _read(garbled.encode(meant, "replace"), read_as)
    fixed, found, lossy = E.repair(garbled)
    assert found and (fixed == text.encode(pairs[0][0], "replace").decode(pairs[0][0]) or lossy)


@pytest.mark.parametrize("layers", [6, 7, 9])
def test_any_number_of_layers(layers):
    garbled = "Größe und Übelkeit"
    for _ in range(layers):
        garbled = _read(garbled.encode(), "cp1252")
    assert E.repair(garbled) == ("Größe und Übelkeit", True, False)


def test_a_gbk_run_is_decoded_strictly():
    """Frequent hanzi that happen to be UTF-8 bytes stay; a cut character is lost with its replacement sign, and no other."""
    assert E.repair("小鼠体内的代谢（P < 0.01）。") == ("小鼠体内的代谢（P < 0.01）。", False, False)
    garbled = "小鼠体内活性显著".encode()[:-1].decode("gbk", "replace")
    fixed, found, lossy = E.repair(garbled)
    assert found and lossy and fixed.startswith("小鼠体内活")
