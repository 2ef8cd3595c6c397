import pytest
from pyspark.sql import functions as F

from glossaflow.llm import sentences as S

CASES = [
    ("en", "Dr. Foo and Prof. Bar scored 3.5 (cf. Fig. 4).|They saw it at 5 p.m.|We then left, e.g. by bus.|“Is X safe?” was the question.|(Data are not shown.)|In U.S. and E.U. centres it works.|RESULTS: it works."),
    ("en", "“We stopped X early,” one said, “and it went away.”|gda27 was seen.|Most improved… but one did not.|p53 is as shown by Foo et al. (2001).|Costs, etc. were low"),
    ("de", "Dr. med. Foo prüfte am 8. Mai u. a. mit X.|Das Gremium schrieb: „X ist gut.“|„Wirkt X auch?“, fragten 3 Kranke.|Die 2. Messung ergab z. B. 3,5 mg."),
    ("fr", "L’essai n° 3 portait sur X !|« Est-ce que X est sûr ? » demandaient 8 malades.|Le Dr X et M. Y ont lu, p. ex. selon Z et coll. (2004).|Le comité a noté : « Aucun effet. »|Fin."),
    ("es", "«¿Sirve X aquí?», preguntaron 5 pacientes.|¿Es seguro en EE. UU. y otros (v. fig. 3)?|Sí, p. ej. X."),
    ("ru", "«Опасен ли X?» — спрашивали больные.|Проф. Y изучил X (рис. 4), т. е. за 12 ч.|У 5 больных."),
    ("zh", "委员会认为：“X无明显炎症。”|“X安全吗？”多数家属问道。|B. foo没有改变2.5%的风险；见图4！|完"),
    ("ja", "委員会は「Xに線維化はない。」と結論した。|「Xは安全ですか。」と家族は尋ねた。|終"),
    ("hi", "परिवार ने पूछा कि “क्या X ज़रूरी है?” और उत्तर मिला।|डॉ. X के यहाँ|".rstrip("|")),
    ("th", "ทีมวิจัยพบว่า X 4 มัก|ลดลง"),
]


@pytest.mark.parametrize(("lang", "marked"), CASES)
def test_boundaries(lang, marked):
    parts = marked.split("|")
    for gap in (" ", "\n", "  ") if lang not in ("zh", "ja") else ("", "\n"):
        text = gap.join(parts) if lang != "th" else " ".join(parts)
        assert [text[a:b] for a, b in S.sentence_spans(text, lang)] == parts


def test_missing_blank_and_title():
    assert [a for a, _ in S.sentence_spans("It ended here.We then saw.", "en")] == [0, 14]
    assert S.sentence_spans(" A vs. B. Really? ", "en", title=True) == [(1, 17)]
    assert S.sentence_spans(" \n ", "en") == []


def test_garbled_text_keeps_its_places():
    text = "Er war müde. „Ist es gut?“, fragte er. Ärzte sagten: „Ja.“ Ende."
    garbled = text.encode().decode("cp1252", "ignore") if False else "".join(chr(b) if b < 128 else bytes([b]).decode("cp1252", "replace") for b in text.encode())
    want = [garbled.index(x) for x in ("Er war", "â€žIst", "Ã„rzte", "Ende")] if "â€žIst" in garbled else None
    got = [a for a, _ in S.stored_spans(garbled, "de", False)]
    assert got[0] == 0 and got[-1] == garbled.index("Ende") and (want is None or got == want)


def test_rows(spark):
    rows = [(1, 5, " One. Two.", "en", {"type": "abstract"}, None, 0), (1, 5, " One. Two.", "en", {"type": "abstract"}, None, 0), (2, 0, "Title. x", None, {"type": "Title"}, None, 0), (3, 9, None, "en", None, [(9, "Given. "), (16, "S.")], 0), (4, None, "", None, None, None, 0), (5, None, "a. " * 20_000, "en", None, None, 0)]
    df = spark.createDataFrame(rows, "passage_id long, passage_offset int, text string, lang string, infons map<string,string>, sentences array<struct<char_offset int, text string>>, char_offset int")
    got = S.sentences(df)
    assert sorted((r.passage_id, r.char_offset, r.text) for r in got.where("passage_id < 5").collect()) == [(1, 6, "One."), (1, 11, "Two."), (2, 0, "Title. x")]
    assert got.where("passage_id = 5").count() == 20_000
    assert sorted((r.char_offset, r.text) for r in S.given_sentences(df).collect()) == [(9, "Given."), (16, "S.")]
    assert got.where(F.lit(False)).count() == 0


def test_marks_are_paired_over_any_distance():
    """A full stop within a quotation or bracket ends nothing, however far away it closes; one that never closes holds nothing."""
    inner = "It was seen. " * 60
    for a, b in (("“", "”"), ("(", ")"), ("„", "“")):
        text = f"They wrote {a}{inner.strip()}{b} then. End here."
        assert [text[x:y] for x, y in S.sentence_spans(text, "en")][-1] == "End here." and len(S.sentence_spans(text, "en")) == 2
    assert len(S.sentence_spans(f"They wrote (see {inner}", "en")) == 60


def test_short_passages_without_a_type_are_split(spark):
    row = [(1, 0, "One is here. Two is there.", "en", None)]
    df = spark.createDataFrame(row, "passage_id long, passage_offset int, text string, lang string, infons map<string,string>")
    assert S.sentences(df).count() == 2


def test_long_texts_take_linear_time():
    import time

    def took(n):
        text = "We saw (cf. Fig. 3) “much of it” in 2.5 ml. " * n
        began = time.process_time()
        assert len(S.sentence_spans(text, "en")) == n
        return time.process_time() - began

    took(100)
    assert took(50_000) < 40 * max(took(5_000), 0.05)
