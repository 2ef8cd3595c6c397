import pytest

from glossaflow.llm import lookalikes as L

@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("".join(chr(c) for c in (0xFF21, 0xFF42, 0xFF11)), "Ab1"), ("e" + chr(0x301), chr(0xE9)), (chr(0x212B), chr(0xC5)), ("x" + chr(0x200B) + "y", "xy"), ("a" + chr(0x2009) + "b", "a b"),
        ("a\tb", "a b"), (chr(0xFB01), "fi"), (chr(0xB5) + "g", chr(0x3BC) + "g"), (chr(0x304B) + chr(0x3099), chr(0x304C)), (chr(0x338E), "mg"),
    ],
)
def test_deviations(text, form):
    assert L._deviates(text) and L.basic_form(text) == form


@pytest.mark.parametrize("text", ["α-X, 10⁶ “q” – —", "（全角）！", "ज़रूरी", "क्‍ष", "line\nbreak", "étude ÅÖ", "", "Ω"])
def test_no_deviation(text):
    assert not L._deviates(text) and L.suspects(text) == [] or "α" in text


def test_letters_by_vocabulary(spark):
    names = ["GDA27 and GDA", "GHZHα", "kinase type", "ghzhα", "Введение снижало с у и повреждение", "THE word"]
    dirty = {1: "GDΑ here", 2: "GHZHΑ OR X", 3: "kіnаѕе", 4: "повpеждeниe", 5: "ѕее me", 6: "у больных с X вызывало", 7: "Τype x", 8: None, 9: "", 10: "x" * 50_000 + "е"}
    rows = [("passages", 100 + k, t) for k, t in enumerate(names)] + [("passages", k, t) for k, t in dirty.items()] + [("annotations", 1, "GDА"), ("annotations", 1, "GDА")]
    got = L.consistent(spark.createDataFrame(rows, "table_name string, row_key long, text string")).where("found").collect()
    forms = {(r.table_name, r.row_key): r.form for r in got}
    assert len(forms) == len(got)
    assert forms.pop(("passages", 10)).endswith("xe")
    assert forms == {("passages", 1): "GDA here", ("passages", 3): "kinase", ("passages", 4): "повреждение", ("passages", 5): "see me", ("passages", 7): "Type x", ("annotations", 1): "GDA"}


def test_garbled_is_no_case(spark):
    rows = [("passages", 1, "GrÃ¶Ã\x9fe Ã  5"), ("passages", 2, "РІРѕР·СЂР°СЃС‚")]
    assert L.consistent(spark.createDataFrame(rows, "table_name string, row_key long, text string")).where("found").count() == 0


def test_dominant_script_and_vocabulary_decide(spark):
    """A word with twins in both directions takes the form that the corpus has, else that of its dominant script."""
    assert [L.dominant(x) for x in ("cахар", "саxap", "abс", "GDΑ")] == ["Cyrillic", "Latin", "Latin", "Latin"]
    rows = [("passages", 1, "сладкий cахар"), ("passages", 2, "сахар и сахар были"), ("passages", 3, "the соре of it"), ("passages", 4, "cope cope"), ("passages", 5, "новый cухосох"), ("passages", 6, "a раceр")]
    got = {r.row_key: r.form for r in L.consistent(spark.createDataFrame(rows, "table_name string, row_key long, text string")).where("found").collect()}
    assert got == {1: "сладкий сахар", 3: "the cope of it", 5: "новый сухосох", 6: "a расер"}
