import pytest

from glossaflow import config
from glossaflow.config import Dictionary
from glossaflow.operators import evaluation
from glossaflow.pipeline import Pipeline

LINE = "c\tr\tn1\t{}\t{}\tGene\n"


def _write(folder, **files):
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text, encoding="utf-8")


def test_any_number_of_stopwords(spark, tmp_path):
    """Far more than 100,000 stopwords count, each; an entry under one is compared exactly."""
    _write(tmp_path, terms__tsv=LINE.format("Was", "Was") + LINE.format("Foo", "Foo") + LINE.format("bar", "bar"), stop__txt="".join(f"word{k}\n" for k in range(150_000)) + "was\nbar\n", a__txt="was Was FOO bar BAR foo")
    s = config.Settings(input_directory=str(tmp_path), dictionaries=[Dictionary(path=str(tmp_path / "terms.tsv"), stopwords=str(tmp_path / "stop.txt"))])
    p = Pipeline(spark, s)
    assert sorted(r.text for r in p.process(p.load(str(tmp_path / "a.txt"))).entities.collect()) == ["FOO", "Was", "bar", "foo"]


def test_ids_name_files_and_what_is_lacking_comes_from_the_fallback(spark, tmp_path):
    bioc = '{"documents": [{"id": "3", "passages": [{"offset": 0, "text": "three"}]}]}'
    _write(tmp_path, in_1__txt="one", in_2__txt="two", b_3__json=bioc, b_1__json=bioc.replace("three", "never read"))
    s = config.Settings(input_directory=str(tmp_path), article_format="txt", fn_format_in="in_{id}.txt", fallback_format="bioc_json", fn_format_fallback="b_{id}.json")
    got = Pipeline(spark, s).load_ids(spark.createDataFrame([("1",), ("3",), ("9",), ("1",)], "id string"))
    assert sorted((r.doc_id, r.text) for r in got.sections.collect()) == [("3", "three"), ("in_1", "one")]


def test_broken_files_are_skipped_if_asked(spark, tmp_path):
    good = "<MedlineCitationSet><MedlineCitation><PMID>1</PMID><Article><ArticleTitle>T</ArticleTitle></Article></MedlineCitation></MedlineCitationSet>"
    _write(tmp_path, a__pxml=good, b__pxml=good[:60], c__pxml="")
    load = lambda skip: Pipeline(spark, config.Settings(article_format="pxml", ignore_load_errors=skip)).load(str(tmp_path / "*.pxml")).sections.collect()
    assert [r.doc_id for r in load(True)] == ["1"]
    with pytest.raises(Exception, match="ParseError"):
        load(False)


def test_index_cache_is_read_again_and_follows_its_file(spark, tmp_path):
    _write(tmp_path, terms__tsv=LINE.format("Foo", "Foo"))
    s = config.Settings(index_cache=str(tmp_path / "cache"), dictionaries=[Dictionary(path=str(tmp_path / "terms.tsv"))])
    keys = lambda: sorted(r.key for r in Pipeline(spark, s).index(s.dictionaries[0], 3).where("recognizer = 3").collect())
    assert keys() == keys() == ["foo"] and len(list((tmp_path / "cache").iterdir())) == 1
    _write(tmp_path, terms__tsv=LINE.format("Foo", "Foo") + LINE.format("Bar", "Bar"))
    assert keys() == ["bar", "foo"]


def test_match_hook_and_records(spark, tmp_path):
    _write(tmp_path, hook__py="def postfilter(entities, keys):\n    return entities.where(\"text <> 'foo'\")\n", terms__tsv=LINE.format("Foo", "Foo"), a__txt="Foo foo")
    s = config.Settings(dictionaries=[Dictionary(path=str(tmp_path / "terms.tsv"), match_hook=str(tmp_path / "hook.py"))])
    p = Pipeline(spark, s)
    assert [r.text for r in p.process(p.load(str(tmp_path / "a.txt"))).entities.collect()] == ["Foo"]
    v = spark.createDataFrame([("d", 1, 2, "c", "TP"), ("d", 3, 4, "c", "FN")], "doc_id string, start int, end int, native_id string, verdict string")
    evaluation.write(v, evaluation.scores(evaluation.counts(v)), evaluation.macro(evaluation.counts(v, ["doc_id"])), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/records/verdict=FN")).first().value == "d\t3\t4\tc"
