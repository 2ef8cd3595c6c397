import unicodedata

import pytest

import __spark_entry__
from glossaflow.llm import leakage as L
from tests.llm.test_leakage import ITEM


def test_each_place_of_an_item(spark, tmp_path):
    """Two whole copies far apart, and two parts of an item far apart, are two spans; each is exactly the characters that hold the item."""
    words, far = ITEM.split(), " ".join(f"foreign{k}" for k in range(500))
    held = {1: [ITEM, ITEM], 2: [" ".join(words[:16]), " ".join(words[20:40])], 3: [ITEM, ITEM], 5: [" ".join(words[10:26])]}
    docs = [(1, f"{far} {ITEM} {far} {ITEM} {far}"), (2, f"{held[2][0]} {far} {held[2][1]}"), (3, f"{ITEM} {ITEM}"), (4, far), (5, f"{far}: {held[5][0]}! {far}")]
    spark.createDataFrame([*docs, docs[0]], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "eval_items.parquet"))
    rows = {n: __spark_entry__.queries()[n](spark, str(tmp_path)).collect() for n in ("p7_found", "p7_leaks", "p7_spans", "p7_clean")}
    assert sorted((r.item_id, r.doc_id) for r in rows["p7_found"]) == [(7, 1), (7, 2), (7, 3), (7, 5)]
    texts = dict(docs)
    for doc, parts in held.items():
        got = sorted((r.begin, r.end) for r in rows["p7_leaks"] if r.doc_id == doc)
        assert [L.words_of(texts[doc][a:b]) for a, b in got] == [L.words_of(x) for x in parts]
    assert {r.words for r in rows["p7_leaks"] if r.doc_id == 5} == {16}
    assert len([r for r in rows["p7_spans"] if r.doc_id in (1, 2)]) == 4 and {r["items"] for r in rows["p7_spans"]} == {1}
    clean = {r.doc_id: r.text for r in rows["p7_clean"]}
    assert clean[4] == far and clean[5].startswith(f"{far}: ") and clean[5].endswith(far) and not set(words[12:24]) & set(clean[5].split())


def test_shards_and_blocks_change_nothing(spark):
    docs = spark.createDataFrame([(k, ITEM if k % 3 else "other " * k) for k in range(1, 40)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, ITEM), (2, " ".join(ITEM.split()[5:30])), (3, "none of these words " * 9)], "item_id long, text string")
    want = sorted(tuple(r) for r in L.leaks(docs, items).collect())
    assert len({x[:2] for x in want}) == 2 * 26
    assert want == sorted(tuple(r) for r in L.leaks(docs, items, block=1, shard=1).collect()) == sorted(tuple(r) for r in L.leaks(docs, items, block=1, shard=900).collect())


@pytest.mark.parametrize("text", ["metal-\nlic end", "x\u200by ﬁne e\u0301té, don’t", "“A”–b/c; 3.5 mg", "İstanbul ＡＢＣ １２", "कि क़लम", "각 ᄀ" + unicodedata.normalize("NFD", "한국"), "", " - ", "a_b __ c"])
def test_places_of_words(text):
    places = L.word_places(text)
    assert [L.words_of(text[a:b]) for a, b in places] == [[w] for w in L.words_of(text)]
