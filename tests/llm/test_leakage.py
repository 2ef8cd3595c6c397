import random

import numpy as np

from glossaflow.llm import leakage as L


def test_index_equals_brute_force():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 6, 400)
    index = L.FMIndex(text, 6)
    phrases = np.array([[a, b] for a in range(1, 6) for b in range(1, 6)])
    low, high = index.search(phrases)
    for p, lo, hi in zip(phrases, low, high):
        want = {i for i in range(399) if tuple(text[i : i + 2]) == tuple(p)}
        assert set(index.locate(np.arange(lo, hi)).tolist()) == want
    for n in (1, 2, 3):
        assert L.suffix_array(np.array([1] * n)).tolist() == list(range(n))[::-1]


ITEM = "A 61-year-old piano tuner limped in with metallic fingertips and foamy jaw that had doubled over forty hours. Examination found scar below the ribs, tremor beside the navel and a swollen pulse above the clavicle, while urinary taurex read 59.2 against 88.2 at baseline."


def test_leaks(spark):
    words = ITEM.split()
    rng = random.Random(4)
    edited = [("changed" if k % 7 == 3 else w) for k, w in enumerate(words)]
    broken = ITEM.replace("metallic", "metal-\nlic").replace("scar", "ѕсаr").replace(" ", "  ").upper()
    noise = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = {100: "Intro. " + ITEM + " End.", 101: " ".join(edited), 102: broken, 103: "x " + " ".join(words[5:20]) + " y", 104: " ".join(words[5:19]) + " other words", 105: noise(400), 106: None, 107: "", 108: noise(30_000) + " " + " ".join(words[10:30]), 109: " ".join(w for k, w in enumerate(words) if k % 3)}
    df = spark.createDataFrame([(k, t, "x") for k, t in docs.items()] + [(100, docs[100], "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, ITEM, "t"), (1, ITEM, "t"), (2, "too short", "t"), (3, None, "t")], "item_id long, text string, task string")
    got = L.leaks(df, items).collect()
    assert sorted((r.item_id, r.doc_id) for r in got) == [(1, k) for k in (100, 101, 102, 103, 108)]
    assert {r.doc_id: r.words for r in got}[103] == 15
    assert sorted((r.item_id, r.doc_id) for r in L.leaks(df, items, block=1).collect()) == sorted((r.item_id, r.doc_id) for r in got)
    assert L.leaks(df.where("false"), items).count() == 0 and L.leaks(df, items.where("false")).count() == 0
    spans = L.removal_spans(spark.createDataFrame([(1, 9, 0, 20), (2, 9, 15, 30), (3, 9, 40, 60)], "item_id long, doc_id long, begin int, end int")).collect()
    assert sorted((r.begin, r.end, r["items"]) for r in spans) == [(0, 30, 2), (40, 60, 1)]
