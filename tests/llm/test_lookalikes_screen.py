import re

import pytest

from glossaflow.llm import lookalikes as L

SIGNS = [0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180E, 0x3164, 0xFFA0, 0x1C, 0x1F, 0x929 - 1, 0xF900, 0xFAD9, 0x2329, 0x232A, 0x37E, 0x387]


def test_screen_has_all_that_deviates():
    texts = [f"a{chr(c)}b" for c in range(0x30000) if not 0xD800 <= c < 0xE000] + ["\u0928\u093c", "\u0930\u093c", "\u0933\u093c", "\u1112\u1161\u11ab"]
    screen = re.compile(L.SCREEN)
    assert [t for t in texts if L._deviates(t) and not screen.search(t)] == []


def test_rows(spark):
    texts = [f"a{chr(c)}b" for c in SIGNS] + ["\u0928\u093c", "\u0930\u093c", "\u0933\u093c", "\u1112\u1161\u11ab"]
    want = {k for k, t in enumerate(texts) if L._deviates(t)}
    assert len(want) > 18
    df = spark.createDataFrame([("passages", k, t) for k, t in enumerate(texts)], "table_name string, row_key long, text string")
    assert {r.row_key for r in L.consistent(df).where("found").collect()} == want
