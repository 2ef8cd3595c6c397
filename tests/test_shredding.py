import json

from glossaflow.operators import shredding

DOC = {
    "id": 7,
    "passages": {
        "offset": 0,
        "infons": {"type": None, "a/b": [1]},
        "annotations": [None, {"id": "T1", "text": "x", "locations": {"offset": 1, "length": 2}}, "no object"],
        "sentences": [{"text": "é\ud800", "annotations": {"id": "T2"}}],
    },
    "relations": [{"id": "R1", "nodes": [{"refid": "T1"}, None, {"refid": "T2", "role": None}]}],
}
COLLECTION = {"source": "s", "documents": [None, DOC], "infons": {"k": "v"}}


def bodies():
    whole = json.dumps(COLLECTION)
    return [
        (1, whole), (1, whole), (2, "﻿" + json.dumps({"collection": COLLECTION})), (3, json.dumps(whole)), (4, json.dumps(DOC)), (5, whole[:-9]),
        (6, None), (7, ""), (8, "null"), (9, "[]"), (10, "[" * 100_000), (None, whole), (11, json.dumps({"documents": None})), (12, '"x"'),
    ]


def test_links_of_dirty_bodies(spark):
    raw = spark.createDataFrame([(*b, "x") for b in bodies()], "rec_id long, body string, node string")
    adjacent = shredding.adjacency(raw)
    got = sorted((r.rec_id, r.parent_path, r.child_path) for r in shredding.links(adjacent, ["annotation", "node"], "passage").collect())
    under = lambda d: [
        (f"{d}/p0", f"{d}/p0/a1"), (f"{d}/p0", f"{d}/p0/i:a/b"), (f"{d}/p0", f"{d}/p0/i:type"), (f"{d}/p0/s0", f"{d}/p0/s0/a0"), (f"{d}/r0", f"{d}/r0/n0"), (f"{d}/r0", f"{d}/r0/n2"),
    ]
    assert got == sorted([(k, *x) for k in (1, 2, 3) for x in under("d1")] + [(4, *x) for x in under("d0")])


def test_tables_keep_parents(spark):
    raw = spark.createDataFrame([(4, json.dumps(DOC))], "rec_id long, body string")
    tables = {k: [r.asDict() for r in t.collect()] for k, t in shredding.flat_tables(raw).items()}
    assert tables["document"] == [{"rec_id": 4, "path": "d0", "parent_path": "", "ordinal": 0, "id": "7"}]
    assert tables["location"] == [{"rec_id": 4, "path": "d0/p0/a1/l0", "parent_path": "d0/p0/a1", "ordinal": 0, "offset": "1", "length": "2"}]
    assert {(r["path"], r["refid"], r["role"]) for r in tables["node"]} == {("d0/r0/n0", "T1", None), ("d0/r0/n2", "T2", None)}
    assert {(r["infon_key"], r["infon_value"]) for r in tables["infon"]} == {("type", None), ("a/b", "[1]")}
    assert tables["sentence"][0]["text"] == "é�"


def test_empty_table(spark):
    raw = spark.createDataFrame([], "rec_id long, body string")
    assert shredding.adjacency(raw).count() == 0
