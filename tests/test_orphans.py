from datetime import datetime, timedelta

from glossaflow.operators import orphans

T = datetime(2022, 1, 1)
A = "anno_key long, article_id string, id string, received_at timestamp, deleted_at timestamp, kind string"
R = "rel_key long, article_id string, id string, nodes array<struct<node_role string, refid string>>, received_at timestamp, deleted_at timestamp, alive string"


def at(days):
    return T + timedelta(days=days)


def rel(key, refs, day, id_="R", article="a", deleted=None):
    return (key, article, id_, None if refs is None else [r if r is None else ("x", r[0]) for r in refs], at(day), deleted, "extra")


def found(spark, annos, rels):
    rows = orphans.orphan_references(spark.createDataFrame(annos, A), spark.createDataFrame(rels, R)).collect()
    return {(r.rel_key, r.node_no): (r.kind, r.reason) for r in rows}, len(rows)


def test_reasons_and_kinds(spark):
    annos = [
        (1, "a", " T1\t", at(0), None, "k"),
        (2, "a", "T2", at(0), at(5), "k"),
        (3, "a", "T3", at(50), None, "k"),
        (4, "b", "T4", at(0), None, "k"),
        (5, "a", "T5", at(0), at(5), "k"),
        (5, "a", "T5", at(8), None, "k"),
        (6, "a", "T6", at(9), at(1), "k"),
        (7, "a", "T7", at(10), None, "k"),
        (8, "a", "T8", at(0), at(10), "k"),
        (9, "a", None, at(0), None, "k"),
    ]
    refs = [["t1 "], ["T2"], ["T3"], ["T4"], ["T5"], ["T6"], ["T7"], ["T8"], [None], ["  \t"], None, ["R2"], ["R"]]
    rels = [rel(1, refs, 10), rel(1, refs, 10), rel(1, [["zzz"]], 60), rel(2, [["T5"]], 7, "R2"), rel(3, None, 10, None), rel(4, [["r9"]], 3), rel(5, [], 20, "R9")]
    got, n = found(spark, annos, rels)
    assert n == len(got)
    assert got == {
        (1, 1): ("annotation", "deleted"),
        (1, 2): ("annotation", "late"),
        (1, 3): ("unknown", "missing"),
        (1, 5): ("annotation", "deleted"),
        (1, 7): ("annotation", "deleted"),
        (2, 0): ("annotation", "deleted"),
        (4, 0): ("relation", "late"),
    }


def test_empty_tables(spark):
    assert found(spark, [], []) == ({}, 0)
    assert found(spark, [], [rel(1, [["x"]], 0)])[0] == {(1, 0): ("unknown", "missing")}


def test_hot_target_over_many_slices(spark):
    annos = [(k, "a", "T1", at(20 * k), at(20 * k + 10), "k") for k in range(30)]
    rels = [rel(k, [["T1"]], k, f"R{k}") for k in range(600)]
    got, _ = found(spark, annos, rels)
    assert set(got) == {(k, 0) for k in range(600) if k % 20 >= 10}
