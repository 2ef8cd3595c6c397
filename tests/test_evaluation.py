from pyspark.sql import functions as F

from glossaflow.operators import evaluation as E

S = "doc_id string, start int, end int, native_id string"


def test_scores(spark):
    gold = spark.createDataFrame([("a", 0, 3, "x"), ("a", 0, 3, "x"), ("a", 5, 9, "y"), ("b", 1, 2, None)], S)
    found = spark.createDataFrame([("a", 0, 3, "x"), ("a", 6, 9, "y"), ("c", 1, 2, "z"), ("b", 1, 2, None)], S)
    v = E.judged(gold, found, ["doc_id", "start", "end", "native_id"])
    assert {(r.doc_id, r.start, r.verdict) for r in v.collect()} == {("a", 0, "TP"), ("a", 5, "FN"), ("a", 6, "FP"), ("c", 1, "FP"), ("b", 1, "TP")}
    s = E.scores(E.counts(v)).first()
    assert (s.tp, s.fp, s.fn, s.p, s.r) == (2, 2, 1, 0.5, 0.666667)
    pp = E.partial_positives(v, ["doc_id", "native_id"])
    lenient = E.scores(E.counts(pp, measure="lenient")).first()
    assert (lenient.tp, lenient.fp, lenient.fn) == (3, 1, 0)
    average = E.counts(pp, measure="average").first()
    assert (average.tp, average.fp, average.fn) == (2.5, 1.5, 0.5)
    m = E.macro(E.counts(v, ["doc_id"])).first()
    assert (m.documents, m.p) == (3, 0.5) and E.macro(E.counts(v, ["doc_id"]), True).first().documents == 4


def test_pairs_shortest_first(spark):
    rows = [("a", 0, 9, "x", "FP"), ("a", 5, 9, "x", "FP"), ("a", 0, 4, "x", "FN"), ("a", 5, 9, "x", "FN")]
    got = E.partial_positives(spark.createDataFrame(rows, S + ", verdict string"), ["doc_id", "native_id"]).collect()
    assert sorted(r.verdict for r in got) == ["PP", "PP"]


def test_empty(spark):
    none = spark.createDataFrame([], S)
    v = E.judged(none, none, ["doc_id", "start", "end", "native_id"])
    s = E.scores(E.counts(v)).first()
    assert (s.p, s.r, s.f1) == (1.0, 1.0, 1.0) and E.macro(E.counts(v, ["doc_id"]), True).first().documents == 1


def test_selectors_and_spans(spark):
    lines = spark.createDataFrame([("a\tb\tc\td",), ("e\tf",)], "line string")
    got = sorted(((r.line, tuple(r.record)) for r in E.selected(lines, ["3,1-2", "2-"]).collect()), key=str)
    assert got == [("a\tb\tc\td", ("b", "c", "d")), ("a\tb\tc\td", ("c", "a", "b")), ("e\tf", ("f",)), ("e\tf", (None, "e", "f"))]
    two = spark.createDataFrame([("1,10", "3;12", "11", "13"), ("1", "3", "3", "5")], "a string, b string, c string, d string")
    assert [r.o for r in two.select(E.spans_overlap(*map(F.col, "abcd")).alias("o")).collect()] == [True, False]
