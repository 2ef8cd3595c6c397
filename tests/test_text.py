from pyspark.sql import functions as F

from glossaflow.functions import segments, stemming
from glossaflow.functions import text as T
from glossaflow.operators import recognize


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def test_normalisers(spark):
    assert one(spark, "Organising RISE", lambda c: T.normalise(c, "lowercase ise")) == "organizing rize"
    assert one(spark, "λσςΑ", lambda c: T.normalise(c, ["greektranslit"])) == "lamdasigmasigmaΑ"
    assert one(spark, "2020", lambda c: T.normalise(c, "mask-0-digits")) == "0"
    assert one(spark, "x2", lambda c: T.normalise(c, "mask-0-digits")) == "x2"
    assert one(spark, "ﬁ", lambda c: T.normalise(c, "unicode-NFKC")) == "fi"
    assert one(spark, None, lambda c: T.normalise(c, "lowercase unicode")) is None
    assert one(spark, "a\tb\nc", T.one_line) == "a b c"
    assert one(spark, "Cell Line (x)", T.field_name) == "Cell_Line_x_"


def test_offsets(spark):
    t = "aé😀b"
    for i in range(5):
        assert one(spark, t, lambda c, i=i: T.byte_offset(c, F.lit(i))) == len(t[:i].encode())
        assert one(spark, t, lambda c, i=i: T.code_point_offset(c, F.lit(len(t[:i].encode())))) == i


def test_tokens_with_offsets(spark):
    rows = [(1, "IL-2 (β1), 3½x😀y"), (2, ""), (3, None), (4, "  ")]
    got = {r.k: r.tokens for r in recognize.token_spans(spark.createDataFrame(rows, "k int, text string")).collect()}
    assert [(t.token, t.start, t.end) for t in got[1]] == [("IL", 0, 2), ("2", 3, 4), ("β", 6, 7), ("1", 7, 8), ("3", 11, 12), ("½x", 12, 14), ("y", 15, 16)]
    assert got[2] == got[3] == got[4] == []


def test_sections_and_sentences(spark):
    text = "\n\nTitle one\n \n\nBody a. Body b? no\nlast line.\n\n"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "\n \n")], "k int, text string")
    parts = sorted((r.k, r.sec, r.text, r.start) for r in segments.explode_parts(df, segments.sections(F.col("text")), "sec").collect())
    assert [p[2] for p in parts if p[0] == 1] == ["\n\nTitle one\n \n\n", "Body a. Body b? no\nlast line.\n\n"]
    assert [p for p in parts if p[0] in (2, 3)] == []
    sents = [r.text for r in segments.explode_parts(df.where("k = 1"), segments.sentences(F.col("text")), "s").orderBy("s").collect()]
    assert "".join(sents) == text
    assert sents[1:] == ["Body b? no\nlast line.\n\n"]
    lines = [r.text for r in segments.explode_parts(df.where("k = 1"), segments.given_lines(F.col("text")), "s").orderBy("s").collect()]
    assert "".join(lines) == text and len(lines) == 8


def test_stems():
    assert [stemming.porter(w) for w in "caresses ponies hopping relational happy controlling".split()] == "caress poni hop relat happi control".split()
    assert [stemming.lancaster(w) for w in "maximum presumably multiply provision saying".split()] == "maxim presum multiply provid say".split()


def test_byte_places_in_one_pass(spark):
    from pyspark.sql import functions as F

    from glossaflow.functions import text as T

    texts = ["aé小😀b", "plain", "", None, "é" * 20_000]
    rows = [(t, None if t is None else list(range(0, len(t) + 1, max(1, len(t) // 7)))) for t in texts]
    got = spark.createDataFrame(rows, "t string, at array<int>").select("t", "at", T.byte_places(F.col("t"), F.col("at")).alias("b")).collect()
    assert all(r.b == (None if r.t is None else [len(r.t[:i].encode()) for i in r["at"]]) for r in got)
