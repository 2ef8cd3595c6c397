import __spark_entry__
from glossaflow.llm import termfreq
from tests.llm.test_termfreq import brute


def test_grams_of_any_length(spark):
    values = [("a", "p q r s t u v", 1), ("b", "q r s t u v", 2), ("b", "x 1-2", 1), (None, "r s t u v", 1), ("a", "w " * 60, 1), ("c", "", 1), ("c", None, 1)]
    df = spark.createDataFrame(values, "record string, value string, weight long")
    for parts in (1, 4):
        got = termfreq.gram_counts(df, partitions=parts).collect()
        assert {r.gram: (r.occurrences, r.records) for r in got} == brute(values, 60)
        assert len(got) == len({r.gram for r in got})


def test_query_has_no_cap(spark, tmp_path):
    rows = [(k, f"a{k}", "one two three four five six") for k in range(3)]
    spark.createDataFrame(rows, "anno_key long, article_id string, text string").write.parquet(str(tmp_path / "annotations.parquet"))
    got = {r.gram: (r["size"], r.occurrences, r.records) for r in __spark_entry__.queries()["p3_ngrams"](spark, str(tmp_path)).collect()}
    assert got["one two three four five six"] == (6, 3, 3) and len(got) == 21


def test_whole_values_lie_in_the_array(spark):
    """Whole values come from the same sorted suffixes as all grams, exactly as stored; very long ones are never cut."""
    long = "word " * 30_000
    values = [("a", " x  y ", 1), ("b", " x  y ", 2), ("a", "x y", 1), ("a", "y", 1), ("b", "", 1), ("c", " ", 1), (None, "\x01\x03", 4), ("a", long, 1), ("b", long + "end", 1), ("b", "y y y y", 3)]
    df = spark.createDataFrame(values, "record string, value string, weight long")
    assert termfreq.suffixes(df.where("value = ' x  y '"), whole=True).count() == 6
    for parts in (1, 5):
        got = termfreq.gram_counts(df, whole=True, partitions=parts).collect()
        assert {r.gram: (r.occurrences, r.records) for r in got} == brute(values, None) and len(got) == len(brute(values, None))
