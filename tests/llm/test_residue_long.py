from glossaflow.llm import residue as R


def test_no_window(spark):
    """A field of any length is seen, wherever its literals lie; texts of any length are judged."""
    long = "{{ " + " ".join(f"name{k}" for k in range(400)) + " }}"
    docs = [(1, f"Text before. {long} Text behind.", "a"), (2, "x" * 50_000 + " {{ title }}", "a"), (3, "ok", "a"), (4, "x", "a"), (5, "Page" + " " * 500 + "not found", "a"), (6, "", "a"), (7, None, "a")]
    assert sorted(r.doc_id for r in R.residue(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()) == [1, 2]
    assert [p for _, p in R.pieces(long)] == [long]


def test_a_third_of_a_host_is_an_error_page(spark):
    docs = [(k, "404 Not Found" if k % 10 == 0 else f"Text number {'abcdefghij'[k % 7]}{'klmnopqrst'[k // 100]} of its own {k}.", "host") for k in range(1000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert R.residue(df).count() == 100 and R.without_residue(df).count() == 900
