import pytest

from glossaflow.llm import residue as R

SCHEMA = "doc_id long, text string, source string"


def test_a_notice_that_is_the_document_stays_a_case(spark):
    """A third of a host are copies of one page; they are found, but the same line under a text is furniture."""
    furniture = "Please enable JavaScript"
    docs = [(k, f"Text {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]} is real.\n{furniture}", "host") for k in range(60)]
    docs += [(100 + k, "404 Not Found\nnginx", "host") for k in range(30)] + [(200 + k, furniture, "host") for k in range(3)]
    docs += [(300 + k, "404 Not Found", None) for k in range(40)]
    df = spark.createDataFrame(docs, SCHEMA)
    assert sorted(r.doc_id for r in R.residue(df).collect()) == [*range(100, 130), *range(200, 203), *range(300, 340)]
    assert R.without_residue(df).count() == 60


@pytest.mark.parametrize("times", [1, 10])
def test_size_of_the_host_makes_no_difference(spark, times):
    """5 of 100 documents and 50 of 1000 have the notice under a text of their own."""
    words = ["".join("abcdefghij"[int(c)] for c in f"{k:04}") for k in range(100 * times)]
    docs = [(k, f"Text {w}.\nPage not found" if k % 20 == 0 else f"Text {w}.", "host") for k, w in enumerate(words)]
    assert R.residue(spark.createDataFrame(docs, SCHEMA)).count() == 0


def test_repeated_rows_are_one_document(spark):
    docs = [(1, "Text one.\nPage not found", "host")] * 5 + [(2, "Text two.", "host")]
    assert [r.doc_id for r in R.residue(spark.createDataFrame(docs, SCHEMA)).collect()] == [1]
