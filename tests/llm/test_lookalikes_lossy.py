from glossaflow.llm import lookalikes as L


def test_words_apart_from_lost_signs_are_judged(spark):
    texts = {1: "kіnаѕе rose \ufffd here", 2: "kіnаѕе rose. The h?man cell", 3: "here kіnа\ufffdѕе rose", 4: "here \ufffdkіnаѕе rose", 5: "kіnаѕе and p\ufffdtein kіnd"}
    df = spark.createDataFrame([("passages", k, t) for k, t in texts.items()], "table_name string, row_key long, text string")
    forms = {r.row_key: r.form for r in L.consistent(df).where("found").collect()}
    assert forms == {1: "kinase rose \ufffd here", 2: "kinase rose. The h?man cell", 5: "kinase and p\ufffdtein kind"}
