import json

from glossaflow.operators import termlist
from glossaflow.streaming import annotate

SCHEMA = "term string, type string, preferred_form string, original_resource string, native_id string, umls_cui string"


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"doc_id": str(k), "text": f"gene {k} and Gene 1"}) + "\n")
    index = termlist.build_index(spark.createDataFrame([("gene 1", "G", "g", "db", "G1", "c")], SCHEMA))
    stream = annotate.recognise_stream(annotate.text_stream(spark, str(tmp_path / "in"), per_batch=1), index, ["doc_id"])
    seen = {}
    q = annotate.start(stream, lambda batch, n: seen.__setitem__(n, [(r.doc_id, r.start, r.text) for r in batch.collect()]), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(x for rows in seen.values() for x in rows) == [("0", 11, "Gene 1"), ("1", 0, "gene 1"), ("1", 11, "Gene 1"), ("2", 11, "Gene 1")]
