import json

import pytest

from glossaflow.operators import shredding as S


def _nested(depth: int) -> str:
    return "[" * depth + '{"a": [1, 2.5, null, "x"]}' + "]" * depth


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, true, null, "x\\u00e9\\n"], "b": {}}', "[]", ' [ { } , [ ] ] ', '"s"', "-0", '{"k": "v", "k": 2}'])
def test_deep_parser_equals_the_standard_one(text):
    value = S.parse_deep(text)
    assert value == json.loads(text) and S.dump_deep(value) == json.dumps(value, ensure_ascii=False, sort_keys=True)


@pytest.mark.parametrize("text", ["", "{", '{"a" 1}', "[1 2]", "[1,]", "nul", '{"a":1}}', "{1: 2}"])
def test_deep_parser_refuses_what_is_no_json(text):
    with pytest.raises(ValueError):
        S.parse_deep(text)


def test_bodies_of_any_depth_and_encoding(spark):
    """A value nested 20,000 deep under an infon and a body encoded six times over both give all their rows."""
    body = json.dumps({"documents": [{"id": "1", "passages": [{"infons": {"type": "t"}, "annotations": [{"id": "a", "text": "x"}]}]}]})
    deep = body.replace('"type": "t"', f'"type": {_nested(20_000)}')
    often = body
    for _ in range(6):
        often = json.dumps(often)
    raw = spark.createDataFrame([(1, body), (2, deep), (3, often)], "rec_id long, body string")
    found = sorted((r.rec_id, r.parent_path, r.child_path) for r in S.links(S.adjacency(raw), ["annotation", "node"], "passage").collect())
    assert found == [(k, "d0/p0", x) for k in (1, 2, 3) for x in ("d0/p0/a0", "d0/p0/i:type")]
    values = {r.rec_id: r.infon_value for r in S.infon_table(S.adjacency(raw)).collect()}
    assert values[1] == values[3] == "t" and values[2] == _nested(20_000)
